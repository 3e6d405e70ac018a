"""Decontamination against a plain dynamic program over every text and item."""

import random
import re

from lamina.llm import decontaminate as de

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = "item_id long, text string"


def best(pattern, text):
    """Smallest edit distance of the pattern to a substring."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def plain(text):
    return " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())).encode()


def edited(r, s, k):
    s = list(s)
    for _ in range(k):
        i = r.randrange(len(s))
        s[i : i + 1] = r.choice([[], [s[i], "q"], ["z"]])
    return "".join(s)


def test_against_brute_force(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 7)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 30)))) for i in range(12)] + [(50, "too short"), (51, None), (52, "The Same, item! of some length here now"), (53, "the same item of some length here now")]
    rows = []
    for d in range(80):
        t = " ".join(word() for _ in range(r.randint(0, 60)))
        if d % 2:
            leak = r.choice(items[:12])[1]
            leak = edited(r, leak, r.choice([0, 1, 3, 6, 12, 25]))
            t = f"{t}\n{leak.upper() if d % 3 else leak}, {t[:40]}"
        rows.append((d, t))
    rows += [(100, None), (101, ""), (102, "x, THE same Item of some--length here now."), (103, "w " * 200_000)]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    bench = spark.createDataFrame(items, ITEMS)
    want = set()
    for d, t in rows[:-1]:
        for i, b in items:
            p = plain(b)
            if len(p) >= de.MIN_BYTES:
                x = best(p, plain(t))
                if x <= de.budget(len(p)):
                    want.add((d, i, x))
    got = {(x.doc_id, x.item_id, x.distance) for x in de.contaminations(docs, bench).collect()}
    assert got == want and (102, 52, 0) in got and (102, 53, 0) in got
    clean = sorted(x.doc_id for x in de.clean_documents(docs, bench).collect())
    assert clean == sorted({d for d, _ in rows} - {d for d, _, _ in want})


def test_blocks_and_edges(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"benchmark item number {i} with a few more words to it") for i in range(40)] + [(None, "an item without any id of its own at all")], ITEMS)
    docs = spark.createDataFrame([(None, "benchmark item number 7 with a few more words to it", None, None, None)] * 2, SCHEMA)
    whole = de.contaminations(docs, bench).count()
    monkeypatch.setattr(de, "BLOCK_BYTES", 500)
    assert len(de.benchmark_blocks(bench)) > 3
    assert de.contaminations(docs, bench).count() == whole > 0
    assert de.clean_documents(docs, bench).count() == 0
    assert de.clean_documents(docs, bench.limit(0)).count() == 2
    assert de.contaminations(spark.createDataFrame([], SCHEMA), bench).count() == 0


def test_items_without_an_id(spark):
    item, other = "the quick brown fox jumps over the lazy dog near the old river bank", "seven slow turtles walked along the dusty road to the market town"
    bench = spark.createDataFrame([(None, item), (None, other), (None, item), (3, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of the kind here"), (3, other)], "doc_id long, text string")
    found = sorted(((r.doc_id, r.item_id) for r in de.contaminations(docs, bench).collect()), key=str)
    assert found == [(1, 3), (1, None), (3, None)]
    assert [r.doc_id for r in de.clean_documents(docs, bench.filter("item_id is null")).collect()] == [2]


def test_short_items(spark):
    """Items below a piece's length are found as whole words, and only so."""
    items = [(1, "What is 2 plus 2? Four."), (2, "x"), (3, "ab cd"), (4, ""), (5, "é à"), (6, "..."), (7, "a" * 29), (8, "a" * 30)]
    texts = ["so: what is 2, plus 2 four", "x", "xx ab  CD", "ab cdx", "cab cd", None, "É À!", "a" * 29, "a" * 31, "b " + "a" * 29 + "b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = set()
    for d, t in enumerate(texts):
        for i, b in items:
            n, p = plain(b), plain(t)
            if n and (b" " + n + b" " in b" " + p + b" " if len(n) < de.MIN_BYTES else best(n, p) <= de.budget(len(n))):
                want.add((d, i))
    assert {(x.doc_id, x.item_id) for x in de.contaminations(docs, spark.createDataFrame(items, ITEMS)).collect()} == want
    assert {(0, 1), (1, 2), (2, 3), (6, 5)} <= want


def test_columns_of_any_name(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    docs = spark.createDataFrame([(1, item, 5, 6), (2, "w " * 100_000 + item, 5, 6), (3, "clean", 5, 6)], "doc_id long, text string, item_id int, budget int")
    bench = spark.createDataFrame([(1, item)], ITEMS)
    kept = de.clean_documents(docs, bench)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(3, "clean", 5, 6)]
    assert {(r.doc_id, r.distance, r.budget) for r in de.contaminations(docs, bench).collect()} == {(1, 0, 4), (2, 0, 4)}


def test_items_and_texts_are_lowered_alike(spark):
    items = [(1, "ΟΔΟΣ ΑΘΗΝΑΣ"), (2, "İZMİR LİMAN"), (3, "Ο ΔΡΟΜΟΣ ΠΡΟΣ ΤΗΝ ΠΟΛΗ ΕΙΝΑΙ ΜΑΚΡΥΣ ΚΑΙ ΣΚΟΤΕΙΝΟΣ")]
    docs = spark.createDataFrame([(i, f"before {t} after", None, None, None) for i, t in items] + [(4, "odos athinas", None, None, None)], SCHEMA)
    bench = spark.createDataFrame(items, ITEMS)
    assert sorted((x.doc_id, x.item_id, x.distance) for x in de.contaminations(docs, bench).collect()) == [(1, 1, 0), (2, 2, 0), (3, 3, 0)]
    assert [x.doc_id for x in de.clean_documents(docs, bench).collect()] == [4]
