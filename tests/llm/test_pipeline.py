"""The five stages against a brute-force chain, and the rows that break things."""

import random
import struct
import zlib

import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lamina.llm import decontaminate
from tests.llm.test_decontaminate import best, plain
from tests.llm.test_jaccard import brute as components
from tests.llm.test_mixing import shared
from tests.llm.test_quality import brute as counts

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, tag="w"):
    return [f"{tag}{r.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Good and junk documents with labels, copies and near copies, benchmark passages, hot and null sources, repeated rows."""
    r = random.Random(4)
    item = " ".join(words(r, 14, "b"))
    rows, labels = [], []
    for i in range(320):  # good ones, labelled
        labels.append((i, 1, 0))
        rows.append((i, " ".join(words(r, r.randint(12, 40))), "en", "hot" if i % 3 else r.choice(["a", "b", None]), 1))
    for i in range(320, 350):  # junk, partly labelled
        labels += [(i, 0, 0)] if i % 2 else []
        rows.append((i, " ".join(f"{w} ##{w}" for w in words(r, 20)), "en", "a", 1))
    for i in range(350, 390):  # copies and near copies
        t = rows[r.randrange(40)][1].split()
        if i % 2:
            t = t + ["edit"] if len(t) > 30 else t
        rows.append((i, " ".join(t), "en", "b", 1))
    for i in range(390, 400):  # benchmark passages, exact and edited
        w = item.split()
        w[3] += "xy" if i % 2 else ""
        rows.append((i, " ".join(words(r, 10) + w + words(r, 10)), "en", "a", 1))
    rows += [(400, None, "en", "a", 1), (401, "", None, None, None), (402, "few words", "en", "a", 1), (403, " ".join(words(r, 3_000)), "en", "long", 1)]
    rows += [(None, "no id " + " ".join(words(r, 12)), "en", "a", 1), (404, "twin " + " ".join(words(r, 12)), "en", "a", 1), (404, None, "en", "a", 1)]
    extra = "row_key int, row_order int, doc int, stratum int, _h int, _id int, copies int, rows int, part int, hash int, node int"
    docs = spark.createDataFrame([(*x, *range(11)) for x in rows], f"{NAMES}, {extra}").repartition(5)
    bench = [(1, item), (None, "a passage without an id of its own"), (2, None), (3, "x")]
    out = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, bench


def test_stages_against_brute_force(spark, tables):
    out, rows, bench = tables
    docs, seen = spark.read.parquet(f"{out}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, out)
        seen.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
            docs = spark.createDataFrame(seen[-1], docs.schema)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    plain_rows = lambda found: sorted(((x.doc_id, x.text, x.source) for x in found), key=key)
    # extra columns keep their values through all stages
    assert all(tuple(x)[5:] == tuple(range(11)) for found in seen[:4] for x in found)

    # 1: base rules, and junk (more symbols than any good document) by the learnt cutoffs
    kept = [x for x in rows if not counts(x[1])[5] and counts(x[1])[2] <= 0.05 * max(1, counts(x[1])[1])]
    assert plain_rows(seen[0]) == sorted([x[:2] + (x[3],) for x in kept], key=key)
    assert not {x[0] for x in kept} & set(range(320, 350)) and len(kept) > 300

    # 2: the smallest id of each component; a missing id counts as the largest
    whole = [(10**9 if d is None else d, t, s) for d, t, _, s, _ in kept]
    firsts = {d for d, n, c in components([x[:2] for x in whole]) if d == c or n == 0}
    kept = [(None if d == 10**9 else d, t, s) for d, t, s in whole if d in firsts]
    assert plain_rows(seen[1]) == sorted(kept, key=key) and len(kept) < len(whole)

    # 3: no item within its budget; short ones as whole words
    def holds(t):
        p = plain(t)
        for _, b in bench:
            n = plain(b)
            if n and ((b" " + n + b" " in b" " + p + b" ") if len(n) < decontaminate.MIN_BYTES else len(p) < 5000 and best(n, p) <= decontaminate.budget(len(n))):
                return True
        return False

    kept = [x for x in kept if not holds(x[1])]
    assert plain_rows(seen[2]) == sorted(kept, key=key) and not {x[0] for x in kept} & set(range(390, 400))

    # 4: whole copies, at most three, that come near each source's target
    size = lambda t: len((t or "").split())
    sizes = {}
    for s in sorted({x[2] for x in kept}, key=lambda s: (s is None, s or "")):
        sizes[s] = sum(size(x[1]) for x in kept if x[2] == s)
    taken = {}
    for x in plain_rows(seen[3]):
        taken[x] = taken.get(x, 0) + 1
    assert set(taken) <= set(kept) and max(taken.values()) <= 3
    for s, want in shared(sizes).items():
        most = max(size(x[1]) for x in kept if x[2] == s)
        assert abs(sum(n * size(x[1]) for x, n in taken.items() if x[2] == s) - want) <= most

    # 5: the tokenizer's ids of every copy, one after the other
    tk, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for d, t, _ in plain_rows(seen[3]):
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        at += len(ids)
    assert sorted((tuple(x) for x in seen[4]), key=lambda x: x[1]) == want

    # the whole run gives the same again
    assert sorted((tuple(x) for x in corpus_pipeline.run(spark, out).collect()), key=lambda x: x[1]) == want


def test_empty_table(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables[0])
        assert out.count() == 0
