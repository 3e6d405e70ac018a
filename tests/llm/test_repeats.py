"""The two substring operators against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lamina.llm import fm_index, suffix_family

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed, n=60):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(40)]
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts = []
    for i in range(n):
        kind = r.random()
        t = " ".join(r.choice(vocab) for _ in range(r.randint(0, 200)))
        if kind < 0.3 and texts:
            t = r.choice(texts) or ""
            w = t.split(" ")
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind < 0.5:
            t = t[: len(t) // 2] + "\n" + passage + "\t " + t
        elif kind < 0.6:
            t = r.choice(["", "ab " * 100, "x" * 300, None, "\0" * 60, "ends here"])
        texts.append(t)
    ids = list(range(0, 2 * n, 2))
    r.shuffle(ids)
    return list(zip(ids, texts))


def brute(rows, window, unit):
    seen, out = {}, {}
    units = {}
    for d, t in rows:
        b = (t or "").encode()
        units[d] = [b[i : i + 1] for i in range(len(b))] if unit == "byte" else b.split()
    for d in sorted(units):
        u = units[d]
        for i in range(len(u) - window + 1):
            seen.setdefault(tuple(u[i : i + window]), d)
    for d, u in units.items():
        gone = [False] * len(u)
        for i in range(len(u) - window + 1):
            if seen[tuple(u[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = (b"" if unit == "byte" else b" ").join(x for x, g in zip(u, gone) if not g)
        out[d] = (len(u), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bytes_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).repartition(3)
    for batch in (64, 1 << 15):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_family.remove_repeats(df, batch=batch, shards=5).collect()}
        assert got == brute(rows, 50, "byte")


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_words_match_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in fm_index.remove_repeats(df, shards=5).collect()}
    assert got == brute(rows, 13, "word")


@pytest.mark.parametrize("seed", [7, 8])
def test_small_indexes(spark, seed):
    """Many indexes a shard, so that what is found goes through the search in them."""
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, "s", None) for d, t in rows], SCHEMA).repartition(3)
    for batch in (1, 200):
        got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in fm_index.remove_repeats(df, batch=batch, shards=2).collect()}
        assert got == brute(rows, 13, "word")


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_matching_statistics(window):
    """Streams that the index does not hold, against a plain search."""
    r = random.Random(window)
    texts = [[r.randint(1, 4) for _ in range(r.randint(1, 30))] for _ in range(12)]
    text = np.array([x for t in texts for x in [*t, 0]], np.int64)
    order = np.array([i for i, t in enumerate(texts) for _ in range(len(t) + 1)], np.int64)
    index = fm_index.FMIndex(text, order, window, 6)
    other = [[r.randint(1, 5) for _ in range(r.randint(1, 40))] for _ in range(9)]
    flat = np.array([x for t in other for x in t], np.int64)
    size = np.array([len(t) for t in other])
    end = np.cumsum(size)
    inside = lambda p, t: any(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1))
    seen = 0
    for at, position, matched, low, high in index.matching_statistics(flat, end, size):
        for i, p, m, a, b in zip(at.tolist(), position.tolist(), matched.tolist(), low.tolist(), high.tolist()):
            rest = flat[p : end[i]].tolist()
            want = max(k for k in range(min(window, len(rest)) + 1) if k == 0 or any(inside(rest[:k], t) for t in texts))
            assert m == want and b > a
            if m == window:
                assert index.smallest(np.array([a]))[0] == min(j for j, t in enumerate(texts) if inside(rest[:m], t))
            seen += 1
    assert seen == len(flat)


def test_bit_vectors():
    for bits in ([1] * 200 + [0] * 300 + [1, 0] * 50, [0] * 64, [1], [1] * 64):
        v = fm_index.BitVector(np.array(bits, bool))
        assert v.rank(np.arange(len(bits))).tolist() == [sum(bits[:i]) for i in range(len(bits))]
        ones = [i for i, b in enumerate(bits) if b]
        assert v.select(np.arange(len(ones) + 2)).tolist() == [*ones, len(bits), len(bits)]


def test_words_that_a_polynomial_confuses(spark):
    tm = thue_morse()
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join([*words[:6], x, *words[6:]])) for i, x in enumerate(tm)]
    got = {r.doc_id: r.n_removed for r in fm_index.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0}


def thue_morse():
    """Two words of 1,024 letters that have one hash by any polynomial modulo 2**64."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_extra_columns_of_any_name(spark):
    names = ("row_key", "row_order", "places", "ranges", "doc", "n_removed")
    rows = [(i, "same words " * 20, *[7] * len(names)) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    for op in (suffix_family.remove_repeats, fm_index.remove_repeats):
        got = {r.doc_id: r.n_removed for r in op(df).collect()}
        assert got[0] == 0 and got[1] == got[2] > 0


def test_windows_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for op, window in ((suffix_family.remove_repeats, 15), (suffix_family.remove_repeats, 271), (fm_index.remove_repeats, 3), (fm_index.remove_repeats, 259)):
        with pytest.raises(ValueError):
            op(df, window=window)


@pytest.mark.parametrize("op", [suffix_family.remove_repeats, fm_index.remove_repeats])
def test_edge_rows(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).count() == 0
    t = "word " * 60
    rows = [(7, t, None, None, None), (7, t, None, None, None), (None, t, None, None, None), (None, None, None, None, None), (1, "é" * 2_000_000 + " z" * 5, None, None, 1)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in op(spark.createDataFrame(rows, SCHEMA)).collect())
    full = len(t) if op is suffix_family.remove_repeats else 60
    # equal ids leave each other alone; a null id comes last
    assert got == [(-1, 0), (-1, full), (1, 0), (7, 0), (7, 0)]
