"""The Jaccard join against brute force, with small lists and blocks so that every path runs."""

import random
import re

import numpy as np
import pytest

from lamina.llm import jaccard
from tests.llm.test_repeats import thue_morse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = list(range(len(sets)))
    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    first = {}
    for (d, _), x in zip(sets, label):
        first[x] = min(first.get(x, d), d)
    return sorted((d, len(s), first[x]) for (d, s), x in zip(sets, label))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [r.choice(vocab) for _ in range(120)]
    common = [r.choice(vocab) for _ in range(30)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.45:  # one large group of near copies, many at the edge of linking
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"e{r.randrange(1000)}"
        elif kind < 0.6 and rows:
            w = (r.choice(rows)[1] or "").split(" ")
            if r.random() < 0.5:
                w[r.randrange(len(w))] = "EDIT"
        elif kind < 0.8:
            w = [r.choice(vocab) for _ in range(r.randint(0, 60))] + common
        else:
            w = r.choice([[], ["one"], ["One"], ["a", "b"], ["x"] * 50, ["a", "b", "c", "d"], [r.choice(vocab) for _ in range(400)]])
        rows.append((i * 7 % 1009, " ".join(w) if r.random() > 0.02 else None))
    return rows


@pytest.mark.parametrize("seed,long_list,block", [(1, 4, 8), (2, 48, 1024), (3, 4, 1024), (4, 10, 20)])
def test_components(spark, monkeypatch, seed, long_list, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)
    if long_list != jaccard.LONG_LIST:  # workers read the module's own value; fold more pairs here instead
        sets = [np.unique(np.array([hash(x) & (2**63 - 1) for x in shingles(t)], np.uint64)) for _, t in rows]
        sets = [s for s in sets if len(s)]
        found = jaccard.divide_skip(sets, range(len(sets)), 85)
        label = list(range(len(sets)))
        for a, b in found:
            old, new = label[b], label[a]
            label = [new if x == old else x for x in label]
        for i in range(len(sets)):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    assert label[i] == label[j]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, shards=5).collect())
    assert got == brute(rows)
    kept = sorted(r.doc_id for r in jaccard.one_of_each(df).collect())
    assert kept == sorted(d for d, n, c in brute(rows) if d == c)


def test_sketch_bounds_difference():
    r = random.Random(5)
    for _ in range(50):
        a = {r.getrandbits(63) for _ in range(r.randint(1, 900))}
        b = set(r.sample(sorted(a), r.randint(0, len(a)))) | {r.getrandbits(63) for _ in range(r.randint(1, 300))}
        x, y = (np.frombuffer(jaccard.parity(np.array(sorted(s), np.uint64)), np.uint8)[None, :] for s in (a, b))
        w = min(x.shape[1], y.shape[1])
        assert np.bitwise_count(jaccard.narrowed(x, w) ^ jaccard.narrowed(y, w)).sum() <= len(a ^ b)


def test_edges(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(None, t, 1), (9, t, 2), (9, t, 3), (9, "lone text of its own", 4), (None, None, 5), (None, "other words are here now", 6), (3, "", 7), (4, "x" * 3_000_000, 8)]
    df = spark.createDataFrame([(d, x, None, None, None, k) for d, x, k in rows], SCHEMA + ", node int")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect())
    assert [g for g in got if g[1] == 47] == [(-1, 47, 9), (9, 47, 9), (9, 47, 9)]
    assert (-1, 2, None) in got and (-1, 0, None) in got and (3, 0, 3) in got and (9, 2, 9) in got and (4, 1, 4) in got
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r.node for r in kept.collect()) in ([2, 4, 5, 6, 7, 8], [3, 4, 5, 6, 7, 8])


def test_words_that_a_polynomial_confuses(spark):
    rows = [(i, " ".join([x, "b", "c", "d"])) for i, x in enumerate(thue_morse())]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == [(0, 1, 0), (1, 1, 1)]


def test_long_lists(spark):
    """A common passage in many documents that are near copies of a few, and of none."""
    r = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    bases = [[f"b{k}x{i}" for i in range(8)] for k in range(5)]
    rows = []
    for i in range(400):
        w = common + bases[i % 5] if i % 2 else common + [f"u{i}x{j}" for j in range(r.randint(2, 9))]
        if i % 7 == 0:
            w[r.randrange(len(w))] = f"e{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for percent_of in (jaccard.near_duplicates(df, shards=3),):
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in percent_of.collect()) == brute(rows)


def test_slots_grow():
    assert [jaccard.slot_count(n) for n in (1, 32, 33, 64, 65, 200, 10**6)] == [1 << 18, 1 << 18, 1 << 19, 1 << 19, 1 << 20, 1 << 21, 1 << 22]
