"""Periodic runs against a brute-force search, and the query against the contract's words."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lamina.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words, least=24, exponent=3):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, size, q) for (s, size), q in found.items())


def brute_report(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    found = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *found, digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    n, kinds = rng.randint(0, 150), rng.choice([1, 2, 3, 50])
    words = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 3 else 0):
        a, p = rng.randrange(n), rng.randint(1, n // 4 + 1)
        for i in range(a + p, min(n, a + rng.randint(1, n))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize(("least", "exponent"), [(24, 3), (6, 3), (12, 4), (3, 3)])
def test_runs_equal_brute_force(least, exponent):
    rng = random.Random(least)
    texts = [random_words(rng) for _ in range(500)] + [[], [1] * 24, [1] * 23, [0, 1, 2] * 9]
    a, b = [0], [0, 1]
    while len(b) < 300:  # Fibonacci words are full of near periods
        a, b = b, b + a
    texts.append(b)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = periodic.runs_of(np.array([w for t in texts for w in t], np.int64), first, least, exponent)
    assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t, least, exponent)]


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError):
        periodic.runs_of(np.zeros(30, np.int64), np.array([0, 30]), 24, 2)


def test_report_on_odd_rows(spark):
    rng = random.Random(5)
    words = ["a", "b", "ß", "語"]
    texts = [None, "", " \t\n", "x " * 40, "one two three " * 20, "x y " * 30, " ".join(rng.choice(words) for _ in range(400)), "x " * 40]
    rows = [(i, t, "runs") for i, t in enumerate(texts)] + [(None, "a b " * 30, "n"), (7, "x " * 40, "copy")]
    rows += [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), "r") for i in range(100, 300)]  # a tenth is changed
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = periodic.run_report(periodic.with_planted_runs(docs))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute_report(i, t)) for i, t, _ in rows)
    assert periodic.run_report(periodic.with_planted_runs(docs.limit(0))).count() == 0


def test_collapsed_text_and_runs(spark):
    docs = spark.createDataFrame([(1, "start\t" + "red green blue\n" * 10 + "end")], "doc_id long, text string")
    (row,) = periodic.periodic_runs(docs).collect()
    assert row.n_words == 32 and [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed == "start red green blue end"


def test_a_very_long_text(spark):
    text = "lead " + "a b c " * 100_000 + "tail"
    (row,) = periodic.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in row.runs] == [(1, 300_000, 3)] and row.collapsed == "lead a b c tail"


def test_query_equals_brute_force(spark):
    want = sorted(repr(brute_report(r.doc_id, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    assert sorted(repr(tuple(r)) for r in queries.op11_periodic_runs(spark, SF).collect()) == want
