"""Counts and verdicts against brute force; the binomial bound against its definition."""

import math
import re

import numpy as np
import pytest

from lamina.llm import quality
from tests.llm.test_repeats import thue_morse

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            hit |= set(range(i, i + 5))
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 10 or 100 * r > 20 * n)


TEXTS = [None, "", " \n\t", "one two three", "a b c d e f a b c d e x y", "é ñ ### %% <b>\nline one\nline one\n \nline one\r\nb", "w " * 50, "\n".join(f"row {i} of many words here {i * i}" for i in range(300)), "x" * 100_000, "a b c d e " * 2 + " ".join(map(str, range(60)))]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, "en", None, None) for i, t in enumerate(TEXTS)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality_verdicts(df, labels).collect()}
    assert got == {i: brute(t) for i, t in enumerate(TEXTS)}
    assert all(r.kept != r.base_failed for r in quality.quality_verdicts(df, labels).collect())  # no labels: no cutoffs


def test_cutoffs_hold_their_risk(spark):
    """1 % of good documents have many symbols: the cutoff that would reject them all does not stand."""
    good = [(i, " ".join(f"w{i}x{j}" for j in range(20)) + (" #1 $2 %3 &4 |5 <6" if i % 100 == 0 else ""), "en", None, None) for i in range(3000)]
    bad = [(10_000 + i, " ".join(f"v{i}x{j} #{j} ##{j}" for j in range(20)), "en", None, None) for i in range(50)]
    labels = [(i, 1, 0) for i in range(3000)] + [(10_000 + i, 0, 0) for i in range(50)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    out = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not any(kept[10_000 + i] for i in range(50))
    lost = [i for i in range(3000) if not kept[i]]
    assert len(lost) <= 0.005 * 3000  # one rule's share of the budget; it could have lost 30
    assert quality.kept_documents(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 3000 - len(lost)


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 40, 0.02), (5, 5, 0.3)])
def test_binomial(k, n, p):
    exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert quality.binomial_tail(k, n, p) == pytest.approx(exact)


def test_edges(spark):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (1, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(spark.createDataFrame([], SCHEMA), labels).count() == 0
    rows = [(None, None, None, None, None), (1, "a b", None, None, 1), (1, "a b", "", "s", 1)]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], SCHEMA + ", n_words int, stratum int")
    assert quality.quality_verdicts(df, labels).count() == 3
    kept = quality.kept_documents(df, labels)
    assert kept.columns == df.columns and kept.count() == 0


def test_small_strata_get_cutoffs(spark):
    """A few hundred good labels a stratum are enough to reject blatant junk; too few are not."""
    sizes = {"aa": 280, "bb": 310, "cc": 420, "dd": 30}
    assert quality.labels_needed(len(sizes)) == 217
    docs, labels, junk = [], [], {s: [] for s in sizes}
    for s, n in sizes.items():
        for i in range(n):
            labels.append((len(docs), 1, 0))
            docs.append((len(docs), " ".join(f"{s}{i}x{j}" for j in range(20)), s, None, None))
        for i in range(20):
            labels += [(len(docs), 0, 0)] if i % 2 else []
            junk[s].append(len(docs))
            docs.append((len(docs), " ".join(f"{s}v{i}x{j} ##{j}" for j in range(20)), s, None, None))
    df, marks = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    gone = {r.doc_id for r in quality.judged(df, marks).filter("not kept").collect()}
    assert gone == {i for s in ("aa", "bb", "cc") for i in junk[s]}
    assert quality.kept_documents(df, marks).count() == len(docs) - len(gone)


def test_joint_sequence_holds_the_whole_budget():
    """All rules together reject no more than can be shown, and a rule that rejects good documents does not stop those before it."""
    grids = [[0.3, 0.1], [0.6, 0.2]]
    levels, bad = np.array([[2, 2], [0, 2], [2, 1]]), np.array([0, 9, 1])
    assert quality.chosen_cutoffs(levels, np.array([300, 0, 0]), bad, grids, 4) == [0.1, 0.2]
    assert quality.chosen_cutoffs(levels, np.array([299, 0, 1]), bad, grids, 4) == [0.1, 0.6]
    assert quality.chosen_cutoffs(levels, np.array([299, 1, 0]), bad, grids, 4) == [None, None]
    assert quality.chosen_cutoffs(levels, np.array([216, 0, 0]), bad, grids, 4) == [None, None]


def test_words_that_a_polynomial_confuses():
    a, b = thue_morse()
    text = f"w1 w2 {a} w3 w4 and w1 w2 {b} w3 w4"
    assert [int(x[0]) for x in quality._counts([text.encode()])][5] == brute(text)[4] == 0


@pytest.mark.parametrize("good,want", [({1000: 4}, 4), ({217: 4}, 4), ({216: 4}, 3), ({218: 1, 40: 3}, 1), ({149: 1}, 1), ({148: 1}, 0), ({}, 0), ({1200: 10**9}, 10**9)])
def test_tested_strata(good, want):
    assert quality.tested_strata(good) == want


def test_a_verdict_says_why(spark):
    """One stratum can be tested, the others say that they cannot."""
    docs = [(i, " ".join(f"w{i}x{j}" for j in range(20)), "en" if i < 160 else "fr") for i in range(200)]
    out = quality.quality_verdicts(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")).collect()
    assert {(r.doc_id < 160, r.undecided) for r in out} == {(True, False), (False, True)} and all(r.kept for r in out)
