"""Quality rules with risk-controlled thresholds.

A rule compares one feature of a document with a cutoff. Cutoffs are chosen for each stratum on
labelled holdouts: from the most lenient on, a step stands while an exact binomial test shows, at
the stratum's share of the error level, that good documents are rejected at most at the allowed
rate. The sequence stops at the first step that cannot be shown, so one test level covers it all
(fixed-sequence testing); Bonferroni's correction covers the strata that are tested. Those are the
strata with the most good labels, as many as can each show something at their share of the level;
numbers of labels alone decide it. There are two sequences:

* a stratum with good labels enough to outlive a false rejection by each rule tests each rule by
  itself, at its share of the budget and of the level;
* a smaller one tests all rules together, at the whole budget and level: every rule's most lenient
  cutoff, then one rule's grid after the other. Rules that catch more of the bad labels come first;
  bad documents are a sample of their own, so the order does not depend on what is tested.

Only the number of good labels picks the sequence. With probability 1 - DELTA all strata keep at
least 1 - BUDGET of their good documents, besides those that fail the base rules. A stratum of
fewer good labels than ``labels_needed`` can show nothing, gets no cutoff and keeps its documents;
its rows say so by ``undecided``.

Results: one row per document, repeated rows each for itself; ties at a cutoff stay, as only what
is above goes. A null text has no words and fails the base rules; null strata are a stratum of
their own; an empty table gives an empty one; a text of any length is counted whole, which takes
some 40 bytes a word in its task. Extra columns, of whatever names, are kept by
``kept_documents`` and left out of the verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.llm import seqs
from lamina.llm.common import written

#: Share of good documents that may go, probability that this fails, bytes handled at once.
BUDGET, DELTA, PIECE = 0.02, 0.05, 1 << 20
MIN_WORDS, REPEAT_PERCENT, SHINGLE = 10, 20, 5
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
#: Each rule's feature and its cutoffs from lenient to strict; a document above a cutoff is rejected.
GRIDS: dict[str, list[float]] = {
    "symbol_share": [0.30, 0.20, 0.15, 0.10, 0.07, 0.05, 0.03, 0.02],
    "dup_line_share": [0.60, 0.50, 0.40, 0.30, 0.20, 0.10],
    "repeat_share": [0.18, 0.15, 0.12, 0.10, 0.07, 0.05],
    "mean_word_chars": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _counts(texts: list[bytes]) -> list[np.ndarray]:
    """The counts of COUNTS for each text."""
    n = len(texts)
    raw = b"".join(texts)
    buf = np.frombuffer(raw, np.uint8)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))

    def by_text(marks: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(marks, dtype=np.int64)))[edges])

    blank = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    chars = by_text(((buf & 0xC0) != 0x80) & ~blank)
    symbols = by_text(_SYMBOL[buf])
    lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        own = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines[i], dups[i] = len(own), len(own) - len(set(own))
    joined, start, end, first = seqs.split_words(texts)
    words = np.diff(first)
    repeats = np.zeros(n, np.int64)
    grams = seqs.shingles(seqs.span_hashes(joined, start, end), SHINGLE) if len(start) else np.zeros(0, np.uint64)
    if len(grams):
        text = np.repeat(np.arange(n), words)[: len(grams)]
        inside = np.arange(len(grams)) + SHINGLE <= first[text + 1]
        at, text = np.flatnonzero(inside), text[inside]
        own = seqs.mix(grams[at] ^ seqs.mix(text.astype(np.uint64)))
        by = np.argsort(own)
        same = own[by][1:] == own[by][:-1]
        twice = np.zeros(len(at), bool)
        twice[by[1:][same]] = True
        twice[by[:-1][same]] = True
        cover = np.zeros(len(start) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + SHINGLE, -1)
        marked = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        repeats = np.diff(marked[first])
    return [words, chars, symbols, lines, dups, repeats]


def counted(rows: DataFrame, keep: str, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The kept column with the counts of COUNTS and the stratum of each row.

    rows: the kept column first, ``stratum`` next, and what else text_of needs.
    """
    names = [keep, "stratum", *COUNTS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = seqs.utf8_column(text_of(batch))
            lots = [_counts([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)]) for i, j in seqs.slices(offsets, PIECE)]
            found = [pa.array(np.concatenate(x)) for x in zip(*lots, strict=True)] if lots else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], names)

    counts = [T.StructField("stratum", T.StringType()), *(T.StructField(c, T.LongType()) for c in COUNTS)]
    return rows.mapInArrow(measure, T.StructType([rows.schema[keep], *counts]))


def _stratum(of: str) -> Column:
    return F.coalesce(F.col(of).cast("string"), F.lit("")).alias("stratum")


def _share(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rule_features() -> dict[str, Column]:
    """Each rule's feature, from the counts."""
    return {
        "symbol_share": _share("n_symbols", "word_chars"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "mean_word_chars": _share("word_chars", "n_words"),
    }


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts, base_failed and the rules' features of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _stratum(stratum), F.col("text").cast("string").alias("text"))
    rows = counted(slim, "doc_id", lambda batch: batch.column(2))
    return rows.select("doc_id", "stratum", *COUNTS, base_failed().alias("base_failed"), *(f.alias(r) for r, f in rule_features().items()))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), exactly."""
    if k >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def shown(rejected: int, good: int, risk: float, level: float) -> bool:
    """Whether rejected of good holdouts show, at the level, that the rate of false rejection is at most risk."""
    if good <= 0 or rejected > risk * good:
        return False
    return binomial_tail(int(rejected), int(good), risk) <= level


def labels_needed(strata: int, budget: float = BUDGET, delta: float = DELTA) -> int:
    """Good labels that a stratum needs to get any cutoff, if none of them is rejected."""
    return math.ceil(math.log(delta / strata) / math.log1p(-budget))


def tested_strata(good: dict[int, int], budget: float = BUDGET, delta: float = DELTA) -> int:
    """How many strata are tested: as many as have labels enough at their share of the level. good: strata by their number of good labels."""
    strata, k = 0, 0
    for labels in sorted(good, reverse=True):
        strata += good[labels]
        # the largest number of strata at which these labels are enough
        k = max(k, min(strata, int(delta * math.exp(-labels * math.log1p(-budget)) * (1 + 1e-12))))
    return k


def steps(n_cutoffs: list[int], caught: list[int]) -> list[tuple[int, int]]:
    """(rule, cutoff) of the joint sequence, by numbers; caught: bad documents above each rule's last cutoff."""
    order = sorted(range(len(n_cutoffs)), key=lambda r: -caught[r])
    return [(r, 0) for r in order] + [(r, i) for r in order for i in range(1, n_cutoffs[r])]


def chosen_cutoffs(levels: np.ndarray, good: np.ndarray, bad: np.ndarray, grids: list[list[float]], strata: int, budget: float = BUDGET, delta: float = DELTA) -> list[float | None]:
    """A stratum's cutoff for each rule (None: off).

    levels: cells by rules, the number of the first cutoff below the feature; good, bad: documents of each cell.
    """
    n, rules = int(good.sum()), len(grids)
    risk, level = budget / rules, delta / (rules * strata)
    cutoffs: list[float | None] = [None] * rules
    if n and binomial_tail(1, n, risk) <= level:
        for r, grid in enumerate(grids):
            for i, c in enumerate(grid):
                if not shown(good[levels[:, r] <= i].sum(), n, risk, level):
                    break
                cutoffs[r] = c
        return cutoffs
    rejected = np.zeros(len(levels), bool)
    for r, i in steps([len(g) for g in grids], [int(bad[levels[:, r] < len(g)].sum()) for r, g in enumerate(grids)]):
        rejected |= levels[:, r] <= i
        if not shown(good[rejected].sum(), n, budget, delta / strata):
            break
        cutoffs[r] = grids[r][i]
    return cutoffs


def thresholds(features: DataFrame, labels: DataFrame, grids: dict[str, list[float]] | None = None, budget: float = BUDGET, delta: float = DELTA) -> DataFrame:
    """stratum and a cutoff for each rule (null: the rule is off there).

    labels: doc_id and quality (1 is good, 0 is bad). Only documents that pass the base rules count.
    Counting is one aggregation to cells of equal levels, whose number the grids bound; each
    stratum's cells are tested in a task.
    """
    grids = grids or GRIDS
    judged = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"))
    held = features.join(judged, "doc_id").filter(~F.col("base_failed"))
    level = {r: sum(((F.col(r) <= c).cast("int") for c in grid), F.lit(0)).alias(f"_{r}") for r, grid in grids.items()}
    cells = held.groupBy("stratum", *level.values()).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # numbers of labels beyond what any number of strata needs are one, so their table is small
    most = labels_needed(10**12, budget, delta)
    per = held.filter("good").groupBy("stratum").count().groupBy(F.least("count", F.lit(most)).alias("labels")).count()
    strata = max(1, tested_strata({r["labels"]: r["count"] for r in per.collect()}, budget, delta))
    names = [f"{r}_cutoff" for r in grids]

    def choose(pdf):
        found = chosen_cutoffs(pdf[[f"_{r}" for r in grids]].to_numpy(), pdf["good"].to_numpy(), pdf["bad"].to_numpy(), list(grids.values()), strata, budget, delta)
        return pd.DataFrame([[pdf["stratum"].iloc[0], *found]], columns=["stratum", *names])

    schema = ", ".join(["stratum string", *(f"{n} double" for n in names)])
    return cells.groupBy("stratum").applyInPandas(choose, schema).select("stratum", *(F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names))


def judged(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Every document's counts, base_failed, kept and failed_rules (of the method)."""
    features = written(measured(docs, stratum), "features")
    cutoffs = written(thresholds(features, labels), "cutoffs").withColumnRenamed("stratum", "_stratum")
    rows = features.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left").drop("_stratum")
    failed: list[Column] = [F.when(F.col(r) > F.col(f"{r}_cutoff"), F.lit(r)) for r in GRIDS]
    rows = rows.withColumn("failed_rules", F.array_compact(F.array(*failed))).withColumn("undecided", F.coalesce(*(F.col(f"{r}_cutoff") for r in GRIDS)).isNull())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"), "undecided")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that pass, with the columns they had.

    The counts are taken once to set cutoffs and again beside the text to apply them, so no text
    is shuffled and rows need no key.
    """
    cutoffs = written(thresholds(written(measured(docs, stratum), "features"), labels), "cutoffs").withColumnRenamed("stratum", "_stratum")
    at = docs.columns.index("text")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), _stratum(stratum))
    rows = counted(rows, "doc", lambda batch: pc.struct_field(batch.column(0), [at])).filter(~base_failed())
    rows = rows.join(cutoffs, F.col("stratum") == F.col("_stratum"), "left")
    for r, feature in rule_features().items():
        rows = rows.filter(~F.coalesce(feature > F.col(f"{r}_cutoff"), F.lit(False)))
    return rows.select("doc.*")
