"""Mixing sources to target weights by entropy balancing.

Each token counts as a unit of mass. Among all document rates that meet the token targets, the one
nearest to 1 in relative entropy tilts each document by ``exp(dual of its category)``, summed over
groupings. The convex dual is solved by Newton steps: categories of one grouping are disjoint, so
their block of the Hessian is a diagonal and a step is one aggregation and one join, for any
number of categories; with several groupings the blocks take turns. Documents are first summed by
cells of equal categories, which is all the dual needs. Steps that do not come to the targets
raise an error.

Rates become copies by bounded error: within buckets of a source, dealt by hash, documents go from
large to small and get one more copy when the words still owed reach half their size. Rows with
equal id, text and source are one entry with their number; its copies are shared out among them.

Sources may be many (a source may be a domain): they are ranked by range-partitioned counts, their
levels come from one aggregation a round, and their facts are broadcast just if they are few.

Results: one row per document. A null text has size 0 and is taken 0 times; a null source is a
source of its own, last in order; an empty table gives an empty one; ties are dealt by hash, so
reruns agree; extra columns, of whatever names, are kept by ``mix`` and left out of the plan.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm.common import dropped, written

#: Copies of a document at most, documents in a bucket, Newton steps at most, and the relative error to stop at.
MOST_COPIES, BUCKET, STEPS, TOLERANCE = 3, 4096, 200, 1e-9
#: Sources whose facts are broadcast at most, shares of a source's rows in a join beyond that, and rows made at once of repeated ones.
FEW, SALTS, CHUNK = 20_000, 64, 4096
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Adds ``place``, a source's number in order of code points (null last), from 0: by ranges, and the counts of ranges."""
    ranges = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = written(ranges, "ranges")
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    # a row for each range
    counts = ranges.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    return ranges.withColumn("within", within).join(F.broadcast(counts), "range").withColumn("place", F.col("first") + F.col("within")).drop("range", "within", "first")


def share_targets(sources: DataFrame, weight: Column, cap: float = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to source, source_size: all mass shared by weight, no source above cap times its size, the excess shared again.

    In each round the level of the sources not yet capped rises by what the capped ones leave over;
    a round is one aggregation, and they end when no further source is above.
    """
    s = sources.withColumn("weight", weight).withColumn("room", F.lit(float(cap)) * F.col("source_size"))
    total, level, capped = s.agg(F.sum("source_size")).first()[0], 0.0, -1
    while total:
        above = F.col("room") < F.lit(level) * F.col("weight")
        free = F.when(above, 0.0)
        found = s.agg(F.count_if(above).alias("n"), F.sum(F.when(above, F.col("room")).otherwise(0.0)).alias("room"), F.sum(free.otherwise(F.col("weight"))).alias("weight")).first()
        if found["n"] == capped or not found["weight"]:
            break
        capped, level = found["n"], (total - found["room"]) / found["weight"]
    share = F.lit(level) * F.col("weight")
    return s.withColumn("target", F.when(F.col("room") < share, F.col("room")).otherwise(share)).drop("weight", "room")


def entropy_balance(cells: DataFrame, targets: dict[str, DataFrame], mass: str = "mass", cap: float = MOST_COPIES, steps: int = STEPS) -> DataFrame:
    """Cells (category columns and a mass) with the rate that meets every target.

    targets: by grouping, a table of its category column and ``target``. Rates stay at most cap.
    """
    groupings = list(targets)
    duals = {g: written(targets[g].select(g, F.col("target").cast("double").alias("target"), F.lit(0.0).alias("dual")), "duals") for g in groupings}

    def rated() -> DataFrame:
        out = cells
        for g in groupings:
            d = duals[g].select(F.col(g).alias("_key"), F.col("dual").alias(f"_dual_{g}"))
            out = out.join(d, F.col(g).eqNullSafe(F.col("_key")), "left").drop("_key")
        tilt = sum((F.coalesce(F.col(f"_dual_{g}"), F.lit(0.0)) for g in groupings), F.lit(0.0))
        return out.withColumn("rate", F.least(F.exp(F.least(tilt, F.lit(60.0))), F.lit(float(cap)))).drop(*(f"_dual_{g}" for g in groupings))

    off = 0.0
    for _ in range(steps):
        off = 0.0
        for g in groupings:
            taken = F.col("rate") * F.col(mass)
            sums = rated().groupBy(g).agg(F.sum(taken).alias("value"), F.sum(F.when(F.col("rate") < cap, taken).otherwise(0.0)).alias("slope"))
            sums = sums.select(F.col(g).alias("_key"), "value", "slope")
            gap = F.col("target") - F.col("value")
            # a step of the dual's Newton iteration; none is longer than 2, and a category at its cap with too much steps down
            move = F.when((F.col("value") <= 0) | F.col("value").isNull(), 0.0).when(F.col("slope") > 0, F.greatest(F.least(gap / F.col("slope"), F.lit(2.0)), F.lit(-2.0))).otherwise(F.when(gap < 0, -0.5).otherwise(0.0))
            moved = duals[g].join(sums, F.col(g).eqNullSafe(F.col("_key")), "left")
            new = written(moved.select(g, "target", (F.col("dual") + move).alias("dual"), F.when(F.col("value") > 0, F.abs(gap) / F.greatest("target", F.lit(1.0))).otherwise(0.0).alias("gap")), "duals")
            off = max(off, new.agg(F.max("gap")).first()[0] or 0.0)
            dropped(duals[g])
            duals[g] = new
        if off < TOLERANCE:
            return rated()
    raise ArithmeticError(f"after {steps} Newton steps a target is still off by a share of {off:.3g}; the targets may contradict each other")


def with_facts(rows: DataFrame, facts: DataFrame, few: int = FEW) -> DataFrame:
    """Rows with their source's facts: few facts are broadcast, more are repeated for each share of a source's rows."""
    facts = facts.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if facts.limit(few + 1).count() <= few:
        return rows.join(F.broadcast(facts), same, "left").drop("_source")
    facts = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    return rows.withColumn("_share", salt).join(facts, same & (F.col("_share") == F.col("_salt")), "left").drop("_source", "_share", "_salt")


def rounded(entries: DataFrame) -> DataFrame:
    """Adds ``copies``, of all an entry's rows together: the words taken of a source come near rate times size.

    entries: doc_id, text_hash, source, size, rows (how many an entry stands for), entries (of its source), rate.
    """
    spread = F.xxhash64("doc_id", "text_hash", "size")
    dealt = entries.withColumn("spread", spread).withColumn("bucket", F.pmod(F.xxhash64("spread"), F.ceil(F.col("entries") / BUCKET)))
    columns = [*entries.columns, "copies"]

    def copy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "spread", "doc_id", "text_hash"], ascending=[False, True, True, True], kind="stable")
        rates, n = pdf["rate"].to_numpy(float), pdf["rows"].to_numpy(np.int64)
        whole = np.minimum(np.floor(rates + 1e-9).astype(np.int64), MOST_COPIES)
        extra, owed = np.zeros(len(pdf), np.int64), 0.0
        for i, (part, size, m) in enumerate(zip((rates - whole).clip(0).tolist(), pdf["size"].tolist(), n.tolist(), strict=True)):
            owed += part * size * m
            if size and part and whole[i] < MOST_COPIES:
                extra[i] = min(max(int(owed / size + 0.5), 0), m)
                owed -= int(extra[i]) * size
        return pdf.assign(copies=whole * n + extra)[columns]

    schema = ", ".join(f"`{n}` {t}" for n, t in entries.dtypes) + ", copies long"
    return dealt.groupBy("source", "bucket").applyInPandas(copy, schema)


def mix_entries(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size, rows, source_size, entries, target, rate, copies: an entry for rows with equal id, text and source.

    Sources in order of code points weigh 1, 2, 3, 1, 2, 3 and so on, a null source last.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    slim = written(slim.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("rows")), "sizes")
    sources = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("entries"))
    weight = (F.col("place") % 3 + 1).cast("double")
    placed = written(ranked(sources), "places")
    targets = written(share_targets(placed, weight).drop("place"), "targets")
    cells = targets.select("source", F.col("source_size").cast("double").alias("mass"))
    rates = entropy_balance(cells, {"source": targets}).select(F.col("source").alias("_source"), "rate")
    facts = written(targets.join(rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "facts")
    return rounded(with_facts(slim, facts))


def _share(nth: Column, copies: Column, rows: Column) -> Column:
    """Copies of the nth row (from 0) of an entry."""
    return F.floor(copies / rows) + F.when(nth < copies % rows, 1).otherwise(0)


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, source, size, source_size, target, rate, copies of every document."""
    plan = mix_entries(docs)
    # a row for each repeated one, made in chunks that are dealt out
    chunks = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / CHUNK))))
    if not plan.filter(F.col("rows") > CHUNK).isEmpty():
        chunks = chunks.repartition()
    first = F.col("chunk") * CHUNK
    each = chunks.withColumn("nth", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("rows")) - 1)))
    return each.select("doc_id", "text_hash", "source", "size", "source_size", "target", "rate", _share(F.col("nth"), F.col("copies"), F.col("rows")).cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as its copies, with the columns it had."""
    plan = written(mix_entries(docs).filter("copies > 0").select("doc_id", "text_hash", F.col("source").alias("of"), "rows", "copies"), "plan")
    # the user's columns stand in one of their own, so no name can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), F.col("source").cast("string").alias("from"))
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")) & F.col("from").eqNullSafe(F.col("of"))
    once = rows.join(plan.filter("rows = 1"), same).select("doc", "copies")
    repeated = plan.filter("rows > 1")
    if not repeated.isEmpty():
        # rows of an entry are numbered within parts of a written table, so that none is numbered in one task
        several = rows.join(repeated, same).select("doc", "doc_id", "text_hash", "of", "rows", "copies").withColumn("part", F.spark_partition_id())
        several = written(several, "repeated")
        key = ["doc_id", "text_hash", "of"]
        sizes = several.groupBy(*key, "part").agg(F.count("*").alias("n"))
        first = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        sizes = sizes.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("part").alias("_part"), first.alias("first"))
        numbered = several.withColumn("within", F.row_number().over(W.partitionBy("part", *key).orderBy(F.lit(0))) - 1)
        equal = F.col("part") == F.col("_part")
        for k in key:
            equal = equal & F.col(k).eqNullSafe(F.col(f"_{k}"))
        own = _share(F.col("first") + F.col("within"), F.col("copies"), F.col("rows"))
        once = once.unionByName(numbered.join(sizes, equal).select("doc", own.cast("long").alias("copies")))
    taken = once.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("doc.*")
