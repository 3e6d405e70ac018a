"""Scores of extraction arms: validity, empty fields, agreement of outputs, time and cost.

Outputs are rows of arm, doc, mode, valid, output (a struct of the fields below, null where there is
none), latency_s, tokens_in, tokens_out and cost_usd, one row for an arm and a document. Only valid
outputs are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import evaluation

SET_FIELDS, TEXT_FIELDS = ("symptoms", "systems", "components"), ("summary", "remedy")
COMPARED = (*SET_FIELDS, "doc_kind", *TEXT_FIELDS)
ALL_ARMS = "(all)"


def _good() -> Column:
    return F.coalesce(F.col("valid"), F.lit(False)) & F.col("output").isNotNull()


def _is_empty(field: str) -> Column:
    """Without a letter: null, blank, or a list of nothing else."""
    value = F.col(f"output.{field}")
    said = F.exists(value, lambda v: F.trim(v) != "") if field in SET_FIELDS else F.trim(value) != ""
    return ~F.coalesce(said, F.lit(False))


def arm_report(outputs: DataFrame) -> DataFrame:
    """One row an arm and one for all of them, in one pass.

    A field's empty rate is over the arm's valid outputs, the price of a thousand documents over
    those that were billed; what does not occur is null. A live arm also gets its price as a batch.
    """
    # sums by arm and mode are numbers alone, which Spark adds up in a map without sorting rows; the few sums are rolled up
    good = outputs.withColumn("good", _good())
    few = good.groupBy("arm", "mode").agg(
        F.count("*").alias("n"), F.count_if("good").alias("n_valid"), *(F.count_if(F.col("good") & _is_empty(f)).alias(f"empty_{f}") for f in COMPARED), F.sum("latency_s").alias("latency"), F.count("latency_s").alias("n_timed"),
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").alias("usd"), F.count_if(F.col("cost_usd") > 0).alias("billed"),
    )
    usd, billed, n_valid = F.coalesce(F.sum("usd"), F.lit(0.0)), F.sum("billed"), F.sum("n_valid")
    mean = lambda total, n: F.round(F.when(n > 0, total / n), 6)
    sums = few.rollup("arm").agg(
        F.grouping_id().alias("g"), F.max("mode").alias("mode"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(n_valid, F.lit(0)).alias("n_valid"), F.round(n_valid / F.sum("n"), 6).alias("validity"),
        *(mean(F.sum(f"empty_{f}"), n_valid).alias(f"empty_{f}") for f in COMPARED), mean(F.sum("latency"), F.sum("n_timed")).alias("mean_latency"),
        F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"),
        F.round(usd, 4).alias("usd"), F.coalesce(billed, F.lit(0)).alias("billed"), F.when(billed > 0, usd / billed * 1000).alias("per_1000"),
    )
    whole = F.col("g") == 1
    _, batch = evaluation.live_and_batch(F.col("per_1000"), F.col("mode"))
    return sums.withColumns({
        "arm": F.when(whole, ALL_ARMS).otherwise(F.col("arm")), "per_1000_batch": F.when(~whole, F.round(batch, 4)), "mode": F.when(~whole, F.col("mode")), "per_1000": F.round("per_1000", 4),
    }).drop("g")


def comparable(output: str) -> Column:
    """An output's fields as sets and bags of words, made once however many others it is held against."""
    sets, bags = ([made(F.col(f"{output}.{f}")).alias(f) for f in fields] for made, fields in ((text.norm_set, SET_FIELDS), (text.word_bag, TEXT_FIELDS)))
    return F.struct(*sets, *bags, F.col(f"{output}.doc_kind").alias("doc_kind"))


def agreement(a: str, b: str) -> dict[str, Column]:
    """How far two comparable outputs agree, field by field, from 0 to 1."""
    found = {f: text.sets_agree(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in SET_FIELDS}
    found["doc_kind"] = F.col(f"{a}.doc_kind").eqNullSafe(F.col(f"{b}.doc_kind")).cast("double")
    return found | {f: text.bags_agree(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")) for f in TEXT_FIELDS}


def _means(pairs: DataFrame, *keys: str) -> DataFrame:
    scored = pairs.select(*keys, *(c.alias(f) for f, c in agreement("output", "other").items()))
    return scored.groupBy(*keys).agg(F.count("*").alias("n"), *(F.round(F.avg(f), 6).alias(f) for f in COMPARED))


def agreements(outputs: DataFrame, stored: DataFrame, reference_arm: str) -> DataFrame:
    """Mean agreement of each arm with the stored outputs (doc, output) and, for the other arms, with one arm's."""
    good = outputs.filter(_good()).select("arm", "doc", comparable("output").alias("output"))
    known = stored.filter("output IS NOT NULL").select("doc", F.lit("stored").alias("against"), comparable("output").alias("other"))
    reference = good.filter(F.col("arm") == reference_arm).select("doc", F.lit("reference").alias("against"), F.col("output").alias("other"))
    pairs = good.join(known.unionByName(reference), "doc").filter((F.col("against") == "stored") | (F.col("arm") != reference_arm))
    return _means(pairs, "arm", "against")


def pairwise(outputs: DataFrame) -> DataFrame:
    """Mean agreement of every two arms over the documents that both have (Q24, J19); a document has at most one row for each of the few arms."""
    good = outputs.filter(_good()).select("arm", "doc", comparable("output").alias("output"))
    other = good.select("doc", F.col("arm").alias("other_arm"), F.col("output").alias("other"))
    return _means(good.join(other, "doc").filter("arm < other_arm"), "arm", "other_arm")
