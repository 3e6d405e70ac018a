"""Evaluations and spending: answer quality, wall clocks, fixed draws, examples, budgets and input plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labels of judged arms, statuses that count against an arm, pages and bytes that are sent as they are, and the share of the live price that a batch costs.
LABELS, BAD_STATUSES = "ABCDEF", ["unsupported", "missing_but_in_source"]
MAX_DIRECT_PAGES, MAX_PAYLOAD_BYTES, BATCH_DISCOUNT = 30, 20_000_000, 0.5


def fixed_order(seed: int, *keys: str) -> Column:
    """A place in an order that only seed and keys decide."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def answer_quality(answers: DataFrame) -> DataFrame:
    """By model: grounded and refused answers, made-up citations, hits at 1, 3 and 5, cost.

    answers: model, expects_match, hit_rank (null: not found), grounded, refused, n_hallucinated, cost_usd.
    """
    match = F.col("expects_match")
    n, none = F.count_if(match), F.count_if(~match)
    rate = lambda part, whole, empty: F.round(F.when(whole > 0, part / whole).otherwise(empty), 4)
    return answers.groupBy("model").agg(
        n.alias("match_queries"), rate(F.count_if(match & F.col("grounded")), n, 0.0).alias("grounded_rate"), F.count_if(match & F.col("refused")).alias("false_refusals"), F.sum("n_hallucinated").alias("hallucinated"),
        *(rate(F.count_if(match & (F.col("hit_rank") <= k)), n, 0.0).alias(f"hit_{k}") for k in (1, 3, 5)),
        none.alias("no_match_queries"), rate(F.count_if(~match & F.col("refused")), none, 1.0).alias("refusal_precision"), F.count_if(~match & ~F.col("refused")).alias("false_answers"),
        F.round(F.sum("cost_usd"), 4).alias("total_cost"), F.round(F.avg("cost_usd"), 6).alias("avg_cost"), F.round(F.max("cost_usd"), 6).alias("max_cost"),
    )


def wall_clocks(runs: DataFrame) -> DataFrame:
    """By arm: a batch arm from its first submission to its last collection, a live arm the sum of its runs; and the mean of a run."""
    seconds = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    whole = F.unix_micros(F.max("finished_at").cast("timestamp")) - F.unix_micros(F.min("started_at").cast("timestamp"))
    return runs.groupBy("arm", "mode").agg(F.round(F.when(F.col("mode") == "live", F.sum(seconds)).otherwise(whole) / 1e6, 3).alias("wall_seconds"), F.round(F.avg(seconds) / 1e6, 3).alias("mean_seconds"))


def labelled_arms(outputs: DataFrame, seed: int = 7) -> DataFrame:
    """Each document's arms under letters that only seed and document decide (L17); an arm's row is one of few of its document. More arms than letters raise."""
    place = F.row_number().over(Window.partitionBy("doc").orderBy(fixed_order(seed, "doc", "arm"), "arm"))
    few = F.when(F.col("place") <= len(LABELS), F.substr(F.lit(LABELS), F.col("place"), F.lit(1))).otherwise(F.raise_error(F.lit(f"more than {len(LABELS)} arms of a document")).cast("string"))
    return outputs.withColumn("place", place).withColumn("label", few).drop("place")


def judged_documents(gaps: DataFrame, n_hard: int, n_random: int, seed: int = 7) -> DataFrame:
    """The documents of largest disagreement, and a fixed draw of the others (L13, L18); both numbers are the feature."""
    hard = gaps.orderBy(F.desc("gap"), "doc").limit(n_hard).select("doc", F.lit("hard").alias("chosen"))
    rest = gaps.join(F.broadcast(hard), "doc", "left_anti").orderBy(fixed_order(seed, "doc"), "doc").limit(n_random)
    return hard.unionByName(rest.select("doc", F.lit("random").alias("chosen")))


def examples(verdicts: DataFrame, n: int = 3) -> DataFrame:
    """The documents whose arms differ most, with the field that shows it (L15); n is the feature.

    verdicts: doc, field, arm, status, is_pdf. More kinds of status come first, then more of the
    rarer of bad and correct ones, then PDFs, then smaller ids.
    """
    bad, right = F.count_if(F.col("status").isin(BAD_STATUSES)), F.count_if(F.col("status") == "correct")
    fields = verdicts.groupBy("doc", "field").agg(F.countDistinct("status").alias("kinds"), F.least(bad, right).alias("balance"), F.max("is_pdf").alias("is_pdf"), F.count("*").alias("n")).filter("n > 1")
    best = fields.groupBy("doc").agg(F.max(F.struct("kinds", "balance", "is_pdf", "field")).alias("b")).select("doc", "b.*")
    return best.orderBy(F.desc("kinds"), F.desc("balance"), F.desc("is_pdf"), "doc").limit(n)


def drawn(rows: DataFrame, takes: DataFrame, cells: Sequence[str], key: str, seed: int = 7) -> DataFrame:
    """The rows of a stratified sample: forced ones first, then a fixed draw up to what a cell gives (Q22).

    The draw's rank is limited by the most that any cell gives, which Spark applies in every task
    before a cell's rows come together, so that a hot cell sends a few rows a task.
    """
    in_cell = Window.partitionBy(*cells)
    named = rows.join(F.broadcast(takes.select(*cells, "take")), list(cells))  # a row a cell
    forced = named.filter("is_forced").withColumn("place", F.row_number().over(in_cell.orderBy(fixed_order(seed, key), key)))
    most = takes.agg(F.coalesce(F.max("take"), F.lit(0))).first()[0]
    first = named.filter("NOT is_forced").withColumn("place", F.row_number().over(in_cell.orderBy(fixed_order(seed, key), key))).filter(F.col("place") <= int(most))
    n = forced.groupBy(*cells).agg(F.count("*").alias("n_forced"))
    rest = first.join(n, list(cells), "left").withColumn("place", F.col("place") + F.coalesce("n_forced", F.lit(0))).drop("n_forced").filter(F.col("place") <= F.col("take"))
    return forced.unionByName(rest)


def first_child(children: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """The first child's value."""
    return children.groupBy(by).agg(F.min_by(column, order).alias(column))


def spent_since(ledger: DataFrame, since: Column, kinds: Sequence[str]) -> DataFrame:
    """One row: the spending of some kinds since a time."""
    return ledger.filter((F.col("occurred_at") >= since) & F.col("kind").isin(*kinds)).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"))


def document_budget(cap: Column, spent: Column, per_document: Column) -> Column:
    """Documents that a cap still allows; null is no limit, 0 is none."""
    left = cap - spent
    return F.when(cap > 0, F.when(left <= 0, 0).when(per_document > 0, F.floor(left / per_document))).cast("long")


def input_plan(pages: Column, n_bytes: Column, method: Column, has_text: Column) -> Column:
    """How a document is sent."""
    small = F.when(n_bytes <= MAX_PAYLOAD_BYTES, "pdf: direct").otherwise("pdf: shrunk")
    return F.when(pages <= MAX_DIRECT_PAGES, small).when((method == "pymupdf") & has_text, "text").otherwise("chunks")


def live_and_batch(per_1000: Column, mode: Column) -> tuple[Column, Column]:
    """Live and batch price of a thousand documents."""
    live = mode == "live"
    return F.when(live, per_1000).otherwise(per_1000 / BATCH_DISCOUNT), F.when(live, per_1000 * BATCH_DISCOUNT).otherwise(per_1000)
