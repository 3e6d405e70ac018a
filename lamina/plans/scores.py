"""Scores of extraction arms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import scores as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived, results
from lamina.sources.snapshots import shared_folder


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulletin's documents as the outputs of arms, some invalid, absent, blank or not billed."""
    return derived.papers(spark, sf_dir).selectExpr(
        "concat('arm ', CAST(paper_id % 10 AS STRING)) AS arm", "bulletin_id AS doc", "if(paper_id % 2 = 0, 'live', 'batch') AS mode", "tokens_in % 700 > 0 AS valid",
        """CASE WHEN tokens_in % 1300 > 0 THEN struct(if(tokens_in % 900 = 0, '  ', paper_summary) AS summary, symptoms, if(tokens_in % 1100 = 0, array(' '), systems) AS systems, components, remedy,
         if(tokens_in % 400 = 0, 'recall', doc_kind) AS doc_kind) END AS output""",
        "CASE WHEN tokens_in % 300 > 0 THEN tokens_in * 0.001D END AS latency_s", "tokens_in", "tokens_out", "if(tokens_in % 1500 = 0, 0D, tokens_in * 0.0001D) AS cost_usd",
    )


_OUTPUTS = r""", o AS (SELECT 'arm ' || (paper_id % 10) AS arm, bulletin_id AS doc, CASE WHEN paper_id % 2 = 0 THEN 'live' ELSE 'batch' END AS mode, tokens_in % 700 > 0 AND tokens_in % 1300 > 0 AS good,
  CASE WHEN tokens_in % 900 = 0 THEN '  ' ELSE paper_summary END AS summary, symptoms, CASE WHEN tokens_in % 1100 = 0 THEN [' '] ELSE systems END AS systems, components, remedy,
  CASE WHEN tokens_in % 400 = 0 THEN 'recall' ELSE doc_kind END AS doc_kind, CASE WHEN tokens_in % 300 > 0 THEN tokens_in * 0.001::DOUBLE END AS latency_s, tokens_in, tokens_out,
  CASE WHEN tokens_in % 1500 = 0 THEN 0 ELSE tokens_in * 0.0001::DOUBLE END AS cost_usd FROM papers),
 g AS (SELECT arm, doc, doc_kind, summary, remedy, list_distinct(list_filter(list_transform(symptoms, lambda v: lower(trim(v))), lambda v: v <> '')) AS symptoms,
  list_distinct(list_filter(list_transform(systems, lambda v: lower(trim(v))), lambda v: v <> '')) AS systems, list_distinct(list_filter(list_transform(components, lambda v: lower(trim(v))), lambda v: v <> '')) AS components,
  list_filter(string_split_regex(lower(coalesce(summary, '')), '\W+'), lambda w: w <> '') AS summary_w, list_filter(string_split_regex(lower(coalesce(remedy, '')), '\W+'), lambda w: w <> '') AS remedy_w FROM o WHERE good)"""


def _sets(f: str) -> str:
    return f"round(avg(CASE WHEN len(a.{f}) + len(b.{f}) = 0 THEN 1 ELSE len(list_intersect(a.{f}, b.{f}))::DOUBLE / len(list_distinct(a.{f} || b.{f})) END), 6) AS {f}"


def _bags(f: str) -> str:
    both = f"coalesce(list_sum(list_transform(list_distinct(a.{f}_w), lambda w: least(len(list_filter(a.{f}_w, lambda x: x = w)), len(list_filter(b.{f}_w, lambda x: x = w))))), 0)"
    return f"round(avg(CASE WHEN len(a.{f}_w) + len(b.{f}_w) = 0 THEN 1 ELSE 2 * {both}::DOUBLE / (len(a.{f}_w) + len(b.{f}_w)) END), 6) AS {f}"


_FIELDS = "count(*) AS n, " + ", ".join([*map(_sets, ("symptoms", "systems", "components")), "round(avg(CASE WHEN a.doc_kind IS NOT DISTINCT FROM b.doc_kind THEN 1.0::DOUBLE ELSE 0 END), 6) AS doc_kind", *map(_bags, ("summary", "remedy"))])


def a24_arm_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A24, C42."""
    return ops.arm_report(_outputs(spark, sf_dir))


_BLANK = {f: f"len(list_filter({f}, lambda v: trim(v) <> '')) = 0" for f in ("symptoms", "systems", "components")} | {f: f"coalesce(trim({f}), '') = ''" for f in ("doc_kind", "summary", "remedy")}
_A24 = _OUTPUTS + """, s AS (SELECT GROUPING(arm) AS w, arm, max(mode) AS mode, count(*) AS n, count(*) FILTER (good) AS n_valid, round(count(*) FILTER (good) / count(*), 6) AS validity,
""" + ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END) FILTER (good), 6) AS empty_{f}" for f, c in _BLANK.items()) + """,
  round(avg(latency_s), 6) AS mean_latency, CAST(sum(tokens_in) AS BIGINT) AS tokens_in, CAST(sum(tokens_out) AS BIGINT) AS tokens_out, round(sum(cost_usd), 4) AS usd, count(*) FILTER (cost_usd > 0) AS billed,
  sum(cost_usd) / nullif(count(*) FILTER (cost_usd > 0), 0) * 1000 AS p FROM o GROUP BY ROLLUP (arm))
SELECT * EXCLUDE (w, p, arm, mode), CASE WHEN w = 1 THEN '(all)' ELSE arm END AS arm, CASE WHEN w = 0 THEN mode END AS mode, round(p, 4) AS per_1000, CASE WHEN w = 0 THEN round(CASE mode WHEN 'live' THEN p / 2 ELSE p END, 4) END AS per_1000_batch FROM s"""


def q24_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms against what is stored and against one arm. A24, Q24, C26, C27."""
    stored = derived.papers(spark, sf_dir).filter("paper_id % 10 = 2").selectExpr("bulletin_id AS doc", "struct(paper_summary AS summary, symptoms, systems, components, remedy, doc_kind) AS output")
    return ops.agreements(_outputs(spark, sf_dir), stored, "arm 1")


_Q24A = _OUTPUTS + r""", t AS (SELECT bulletin_id AS doc, doc_kind, list_transform(symptoms, lambda v: lower(v)) AS symptoms, list_transform(systems, lambda v: lower(v)) AS systems, components,
  list_filter(string_split_regex(lower(coalesce(paper_summary, '')), '\W+'), lambda w: w <> '') AS summary_w, list_filter(string_split_regex(lower(coalesce(remedy, '')), '\W+'), lambda w: w <> '') AS remedy_w FROM papers WHERE paper_id % 10 = 2)
""" + f"SELECT a.arm, 'stored' AS against, {_FIELDS} FROM g a JOIN t b USING (doc) GROUP BY a.arm UNION ALL SELECT a.arm, 'reference', {_FIELDS} FROM g a JOIN g b USING (doc) WHERE b.arm = 'arm 1' AND a.arm <> 'arm 1' GROUP BY a.arm"


def q24_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24, J19."""
    return ops.pairwise(_outputs(spark, sf_dir))


_Q24P = _OUTPUTS + f" SELECT a.arm, b.arm AS other_arm, {_FIELDS} FROM g a JOIN g b USING (doc) WHERE a.arm < b.arm GROUP BY a.arm, b.arm"


def s12_result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs written as lines of JSON, one folder an arm, and those of three arms read back, of which one has none. S12."""
    rows = _outputs(spark, sf_dir).withColumn("model", F.concat(F.lit("m\u2028"), "arm", F.lit("\u0085\n\"")))
    folder = f"{shared_folder(spark, 'results')}/run"
    results.write(rows, folder)
    found = results.read(spark, folder, rows.schema, ["arm 1", "arm 2", "arm x"])
    return found.select("arm", "doc", "valid", "model", F.col("output.summary").alias("summary"), F.array_join("output.systems", ",").alias("systems"), F.round("latency_s", 6).alias("latency_s"), "tokens_in")


_S12 = _OUTPUTS + """ SELECT arm, doc, tokens_in % 700 > 0 AS valid, 'm' || chr(8232) || arm || chr(133) || chr(10) || '"' AS model, CASE WHEN tokens_in % 1300 > 0 THEN summary END AS summary, CASE WHEN tokens_in % 1300 > 0 THEN systems[1] END AS systems,
 round(latency_s, 6) AS latency_s, tokens_in FROM o WHERE arm IN ('arm 1', 'arm 2')"""

QUERIES = {f.__name__: f for f in (a24_arm_report, q24_agreements, q24_pairwise, s12_result_lines)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_A24, _Q24A, _Q24P, _S12))}
