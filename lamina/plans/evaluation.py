"""Evaluations, fixed draws, budgets and input plans."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import evaluation as ops
from lamina.operators import reports
from lamina.plans import reports as report_plans
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def a23_answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by model, with and without a match to find."""
    rows = derived.ledger(spark, sf_dir).selectExpr(
        "model", "k % 4 > 0 AS expects_match", "CASE WHEN event_id % 9 < 7 THEN event_id % 9 + 1 END AS hit_rank", "event_id % 9 < 5 AS grounded",
        "event_id % 11 = 0 OR (k % 4 = 0 AND event_id % 5 > 0) AS refused", "CAST(event_id % 13 = 0 AS INT) AS n_hallucinated", "cost * 0.001 AS cost_usd",
    )
    return ops.answer_quality(rows)


_A23 = """, q AS (SELECT model, k % 4 > 0 AS m, CASE WHEN event_id % 9 < 7 THEN event_id % 9 + 1 END AS r, event_id % 9 < 5 AS g, event_id % 11 = 0 OR (k % 4 = 0 AND event_id % 5 > 0) AS f, CAST(event_id % 13 = 0 AS INT) AS h, cost * 0.001::DOUBLE AS c FROM ledger)
SELECT model, count(*) FILTER (WHERE m) AS match_queries, round(coalesce(count(*) FILTER (WHERE m AND g) / nullif(count(*) FILTER (WHERE m), 0), 0), 4) AS grounded_rate, count(*) FILTER (WHERE m AND f) AS false_refusals, CAST(sum(h) AS BIGINT) AS hallucinated,
""" + ", ".join(f"round(coalesce(count(*) FILTER (WHERE m AND r <= {k}) / nullif(count(*) FILTER (WHERE m), 0), 0), 4) AS hit_{k}" for k in (1, 3, 5)) + """,
 count(*) FILTER (WHERE NOT m) AS no_match_queries, round(coalesce(count(*) FILTER (WHERE NOT m AND f) / nullif(count(*) FILTER (WHERE NOT m), 0), 1), 4) AS refusal_precision, count(*) FILTER (WHERE NOT m AND NOT f) AS false_answers,
 round(sum(c), 4) AS total_cost, round(avg(c), 6) AS avg_cost, round(max(c), 6) AS max_cost FROM q GROUP BY model"""


def a33_wall_clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time of batch and live arms."""
    rows = derived.ledger(spark, sf_dir).select(F.col("model").alias("arm"), F.when(F.col("k") % 2 == 0, "live").otherwise("batch").alias("mode"), F.col("occurred_at").alias("started_at"), (F.col("occurred_at") + F.make_interval(secs=F.col("tokens_out"))).alias("finished_at"))
    return ops.wall_clocks(rows)


_A33 = """SELECT model AS arm, CASE WHEN k % 2 = 0 THEN 'live' ELSE 'batch' END AS mode,
 round(CASE WHEN k % 2 = 0 THEN sum(tokens_out)::DOUBLE ELSE (epoch_us(max(occurred_at + to_seconds(tokens_out))) - epoch_us(min(occurred_at))) / 1e6 END, 3) AS wall_seconds, round(avg(tokens_out), 3) AS mean_seconds FROM ledger GROUP BY model, k % 2"""


def l17_labelled_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of the arms that answered for a document."""
    rows = derived.papers(spark, sf_dir).select(F.col("bulletin_id").alias("doc"), F.col("audience").alias("arm")).distinct()
    return ops.labelled_arms(rows)


_L17 = """, o AS (SELECT DISTINCT bulletin_id AS doc, audience AS arm FROM papers)
SELECT doc, arm, substr('ABCDEF', CAST(row_number() OVER (PARTITION BY doc ORDER BY md5('7:' || doc || ':' || arm), arm) AS INT), 1) AS label FROM o"""


def l13_judged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents the arms disagree on most, and ten others."""
    gaps = derived.papers(spark, sf_dir).groupBy(F.col("bulletin_id").alias("doc")).agg((F.countDistinct("audience") / F.count("*")).alias("gap"), F.count("*").alias("n")).filter("n > 1")
    return ops.judged_documents(gaps, 10, 10)


_L13 = """, g AS (SELECT bulletin_id AS doc, count(DISTINCT audience) / count(*) AS gap FROM papers GROUP BY 1 HAVING count(*) > 1), h AS (SELECT doc FROM g ORDER BY gap DESC, doc LIMIT 10)
SELECT doc, 'hard' AS chosen FROM h UNION ALL (SELECT doc, 'random' FROM g WHERE doc NOT IN (SELECT doc FROM h) ORDER BY md5('7:' || doc), doc LIMIT 10)"""


def l15_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields whose verdicts differ most."""
    status = F.element_at(F.array(*(F.lit(s) for s in ("correct", "unsupported", "missing_but_in_source", "partial"))), (F.col("tokens_in") / 100 % 4).cast("int") + 1)
    rows = derived.papers(spark, sf_dir).select(F.col("bulletin_id").alias("doc"), F.col("doc_kind").alias("field"), F.col("paper_id").alias("arm"), status.alias("status"), (F.col("audience") == "owner").alias("is_pdf"))
    return ops.examples(rows)


_L15 = """, v AS (SELECT bulletin_id AS doc, doc_kind AS field, ['correct', 'unsupported', 'missing_but_in_source', 'partial'][CAST(tokens_in // 100 % 4 + 1 AS INT)] AS status, audience = 'owner' AS pdf FROM papers),
 f AS (SELECT doc, field, count(DISTINCT status) AS kinds, least(count(*) FILTER (WHERE status IN ('unsupported', 'missing_but_in_source')), count(*) FILTER (WHERE status = 'correct')) AS balance, bool_or(pdf) AS is_pdf FROM v GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc, kinds, balance, is_pdf, field FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY kinds DESC, balance DESC, is_pdf DESC, field DESC) AS rn FROM f) WHERE rn = 1 ORDER BY kinds DESC, balance DESC, is_pdf DESC, doc LIMIT 3"""


def q22_sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of a stratified sample, the largest documents forced in."""
    rows = derived.papers(spark, sf_dir).withColumn("system", F.lower(F.get("systems", F.lit(0))))
    cells = ["doc_kind", "audience", "system"]
    largest = rows.orderBy(F.desc("tokens_in"), "paper_id").limit(5).select("paper_id", F.lit(True).alias("largest"))
    forced = rows.join(F.broadcast(largest), "paper_id", "left").withColumn("is_forced", F.col("largest").isNotNull())
    return ops.drawn(forced, reports.strata_allocation(rows, cells, 300), cells, "paper_id").select("paper_id", *cells, "is_forced")


_Q22R = report_plans._Q22.replace("SELECT doc_kind, audience, system, available, share", ", a AS (SELECT doc_kind, audience, system, available, share").removesuffix(" ") + """),
 f AS (SELECT paper_id FROM papers ORDER BY tokens_in DESC, paper_id LIMIT 5),
 r AS (SELECT p.paper_id, p.doc_kind, p.audience, lower(p.systems[1]) AS system, p.paper_id IN (SELECT paper_id FROM f) AS is_forced FROM papers p),
 n AS (SELECT r.*, take, row_number() OVER (PARTITION BY r.doc_kind, r.audience, r.system ORDER BY is_forced DESC, md5('7:' || paper_id), paper_id) AS place FROM r JOIN a ON a.doc_kind = r.doc_kind AND a.audience = r.audience AND a.system = r.system)
SELECT paper_id, doc_kind, audience, system, is_forced FROM n WHERE is_forced OR place <= take"""


def a19_report_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three bulletins drawn from each tier, with their first document's summary."""
    rows = derived.bulletins(spark, sf_dir).select("severity", "bulletin_id", "number")
    drawn = ops.drawn(rows.withColumn("is_forced", F.lit(False)), spark.createDataFrame([(s, 3) for s in ("serious", "medium", "small")], "severity string, take int"), ["severity"], "bulletin_id")
    theirs = derived.papers(spark, sf_dir).join(F.broadcast(drawn.select("bulletin_id")), "bulletin_id", "left_semi")  # three a tier
    first = ops.first_child(theirs, "bulletin_id", "paper_id", "paper_summary")
    return drawn.join(first, "bulletin_id", "left").select("severity", "bulletin_id", "number", "paper_summary")


_A19 = """, d AS (SELECT * FROM (SELECT severity, bulletin_id, number, row_number() OVER (PARTITION BY severity ORDER BY md5('7:' || bulletin_id), bulletin_id) AS rn FROM bulletins) WHERE rn <= 3)
SELECT severity, d.bulletin_id, number, p.paper_summary FROM d LEFT JOIN LATERAL (SELECT paper_summary FROM papers p WHERE p.bulletin_id = d.bulletin_id ORDER BY paper_id LIMIT 1) p ON true"""


def c41_document_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What caps allow after the spending of the last day."""
    ledger = derived.ledger(spark, sf_dir)
    spent = ops.spent_since(ledger, F.lit(datetime(2024, 1, 29, 12)).cast("timestamp_ntz"), ["view", "click", "purchase"])
    per = ledger.filter("kind = 'purchase'").agg(F.round(F.avg("cost"), 6).alias("per_document"))
    caps = spark.createDataFrame([(c,) for c in (-1.0, 0.0, 50.0, 400.0, 1e6)], "cap double")
    both = caps.crossJoin(F.broadcast(spent)).crossJoin(F.broadcast(per))  # one row each
    return both.select("cap", F.round("spent", 4).alias("spent"), ops.document_budget(F.col("cap"), F.col("spent"), F.col("per_document")).alias("budget"))


_C41 = """, s AS (SELECT coalesce(sum(cost) FILTER (WHERE occurred_at >= TIMESTAMP '2024-01-29 12:00:00' AND kind IN ('view', 'click', 'purchase')), 0) AS spent, round(avg(cost) FILTER (WHERE kind = 'purchase'), 6) AS per FROM ledger)
SELECT cap, round(spent, 4) AS spent, CASE WHEN cap > 0 THEN CASE WHEN cap - spent <= 0 THEN 0 WHEN per > 0 THEN CAST(floor((cap - spent) / per) AS BIGINT) END END AS budget FROM (VALUES (-1.0::DOUBLE), (0.0), (50.0), (400.0), (1e6)) c(cap), s"""


def c39_input_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How documents are sent, and what that costs live and in batches."""
    rows = derived.papers(spark, sf_dir).select("paper_id", (F.col("tokens_in") / 100).cast("int").alias("pages"), F.col("tokens_in") * 5000, F.when(F.col("audience") == "owner", "pymupdf").otherwise("ocr").alias("method"), F.col("paper_summary").isNotNull().alias("has_text"), (F.col("tokens_in") * 0.001).alias("price")).toDF("paper_id", "pages", "n_bytes", "method", "has_text", "price")
    live, batch = ops.live_and_batch(F.col("price"), F.when(F.col("paper_id") % 2 == 0, "live").otherwise("batch"))
    return rows.select("paper_id", ops.input_plan(F.col("pages"), F.col("n_bytes"), F.col("method"), F.col("has_text")).alias("plan"), F.round(live, 6).alias("live"), F.round(batch, 6).alias("batch"))


_C39 = """SELECT paper_id, CASE WHEN tokens_in // 100 <= 30 THEN CASE WHEN tokens_in * 5000 <= 20000000 THEN 'pdf: direct' ELSE 'pdf: shrunk' END
 WHEN audience = 'owner' AND paper_summary IS NOT NULL THEN 'text' ELSE 'chunks' END AS plan,
 round(tokens_in * 0.001::DOUBLE * CASE WHEN paper_id % 2 = 0 THEN 1 ELSE 2 END, 6) AS live, round(tokens_in * 0.001::DOUBLE * CASE WHEN paper_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END, 6) AS batch FROM papers"""


def c31_lock_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signed 64-bit key of a window's name."""
    return derived.filed_rows(spark, sf_dir).select("source_window", "raw_model").distinct().select("source_window", "raw_model", text.lock_key(F.concat("source_window", "raw_model")).alias("key"))


_C31 = """, k AS (SELECT DISTINCT source_window, raw_model, CAST(('0x' || left(sha256(source_window || raw_model), 16))::UBIGINT AS HUGEINT) AS u FROM filed)
SELECT source_window, raw_model, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS key FROM k"""

QUERIES = {f.__name__: f for f in (a23_answer_quality, a33_wall_clocks, l17_labelled_arms, l13_judged_documents, l15_examples, q22_sample_rows, a19_report_draws, c41_document_budget, c39_input_plans, c31_lock_keys)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_A23, _A33, _L17, _L13, _L15, _Q22R, _A19, _C41, _C39, _C31))}
