"""Counts by car, the search gate, revived cars and lists of the picker."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import scoped as ops
from lamina.operators import vocabulary
from lamina.plans.oracle import TABLES
from lamina.plans.vocabulary import _RESOLVED, SHOWN_MAKES
from lamina.sources import derived

NOW = datetime(2024, 1, 20)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bulletins = derived.bulletins(spark, sf_dir).selectExpr("bulletin_id", "status", "CASE WHEN status = 'processed' AND CAST(bulletin_id AS BIGINT) % 9 = 0 THEN 'summary only' ELSE reason END AS reason")
    papers = derived.papers(spark, sf_dir).selectExpr("bulletin_id", "paper_summary", "paper_id % 3 <> 0 AS is_embedded")
    return ops.work_by_car(bulletins, papers, derived.links(spark, sf_dir), derived.cars(spark, sf_dir))


def a20_reread_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What re-reading each car's bulletins would touch and cost, and what resuming would. A20, A13."""
    counts = _counts(spark, sf_dir)
    again, resumed = ops.reread_cost(counts, 0.0015), ops.reread_cost(counts, 0.0015, resume=True).select("car_id", F.col("estimated_cost").alias("resume_cost"))
    return again.join(resumed, "car_id").select("car_id", "bulletins", "documents", "pending_documents", "requeue_bulletins", "requeue_documents", "estimated_cost", "resume_cost")


def a21_leftovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has left over by car. A21."""
    return _counts(spark, sf_dir).select("car_id", "failed_bulletins", "without_summary", "unembedded")


_COUNTS = TABLES + """, b AS (SELECT bulletin_id, status, CASE WHEN status = 'processed' AND CAST(bulletin_id AS BIGINT) % 9 = 0 THEN 'summary only' ELSE reason END AS reason FROM bulletins),
 j AS (SELECT l.car_id, b.*, p.paper_id, p.paper_summary, status = 'failed' AND (reason LIKE 'timeout%' OR reason LIKE 'rate limit%') AS passing, reason IS DISTINCT FROM 'summary only' AS own FROM links l JOIN b USING (bulletin_id) LEFT JOIN papers p USING (bulletin_id)),
 c AS (SELECT c.car_id, count(DISTINCT bulletin_id) FILTER (status = 'processed' AND own) AS bulletins, count(paper_id) FILTER (status = 'processed' AND own AND paper_summary IS NOT NULL) AS documents,
  count(paper_id) FILTER (status = 'pending' AND paper_summary IS NULL) AS pending_documents, count(DISTINCT bulletin_id) FILTER (passing) AS requeue_bulletins, count(paper_id) FILTER (passing AND paper_summary IS NULL) AS requeue_documents,
  count(DISTINCT bulletin_id) FILTER (status = 'failed' AND own) AS failed_bulletins, count(paper_id) FILTER (own AND paper_summary IS NULL) AS without_summary,
  count(paper_id) FILTER (own AND paper_summary IS NOT NULL AND paper_id % 3 = 0) AS unembedded FROM cars c LEFT JOIN j USING (car_id) GROUP BY 1)
"""
_A20 = _COUNTS + "SELECT car_id, bulletins, documents, pending_documents, requeue_bulletins, requeue_documents, round((documents + pending_documents) * 0.0015::DOUBLE, 6) AS estimated_cost, round((pending_documents + requeue_documents) * 0.0015::DOUBLE, 6) AS resume_cost FROM c"
_A21 = _COUNTS + "SELECT car_id, failed_bulletins, without_summary, unembedded FROM c"


def q17_search_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which searches are refused, with limits of 3 a day and 20 a payment. Q17, T06, Q14."""
    accounts = derived.accounts(spark, sf_dir).withColumn("searches_reset_at", F.expr("CASE WHEN user_id % 2 = 0 THEN TIMESTAMP_NTZ '2024-01-10 00:00:00' END"))
    garage, ledger = derived.garage(spark, sf_dir), derived.ledger(spark, sf_dir)
    requests = garage.selectExpr("user_id", "explode(array(car_id, car_id + 100)) AS car_id").distinct()
    return ops.search_refusals(requests, garage, accounts, derived.entitlements(spark, sf_dir), ledger, NOW, ("click", "view"), daily=3, allowance=20)


_Q17 = TABLES + """, r AS (SELECT DISTINCT user_id, unnest([car_id, car_id + 100]) AS car_id FROM garage), f AS (SELECT user_id, car_id, bool_or(access = 'full') AS is_full FROM access GROUP BY ALL),
 u AS (SELECT user_id, count(*) FILTER (kind = 'click' AND occurred_at > TIMESTAMP '2024-01-19') AS today, count(*) FILTER (kind = 'view' AND (user_id % 2 <> 0 OR occurred_at > TIMESTAMP '2024-01-10')) AS paid FROM ledger GROUP BY 1)
SELECT user_id, car_id, CASE WHEN is_full IS NULL THEN 'not tracked' WHEN NOT is_full THEN 'locked' WHEN today >= 3 THEN 'daily limit' WHEN paid >= 20 THEN 'payment limit' END AS refusal FROM r LEFT JOIN f USING (user_id, car_id) LEFT JOIN u USING (user_id)"""


def d03_revived_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars after some were added again by identity and others for the first time. D03, D15, F17."""
    cars = derived.cars(spark, sf_dir).selectExpr("car_id", "year", "make", "model", "array(lower(model)) AS keywords", "car_id % 3 <> 0 AS active")
    again = cars.filter("car_id % 2 = 0").selectExpr("year", "make", "model", "CASE WHEN year % 2 = 0 THEN array('new') ELSE CAST(array() AS ARRAY<STRING>) END AS keywords")
    first = cars.filter("car_id % 5 = 0").selectExpr("year + 100 AS year", "make", "model", "CAST(NULL AS ARRAY<STRING>) AS keywords")
    return ops.revived(cars, again.unionByName(first)).withColumn("keywords", F.array_join("keywords", ","))


_D03 = TABLES + """, c AS (SELECT car_id, year, make, model, lower(model) AS keywords, car_id % 3 <> 0 AS active FROM cars),
 asked AS (SELECT DISTINCT year, make, model FROM c WHERE car_id % 2 = 0), new AS (SELECT DISTINCT year + 100 AS year, make, model FROM c WHERE car_id % 5 = 0),
 t AS (SELECT year, make, model, first(car_id ORDER BY active DESC, car_id) AS car_id FROM c SEMI JOIN asked USING (year, make, model) GROUP BY ALL)
SELECT c.car_id, c.year, c.make, c.model, CASE WHEN t.car_id IS NOT NULL AND c.year % 2 = 0 THEN 'new' ELSE keywords END AS keywords, active OR t.car_id IS NOT NULL AS active,
 CASE WHEN t.car_id IS NOT NULL THEN CASE WHEN active THEN 'kept' ELSE 'revived' END END AS outcome FROM c LEFT JOIN t ON t.car_id = c.car_id
UNION ALL SELECT (SELECT max(car_id) FROM c) + row_number() OVER (ORDER BY year, make, model), year, make, model, '', true, 'inserted' FROM new"""


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.vocabulary(vocabulary.clean_rows(derived.filed_rows(spark, sf_dir)))


def q11_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, L07."""
    return ops.picker_years(_vocab(spark, sf_dir))


def q11_makes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11, L08."""
    return ops.picker_makes(_vocab(spark, sf_dir), SHOWN_MAKES)


def q11_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed names with a 1 in them."""
    return ops.picker_models(vocabulary.resolved_models(_vocab(spark, sf_dir)), "f 1")


_Q11Y = TABLES + "SELECT model_year, row_number() OVER (ORDER BY model_year DESC) AS place FROM (SELECT DISTINCT model_year FROM vocabulary WHERE model_year <> 9999 ORDER BY 1 DESC LIMIT 30)"
_Q11M = TABLES + "SELECT model_year, make, row_number() OVER (PARTITION BY model_year ORDER BY o) AS place FROM (SELECT DISTINCT model_year, make, o FROM vocabulary JOIN (VALUES ('MAKE 2', 0), ('MAKE 0', 1), ('MAKE 9', 2)) s(make, o) USING (make))"
_Q11L = TABLES + _RESOLVED + "SELECT model_year, make, listed, row_number() OVER (PARTITION BY model_year, make ORDER BY listed) AS place FROM (SELECT DISTINCT model_year, make, listed FROM resolved WHERE contains(lower(listed), 'f 1'))"


def q29_own_entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q29."""
    return ops.own_entitlements(derived.entitlements(spark, sf_dir))


_Q29 = TABLES + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY entitlement_id) AS place, kind, plan, car_id, status FROM entitlements"


def q30_runs_of_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each car's newest run and whether one is running. Q30, L10, C34."""
    runs = derived.ledger(spark, sf_dir).selectExpr("event_id AS run_id", "user_id AS car_id", "occurred_at AS started_at", "IF(event_id % 7 = 0, 'running', 'done') AS status", "IF(event_id % 7 = 0, true, NULL) AS is_active", "IF(event_id % 5 = 0, NULL, concat('{\"mode\":\"', kind, '\",\"jobs\":[\"', event_id, '\"]}')) AS counts")
    return ops.runs_of_car(runs)


_Q30 = TABLES + """, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at DESC, event_id DESC) AS n, bool_or(event_id % 7 = 0) OVER (PARTITION BY user_id) AS is_running FROM ledger)
SELECT user_id AS car_id, event_id AS run_id, CASE WHEN event_id % 7 = 0 THEN 'running' ELSE 'done' END AS status, CASE WHEN event_id % 5 <> 0 THEN kind END AS mode, CASE WHEN event_id % 5 <> 0 THEN 1 END AS n_jobs, is_running FROM r WHERE n = 1"""

QUERIES = {f.__name__: f for f in (a20_reread_plans, a21_leftovers, q17_search_gate, d03_revived_cars, q11_years, q11_makes, q11_models, q29_own_entitlements, q30_runs_of_cars)}
ORACLE_SQL = dict(zip(QUERIES, (_A20, _A21, _Q17, _D03, _Q11Y, _Q11M, _Q11L, _Q29, _Q30)))
