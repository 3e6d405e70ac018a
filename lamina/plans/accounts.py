"""Accounts: access, limits, recipients and alerts (Q14-Q17, Q27-Q29, Q31)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import accounts as ops
from lamina.operators import bulletins as lists
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return derived.garage(spark, sf_dir), derived.accounts(spark, sf_dir), derived.entitlements(spark, sf_dir)


def q14_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q14, W10, F13, F21, L14."""
    return ops.access(*_tables(spark, sf_dir)).select("user_id", "car_id", "is_unlocked", "access")


def q15_add_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15, A29, Q31."""
    garage, people, entitled = _tables(spark, sf_dir)
    return ops.add_refusals(people, garage, entitled).select("user_id", "total", "on_plan", "refusal")


_Q15 = """, h AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT is_unlocked) AS on_plan FROM seats GROUP BY 1)
SELECT a.user_id, coalesce(total, 0) AS total, coalesce(on_plan, 0) AS on_plan, CASE WHEN places IS NOT NULL AND NOT is_admin THEN CASE WHEN on_plan >= places THEN 'plan limit' END
 WHEN total >= 10 THEN 'vehicle limit' WHEN NOT is_admin AND places IS NULL AND on_plan >= 2 THEN 'sample limit' END AS refusal
FROM accounts a LEFT JOIN h USING (user_id) LEFT JOIN plan_of USING (user_id)"""


def q27_recipients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q27, F22, C36."""
    garage, people, entitled = _tables(spark, sf_dir)
    return ops.recipients(people, garage, entitled)


_PEOPLE = """, people AS (SELECT a.user_id, is_admin, subscribed_since, CASE WHEN coalesce(last_watermark, subscribed_since) IS NOT NULL OR is_admin THEN coalesce(last_watermark, subscribed_since) ELSE a.created_at END AS since
 FROM accounts a LEFT JOIN plan_of USING (user_id) WHERE NOT unsubscribed AND (is_admin OR subscribed_since IS NOT NULL OR user_id IN (SELECT user_id FROM garage)))
"""


def q16_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q16, W08, T03, T04, U04, C33."""
    garage, people, entitled = _tables(spark, sf_dir)
    told = ops.recipients(people, garage, entitled)
    seats = ops.access(garage, people, entitled).select("user_id", "car_id", "alerts_enabled", "access")
    return ops.alerts(derived.bulletins(spark, sf_dir), derived.links(spark, sf_dir), derived.cars(spark, sf_dir), told, seats)


_Q16 = _PEOPLE + """, w AS (SELECT p.user_id, c.car_id, x.access, c.ready_at, p.since, coalesce(c.ready_at IS NOT NULL AND (p.since IS NULL OR c.ready_at > p.since), false) AS is_ready
  FROM people p JOIN access x USING (user_id) JOIN cars c ON c.car_id = x.car_id WHERE x.alerts_enabled AND (x.access = 'full' OR p.subscribed_since IS NULL)),
 r AS (SELECT w.*, b.bulletin_id, b.stem, b.published, b.severity, CASE WHEN w.is_ready THEN w.ready_at ELSE greatest(b.processed_at, l.first_seen_at) END AS seen
  FROM w JOIN links l USING (car_id) JOIN stemmed b USING (bulletin_id) WHERE b.status = 'processed' AND b.processed_at IS NOT NULL
  AND (w.is_ready OR (l.alert_pending AND (w.since IS NULL OR greatest(b.processed_at, l.first_seen_at) > w.since)))),
 f AS (SELECT *, row_number() OVER (PARTITION BY user_id, car_id, stem ORDER BY published DESC NULLS LAST, bulletin_id DESC) AS rn, count(*) OVER (PARTITION BY user_id, car_id, stem) - 1 AS sup FROM r)
SELECT user_id, car_id, access, is_ready, count(*) AS n_families, count(*) FILTER (WHERE severity = 'serious') AS n_serious, max(published) AS newest, max(seen) AS seen_until, CAST(sum(sup) AS BIGINT) AS superseded FROM f WHERE rn = 1 GROUP BY ALL"""


def q28_my_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's cars with access, families and tiers. Q28, Q29, A03."""
    seats = ops.access(*_tables(spark, sf_dir)).select("user_id", "car_id", "access")
    listed = derived.links(spark, sf_dir).select("car_id", "bulletin_id").join(derived.bulletins(spark, sf_dir), "bulletin_id")
    counts = lists.fold(lists.stemmed(listed), ["car_id", "stem"]).groupBy("car_id").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "serious").alias("serious"), F.max("published").alias("newest"))
    return seats.join(counts, "car_id", "left").fillna(0, ["n", "serious"])


_Q28 = """SELECT x.user_id, x.car_id, x.access, coalesce(n, 0) AS n, coalesce(serious, 0) AS serious, newest FROM access x
LEFT JOIN (SELECT car_id, count(*) AS n, count(*) FILTER (WHERE severity = 'serious') AS serious, max(published) AS newest FROM car_families GROUP BY 1) c ON c.car_id = x.car_id"""

QUERIES = {f.__name__: f for f in (q14_access, q15_add_refusals, q27_recipients, q16_alerts, q28_my_vehicles)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, ("SELECT user_id, car_id, is_unlocked, access FROM access", _Q15, _PEOPLE + "SELECT user_id, is_admin, subscribed_since, since FROM people", _Q16, _Q28))}
