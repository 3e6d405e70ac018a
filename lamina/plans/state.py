"""Changes as snapshots (D01-D06, D08, D11, J18) and the last runs and heads of queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import state as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def d01_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New details over old rows, status kept, new rows told."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "number", "summary", "status", "attempts")
    incoming = rows.filter("attempts < 3").select("bulletin_id", F.when(F.col("attempts") == 1, F.concat(F.col("number"), F.lit("Z"))).alias("number"), "summary", F.lit("pending").alias("status"))
    return ops.upsert(rows.filter("attempts > 0").drop("attempts"), incoming, "bulletin_id", ["number", "summary"], ["status"])


_D01 = """, c AS (SELECT bulletin_id, number, summary, status FROM bulletins WHERE attempts > 0),
 i AS (SELECT bulletin_id, CASE WHEN attempts = 1 THEN number || 'Z' END AS number, summary, 'pending' AS status FROM bulletins WHERE attempts < 3)
SELECT bulletin_id, coalesce(i.number, c.number) AS number, coalesce(i.summary, c.summary) AS summary, CASE WHEN c.bulletin_id IS NULL THEN i.status ELSE c.status END AS status, c.bulletin_id IS NULL AS inserted
FROM c FULL JOIN i USING (bulletin_id)"""


def d02_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D02, D17, F12, U01."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "status")
    return ops.insert_absent(rows.filter("status = 'processed'"), rows, ["bulletin_id"])


def d05_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed try, passing reasons queued again, read bulletins promoted."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "status", "attempts", "reason")
    tried = ops.after_attempt(rows, F.col("status") == "pending", F.col("attempts") != 1)
    return ops.promoted(ops.requeue_transient(tried), derived.papers(spark, sf_dir))


_D05 = """, a AS (SELECT bulletin_id, CASE WHEN status = 'pending' THEN CASE WHEN attempts = 1 OR attempts + 1 >= 3 THEN 'failed' ELSE 'pending' END ELSE status END AS status, CASE WHEN status = 'pending' THEN attempts + 1 ELSE attempts END AS attempts, reason FROM bulletins),
 p AS (SELECT *, status = 'failed' AND coalesce(reason LIKE 'timeout%' OR reason LIKE 'rate limit%' OR reason LIKE '%(429)%' OR reason LIKE 'connection%', false) AS t FROM a),
 q AS (SELECT bulletin_id, CASE WHEN t THEN 'pending' ELSE status END AS status, CASE WHEN t THEN 0 ELSE attempts END AS attempts, CASE WHEN NOT t THEN reason END AS reason FROM p)
SELECT bulletin_id, CASE WHEN status = 'pending' AND bulletin_id IN (SELECT bulletin_id FROM papers GROUP BY 1 HAVING count(*) FILTER (WHERE paper_summary IS NULL) = 0) THEN 'processed' ELSE status END AS status, attempts, reason FROM q"""


def d08_ready_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D08, F19."""
    rows = derived.bulletins(spark, sf_dir).filter("status <> 'pending' OR CAST(bulletin_id AS BIGINT) % 40 = 0")
    return ops.ready_cars(derived.cars(spark, sf_dir), derived.links(spark, sf_dir), rows)


_D08 = """SELECT l.car_id, count(*) AS n_bulletins FROM links l JOIN bulletins b USING (bulletin_id) WHERE (b.status <> 'pending' OR CAST(bulletin_id AS BIGINT) % 40 = 0)
 AND l.car_id IN (SELECT car_id FROM cars WHERE ready_at IS NULL) GROUP BY 1 HAVING count(*) FILTER (WHERE b.status = 'pending') = 0"""


def d11_apply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come twice count once."""
    events = derived.ledger(spark, sf_dir).select("event_id", "user_id", "kind", "occurred_at")
    return ops.apply_events(events.unionByName(events.filter("event_id % 3 = 0")))


_D11 = """SELECT user_id, last_kind, changed_at, n_applied, CASE WHEN last_kind IN ('purchase', 'signup') THEN 'active' WHEN last_kind = 'error' THEN 'past_due' ELSE 'canceled' END AS status
FROM (SELECT user_id, first(kind ORDER BY occurred_at DESC, event_id DESC) AS last_kind, max(occurred_at) AS changed_at, count(*) AS n_applied FROM ledger GROUP BY 1)"""


def j18_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J18, S11."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "number", "published", "attempts")
    changed = rows.filter("attempts <> 1").withColumn("number", F.when(F.col("attempts") == 2, F.lit(None).cast("string")).otherwise(F.col("number")))
    return ops.difference(rows.filter("attempts < 3"), changed, "bulletin_id", ["number", "published"])


_J18 = """, s AS (SELECT bulletin_id, number, published FROM bulletins WHERE attempts < 3), d AS (SELECT bulletin_id, CASE WHEN attempts <> 2 THEN number END AS number, published FROM bulletins WHERE attempts <> 1)
SELECT bulletin_id, CASE WHEN d.bulletin_id IS NULL THEN 'insert' WHEN s.bulletin_id IS NULL THEN 'extra'
 WHEN s.number IS NOT DISTINCT FROM d.number AND s.published IS NOT DISTINCT FROM d.published THEN 'identical' ELSE 'update' END AS action FROM s FULL JOIN d USING (bulletin_id)"""


def l10_latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each account and its first of a kind still in the queue."""
    rows = derived.ledger(spark, sf_dir)
    queued = F.when(F.col("kind") == "view", F.struct("occurred_at", "event_id"))
    return rows.groupBy("user_id").agg(F.max_by("event_id", F.struct("occurred_at", "event_id")).alias("last_event"), F.min(queued)["event_id"].alias("queue_head"))


_L10 = "SELECT user_id, first(event_id ORDER BY occurred_at DESC, event_id DESC) AS last_event, first(event_id ORDER BY occurred_at, event_id) FILTER (WHERE kind = 'view') AS queue_head FROM ledger GROUP BY 1"

QUERIES = {f.__name__: f for f in (d01_upsert, d02_insert_absent, d05_state_machine, d08_ready_cars, d11_apply_events, j18_difference, l10_latest_runs)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_D01, "SELECT bulletin_id, status FROM bulletins WHERE status <> 'processed'", _D05, _D08, _D11, _J18, _L10))}
