"""Queues, run logs and guarded updates."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import state, work
from lamina.plans.oracle import TABLES
from lamina.sources import derived

NOW, THEN = datetime(2024, 1, 20), datetime(1998, 6, 1)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log: batches that are sent and collected, as JSON counts."""
    return derived.ledger(spark, sf_dir).selectExpr(
        "event_id AS run_id", "if(event_id % 5 = 0, 'sync', 'llm') AS job",
        """concat('{"mode":"', CASE WHEN event_id % 4 = 0 THEN 'batch-submitted' WHEN event_id % 12 = 1 THEN 'batch' ELSE 'live' END, '","jobs":["b', event_id DIV 8, '","b', event_id DIV 8 + 1, '"]}') AS counts""",
        "event_id % 7 = 0 AS is_active", "if(event_id % 7 = 0, 'running', 'done') AS status", "occurred_at AS heartbeat_at",
    )


_RUNS = """, runs AS (SELECT event_id AS run_id, CASE WHEN event_id % 5 = 0 THEN 'sync' ELSE 'llm' END AS job,
 '{"mode":"' || CASE WHEN event_id % 4 = 0 THEN 'batch-submitted' WHEN event_id % 12 = 1 THEN 'batch' ELSE 'live' END || '","jobs":["b' || (event_id // 8) || '","b' || (event_id // 8 + 1) || '"]}' AS counts,
 event_id % 7 = 0 AS is_active, CASE WHEN event_id % 7 = 0 THEN 'running' ELSE 'done' END AS status, occurred_at AS heartbeat_at FROM ledger)"""


def f18_reaped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs without a heartbeat for 30 minutes."""
    return work.reaped(_runs(spark, sf_dir), NOW).select("run_id", "status", "is_active", "error")


_F18 = _RUNS + """, g AS (SELECT *, is_active AND heartbeat_at < TIMESTAMP '2024-01-20' - INTERVAL 30 MINUTE AS gone FROM runs)
SELECT run_id, CASE WHEN gone THEN 'failed' ELSE status END AS status, is_active AND NOT gone AS is_active, CASE WHEN gone THEN 'the run stopped reporting and was assumed abandoned' END AS error FROM g"""


def a28_open_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28, C34."""
    return work.open_batches(_runs(spark, sf_dir))


_OPEN = _RUNS + """, said AS (SELECT json_extract_string(counts, '$.mode') AS mode, unnest(CAST(json_extract(counts, '$.jobs') AS VARCHAR[])) AS batch FROM runs WHERE job = 'llm'),
 open_ AS (SELECT DISTINCT batch FROM said WHERE mode = 'batch-submitted' AND batch NOT IN (SELECT batch FROM said WHERE mode = 'batch'))"""


def f19_claimable_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents a reader may claim."""
    papers = derived.papers(spark, sf_dir).withColumns({"is_extracted": F.col("audience") != "both", "batch": F.concat(F.lit("b"), (F.col("paper_id") % 5000).cast("string"))})
    found = work.claimable(papers, derived.bulletins(spark, sf_dir), work.open_batches(_runs(spark, sf_dir)))
    return found.select("paper_id", "bulletin_id", "number", "batch")


_F19 = _OPEN + """ SELECT p.paper_id, p.bulletin_id, b.number, 'b' || (p.paper_id % 5000) AS batch FROM papers p JOIN bulletins b USING (bulletin_id)
WHERE p.audience <> 'both' AND p.paper_summary IS NULL AND b.status = 'pending' AND 'b' || (p.paper_id % 5000) NOT IN (SELECT batch FROM open_)"""


def d16_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars queued again, tried, done or failed; claimable while tries are left."""
    cars = derived.cars(spark, sf_dir)
    queue = cars.filter("car_id % 3 = 0").select("car_id", (F.col("car_id") % 5).cast("int").alias("attempts"), F.when(F.col("car_id") % 5 > 0, "timeout").alias("last_error"))
    results = cars.filter("car_id % 7 < 2").select("car_id", (F.col("car_id") % 7 == 0).alias("ok"), F.when(F.col("car_id") % 7 == 1, F.concat(F.lit("bad answer for "), F.col("make"))).alias("error"))
    out = work.settled(work.enqueued(queue, cars.filter("car_id % 2 = 0")), results)
    return out.withColumn("claimable", F.col("attempts") < work.MAX_TRIES)


_D16 = """, q AS (SELECT car_id, CAST(CASE WHEN car_id % 2 = 0 THEN 0 ELSE car_id % 5 END AS INT) AS attempts, CASE WHEN car_id % 2 <> 0 AND car_id % 5 > 0 THEN 'timeout' END AS last_error, make FROM cars WHERE car_id % 3 = 0 OR car_id % 2 = 0),
 s AS (SELECT car_id, CASE WHEN car_id % 7 = 1 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN car_id % 7 = 1 THEN 'bad answer for ' || make ELSE last_error END AS last_error FROM q WHERE car_id % 7 <> 0)
SELECT car_id, attempts, last_error, attempts < 3 AS claimable FROM s"""


def s17_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of each kind recorded beside those there are."""
    runs = derived.ledger(spark, sf_dir).groupBy(F.col("kind").alias("job")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("accounts"), F.round(F.sum("cost"), 4).alias("cost_usd"))
    log = _runs(spark, sf_dir).select("job", "counts", F.lit(0.0).alias("cost_usd"))
    return work.logged(log, runs, ["n", "accounts"])


_S17 = _RUNS + """ SELECT job, counts, 0.0::DOUBLE AS cost_usd FROM runs UNION ALL
SELECT kind, CAST(json_object('n', count(*), 'accounts', count(DISTINCT user_id)) AS VARCHAR), round(sum(cost), 4) FROM ledger GROUP BY kind"""


def s16_ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage added to the ledger once by id."""
    rows = derived.ledger(spark, sf_dir).select("event_id", "kind", "cost")
    ledger, usage = rows.filter("event_id % 3 <> 0"), rows.filter("event_id % 2 = 0").withColumn("cost", F.col("cost") * 2)
    return ledger.unionByName(state.insert_absent(ledger, usage, ["event_id"]))


_S16 = "SELECT event_id, kind, CASE WHEN event_id % 3 <> 0 THEN cost ELSE cost * 2 END AS cost FROM ledger WHERE event_id % 3 <> 0 OR event_id % 2 = 0"


def d10_partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords set, cleared or left; removed cars stay, inactive, and take no change."""
    cars = derived.cars(spark, sf_dir).select("car_id", F.array(F.lower("make")).alias("keywords"), (F.col("car_id") % 10 != 3).alias("active"))
    new = F.when(F.col("car_id") % 4 == 0, F.array(F.lit("brakes"), F.lit("screen"))).when(F.col("car_id") % 4 == 1, F.array().cast("array<string>"))
    after = work.patched(work.deactivated(cars, cars.filter("car_id % 9 = 0"), "car_id"), cars.filter("car_id % 4 < 3").select("car_id", new.alias("keywords")), "car_id", ["keywords"])
    return after.select("car_id", F.array_join("keywords", "|").alias("keywords"), "active")


_D10 = """, a AS (SELECT *, car_id % 10 <> 3 AND car_id % 9 <> 0 AS active FROM cars)
SELECT car_id, CASE WHEN active AND car_id % 4 = 0 THEN 'brakes|screen' WHEN active AND car_id % 4 = 1 THEN '' ELSE lower(make) END AS keywords, active FROM a"""


def d07_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late documents of bulletins that stood by their summary."""
    rows = derived.bulletins(spark, sf_dir).withColumn("reason", F.when((F.col("status") == "processed") & (F.col("attempts") > 1), "summary only").otherwise(F.col("reason")))
    late = derived.papers(spark, sf_dir).filter("paper_id % 10 > 4")
    return work.reopened(rows, late, "summary only").select("bulletin_id", "status", "processed_at", "reason")


_D07 = """, r AS (SELECT * REPLACE (CASE WHEN status = 'processed' AND attempts > 1 THEN 'summary only' ELSE reason END AS reason) FROM bulletins),
 w AS (SELECT *, coalesce(reason = 'summary only', false) AND bulletin_id IN (SELECT bulletin_id FROM papers WHERE paper_id % 10 > 4) AS again FROM r)
SELECT bulletin_id, CASE WHEN again THEN 'pending' ELSE status END AS status, CASE WHEN NOT again THEN processed_at END AS processed_at, CASE WHEN NOT again THEN reason END AS reason FROM w"""


def d09_first_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of scanned cars, held back by a missing history until its links are old."""
    cars = derived.cars(spark, sf_dir).select("car_id", "ready_at", (F.col("car_id") % 2 == 0).alias("is_missing"))
    links = derived.links(spark, sf_dir).filter(F.col("first_seen_at") > F.lit(datetime(1998, 5, 1)))
    return work.first_synced(cars, cars.filter("car_id % 5 <> 0"), links, THEN).select("car_id", "ready_at")


_D09 = """, o AS (SELECT car_id, min(first_seen_at) AS oldest FROM links WHERE first_seen_at > TIMESTAMP '1998-05-01' GROUP BY 1)
SELECT car_id, CASE WHEN ready_at IS NULL AND car_id % 5 <> 0 AND (car_id % 2 <> 0 OR coalesce(oldest < TIMESTAMP '1998-06-01' - INTERVAL 3 DAY, false)) THEN TIMESTAMP '1998-06-01' ELSE ready_at END AS ready_at
FROM cars LEFT JOIN o USING (car_id)"""


def d12_unsubscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that are known, used up, unknown or no tokens at all."""
    people = derived.accounts(spark, sf_dir).withColumn("token", F.left(F.sha2(F.col("user_id").cast("string"), 256), F.lit(24)))
    asked = people.select(F.when(F.col("user_id") % 4 == 1, F.concat(F.col("token"), F.lit("!"))).when(F.col("user_id") % 4 == 2, F.left("token", F.lit(8))).when(F.col("user_id") % 4 == 3, F.reverse("token")).otherwise(F.col("token")).alias("token"))
    return work.unsubscribed(people, asked)


_D12 = """, t AS (SELECT *, left(sha256(CAST(user_id AS VARCHAR)), 24) AS token FROM accounts),
 q AS (SELECT CASE user_id % 4 WHEN 1 THEN token || '!' WHEN 2 THEN left(token, 8) WHEN 3 THEN reverse(token) ELSE token END AS token FROM t)
SELECT q.token, CASE WHEN regexp_full_match(q.token, '[A-Za-z0-9_-]{16,128}') THEN CASE WHEN t.unsubscribed THEN 'already' WHEN NOT t.unsubscribed THEN 'unsubscribed' END END AS outcome FROM q LEFT JOIN t ON t.token = q.token"""


def t04_cleared_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced links lose their flag, given as two parallel lists for each of them."""
    links = derived.links(spark, sf_dir)
    told = links.filter("alert_pending AND car_id % 4 = 1").groupBy("car_id", F.year("first_seen_at")).agg(F.collect_list("bulletin_id").alias("b"))
    told = told.withColumn("c", F.transform("b", lambda _: F.col("car_id")))
    return work.flags_cleared(links, F.col("b"), F.col("c"), told.drop("car_id"))


_T04 = "SELECT bulletin_id, car_id, first_seen_at, alert_pending AND car_id % 4 <> 1 AS alert_pending FROM links"


def j13_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest link where a car has no last fetch."""
    cars = derived.cars(spark, sf_dir).select("car_id", F.col("ready_at").alias("last_fetched"))
    return work.backfilled(cars, derived.links(spark, sf_dir), "car_id", "last_fetched", F.max("first_seen_at"))


_J13 = "SELECT car_id, coalesce(ready_at, (SELECT max(first_seen_at) FROM links l WHERE l.car_id = c.car_id)) AS last_fetched FROM cars c"


def l16_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest known customer id of each account."""
    rows = derived.ledger(spark, sf_dir).select("user_id", "event_id", F.when(F.col("event_id") % 30 == 0, F.concat(F.lit("cus_"), F.col("event_id").cast("string"))).alias("customer"))
    return work.newest_known(rows, "user_id", "event_id", "customer")


_L16 = "SELECT user_id, arg_max('cus_' || event_id, event_id) FILTER (WHERE event_id % 30 = 0) AS customer FROM ledger GROUP BY 1"


def q15_removal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: what each subscriber may still remove this month."""
    removals = derived.ledger(spark, sf_dir).filter("kind = 'error'").select("user_id", (F.col("occurred_at") - F.make_interval(days=F.lit(15))).alias("removed_at"))
    return work.removal_states(derived.accounts(spark, sf_dir), derived.entitlements(spark, sf_dir), removals, NOW)


_Q15R = """, p AS (SELECT user_id, CASE WHEN bool_or(plan = 'all_access') THEN 'all_access' ELSE 'monthly' END AS plan FROM entitlements WHERE kind = 'subscription' AND status = 'active' GROUP BY 1),
 u AS (SELECT user_id, count(*) AS used FROM ledger WHERE kind = 'error' AND occurred_at - INTERVAL 15 DAY >= TIMESTAMP '2024-01-01' GROUP BY 1)
SELECT user_id, plan, CASE plan WHEN 'all_access' THEN 5 ELSE 1 END AS limit, coalesce(used, 0) AS used, DATE '2024-02-01' AS resets_on FROM accounts JOIN p USING (user_id) LEFT JOIN u USING (user_id) WHERE NOT is_admin"""


def q31_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q31: purchases asked for cars that an account has, and for one it may not have."""
    garage = derived.garage(spark, sf_dir)
    asked = garage.select("user_id", (F.col("car_id") + F.col("user_id") % 2).alias("car_id"), F.when((F.col("user_id") + F.col("car_id")) % 3 == 0, "subscription").otherwise("unlock").alias("kind"))
    return work.checkout_refusals(asked, garage, derived.entitlements(spark, sf_dir))


_Q31 = """, r AS (SELECT user_id, car_id + user_id % 2 AS car_id, CASE WHEN (user_id + car_id) % 3 = 0 THEN 'subscription' ELSE 'unlock' END AS kind FROM garage)
SELECT user_id, car_id, kind, CASE WHEN kind = 'unlock' THEN CASE WHEN (user_id, car_id) NOT IN (SELECT (user_id, car_id) FROM garage) THEN 'vehicle not found'
  WHEN EXISTS (SELECT 1 FROM entitlements e WHERE e.user_id = r.user_id AND e.car_id = r.car_id AND e.kind = 'unlock' AND e.status = 'active') THEN 'already unlocked' END
 WHEN EXISTS (SELECT 1 FROM entitlements e WHERE e.user_id = r.user_id AND e.kind = 'subscription' AND e.status = 'active') THEN 'already subscribed' END AS refusal FROM r"""


def s15_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a destination lacks of a schema."""
    wanted = spark.createDataFrame([(t, c) for t in ("documents", "labels") for c in ("doc_id", "text", "quality", "revision")], "table_name string, column_name string")
    return work.missing_columns({t: derived.read(spark, sf_dir, t) for t in ("documents", "labels")}, wanted)


_S15 = """SELECT t AS table_name, c AS column_name FROM (VALUES ('documents'), ('labels')) a(t), (VALUES ('doc_id'), ('text'), ('quality'), ('revision')) b(c)
WHERE NOT EXISTS (SELECT 1 FROM duckdb_columns() d WHERE d.table_name = t AND d.column_name = c)"""

QUERIES = {f.__name__: f for f in (f18_reaped_runs, a28_open_batches, f19_claimable_papers, d16_queue, s17_run_log, s16_ledger_append, d10_partial_update, d07_reopened, d09_first_sync, d12_unsubscribe, t04_cleared_flags, j13_backfills, l16_customers, q15_removal_states, q31_checkout)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_F18, _OPEN + " SELECT batch FROM open_", _F19, _D16, _S17, _S16, _D10, _D07, _D09, _D12, _T04, _J13, _L16, _Q15R, _Q31))}
QUERIES |= {"s15_missing_columns": s15_missing_columns}
ORACLE_SQL |= {"s15_missing_columns": _S15}
