"""Ingest, publication, queues and re-keying that change stored tables.

Each query works in a new folder of its own below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import leases, publish, vocabulary
from lamina.plans.oracle import TABLES
from lamina.sources import derived
from lamina.sources.snapshots import Snapshots, shared_folder
from lamina.streaming import ingest

RAW = "raw_id string, raw_make string, raw_model string, raw_years string, summary string, source_window string"
LANDED, NOW = datetime(2024, 1, 1), datetime(2024, 1, 20)


def _landed(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Two windows, then one of them again with rows withdrawn, then one whose etag is unchanged: each lands with a notice after its rows."""
    rows = derived.filed_rows(spark, sf_dir)
    deliveries = [("2015-2019", "a", F.lit(True)), ("2020-2024", "a", F.lit(True)), ("2020-2024", "b", ~F.col("raw_model").startswith("F  ")), ("2015-2019", "a", F.lit(False))]
    for i, (window, etag, kept) in enumerate(deliveries):
        path = f"{folder}/rows/{i}"
        rows.filter((F.col("source_window") == window) & kept).write.parquet(path)
        notice = spark.createDataFrame([(window, etag, LANDED + timedelta(days=i), path)], ingest.NOTICE)
        notice.coalesce(1).write.mode("append").parquet(f"{folder}/notices")


def _ingested(spark: SparkSession, sf_dir: str) -> Snapshots:
    folder = shared_folder(spark, "ingest")
    _landed(spark, sf_dir, folder)
    store = Snapshots(spark, f"{folder}/store")
    ingest.run_ingest(store, f"{folder}/notices", f"{folder}/checkpoint", RAW)
    return store


def t01_ingested_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after four notices were streamed: a changed window replaced its own rows, an unchanged one nothing. T01, S02, S05, D04, A01."""
    return _ingested(spark, sf_dir).read("vocabulary")


_WITHDRAWN = TABLES.replace("FROM filed\n WHERE", "FROM filed\n WHERE NOT (source_window = '2020-2024' AND starts_with(raw_model, 'F  ')) AND", 1)
_T01 = _WITHDRAWN + "SELECT model_year, make, model, source_window, bulletins FROM vocabulary"


def s02_missing_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars that have not been scanned against a window's published etag. S02, J06, F11."""
    store = _ingested(spark, sf_dir)
    cars = derived.cars(spark, sf_dir).select("car_id")
    scans = cars.selectExpr("car_id", "explode(array('2015-2019', '2020-2024')) AS source_window").selectExpr("car_id", "source_window", "CASE WHEN car_id % 3 = 0 THEN 'b' WHEN car_id % 3 = 1 THEN 'a' END AS etag")
    return ingest.missing_scans(store, scans)


_S02 = TABLES + """SELECT car_id, w.source_window FROM cars, (VALUES ('2015-2019', 'a'), ('2020-2024', 'b')) w(source_window, etag)
WHERE (CASE WHEN car_id % 3 = 0 THEN 'b' WHEN car_id % 3 = 1 THEN 'a' END) IS DISTINCT FROM w.etag"""


def s11_published_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table by a dry run, by the real run, and as a reader of the version before still sees them. S05, S11, J18."""
    store = Snapshots(spark, f"{shared_folder(spark, 'index')}/store")
    cars, vocab = derived.cars(spark, sf_dir), vocabulary.vocabulary(vocabulary.clean_rows(derived.filed_rows(spark, sf_dir)))
    links = derived.links(spark, sf_dir).select("bulletin_id", "car_id", "first_seen_at")
    by = {"vocabulary": "source_window"}
    publish.copied_index(store, {"vocabulary": vocab, "links": links}, cars, by)
    source, here = {"vocabulary": vocab.filter("source_window = '2020-2024'"), "links": links}, cars.filter("car_id % 2 = 0")
    before = store.version()
    dry = publish.copied_index(store, source, here, by, dry_run=True)
    unmoved = store.version() == before
    wet = publish.copied_index(store, source, here, by)
    old = {t: store.read(t, before).count() for t in source}
    now = {t: store.read(t).count() for t in source}
    rows = [(t, dry[t], wet[t], now[t], old[t], wet["dropped"], unmoved) for t in source]
    return spark.createDataFrame(rows, "table_name string, dry_rows long, written_rows long, published_rows long, rows_before long, n_dropped long, dry_run_left_nothing boolean")


_S11 = TABLES + """, v AS (SELECT count(*) AS old, count(*) FILTER (WHERE source_window = '2020-2024') AS n FROM vocabulary),
 l AS (SELECT count(*) FILTER (WHERE car_id IN (SELECT car_id FROM cars)) AS old, count(*) FILTER (WHERE car_id IN (SELECT car_id FROM cars WHERE car_id % 2 = 0)) AS n, count(*) AS n_all FROM links)
SELECT 'vocabulary' AS table_name, v.n AS dry_rows, v.n AS written_rows, v.n AS published_rows, v.old AS rows_before, n_all - l.n AS n_dropped, true AS dry_run_left_nothing FROM v, l
UNION ALL SELECT 'links', n, n, n, old, n_all - n, true FROM l"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.accounts(spark, sf_dir).selectExpr("concat('token-of-account-', lpad(CAST(user_id AS STRING), 8, '0')) AS token", "user_id", "unsubscribed", "1L AS row_version")


_STATES = ", states AS (SELECT 'token-of-account-' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS token, user_id, unsubscribed FROM accounts)"


def d12_unsubscribed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published table after two rounds of tokens, some used twice, unknown or misshapen, and each row's last outcome. D12, F21, F24."""
    store = Snapshots(spark, f"{shared_folder(spark, 'states')}/store")
    states = _states(spark, sf_dir)
    store.publish(store.stage({"states": states}))
    tokens = states.filter("user_id % 5 = 0").select("token").unionByName(states.filter("user_id % 10 = 0").select("token")).unionByName(states.selectExpr("concat('?', token) AS token"))
    publish.unsubscribe(store, tokens)
    table, outcomes = publish.unsubscribe(store, states.filter("user_id % 3 = 0").select("token"))
    return table.join(outcomes, "token", "left").select("token", "user_id", "unsubscribed", "row_version", "outcome")


_D12 = TABLES + _STATES + """, one AS (SELECT *, unsubscribed OR user_id % 5 = 0 AS u1 FROM states)
SELECT token, user_id, u1 OR user_id % 3 = 0 AS unsubscribed, 1 + CAST(u1 AND NOT unsubscribed AS BIGINT) + CAST(NOT u1 AND user_id % 3 = 0 AS BIGINT) AS row_version,
 CASE WHEN user_id % 3 = 0 THEN CASE WHEN u1 THEN 'already' ELSE 'unsubscribed' END END AS outcome FROM one"""


def _rekeyed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of three: car 3 goes into 2, that into 1, that into 0; half the survivors get a new name."""
    cars = derived.cars(spark, sf_dir).selectExpr("car_id", "year", "make", "model", "array('car', lower(make), lower(model)) AS keywords", "car_id % 8 = 3 AS active")
    plan = cars.selectExpr("car_id", "CASE WHEN car_id % 4 <> 0 THEN car_id - 1 END AS into", "CASE WHEN car_id % 8 = 0 THEN concat(model, ' PLAIN') END AS model_after")
    links = derived.links(spark, sf_dir).join(cars.select("car_id", "keywords"), "car_id").select("bulletin_id", "car_id", "keywords", "first_seen_at")
    runs = derived.garage(spark, sf_dir).selectExpr("user_id * 100 + car_id AS run_id", "car_id")
    return publish.rekeyed(cars, links, runs, plan)


def q21_rekeyed_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars after the merge, and the runs that moved to them. Q21, U05."""
    cars, _, runs = _rekeyed(spark, sf_dir)
    ran = runs.groupBy("car_id").agg(F.count("*").alias("n_runs"))
    return cars.join(ran, "car_id", "left").select("car_id", "year", "make", "model", F.array_join("keywords", ",").alias("keywords"), "active", F.coalesce("n_runs", F.lit(0)).alias("n_runs"))


def q21_rekeyed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links after the merge: one for each bulletin and survivor. Q21, A14, A15, C33."""
    return _rekeyed(spark, sf_dir)[1].select("bulletin_id", "car_id", F.array_join("keywords", ",").alias("keywords"), "first_seen_at")


_KEYED = TABLES + """, k AS (SELECT *, car_id - car_id % 4 AS survivor, ['car', lower(make), lower(model)] AS words, car_id % 8 = 3 AS active FROM cars)"""
_Q21C = _KEYED + """, w AS (SELECT survivor, string_agg(DISTINCT word, ',' ORDER BY word) AS keywords FROM (SELECT survivor, unnest(words) AS word FROM k) GROUP BY 1),
 a AS (SELECT survivor, bool_or(active) AS active FROM k GROUP BY 1), r AS (SELECT car_id - car_id % 4 AS survivor, count(*) AS n FROM garage GROUP BY 1)
SELECT k.car_id, year, make, CASE WHEN k.car_id % 8 = 0 THEN model || ' PLAIN' ELSE model END AS model, w.keywords, a.active, coalesce(r.n, 0) AS n_runs
FROM k JOIN w USING (survivor) JOIN a USING (survivor) LEFT JOIN r USING (survivor) WHERE k.car_id = survivor"""
_Q21L = _KEYED + """SELECT bulletin_id, survivor AS car_id, string_agg(DISTINCT word, ',' ORDER BY word) AS keywords, min(first_seen_at) AS first_seen_at
FROM (SELECT l.bulletin_id, k.survivor, l.first_seen_at, unnest(k.words) AS word FROM links l JOIN k USING (car_id)) GROUP BY ALL"""


def _queued(spark: SparkSession, sf_dir: str) -> Snapshots:
    store = Snapshots(spark, f"{shared_folder(spark, 'queue')}/store")
    leases.create(store, derived.cars(spark, sf_dir).selectExpr("car_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(car_id % 97 AS INT)) AS requested_at"))
    return store


def _read_cars(rows: DataFrame) -> DataFrame:
    """Every fifth car fails."""
    return rows.selectExpr("car_id", "car_id % 5 <> 0 AS ok", "CASE WHEN car_id % 5 = 0 THEN concat(repeat('no answer ', 60), CAST(car_id AS STRING)) END AS error")


def t02_drained_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a queue drained by leases: cars that failed three times, with the totals of the batches. T02, L11, D16, D17, C37."""
    store = _queued(spark, sf_dir)
    n = max(1, derived.cars(spark, sf_dir).count() // 2)  # half the queue a batch
    leases.drain(store, _read_cars, NOW, n)
    totals = store.read("batches").agg(F.count_if(F.col("closed_at").isNull()).alias("n_open"), F.sum("n_claimed").alias("n_claimed"), F.sum("n_done").alias("n_done"), F.sum("n_failed").alias("n_failed"))
    return store.read("queue").crossJoin(F.broadcast(totals)).select("car_id", "attempts", "last_error", "holder", "n_open", "n_claimed", "n_done", "n_failed")  # one row of totals


_T02 = TABLES + """, t AS (SELECT count(*) FILTER (WHERE car_id % 5 <> 0) AS good, count(*) FILTER (WHERE car_id % 5 = 0) AS bad FROM cars)
SELECT car_id, 3 AS attempts, left(repeat('no answer ', 60) || car_id, 500) AS last_error, CAST(NULL AS VARCHAR) AS holder, 0 AS n_open, good + 3 * bad AS n_claimed, good AS n_done, 3 * bad AS n_failed FROM cars, t WHERE car_id % 5 = 0"""


def l11_claimed_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two claims one after the other: who holds the rows that have waited longest, and where the rest stand. L11, T02, F19."""
    store = _queued(spark, sf_dir)
    for worker in ("w1", "w2"):
        leases.claim(store, worker, NOW, 40, timedelta(minutes=30))
    queue = store.read("queue")
    return queue.join(leases.positions(queue, NOW), "car_id", "left").select("car_id", "holder", "position")


_L11 = TABLES + """, q AS (SELECT car_id, row_number() OVER (ORDER BY car_id % 97, car_id) AS n FROM cars)
SELECT car_id, CASE WHEN n <= 40 THEN 'w1' WHEN n <= 80 THEN 'w2' END AS holder, CASE WHEN n > 80 THEN n - 80 END AS position FROM q"""

QUERIES = {f.__name__: f for f in (t01_ingested_vocabulary, s02_missing_scans, s11_published_index, d12_unsubscribed_table, q21_rekeyed_cars, q21_rekeyed_links, t02_drained_queue, l11_claimed_head)}
ORACLE_SQL = dict(zip(QUERIES, (_T01, _S02, _S11, _D12, _Q21C, _Q21L, _T02, _L11)))
