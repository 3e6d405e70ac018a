"""Usage and cost."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import ledger as ops
from lamina.operators.bulletins import half_open
from lamina.plans.oracle import TABLES
from lamina.sources import derived

#: Prices a token of invented models, and of any other.
RATES, FALLBACK = [("m-small", 0.0001, 0.0005), ("m-large", 0.002, 0.01)], (0.0003, 0.0025)


def q13_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and three breakdowns in one pass. A07, F04, C32."""
    return ops.summary(derived.ledger(spark, sf_dir).filter(half_open("occurred_at", datetime(2024, 1, 5), datetime(2024, 1, 25))))


_Q13 = """, l AS (SELECT *, strftime(occurred_at, '%Y-%m-%d') AS day FROM ledger WHERE occurred_at >= TIMESTAMP '2024-01-05' AND occurred_at < TIMESTAMP '2024-01-25')
""" + " UNION ALL ".join(f"SELECT '{b}' AS breakdown, {e} AS label, count(*) AS n_events, round(sum(cost), 4) AS spend, CAST(sum(tokens_in) AS BIGINT) AS tokens_in FROM l GROUP BY 2" for b, e in (("total", "'(all)'"), ("kind", "kind"), ("model", "model"), ("day", "day")))  # fmt: skip


def a08_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by kind and model with subtotals. A08."""
    return derived.ledger(spark, sf_dir).rollup("kind", "model").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("spend"))


def a09_average_of_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09."""
    return ops.two_level_average(derived.ledger(spark, sf_dir))


_A09 = "SELECT kind, round(avg(s), 4) AS avg_spent, round(max(s), 4) AS max_spent, count(*) AS n_accounts FROM (SELECT kind, user_id, sum(cost) AS s FROM ledger GROUP BY ALL) GROUP BY kind"


def a30_monthly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By month and kind, with accounts and the JSON key. A30, A32, C32, C34."""
    return derived.ledger(spark, sf_dir).groupBy(F.trunc("occurred_at", "month").alias("month"), "kind").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("spend"), F.countDistinct("user_id").alias("n_accounts"), F.sum("k").alias("k"))


_A30 = "SELECT CAST(date_trunc('month', occurred_at) AS DATE) AS month, kind, count(*) AS n, round(sum(cost), 2) AS spend, count(DISTINCT user_id) AS n_accounts, CAST(sum(k) AS BIGINT) AS k FROM ledger GROUP BY ALL"


def c18_priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C18, S16."""
    rates = spark.createDataFrame(RATES, "model string, in_rate double, out_rate double")
    return ops.priced(derived.ledger(spark, sf_dir), rates, FALLBACK, F.col("event_id") % 2 == 0).select("event_id", "model", F.round("cost_usd", 6).alias("cost_usd"))


_C18 = """SELECT event_id, model, round((tokens_in * CASE model WHEN 'm-small' THEN 0.0001::DOUBLE WHEN 'm-large' THEN 0.002::DOUBLE ELSE 0.0003::DOUBLE END
 + tokens_out * CASE model WHEN 'm-small' THEN 0.0005::DOUBLE WHEN 'm-large' THEN 0.01::DOUBLE ELSE 0.0025::DOUBLE END) * CASE WHEN event_id % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END, 6) AS cost_usd FROM ledger"""


def q12_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading each car's new bulletins would cost and take. Q12, A11, A12, C20."""
    papers = derived.papers(spark, sf_dir)
    rates = papers.agg((F.sum("tokens_in") * 0.0001 / F.count("*")).alias("per_paper"), F.count("*").alias("n_papers"))
    total = derived.bulletins(spark, sf_dir).agg(F.count("*").alias("n_all"))
    new = derived.links(spark, sf_dir).join(derived.bulletins(spark, sf_dir).filter("status = 'pending'"), "bulletin_id", "left_semi").groupBy("car_id").agg(F.count("*").alias("n_new"))
    both = new.crossJoin(F.broadcast(rates)).crossJoin(F.broadcast(total))  # one row each
    n_papers = F.ceil(F.col("n_new") * F.greatest(F.col("n_papers") / F.col("n_all"), F.lit(1.0)))
    out = both.withColumn("e", ops.estimate(F.col("n_new"), n_papers, F.col("per_paper")))
    return out.select("car_id", "n_new", n_papers.alias("n_papers"), "e.cost_low", "e.cost_high", "e.seconds", "e.duration_text")


_Q12 = """, r AS (SELECT sum(tokens_in) * 0.0001::DOUBLE / count(*) AS per_paper, greatest(count(*)::DOUBLE / (SELECT count(*) FROM bulletins), 1) AS f FROM papers),
 n AS (SELECT car_id, count(*) AS n_new FROM links WHERE bulletin_id IN (SELECT bulletin_id FROM bulletins WHERE status = 'pending') GROUP BY 1),
 p AS (SELECT *, CAST(ceil(n_new * f) AS BIGINT) AS n_papers FROM n, r), s AS (SELECT *, n_new * 0.8::DOUBLE + n_papers * 0.7::DOUBLE AS sec FROM p)
SELECT car_id, n_new, n_papers, round(n_papers * per_paper * 0.75::DOUBLE, 4) AS cost_low, round(n_papers * per_paper * 1.25::DOUBLE, 4) AS cost_high, CAST(floor(sec) AS BIGINT) AS seconds,
 CASE WHEN sec < 60 THEN 'under a minute' WHEN sec < 90 THEN 'about a minute' WHEN sec / 60 < 10 THEN 'around ' || CAST(round_even(sec / 60, 0) AS INT) || ' minutes'
  ELSE CAST(floor(sec * 0.4::DOUBLE / 60) AS INT) || ' to ' || CAST(floor(sec * 1.6::DOUBLE / 60) AS INT) || ' minutes' END AS duration_text FROM s"""


def t06_rolling_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event finds used in the day before it."""
    return ops.rolling_count(derived.ledger(spark, sf_dir)).select("event_id", "used")


_T06 = "SELECT event_id, count(*) OVER (PARTITION BY user_id, kind ORDER BY occurred_at RANGE BETWEEN INTERVAL 86399999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS used FROM ledger"


def t07_sliding_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events a limiter of 3 in 6 hours admits. T07."""
    return ops.sliding_limit(derived.ledger(spark, sf_dir), limit=3, seconds=6 * 3600)


# an account's events in order, with its last three admitted times: the oldest of them decides
_T07 = TABLES.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT event_id, user_id, occurred_at AS t, row_number() OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) AS n FROM ledger),
 s AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS a, NULL::TIMESTAMP AS b, NULL::TIMESTAMP AS c, NULL::BOOLEAN AS allowed FROM ledger GROUP BY user_id
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN ok THEN b ELSE a END, CASE WHEN ok THEN c ELSE b END, CASE WHEN ok THEN t ELSE c END, ok
  FROM (SELECT o.user_id, o.n, o.event_id, o.t, a, b, c, a IS NULL OR a <= o.t - INTERVAL 6 HOUR AS ok FROM s JOIN o ON o.user_id IS NOT DISTINCT FROM s.user_id AND o.n = s.n + 1))
SELECT event_id, user_id, allowed FROM s WHERE n > 0"""


QUERIES = {f.__name__: f for f in (q13_usage_summary, a08_rollup, a09_average_of_sums, a30_monthly_report, c18_priced_usage, q12_preview, t06_rolling_24h, t07_sliding_limiter)}
ORACLE_SQL = {"t07_sliding_limiter": _T07} | {n: TABLES + s for n, s in zip(QUERIES, (_Q13, "SELECT kind, model, count(*) AS n, round(sum(cost), 4) AS spend FROM ledger GROUP BY ROLLUP (kind, model)", _A09, _A30, _C18, _Q12, _T06))}
