"""Rolling counts and the limiter's runs by time blocks, against plain windows, with one account of a third of all events."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.operators import ledger

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(3000):
        user = 1 if i % 3 == 0 else int(rng.integers(2, 40))
        when = START + timedelta(seconds=int(rng.integers(0, 20 * 86400)) // (1 + i % 2) // 60 * 60)  # many equal times
        rows.append((i, when, user, "a" if i % 4 else "b"))
    rows += [(3000, None, 1, "a"), (3001, None, 1, "a"), (3002, START, None, "a"), (3003, START, None, "a"), (5, rows[5][1], rows[5][2], rows[5][3])]  # no time, no account, a repeated row
    return spark.createDataFrame(rows, "event_id long, occurred_at timestamp_ntz, user_id long, kind string").cache()


def plain(events, hours):
    us = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    back = Window.partitionBy("user_id", "kind").orderBy("us").rangeBetween(-hours * 3_600_000_000 + 1, 0)
    return events.withColumn("us", us).withColumn("used", F.count("*").over(back)).drop("us")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))


@pytest.mark.parametrize(("hours", "blocks"), [(24, 24), (24, 1), (1, 4), (200, 8)])
def test_counts_equal_a_plain_window(events, hours, blocks):
    same(ledger.rolling_count(events, hours, blocks), plain(events, hours))


def test_hours_that_are_no_whole_number_of_blocks(events):
    with pytest.raises(ValueError):
        ledger.rolling_count(events, 1, 7)


def test_no_events(events):
    assert ledger.rolling_count(events.limit(0)).count() == 0
    assert ledger.sliding_limit(events.limit(0)).count() == 0


@pytest.mark.parametrize("minutes", [5, 60, 600])
def test_runs_equal_plain_gaps(events, minutes):
    window = minutes * 60_000_000
    timed = events.filter("occurred_at IS NOT NULL").select("event_id", "user_id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"))
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    began = F.when(F.coalesce(F.col("us") - F.lag("us").over(order) >= window, F.lit(True)), F.col("us"))
    want = timed.withColumn("began", began).withColumn("run", F.max("began").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("began")
    same(ledger.quiet_runs(timed, window), want)


def test_a_hot_account_is_ordered_in_blocks(spark):
    hot = spark.range(30_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS occurred_at", "IF(id % 3 = 0, 1, id % 500) AS user_id", "'a' AS kind")
    placed = ledger.rolling_count(hot).withColumn("task", F.spark_partition_id())
    plan = placed._jdf.queryExecution().analyzed().toString()
    assert "[user_id" in plan and "block" in plan
    assert placed.agg(F.max("used")).first()[0] <= 24 * 60
    hours = hot.filter("user_id = 1").groupBy(F.date_trunc("hour", "occurred_at")).count()
    assert hours.agg(F.max("count")).first()[0] <= 60  # what a task orders at most, of an account of 10,000 events
