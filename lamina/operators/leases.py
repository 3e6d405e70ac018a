"""A queue that is drained by leases: first in, first out, one holder a row.

The queue is a published table: car_id, requested_at, attempts, last_error, holder, leased_until.
A claim writes the rows it takes and publishes them; of two claims that began at one version the
later is refused and begins again on what the first has left, so no row has two holders. A lease
that expired is free again. Each claim opens a batch, and settling it closes the batch once.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.work import MAX_TRIES, at
from lamina.sources.snapshots import LostUpdate, Snapshots

QUEUE = "car_id long, requested_at timestamp_ntz, attempts int, last_error string, holder string, leased_until timestamp_ntz"
BATCHES = "batch string, opened_at timestamp_ntz, n_claimed long, closed_at timestamp_ntz, n_done long, n_failed long"
#: Characters of an error that are kept, and how often a claim that was overtaken begins again.
ERROR_CHARS, CLAIM_TRIES = 500, 20


def waiting(queue: DataFrame, now: datetime) -> DataFrame:
    """Rows that may be claimed: tries left, and no lease that still runs."""
    free = F.col("holder").isNull() | F.coalesce(F.col("leased_until") <= at(now), F.lit(True))
    return queue.filter((F.col("attempts") < MAX_TRIES) & free)


def head(queue: DataFrame, now: datetime, n: int) -> DataFrame:
    """The n rows that have waited longest; top-n is taken in each task first."""
    return waiting(queue, now).orderBy("requested_at", "car_id").limit(n)


def create(store: Snapshots, queue: DataFrame) -> None:
    empty = store.spark.createDataFrame([], BATCHES)
    rows = queue.select("car_id", "requested_at", F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("string").alias("holder"), F.lit(None).cast("timestamp_ntz").alias("leased_until"))
    store.publish(store.stage({"queue": rows, "batches": empty}))


def claim(store: Snapshots, batch: str, now: datetime, n: int, lease: timedelta) -> int:
    """Lease the head of the queue to a batch and record it as open; how many rows it got. A claim that was overtaken begins again."""
    for _ in range(CLAIM_TRIES):
        base = store.version()
        queue = store.read("queue", base)
        taken = head(queue, now, n).select("car_id", F.lit(batch).alias("by"))
        after = queue.join(taken, "car_id", "left").select(
            "car_id", "requested_at", "attempts", "last_error", F.coalesce("by", "holder").alias("holder"), F.when(F.col("by").isNotNull(), at(now + lease)).otherwise(F.col("leased_until")).alias("leased_until")
        )
        stage = store.stage({"queue": after}, base=base)
        written = store.spark.read.schema(QUEUE).parquet(*stage.folders["queue"].values()) if stage.folders["queue"] else store.spark.createDataFrame([], QUEUE)
        got = written.filter(F.col("holder") == batch).count()
        if not got:
            store.discard(stage)
            return 0
        opened = store.spark.createDataFrame([(batch, now, got, None, None, None)], BATCHES)
        more = store.stage({"batches": store.read("batches", base).unionByName(opened)}, base=base)
        stage.folders |= more.folders
        stage.rows |= more.rows
        stage.schemas |= more.schemas
        try:
            store.publish(stage)
            return got
        except LostUpdate:
            store.discard(more)
    raise LostUpdate(f"{batch}: overtaken {CLAIM_TRIES} times")


def held(store: Snapshots, batch: str) -> DataFrame:
    """The rows a batch holds."""
    return store.read("queue").filter(F.col("holder") == batch)


def settle(store: Snapshots, batch: str, results: DataFrame, now: datetime) -> bool:
    """Done rows leave, failed ones count a try and keep the beginning of their error; the batch is closed.

    Rows that the batch no longer holds, as its lease expired and another took them, stay as they
    are. A batch that is closed already changes nothing (False), so settling again is harmless.
    """
    base = store.version()
    queue, batches = store.read("queue", base), store.read("batches", base)
    if batches.filter((F.col("batch") == batch) & F.col("closed_at").isNull()).isEmpty():
        return False
    own = F.col("holder") == batch
    said = results.groupBy("car_id").agg(F.max_by(F.struct("ok", "error"), F.struct("ok", "error")).alias("r")).select("car_id", "r.ok", "r.error")
    both = queue.join(said, "car_id", "left").withColumn("mine", F.coalesce(own & F.col("ok").isNotNull(), F.lit(False)))
    after = both.filter(~(F.col("mine") & F.col("ok"))).select(
        "car_id", "requested_at", (F.col("attempts") + F.col("mine").cast("int")).alias("attempts"), F.when(F.col("mine"), F.left("error", F.lit(ERROR_CHARS))).otherwise(F.col("last_error")).alias("last_error"),
        F.when(~F.coalesce(own, F.lit(False)), F.col("holder")).alias("holder"), F.when(~F.coalesce(own, F.lit(False)), F.col("leased_until")).alias("leased_until"),
    )
    counts = both.filter("mine").agg(F.count_if("ok").alias("n_done"), F.count_if(~F.col("ok")).alias("n_failed"))
    this = F.col("batch") == batch
    closed = batches.crossJoin(F.broadcast(counts.withColumnsRenamed({"n_done": "d", "n_failed": "f"}))).select(  # one row
        "batch", "opened_at", "n_claimed", F.when(this, at(now)).otherwise(F.col("closed_at")).alias("closed_at"), F.when(this, F.col("d")).otherwise(F.col("n_done")).alias("n_done"), F.when(this, F.col("f")).otherwise(F.col("n_failed")).alias("n_failed")
    )
    store.publish(store.stage({"queue": after, "batches": closed}, base=base))
    return True


def drain(store: Snapshots, read: Callable[[DataFrame], DataFrame], now: datetime, n: int, lease: timedelta = timedelta(minutes=30)) -> int:
    """Claim, read and settle batches until nothing waits; how many batches it took. ``read`` gives car_id, ok, error of the rows it is given."""
    number = 0
    while claim(store, f"batch-{number:06d}", now, n, lease):
        settle(store, f"batch-{number:06d}", read(held(store, f"batch-{number:06d}")), now)
        number += 1
    return number


def positions(queue: DataFrame, now: datetime) -> DataFrame:
    """Where each waiting row stands, by requested hour first, so that no task orders the whole queue."""
    hourly = waiting(queue, now).withColumn("hour", F.date_trunc("hour", "requested_at"))
    before = hourly.groupBy("hour").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("hour").orderBy("requested_at", "car_id"))
    return hourly.withColumn("place", place).join(before.drop("n"), "hour").select("car_id", (F.col("ahead") + F.col("place")).alias("position"))
