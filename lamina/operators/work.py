"""Work that waits, runs that report, and guarded updates; each function returns a table after the change."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reaped run says, tries before a queued car is left alone, days after which a first sync counts as done, removals a plan allows in a month, and the shape of a token.
ABANDONED, MAX_TRIES, GIVE_UP_DAYS = "the run stopped reporting and was assumed abandoned", 3, 3
PLAN_REMOVALS = {"monthly": 1, "all_access": 5}
TOKEN_SHAPE = r"^[A-Za-z0-9_-]{16,128}$"


def at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def reaped(runs: DataFrame, now: datetime, minutes: int = 30) -> DataFrame:
    """Active runs without a heartbeat for so long are failed and give up their lock; one that never had a heartbeat keeps it."""
    gone = F.coalesce(F.col("is_active") & (F.col("heartbeat_at") < at(now) - F.make_interval(mins=F.lit(minutes))), F.lit(False))
    return runs.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "error": F.when(gone, ABANDONED), "is_active": F.col("is_active") & ~gone})


def open_batches(runs: DataFrame) -> DataFrame:
    """Batch ids of the run log that were submitted and never collected."""
    said = runs.filter(F.col("job") == "llm").select(F.from_json("counts", "mode string, jobs array<string>").alias("c")).select("c.mode", F.explode("c.jobs").alias("batch"))
    return said.filter("mode = 'batch-submitted'").select("batch").distinct().join(said.filter("mode = 'batch'"), "batch", "left_anti")


def claimable(papers: DataFrame, bulletins: DataFrame, out: DataFrame) -> DataFrame:
    """Documents to read next: extracted, without a summary, of a pending bulletin, in no batch that is still out."""
    waiting = papers.filter(F.col("is_extracted") & F.col("paper_summary").isNull())
    return waiting.join(bulletins.filter("status = 'pending'").select("bulletin_id", "number"), "bulletin_id").join(out, "batch", "left_anti")


def enqueued(queue: DataFrame, cars: DataFrame) -> DataFrame:
    """Cars join the queue; one that waits already gets its tries back and loses its error."""
    both = queue.withColumn("was", F.lit(True)).join(cars.select("car_id").distinct().withColumn("asked", F.lit(True)), "car_id", "full_outer")
    return both.select("car_id", F.when(F.col("asked"), 0).otherwise(F.col("attempts")).alias("attempts"), F.when(F.col("asked").isNull(), F.col("last_error")).alias("last_error"))


def settled(queue: DataFrame, results: DataFrame) -> DataFrame:
    """After tries: done cars leave, failed ones count one more and keep the beginning of their error."""
    both = queue.join(results, "car_id", "left").filter(F.coalesce(F.col("ok"), F.lit(False)) == F.lit(False))
    failed = F.col("ok") == F.lit(False)
    return both.select("car_id", F.when(failed, F.col("attempts") + 1).otherwise(F.col("attempts")).alias("attempts"), F.when(failed, F.left("error", F.lit(500))).otherwise(F.col("last_error")).alias("last_error"))


def logged(log: DataFrame, runs: DataFrame, counts: Sequence[str]) -> DataFrame:
    """The run log with runs added, their counts as JSON."""
    return log.unionByName(runs.withColumn("counts", F.to_json(F.struct(*counts))).select(*log.columns))


def patched(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Active rows take the changes that are not null, so an empty list clears and null leaves."""
    new = changes.select(key, *(F.col(c).alias(f"{c}_new") for c in columns))
    taken = {c: F.when(F.col("active"), F.coalesce(f"{c}_new", c)).otherwise(F.col(c)) for c in columns}
    return rows.join(new, key, "left").withColumns(taken).select(*rows.columns)


def deactivated(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """A soft delete: rows stay and are inactive."""
    return rows.join(gone.select(key).distinct().withColumn("gone", F.lit(True)), key, "left").withColumn("active", F.col("active") & F.col("gone").isNull()).select(*rows.columns)


def reopened(bulletins: DataFrame, late: DataFrame, marker: str) -> DataFrame:
    """Bulletins that stood by their summary alone are pending again when a document comes late; any other state stays."""
    both = bulletins.join(late.select("bulletin_id").distinct().withColumn("late", F.lit(True)), "bulletin_id", "left")
    again = F.coalesce(F.col("late") & (F.col("reason") == marker), F.lit(False))
    new = {"status": F.when(again, "pending").otherwise(F.col("status")), "processed_at": F.when(~again, F.col("processed_at")), "reason": F.when(~again, F.col("reason"))}
    return both.withColumns(new).drop("late")


def first_synced(cars: DataFrame, scans: DataFrame, links: DataFrame, now: datetime, days: int = GIVE_UP_DAYS) -> DataFrame:
    """Scanned cars get their mark when nothing of their history is missing, or their oldest link is old enough to give up."""
    oldest = links.groupBy("car_id").agg(F.min("first_seen_at").alias("oldest"))
    both = cars.join(scans.select("car_id", F.lit(True).alias("scanned")).distinct(), "car_id", "left").join(oldest, "car_id", "left")
    old = F.coalesce(F.col("oldest") < at(now) - F.make_interval(days=F.lit(days)), F.lit(False))
    stamp = F.col("ready_at").isNull() & F.coalesce("scanned", F.lit(False)) & (~F.col("is_missing") | old)
    return both.withColumn("ready_at", F.when(stamp, at(now)).otherwise(F.col("ready_at"))).select(*cars.columns)


def unsubscribed(states: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each asked token's outcome: 'unsubscribed', 'already', or null for one that is unknown or has not a token's shape."""
    asked = tokens.withColumn("shaped", F.coalesce(F.col("token").rlike(TOKEN_SHAPE), F.lit(False)))
    both = asked.join(states.select("token", "unsubscribed"), "token", "left")
    return both.select("token", F.when(F.col("shaped") & F.col("unsubscribed"), "already").when(F.col("shaped") & ~F.col("unsubscribed"), "unsubscribed").alias("outcome"))


def flags_cleared(links: DataFrame, bulletin_ids: Column, car_ids: Column, rows: DataFrame) -> DataFrame:
    """Links whose pair stands in two parallel lists lose their flag."""
    pairs = rows.select(F.explode(F.arrays_zip(bulletin_ids.alias("bulletin_id"), car_ids.alias("car_id"))).alias("p")).select("p.*").distinct().withColumn("told", F.lit(True))
    return links.join(pairs, ["bulletin_id", "car_id"], "left").withColumn("alert_pending", F.col("alert_pending") & F.col("told").isNull()).drop("told")


def backfilled(rows: DataFrame, children: DataFrame, key: str, column: str, value: Column) -> DataFrame:
    """A column's nulls from an aggregate of child rows."""
    found = children.groupBy(key).agg(value.alias("found"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(column, "found")).drop("found")


def newest_known(rows: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """The newest value that is not null."""
    return rows.groupBy(by).agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias(column))


def removal_states(accounts: DataFrame, entitlements: DataFrame, removals: DataFrame, now: datetime) -> DataFrame:
    """Plan, limit, removals of this month and the next reset of subscribers with a limit; admins have none."""
    first = datetime(now.year, now.month, 1)
    plans = entitlements.filter("kind = 'subscription' AND status = 'active'").groupBy("user_id").agg(F.max(F.coalesce("plan", F.lit("monthly")) == "all_access").alias("all_access"))
    used = removals.filter(F.col("removed_at") >= at(first)).groupBy("user_id").agg(F.count("*").alias("used"))
    plan = F.when(F.col("all_access"), "all_access").otherwise("monthly")
    limit = F.when(F.col("all_access"), PLAN_REMOVALS["all_access"]).otherwise(PLAN_REMOVALS["monthly"])
    both = accounts.filter("not is_admin").join(plans, "user_id").join(used, "user_id", "left")
    return both.select("user_id", plan.alias("plan"), limit.alias("limit"), F.coalesce("used", F.lit(0)).alias("used"), F.add_months(F.lit(first.date()), 1).alias("resets_on"))


def checkout_refusals(requests: DataFrame, garage: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Why each asked purchase is refused, or null."""
    linked = garage.select("user_id", "car_id").distinct().withColumn("linked", F.lit(True))
    active = entitlements.filter("status = 'active'")
    unlocked = active.filter("kind = 'unlock'").select("user_id", "car_id").distinct().withColumn("has_unlock", F.lit(True))
    subscribed = active.filter("kind = 'subscription'").select("user_id").distinct().withColumn("has_plan", F.lit(True))
    both = requests.join(linked, ["user_id", "car_id"], "left").join(unlocked, ["user_id", "car_id"], "left").join(subscribed, "user_id", "left")
    unlock = F.col("kind") == "unlock"
    return both.select("user_id", "car_id", "kind", F.when(unlock & F.col("linked").isNull(), "vehicle not found").when(unlock & F.col("has_unlock"), "already unlocked").when(~unlock & F.col("has_plan"), "already subscribed").alias("refusal"))


def missing_columns(tables: dict[str, DataFrame], wanted: DataFrame) -> DataFrame:
    """Wanted (table_name, column_name) that tables have not (S15); only names are looked at."""
    spark = wanted.sparkSession
    have = spark.createDataFrame([(t, c) for t, df in tables.items() for c in df.columns], "table_name string, column_name string")
    return wanted.join(have, ["table_name", "column_name"], "left_anti")


def latest_of(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the rank limit is applied before the shuffle too."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
