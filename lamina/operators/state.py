"""Changes of tables as new snapshots: every function returns the table after the change, ready to overwrite a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.operators.vocabulary import any_of

#: Reasons of failure that pass by themselves, and tries before a row has failed.
TRANSIENT_REASONS, MAX_ATTEMPTS = ["timeout%", "rate limit%", "%(429)%", "connection%"], 3


def upsert(current: DataFrame, incoming: DataFrame, key: str, refresh: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows of both: ``refresh`` columns take the incoming value where there is one, ``keep`` columns stay for rows already there; ``inserted`` tells new rows."""
    both = current.alias("c").withColumn("had", F.lit(True)).join(incoming.alias("i"), key, "full_outer")
    new = F.col("had").isNull()
    columns = [F.coalesce(F.col(f"i.{c}"), F.col(f"c.{c}")).alias(c) for c in refresh] + [F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"c.{c}")).alias(c) for c in keep]
    return both.select(key, *columns, new.alias("inserted"))


def insert_absent(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only the incoming rows whose key is not there yet."""
    return incoming.join(current.select(*keys), list(keys), "left_anti")


def after_attempt(rows: DataFrame, failed: Column, retryable: Column) -> DataFrame:
    """One more try counted; failed for good past the last or when a retry cannot help, else pending again."""
    tries = F.col("attempts") + 1
    status = F.when(failed & (~retryable | (tries >= MAX_ATTEMPTS)), "failed").when(failed, "pending").otherwise(F.col("status"))
    return rows.withColumns({"status": status, "attempts": F.when(failed, tries).otherwise(F.col("attempts"))})


def requeue_transient(rows: DataFrame) -> DataFrame:
    """Rows that failed for a passing reason are pending again, with no tries and no reason."""
    passing = (F.col("status") == "failed") & F.coalesce(any_of(F.col("reason"), TRANSIENT_REASONS), F.lit(False))
    return rows.withColumns(
        {"status": F.when(passing, "pending").otherwise(F.col("status")), "attempts": F.when(passing, 0).otherwise(F.col("attempts")), "reason": F.when(~passing, F.col("reason"))}
    )


def promoted(bulletins: DataFrame, papers: DataFrame) -> DataFrame:
    """Pending bulletins all of whose documents are read become processed (D05); none without documents."""
    done = papers.groupBy("bulletin_id").agg(F.count_if(F.col("paper_summary").isNull()).alias("open")).filter("open = 0").select("bulletin_id", F.lit(True).alias("done"))
    out = bulletins.join(done, "bulletin_id", "left")
    return out.withColumn("status", F.when((F.col("status") == "pending") & F.col("done").isNotNull(), "processed").otherwise(F.col("status"))).drop("done")


def ready_cars(cars: DataFrame, links: DataFrame, bulletins: DataFrame) -> DataFrame:
    """Cars not yet ready that have bulletins and none pending."""
    told = links.join(bulletins.select("bulletin_id", "status"), "bulletin_id").groupBy("car_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count("*").alias("n_bulletins"))
    return cars.filter("ready_at IS NULL").join(told.filter("pending = 0"), "car_id").select("car_id", "n_bulletins")


def difference(source: DataFrame, destination: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Each key as 'identical', 'update', 'insert' or 'extra', comparing null-safely."""
    both = source.withColumn("s", F.lit(1)).alias("a").join(destination.withColumn("d", F.lit(1)).alias("b"), key, "full_outer")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return both.select(key, F.when(F.col("d").isNull(), "insert").when(F.col("s").isNull(), "extra").when(same, "identical").otherwise("update").alias("action"))


def apply_events(events: DataFrame) -> DataFrame:
    """The last state of each subscription from events that may come twice and out of order.

    Events count once by id (of copies that differ, the earliest stands); the newest decides, and its statuses map to those kept here.
    """
    once = events.groupBy("event_id").agg(F.min(F.struct("occurred_at", "user_id", "kind")).alias("e")).select("event_id", "e.*")
    last = once.groupBy("user_id").agg(F.max_by("kind", F.struct("occurred_at", "event_id")).alias("last_kind"), F.max("occurred_at").alias("changed_at"), F.count("*").alias("n_applied"))
    status = F.when(F.col("last_kind").isin("purchase", "signup"), "active").when(F.col("last_kind") == "error", "past_due").otherwise("canceled")
    return last.withColumn("status", status)


def replace_partition(spark, rows: DataFrame, path: str, column: str) -> None:
    """Overwrite only the partitions that the rows have; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
