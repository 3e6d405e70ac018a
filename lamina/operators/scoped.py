"""Counts by car, the gate before a search, cars that come back, and the picker's lists."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators import accounts as people
from lamina.operators.state import TRANSIENT_REASONS
from lamina.operators.vocabulary import any_of
from lamina.operators.work import at

#: What a bulletin says that stands by its summary alone, searches a day and searches that one payment buys, years that the picker shows, and the year that means unknown.
SUMMARY_ONLY, SEARCHES_A_DAY, SEARCHES_A_PAYMENT, SHOWN_YEARS, NO_YEAR = "summary only", 50, 1000, 30, 9999


def work_by_car(bulletins: DataFrame, papers: DataFrame, links: DataFrame, cars: DataFrame) -> DataFrame:
    """For each car, what a re-read would touch and what a run has left over (A20, A21); a car without bulletins has zeros.

    papers: bulletin_id, paper_summary, is_embedded. Papers are counted by bulletin first, so that
    the join to cars carries one row a link.
    """
    read, unread = F.col("paper_summary").isNotNull(), F.col("paper_summary").isNull()
    counted = papers.groupBy("bulletin_id").agg(F.count_if(read).alias("n_read"), F.count_if(unread).alias("n_unread"), F.count_if(read & ~F.col("is_embedded")).alias("n_unembedded"))
    own = ~F.col("reason").eqNullSafe(SUMMARY_ONLY)
    passing = (F.col("status") == "failed") & F.coalesce(any_of(F.col("reason"), TRANSIENT_REASONS), F.lit(False))
    flagged = bulletins.join(counted, "bulletin_id", "left").select(
        "bulletin_id", (own & (F.col("status") == "processed")).alias("again"), (F.col("status") == "pending").alias("waits"), passing.alias("passing"), (own & (F.col("status") == "failed")).alias("failed"),
        (own & F.col("status").isin("processed", "pending", "failed")).alias("own"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_read", "n_unread", "n_unembedded")),
    )
    count = lambda c: F.count_if(c)
    total = lambda c, n: F.coalesce(F.sum(F.when(F.col(c), F.col(n))), F.lit(0))
    by_car = links.select("car_id", "bulletin_id").join(flagged, "bulletin_id").groupBy("car_id").agg(
        count("again").alias("bulletins"), total("again", "n_read").alias("documents"), total("waits", "n_unread").alias("pending_documents"), count("passing").alias("requeue_bulletins"), total("passing", "n_unread").alias("requeue_documents"),
        count("failed").alias("failed_bulletins"), total("own", "n_unread").alias("without_summary"), total("own", "n_unembedded").alias("unembedded"),
    )
    return cars.select("car_id").join(by_car, "car_id", "left").fillna(0)


def reread_cost(counts: DataFrame, per_document: float, resume: bool = False) -> DataFrame:
    """The plan with its cost; a run that resumes resets nothing and takes failed documents along."""
    if resume:
        counts = counts.withColumns({"bulletins": F.lit(0).cast("long"), "documents": F.lit(0).cast("long")})
    n = F.col("documents") + F.col("pending_documents") + (F.col("requeue_documents") if resume else 0)
    return counts.withColumn("estimated_cost", F.round(n * per_document, 6))


def search_refusals(requests: DataFrame, garage: DataFrame, accounts: DataFrame, entitlements: DataFrame, ledger: DataFrame, now: datetime, kinds: tuple[str, str], daily: int = SEARCHES_A_DAY, allowance: int = SEARCHES_A_PAYMENT) -> DataFrame:
    """Why each asked search (user_id, car_id) is refused, or null: car not tracked, car locked, the day's searches or the payment's used up.

    ``kinds`` are the ledger's kinds of an answered search and of any search; ``accounts`` has
    searches_reset_at, from which the payment's searches count (null: from the beginning).
    """
    answered, asked = kinds
    held = people.access(garage, accounts, entitlements).groupBy("user_id", "car_id").agg(F.max(F.col("access") == "full").alias("is_full"))
    searches = ledger.filter(F.col("kind").isin(answered, asked)).join(accounts.select("user_id", "searches_reset_at"), "user_id")
    since = F.col("searches_reset_at").isNull() | (F.col("occurred_at") > F.col("searches_reset_at"))
    used = searches.groupBy("user_id").agg(
        F.count_if((F.col("kind") == answered) & (F.col("occurred_at") > at(now) - F.make_interval(hours=F.lit(24)))).alias("today"), F.count_if((F.col("kind") == asked) & since).alias("paid")
    )
    both = requests.join(held, ["user_id", "car_id"], "left").join(used, "user_id", "left")
    refusal = F.when(F.col("is_full").isNull(), "not tracked").when(~F.col("is_full"), "locked").when(F.col("today") >= daily, "daily limit").when(F.col("paid") >= allowance, "payment limit")
    return both.select("user_id", "car_id", refusal.alias("refusal"))


def revived(cars: DataFrame, incoming: DataFrame) -> DataFrame:
    """Cars after some are tracked by identity: one that is there is active again, else it is new; ``outcome`` says which.

    Of rows with one identity the active one with the least id is taken. Keywords stay where none
    are given. Identities asked for twice count once. New ids follow the greatest; they are counted
    by year, so that no task numbers all new cars.
    """
    who = ["year", "make", "model"]
    asked = incoming.groupBy(*who).agg(F.max("keywords").alias("new_keywords"))
    twin = cars.groupBy(*who).agg(F.min_by("car_id", F.struct(~F.col("active"), "car_id")).alias("car_id"))
    known = asked.join(twin, who, "left")
    touched = known.filter("car_id IS NOT NULL").select("car_id", "new_keywords", F.lit(True).alias("asked"))
    given = F.size(F.coalesce("new_keywords", F.array().cast("array<string>"))) > 0
    before = F.when(F.col("asked"), F.when(F.col("active"), "kept").otherwise("revived"))
    stay = cars.join(touched, "car_id", "left").select(
        "car_id", *who, F.when(given, F.col("new_keywords")).otherwise(F.col("keywords")).alias("keywords"), (F.col("active") | F.coalesce("asked", F.lit(False))).alias("active"), before.alias("outcome")
    )
    fresh = known.filter("car_id IS NULL")
    years = fresh.groupBy("year").agg(F.count("*").alias("n")).withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("year").alias("of"), "ahead")
    top = cars.agg(F.coalesce(F.max("car_id"), F.lit(0)).alias("top"))
    placed = fresh.withColumn("place", F.row_number().over(Window.partitionBy("year").orderBy("make", "model"))).join(years, F.col("year").eqNullSafe(F.col("of"))).crossJoin(F.broadcast(top))  # one row
    new = placed.select((F.col("top") + F.col("ahead") + F.col("place")).alias("car_id"), *who, F.coalesce("new_keywords", F.array().cast("array<string>")).alias("keywords"), F.lit(True).alias("active"), F.lit("inserted").alias("outcome"))
    return stay.unionByName(new)


def picker_years(vocab: DataFrame, n: int = SHOWN_YEARS) -> DataFrame:
    """The newest years that are known, and their places (L07); n is the feature."""
    years = vocab.select("model_year").distinct().filter(F.col("model_year") != NO_YEAR).orderBy(F.desc("model_year")).limit(n)
    return years.select("model_year", F.row_number().over(Window.orderBy(F.desc("model_year"))).alias("place"))


def picker_makes(vocab: DataFrame, shown: Sequence[str]) -> DataFrame:
    """By year, the shown makes that have bulletins, in the order of the list."""
    found = vocab.filter(F.col("make").isin(*shown)).select("model_year", "make").distinct()
    return found.withColumn("place", F.row_number().over(Window.partitionBy("model_year").orderBy(F.array_position(F.array(*[F.lit(m) for m in shown]), F.col("make")))))


def picker_models(resolved: DataFrame, typed: str | None = None) -> DataFrame:
    """By year and make, the listed names once each in alphabetical order, those that contain what was typed."""
    found = resolved.select("model_year", "make", "listed").distinct()
    if typed:
        found = found.filter(F.contains(F.lower("listed"), F.lit(typed.lower())))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("model_year", "make").orderBy("listed")))


def own_entitlements(entitlements: DataFrame) -> DataFrame:
    """Each account's entitlements, oldest first (Q29)."""
    return entitlements.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("entitlement_id"))).select("user_id", "place", "kind", "plan", "car_id", "status")


def runs_of_car(runs: DataFrame) -> DataFrame:
    """For each car its newest run, and whether one holds the lock (Q30); counts come as JSON."""
    newest = F.max_by(F.struct("run_id", "status", "counts"), F.struct("started_at", "run_id"))
    found = runs.groupBy("car_id").agg(newest.alias("r"), F.coalesce(F.max("is_active"), F.lit(False)).alias("is_running"))
    said: Column = F.from_json("r.counts", "mode string, jobs array<string>")
    return found.select("car_id", "r.run_id", "r.status", said["mode"].alias("mode"), F.size(said["jobs"]).alias("n_jobs"), "is_running")
