"""Who may read what: entitlements, plan seats, limits, recipients and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.bulletins import fold, stemmed

#: Cars a plan covers, cars an account may hold, cars of the free sample.
PLAN_CARS, MAX_CARS, FREE_CARS = {"monthly": 2, "all_access": 20}, 10, 2


def active_plans(entitlements: DataFrame) -> DataFrame:
    """The best active plan of an account and since when it subscribes."""
    active = entitlements.filter("kind = 'subscription' AND status = 'active'")
    best = F.max((F.col("plan").eqNullSafe("all_access")).cast("int")).alias("best")
    out = active.groupBy("user_id").agg(best, F.min("created_at").alias("subscribed_since"))
    return out.withColumn("plan", F.when(F.col("best") == 1, "all_access").otherwise("monthly")).withColumn("places", F.when(F.col("best") == 1, PLAN_CARS["all_access"]).otherwise(PLAN_CARS["monthly"])).drop("best")


def access(garage: DataFrame, accounts: DataFrame, entitlements: DataFrame) -> DataFrame:
    """'full' or 'sample' for each car of each account.

    Full for an admin, an unlocked car, and the plan's first cars that are not unlocked, oldest
    link first. Past due and canceled entitlements count for nothing.
    """
    unlocked = entitlements.filter("kind = 'unlock' AND status = 'active'").select("user_id", "car_id").distinct().withColumn("is_unlocked", F.lit(True))
    seats = garage.join(unlocked, ["user_id", "car_id"], "left").withColumn("is_unlocked", F.coalesce("is_unlocked", F.lit(False)))
    oldest = Window.partitionBy("user_id").orderBy("created_at", "car_id")
    placed = seats.withColumn("place", F.sum((~F.col("is_unlocked")).cast("long")).over(oldest))
    both = placed.join(accounts.select("user_id", "is_admin"), "user_id").join(active_plans(entitlements), "user_id", "left")
    full = F.col("is_admin") | F.col("is_unlocked") | F.coalesce(F.col("place") <= F.col("places"), F.lit(False))
    return both.withColumn("access", F.when(full, "full").otherwise("sample")).select(*garage.columns, "is_unlocked", "subscribed_since", "access")


def add_refusals(accounts: DataFrame, garage: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Why each account may not add one more car: 'plan limit', 'vehicle limit', 'sample limit', or null."""
    unlocked = entitlements.filter("kind = 'unlock' AND status = 'active'").select("user_id", "car_id").distinct().withColumn("u", F.lit(1))
    held = garage.join(unlocked, ["user_id", "car_id"], "left").groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("u").isNull()).alias("on_plan"))
    both = accounts.join(held, "user_id", "left").join(active_plans(entitlements), "user_id", "left").fillna(0, ["total", "on_plan"])
    by_plan = F.col("plan").isNotNull() & ~F.col("is_admin")
    refusal = (
        F.when(by_plan, F.when(F.col("on_plan") >= F.col("places"), "plan limit"))
        .when(F.col("total") >= MAX_CARS, "vehicle limit")
        .when(~F.col("is_admin") & F.col("plan").isNull() & (F.col("on_plan") >= FREE_CARS), "sample limit")
    )
    return both.select("user_id", "total", "on_plan", "plan", refusal.alias("refusal"))


def recipients(accounts: DataFrame, garage: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Accounts that get mail: an admin, or with a car, or subscribed; not unsubscribed (Q27, F22). Where their news starts."""
    with_car = garage.select("user_id").distinct().withColumn("has_car", F.lit(True))
    both = accounts.join(with_car, "user_id", "left").join(active_plans(entitlements), "user_id", "left")
    eligible = F.col("is_admin") | F.col("has_car").isNotNull() | F.col("subscribed_since").isNotNull()
    known = F.coalesce("last_watermark", "subscribed_since")
    since = F.when(known.isNotNull() | F.col("is_admin"), known).otherwise(F.col("created_at"))
    return both.filter(eligible & ~F.col("unsubscribed")).select("user_id", "is_admin", "subscribed_since", since.alias("since"))


def alerts(bulletins: DataFrame, links: DataFrame, cars: DataFrame, people: DataFrame, seats: DataFrame) -> DataFrame:
    """What is new for each account and car since its watermark.

    A car whose first read ended after the watermark lists everything; another car lists
    bulletins flagged as new and seen after it. Families fold to the newest; ``seen_until`` is the
    watermark once delivered.
    """
    allowed = seats.filter("alerts_enabled AND (access = 'full' OR subscribed_since IS NULL)").select("user_id", "car_id", "access")
    watched = people.join(allowed, "user_id").join(cars.select("car_id", "ready_at"), "car_id")
    watched = watched.withColumn("is_ready", F.coalesce(F.col("ready_at").isNotNull() & (F.col("since").isNull() | (F.col("ready_at") > F.col("since"))), F.lit(False)))
    processed = bulletins.filter("status = 'processed' AND processed_at IS NOT NULL")
    linked = links.join(processed, "bulletin_id").withColumn("news_at", F.greatest("processed_at", "first_seen_at"))
    rows = watched.join(linked, "car_id").filter(F.col("is_ready") | (F.col("alert_pending") & (F.col("since").isNull() | (F.col("news_at") > F.col("since")))))
    seen = rows.withColumn("seen", F.when(F.col("is_ready"), F.col("ready_at")).otherwise(F.col("news_at")))
    folded = fold(stemmed(seen.select("user_id", "car_id", "access", "is_ready", "bulletin_id", "number", "published", "severity", "seen")), ["user_id", "car_id", "stem"])
    return folded.groupBy("user_id", "car_id", "access", "is_ready").agg(
        F.count("*").alias("n_families"), F.count_if(F.col("severity") == "serious").alias("n_serious"), F.max("published").alias("newest"), F.max("seen").alias("seen_until"), F.sum("superseded").alias("superseded")
    )
