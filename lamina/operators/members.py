"""What members ask for: one more car, the list of their own, bulletins marked read, a sign-in, and the picker's filter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import accounts as people
from lamina.operators.bulletins import SAMPLE_QUOTA, fold, stemmed
from lamina.operators.work import at
from lamina.sources.snapshots import Snapshots

#: Fixed value: options that the picker shows at once.
SHOWN_OPTIONS = 80
#: Folders of a stored table of reads, the one of requests without an account, and hex digits of a new account's hash by which numbers are dealt out.
READ_BUCKETS, NOBODY, DEALT_DIGITS = 64, -1, 3


def car_requests(requests: DataFrame, cars: DataFrame, garage: DataFrame, accounts: DataFrame, entitlements: DataFrame, grants: DataFrame) -> DataFrame:
    """Each request (user_id, year, make, model) with why it is refused, or null.

    A car of that name already on the account is always fine. A subscriber is held to the plan's
    places; others to all cars an account may hold, and then to the free sample: a car granted
    before is free again, else fewer grants than the sample has cars must be in use. A grant is not
    in use once its car is unlocked. Repeated requests have repeated rows; an unknown account has
    nothing; a null in a name equals no car.
    """
    name = ["year", "make", "model"]
    named = cars.select("car_id", *name)
    unlocked = entitlements.filter("kind = 'unlock' AND status = 'active'").select("user_id", "car_id").distinct()
    linked = garage.select("user_id", "car_id").join(named, "car_id").select("user_id", *name).distinct().withColumn("linked", F.lit(True))
    granted = grants.select("user_id", "car_id").join(named, "car_id").select("user_id", *name).distinct().withColumn("granted", F.lit(True))
    in_use = grants.select("user_id", "car_id").distinct().join(unlocked, ["user_id", "car_id"], "left_anti").groupBy("user_id").agg(F.count("*").alias("in_use"))
    held = people.add_refusals(accounts, garage, entitlements).select("user_id", "total", "on_plan", "plan")
    asked = requests.select("user_id", *(F.col(c).alias(f"asked_{c}") for c in name), F.col("year"), F.upper(F.trim("make")).alias("make"), F.when(F.col("model").isNotNull(), text.normal_model(F.col("model"))).alias("model"))
    both = asked.join(linked, ["user_id", *name], "left").join(granted, ["user_id", *name], "left").join(held, "user_id", "left").join(in_use, "user_id", "left").join(accounts.select("user_id", "is_admin"), "user_id", "left")
    both = both.fillna(0, ["total", "on_plan", "in_use"]).fillna(False, ["linked", "granted", "is_admin"])
    places = F.when(F.col("plan") == "all_access", people.PLAN_CARS["all_access"]).otherwise(people.PLAN_CARS["monthly"])
    free = F.col("is_admin") | F.col("plan").isNotNull() | F.col("granted") | (F.col("in_use") < people.FREE_CARS)
    refusal = (
        F.when(F.col("linked"), None)
        .when(F.col("plan").isNotNull() & ~F.col("is_admin"), F.when(F.col("on_plan") >= places, "plan limit"))
        .when(F.col("total") >= people.MAX_CARS, "vehicle limit")
        .when(~free, "sample limit")
    )
    return both.select("user_id", *(F.col(f"asked_{c}").alias(c) for c in name), F.col("in_use").alias("grants_in_use"), refusal.alias("refusal"))


def my_cars(garage: DataFrame, cars: DataFrame, accounts: DataFrame, entitlements: DataFrame, bulletins: DataFrame, links: DataFrame, reads: DataFrame, now: datetime) -> DataFrame:
    """Each account's active cars with tiers, what is unread of them, what is new this week, availability and access.

    A car's families are those of its processed bulletins. Unread is a car's count less what the
    account has read of it, so no account is joined with every family of its cars: the rows that
    meet are the reads.
    """
    done = bulletins.filter("status = 'processed'").select("bulletin_id", "number", "published", "severity")
    families = fold(stemmed(links.select("car_id", "bulletin_id").join(done, "bulletin_id")), ["car_id", "stem"]).select("car_id", "bulletin_id", "severity", "published")
    tiers = lambda prefix: [F.count_if(F.col("severity") == t).alias(prefix + t) for t in SAMPLE_QUOTA]
    week = F.count_if(F.col("published") >= at(now) - F.make_interval(days=F.lit(7)))
    counted = families.groupBy("car_id").agg(*tiers(""), week.alias("new_this_week"), F.count("*").alias("n_families"))
    held = garage.select("user_id", "car_id").distinct()
    seen = reads.select("user_id", "bulletin_id").distinct().join(families, "bulletin_id").join(held, ["user_id", "car_id"], "left_semi").groupBy("user_id", "car_id").agg(*tiers("read_"))
    seats = people.access(garage, accounts, entitlements).select("user_id", "car_id", F.col("created_at").alias("added_at"), "alerts_enabled", "access")
    both = seats.join(cars.filter("active").select("car_id", "year", "make", "model"), "car_id").join(counted, "car_id", "left").join(seen, ["user_id", "car_id"], "left")
    both = both.fillna(0, [*SAMPLE_QUOTA, *(f"read_{t}" for t in SAMPLE_QUOTA), "new_this_week", "n_families"])
    unread = [(F.col(t) - F.col(f"read_{t}")).alias(f"unread_{t}") for t in SAMPLE_QUOTA]
    availability = F.when(F.col("n_families") > 0, "ready").otherwise("processing").alias("availability")
    return both.select("user_id", "car_id", "year", "make", "model", "added_at", "alerts_enabled", *SAMPLE_QUOTA, *unread, "new_this_week", availability, "access")


def _bucket() -> Column:
    """An account's folder, by the hash with which Spark deals rows: of a multiple of READ_BUCKETS partitions each has rows of one folder."""
    return F.when(F.col("user_id").isNull(), NOBODY).otherwise(F.pmod(F.hash("user_id"), F.lit(READ_BUCKETS))).alias("bucket")


def dealt(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows by account in so many partitions at least, a multiple of READ_BUCKETS; Spark leaves out the shuffle of rows that lie so already."""
    return rows.repartition(-(-partitions // READ_BUCKETS) * READ_BUCKETS, "user_id")


def create_reads(store: Snapshots, reads: DataFrame, partitions: int = READ_BUCKETS) -> None:
    """A stored table of reads, in folders by account."""
    rows = dealt(reads.select("user_id", "bulletin_id"), partitions).distinct()
    store.publish(store.stage({"reads": rows.select("user_id", "bulletin_id", _bucket())}, {"reads": "bucket"}))


def mark_read(store: Snapshots, requests: DataFrame, garage: DataFrame, links: DataFrame, partitions: int = READ_BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(the published reads after the change, every request with ``marked``): false unless the bulletin is on a car of the account.

    Marking again changes nothing and is true. Requests lie by account; the account's cars and the
    bulletin's, each as one set, are held against each other, so no request is multiplied by cars.
    Answers are written first, and the reads are made of them. Only folders of accounts that asked
    are written again; table and answers are published in one step and read from what was written.
    """
    base = store.version()
    asked = dealt(requests.select("user_id", "bulletin_id"), partitions).distinct()
    own = dealt(garage.select("user_id", "car_id"), partitions).groupBy("user_id").agg(F.collect_set("car_id").alias("own"))
    on = links.groupBy("bulletin_id").agg(F.collect_set("car_id").alias("on"))
    marked = F.coalesce(F.arrays_overlap("own", "on"), F.lit(False)).alias("marked")
    answers = asked.join(own, "user_id", "left").join(on, "bulletin_id", "left").select("user_id", "bulletin_id", marked)
    stage = store.stage({"answers": dealt(answers, partitions).select("*", _bucket())}, {"answers": "bucket"}, base)
    touched = set(stage.folders["answers"]) - {str(NOBODY)}
    before = store.read("reads", base, only=touched.__contains__).select("user_id", "bulletin_id")
    after = dealt(before.unionByName(store.staged(stage, "answers").filter("marked").select("user_id", "bulletin_id")), partitions).distinct()
    stage = store.stage({"reads": after.select("user_id", "bulletin_id", _bucket())}, {"reads": "bucket"}, into=stage)
    store.publish(stage, {"reads": ()})
    return store.read("reads", base + 1).select("user_id", "bulletin_id"), store.read("answers", base + 1).select("user_id", "bulletin_id", "marked")


def numbered(rows: DataFrame, key: str, name: str, digits: int = DEALT_DIGITS) -> DataFrame:
    """Rows numbered from 1 by the md5 of their key: ranks are taken within the hash's first digits and carried over their counts, so no task orders all rows."""
    dealt = rows.withColumn("_md5", F.md5(F.col(key).cast("binary"))).withColumn("_part", F.substring("_md5", 1, digits))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    # 16 ** digits rows at most
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_md5", key))
    return dealt.withColumn("_place", place).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_place")).drop("_md5", "_part", "_place", "_start")


def signed_in(users: DataFrame, sign_ins: DataFrame) -> DataFrame:
    """The users after sign-ins (uid, email, display_name, is_admin, at) that may repeat: one row a uid.

    The last sign-in's email and name stand, null ones too (of a tie, the larger). An admin stays
    one whatever later sign-ins say, and any sign-in as admin makes one. New users are numbered
    after the largest user_id. Sign-ins without a uid are passed over.
    """
    last = sign_ins.filter("uid IS NOT NULL").groupBy("uid").agg(
        F.max(F.struct("at", "email", "display_name")).alias("last"), F.max(F.coalesce("is_admin", F.lit(False))).alias("as_admin"),
    )
    top = users.agg(F.coalesce(F.max("user_id"), F.lit(0)).alias("top"))
    fresh = numbered(last.join(users.select("uid"), "uid", "left_anti"), "uid", "n").crossJoin(F.broadcast(top))  # one row
    fresh = fresh.select("uid", (F.col("top") + F.col("n")).alias("user_id"), F.col("last.email").alias("email"), F.col("last.display_name").alias("display_name"), F.col("as_admin").alias("is_admin"), F.col("last.at").alias("last_seen_at"))
    here = F.col("last").isNotNull()
    new = {c: F.when(here, F.col(f"last.{c}")).otherwise(F.col(c)) for c in ("email", "display_name")}
    kept = users.join(last, "uid", "left").withColumns(new | {"is_admin": F.coalesce("is_admin", F.lit(False)) | F.coalesce("as_admin", F.lit(False)), "last_seen_at": F.greatest("last_seen_at", "last.at")})
    return kept.select(*fresh.columns).unionByName(fresh)


def shown_options(options: DataFrame, column: str, typed: str | None, most: int = SHOWN_OPTIONS) -> DataFrame:
    """The first options, in order, that contain what was typed in any case; all of them when nothing was (F20). Nulls are no options."""
    q = (typed or "").strip().lower()
    kept = options.filter(F.col(column).isNotNull()).select(column).distinct()
    if q:
        kept = kept.filter(F.contains(F.lower(column), F.lit(q)))
    return kept.orderBy(column).limit(most)
