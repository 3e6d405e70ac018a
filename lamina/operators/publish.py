"""Changes that are published: an index copied whole, guarded updates with their outcomes, re-keyed cars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.operators import work
from lamina.sources.snapshots import Snapshots, Stage


def copied_index(store: Snapshots, source: dict[str, DataFrame], cars: DataFrame, by: dict[str, str] | None = None, dry_run: bool = False) -> dict[str, int]:
    """Replace a store's tables by those of a source, in one step; rows of cars that the destination has not are left out and counted.

    Returns the rows of each table and ``dropped``. A dry run counts what the real run would write
    and leaves nothing. A table without rows is refused before anything is published.
    """
    ids = cars.select("car_id").distinct()
    kept = {t: frame.join(ids, "car_id", "left_semi") if "car_id" in frame.columns else frame for t, frame in source.items()}
    stage = store.stage(kept, by)
    dropped = sum(frame.join(ids, "car_id", "left_anti").count() for frame in source.values() if "car_id" in frame.columns)

    def check(counts: dict[str, int]) -> None:
        empty = [t for t, n in counts.items() if not n]
        if empty:
            raise ValueError(f"nothing to publish for {', '.join(empty)}")

    return store.publish(stage, check=check, dry_run=dry_run) | {"dropped": dropped}


def unsubscribed_states(states: DataFrame, tokens: DataFrame) -> DataFrame:
    """The states after the tokens were used, with each asked row's outcome: the change and what it returns are one plan.

    A row that changes gets the next ``row_version``. An unknown or misshapen token changes nothing and has no row here.
    """
    asked = tokens.filter(F.coalesce(F.col("token").rlike(work.TOKEN_SHAPE), F.lit(False))).select("token").distinct().withColumn("asked", F.lit(True))
    both = states.join(asked, "token", "left")
    was = F.coalesce(F.col("unsubscribed"), F.lit(False))
    changed = F.col("asked").isNotNull() & ~was
    return both.withColumns(
        {
            "outcome": F.when(F.col("asked") & was, "already").when(F.col("asked"), "unsubscribed"),
            "unsubscribed": was | F.col("asked").isNotNull(),
            "row_version": F.col("row_version") + changed.cast("long"),
        }
    ).drop("asked")


def unsubscribe(store: Snapshots, tokens: DataFrame, table: str = "states") -> tuple[DataFrame, DataFrame]:
    """(the published table after the change, token and outcome of every row that was asked for), both read from what was written.

    The change is computed once, so an executor that is lost cannot make the two differ; a writer
    that began before another's publication is refused (``LostUpdate``) and may begin again.
    """
    base = store.version()
    stage: Stage = store.stage({table: unsubscribed_states(store.read(table, base).drop("outcome"), tokens)}, base=base)
    store.publish(stage)
    after = store.read(table, base + 1)
    return after.drop("outcome"), after.filter("outcome IS NOT NULL").select("token", "outcome")


def final_survivors(merges: DataFrame) -> DataFrame:
    """car_id and the car it ends up in, where ``into`` may itself be merged further (Q21).

    Pointer jumping: each round a car takes its target's target, so a chain of n merges takes
    log2(n) rounds; what still moves after that goes round in a circle, which raises. Lineage is
    cut by a checkpoint each round.
    """
    now = merges.groupBy("car_id").agg(F.min("into").alias("into")).checkpoint()
    for _ in range(now.count().bit_length() + 1):
        ahead = now.select(F.col("car_id").alias("into"), F.col("into").alias("further"))
        moved = now.join(ahead, "into", "left").select("car_id", F.coalesce("further", "into").alias("into"), F.col("further").isNotNull().alias("moved")).checkpoint()
        now = moved.select("car_id", "into")
        if moved.filter("moved").isEmpty():
            return now
    raise ValueError("merges go round in a circle")


def rekeyed(cars: DataFrame, links: DataFrame, runs: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cars, links and runs after a re-key plan of car_id, into (another car, or null) and model_after (Q21).

    Absorbed cars go. A survivor unites its cars' keywords, is active if any was, and takes its new
    name. Links are united by bulletin and survivor with the earliest sight and all keywords. Runs move along.
    A merge into a car that isn't there raises.
    """
    final = final_survivors(plan.filter("into IS NOT NULL AND into <> car_id").select("car_id", "into"))
    if not final.join(cars.select(F.col("car_id").alias("into")), "into", "left_anti").isEmpty():
        raise ValueError("a car would be merged into one that isn't there")
    to = F.coalesce("into", "car_id")
    words = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    names = plan.filter("into IS NULL").select("car_id", "model_after")
    united = cars.join(final, "car_id", "left").groupBy(to.alias("car_id")).agg(words("keywords").alias("keywords"), F.max("active").alias("active"))
    own = cars.select("car_id", "year", "make", "model").join(names, "car_id", "left").withColumn("model", F.coalesce("model_after", "model")).drop("model_after")
    linked = links.join(final, "car_id", "left").groupBy("bulletin_id", to.alias("car_id")).agg(words("keywords").alias("keywords"), F.min("first_seen_at").alias("first_seen_at"))
    ran = runs.join(final, "car_id", "left").withColumn("car_id", to).drop("into")
    return own.join(united, "car_id"), linked, ran
