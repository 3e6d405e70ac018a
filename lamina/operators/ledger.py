"""Usage ledger: prices, totals that reconcile, rolling limits and estimates."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the list price in a batch; spread of cost estimates; seconds for a bulletin and a document.
BATCH_SHARE, COST_SPREAD, SECONDS_PER_BULLETIN, SECONDS_PER_PAPER = 0.5, 0.25, 0.8, 0.7
#: Fixed values of the limiter: this many requests in this many seconds.
LIMIT, LIMIT_SECONDS = 20, 60


def priced(ledger: DataFrame, rates: DataFrame, fallback: tuple[float, float], batch: Column | None = None) -> DataFrame:
    """cost_usd by the model's rates (model, in_rate, out_rate: a small table of prices); unknown models cost the fallback, never nothing."""
    both = ledger.join(F.broadcast(rates), "model", "left")
    cost = F.col("tokens_in") * F.coalesce("in_rate", F.lit(fallback[0])) + F.col("tokens_out") * F.coalesce("out_rate", F.lit(fallback[1]))
    share = F.when(batch, BATCH_SHARE).otherwise(1.0) if batch is not None else F.lit(1.0)
    return both.withColumn("cost_usd", F.round(cost * share, 10)).drop("in_rate", "out_rate")


def summary(ledger: DataFrame) -> DataFrame:
    """Totals, by kind, by model and by day in one pass over the ledger; every breakdown sums to the total."""
    spread = ledger.withColumn("day", F.date_format("occurred_at", "yyyy-MM-dd"))
    return spread.groupingSets([[], ["kind"], ["model"], ["day"]], "kind", "model", "day").agg(
        F.grouping_id().alias("g"), F.count("*").alias("n_events"), F.round(F.sum("cost"), 4).alias("spend"), F.sum("tokens_in").alias("tokens_in")
    ).select(F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "kind").when(F.col("g") == 5, "model").otherwise("day").alias("breakdown"), F.coalesce("kind", "model", "day", F.lit("(all)")).alias("label"), "n_events", "spend", "tokens_in")


def rolling_count(ledger: DataFrame, hours: int = 24, blocks: int = 24) -> DataFrame:
    """For each event, the account's events of the same kind in the hours before it, itself included.

    Time is cut into blocks, of which the hours are a whole number. An event's count is its place in
    its own block, plus all of the blocks that the hours reach back over, less what the farthest of
    these has up to that long before the event. Only a block of an account is ever ordered in one
    task; of all its blocks just the counts are. Events without a time count each other alone.
    """
    span = hours * 3_600_000_000
    step = span // blocks
    if step * blocks != span:
        raise ValueError("the hours must be a whole number of blocks")
    us = F.unix_micros(F.col("occurred_at").cast("timestamp"))
    key = ["user_id", "kind", "block"]
    timed = ledger.select(F.struct("*").alias("event"), "event_id", "user_id", "kind", us.alias("at"))
    block = lambda t: F.floor((t - F.pmod(t, F.lit(step))) / step).cast("long")
    # each event stands in its own block, and asks (role 1) how many events the block at the far edge has up to there
    roles = F.array(F.struct(F.lit(0).alias("role"), F.col("at").alias("us")), F.struct(F.lit(1).alias("role"), (F.col("at") - span).alias("us")))
    asked = timed.withColumn("r", F.explode(roles)).filter((F.col("r.role") == 0) | F.col("at").isNotNull()).select(F.when(F.col("r.role") == 0, F.col("event")).alias("event"), "event_id", "user_id", "kind", "at", "r.role", "r.us", block(F.col("r.us")).alias("block"), F.lit(0).cast("long").alias("before"))
    counts = timed.groupBy("user_id", "kind", block(F.col("at")).alias("block")).agg(F.count("*").alias("n")).filter("block IS NOT NULL")
    reach = Window.partitionBy("user_id", "kind").orderBy("block").rangeBetween(-blocks, -1)
    carried = counts.select("user_id", "kind", "block", F.coalesce(F.sum("n").over(reach), F.lit(0)).alias("before"))
    edge = carried.select(F.lit(None).cast(timed.schema["event"].dataType).alias("event"), F.lit(None).cast(timed.schema["event_id"].dataType).alias("event_id"), "user_id", "kind", F.lit(None).cast("long").alias("at"), F.lit(2).alias("role"), F.lit(None).cast("long").alias("us"), "block", "before")
    within = Window.partitionBy(*key)
    placed = asked.unionByName(edge).withColumns({"place": F.sum((F.col("role") == 0).cast("long")).over(within.orderBy("us").rangeBetween(Window.unboundedPreceding, 0)), "before": F.max("before").over(within)}).filter("role < 2")
    same = Window.partitionBy("event_id", "user_id", "kind", "at")
    used = F.col("place") + F.col("before") - F.coalesce(F.max(F.when(F.col("role") == 1, F.col("place"))).over(same), F.lit(0))
    return placed.withColumn("used", used).filter("role = 0").select("event.*", "used")


def _admit(batches: Iterator, limit: int, window_us: int) -> Iterator:
    current, hits = None, deque()
    for batch in batches:
        allowed = []
        for user, at in zip(batch["user_id"], batch["us"]):
            if user != current:
                current, hits = user, deque()
            while hits and hits[0] <= at - window_us:
                hits.popleft()
            ok = len(hits) < limit
            if ok:
                hits.append(at)
            allowed.append(ok)
        batch["allowed"] = allowed
        yield batch


#: Windows of the limiter in a block of time.
BLOCK_WINDOWS = 16


def quiet_runs(timed: DataFrame, window_us: int) -> DataFrame:
    """``run`` for event_id, user_id, us: when the account's run of requests began, a run ending where none came for a whole window.

    Gaps are looked for within blocks of time, each with the last request before it as its first
    row; then the newest beginning is handed on from block to block. So a task orders a block of an
    account at most, and of all its blocks just their ends.
    """
    blocked = timed.withColumn("block", F.floor(F.col("us") / (window_us * BLOCK_WINDOWS)).cast("long"))
    none = F.lit(None).cast("long")
    by_block, within = Window.partitionBy("user_id").orderBy("block"), Window.partitionBy("user_id", "block").orderBy("us", F.col("event_id").asc_nulls_first())
    ends = blocked.groupBy("user_id", "block").agg(F.max("us").alias("last")).select("user_id", "block", F.lag("last").over(by_block).alias("us")).filter("us IS NOT NULL")
    before = F.lag("us").over(within)
    gaps = blocked.withColumn("is_real", F.lit(True)).unionByName(ends.select(none.alias("event_id"), "user_id", "us", "block", F.lit(False).alias("is_real")))
    began = gaps.withColumn("began", F.when(F.coalesce(F.col("us") - before >= window_us, F.lit(True)), F.col("us"))).filter("is_real").drop("is_real")
    last = began.groupBy("user_id", "block").agg(F.max("began").alias("began"))
    handed = last.select("user_id", "block", F.last("began", ignorenulls=True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("began")).filter("began IS NOT NULL")
    firsts = handed.select(none.alias("event_id"), "user_id", F.col("began").alias("us"), "block", "began", F.lit(False).alias("is_real"))
    run = F.max("began").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return began.withColumn("is_real", F.lit(True)).unionByName(firsts).withColumn("run", run).filter("is_real").select("event_id", "user_id", "us", "run")


def sliding_limit(events: DataFrame, limit: int = LIMIT, seconds: int = LIMIT_SECONDS) -> DataFrame:
    """Which requests a limiter of so many in so many seconds admits; refused ones do not count.

    An account's requests are cut wherever none came for the whole window: nothing admitted before
    such a gap matters after it. The runs are dealt over tasks and read in order; a task holds at
    most ``limit`` times, so no account is gathered into memory. A run without such a gap is read in
    one task, as each answer there depends on the one before.
    """
    window_us = seconds * 1_000_000
    timed = events.select("event_id", "user_id", F.unix_micros(F.col("occurred_at").cast("timestamp")).alias("us"))
    # within a partition two runs of one account follow each other in order, so the times of the first expire by themselves
    ordered = quiet_runs(timed, window_us).repartition("user_id", "run").sortWithinPartitions("user_id", "us", "event_id").drop("run")
    return ordered.mapInPandas(lambda it: _admit(it, limit, window_us), "event_id long, user_id long, us long, allowed boolean").drop("us")


def two_level_average(ledger: DataFrame) -> DataFrame:
    """Average over accounts of what each spent on a kind."""
    each = ledger.groupBy("kind", "user_id").agg(F.sum("cost").alias("spent"))
    return each.groupBy("kind").agg(F.round(F.avg("spent"), 4).alias("avg_spent"), F.round(F.max("spent"), 4).alias("max_spent"), F.count("*").alias("n_accounts"))


def estimate(new_bulletins: Column, papers: Column, per_paper: Column) -> Column:
    """Cost and duration ranges and their words."""
    mid = papers * per_paper
    seconds = new_bulletins * SECONDS_PER_BULLETIN + papers * SECONDS_PER_PAPER
    minutes = seconds / 60
    words = F.when(seconds < 60, "under a minute").when(seconds < 90, "about a minute").when(minutes < 10, F.format_string("around %d minutes", F.bround(minutes, 0).cast("int")))
    return F.struct(
        F.round(mid * (1 - COST_SPREAD), 4).alias("cost_low"), F.round(mid * (1 + COST_SPREAD), 4).alias("cost_high"), F.floor(seconds).cast("long").alias("seconds"),
        F.coalesce(words, F.format_string("%d to %d minutes", F.floor(seconds * 0.4 / 60).cast("int"), F.floor(seconds * 1.6 / 60).cast("int"))).alias("duration_text"),
    )
