"""Reports: tiers, identity, status counts, samples and comparisons of extractions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def status_counts(bulletins: DataFrame) -> DataFrame:
    """Counts of one pass."""
    state = F.col("status")
    return bulletins.agg(
        F.count("*").alias("total"), *[F.count_if(state == s).alias(s) for s in ("pending", "processed", "failed")],
        F.count_if((state == "pending") & (F.col("attempts") > 0)).alias("retrying"), F.count_if(F.col("published").isNull()).alias("undated"),
    )


def severity_report(bulletins: DataFrame, papers: DataFrame) -> DataFrame:
    """Tiers by type and by status."""
    counted = bulletins.join(papers.groupBy("bulletin_id").agg(F.count("*").alias("n_papers")), "bulletin_id", "left")
    return counted.groupBy("severity", F.coalesce("kind", F.lit("(none)")).alias("kind"), "status").agg(F.count("*").alias("n"), F.sum(F.coalesce("n_papers", F.lit(0))).alias("n_papers"))


def hash_sample(rows: DataFrame, by: str, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows of each group in an order fixed by a hash of key and seed (L09); a feature of sampling, not a cap."""
    draw = Window.partitionBy(by).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), F.col(key))
    return rows.withColumn("rn", F.row_number().over(draw)).filter(F.col("rn") <= n).drop("rn")


def identities(cars: DataFrame, links: DataFrame) -> DataFrame:
    """Groups of cars with one year, make and model, and their links."""
    linked = links.groupBy("car_id").agg(F.countDistinct("bulletin_id").alias("n_links"))
    both = cars.join(linked, "car_id", "left")
    return both.groupBy("year", "make", "model").agg(F.count("*").alias("n_cars"), F.array_join(F.array_sort(F.collect_list("car_id")), ",").alias("car_ids"), F.sum(F.coalesce("n_links", F.lit(0))).alias("n_links")).filter("n_cars > 1")


def strata_allocation(rows: DataFrame, cells: list[str], size: int) -> DataFrame:
    """How many rows each cell gives: one each, the rest in proportion to what is left, largest remainders first.

    Only cell counts are ranked, never rows.
    """
    counted = rows.groupBy(*cells).agg(F.count("*").alias("available"))
    totals = counted.agg(F.count("*").alias("n_cells"), F.sum(F.col("available") - 1).alias("left"))
    spread = counted.crossJoin(F.broadcast(totals))  # one row of totals
    spare = F.least(F.greatest(F.lit(size) - F.col("n_cells"), F.lit(0)), F.col("left"))
    exact = F.when(F.col("left") > 0, (spare * (F.col("available") - 1)).cast("double") / F.col("left")).otherwise(0.0)
    shared = spread.withColumn("spare", spare).withColumn("share", F.floor(exact).cast("long")).withColumn("rest", F.round(exact - F.floor(exact), 9))
    open_cells = shared.withColumn("open", (F.col("share") < F.col("available") - 1).cast("int"))
    sums = open_cells.agg(F.sum("share").alias("given"))
    ranked = open_cells.crossJoin(F.broadcast(sums)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("open"), F.desc("rest"), *cells)))
    more = F.when((F.col("open") == 1) & (F.col("rank") <= F.col("spare") - F.col("given")), 1).otherwise(0)
    return ranked.select(*cells, "available", (F.col("share") + 1 + more).alias("take"))


def arm_scores(outputs: DataFrame) -> DataFrame:
    """By arm: share of valid answers, mean tokens, cost per thousand."""
    return outputs.groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("valid").cast("double")), 6).alias("validity"), F.round(F.avg("tokens_in"), 4).alias("mean_tokens_in"), F.round(F.sum("cost") * 1000 / F.count("*"), 4).alias("cost_per_1000")
    )


def disagreement(outputs: DataFrame) -> DataFrame:
    """Mean gap between arms of one document (C29, J19): of n arms, n * n less the squares of equal answers' numbers differ in pairs."""
    equal = outputs.groupBy("doc", "answer").agg(F.count("*").alias("c"))
    sums = equal.groupBy("doc").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("answer").isNotNull(), F.col("c") * F.col("c"))).alias("same"), F.coalesce(F.sum(F.when(F.col("answer").isNull(), F.col("c"))), F.lit(0)).alias("none"))
    known = F.col("n") - F.col("none")  # as before, pairs with an unknown answer tell nothing
    return sums.filter("n > 1").select("doc", F.round(F.when(known > 1, (known * known - F.col("same")) / (known * (known - 1))), 6).alias("gap"))


def mean_ranks(rankings: DataFrame) -> DataFrame:
    """Wins and mean rank of labels in ordered lists."""
    placed = rankings.select(F.posexplode("ranking").alias("pos", "arm"))
    return placed.groupBy("arm").agg(F.count_if(F.col("pos") == 0).alias("wins"), F.round(F.avg(F.col("pos") + 1), 6).alias("mean_rank"))


def error_reasons(rows: DataFrame) -> DataFrame:
    """Histogram of reasons up to their first colon or bracket."""
    short = F.trim(F.substring(F.regexp_extract("reason", r"^[^:(]*", 0), 1, 40))
    return rows.filter("reason IS NOT NULL").groupBy(short.alias("reason")).count().withColumnRenamed("count", "n")


def nested_records(bulletins: DataFrame, papers: DataFrame) -> DataFrame:
    """One JSON record a bulletin with its documents in order."""
    docs = F.array_sort(F.collect_list(F.struct("paper_id", "doc_kind", "audience")))
    joined = bulletins.join(papers.groupBy("bulletin_id").agg(docs.alias("papers")), "bulletin_id", "left")
    return joined.select("bulletin_id", F.size(F.coalesce("papers", F.array().cast("array<struct<paper_id:bigint,doc_kind:string,audience:string>>"))).alias("n_papers"), F.to_json("papers").alias("papers_json"))


def _pack(batches, max_rows: int, max_bytes: int):
    pack, rows, size = 0, 0, 0
    for batch in batches:
        packs = []
        for n in batch["n_bytes"]:
            if rows and (rows >= max_rows or size + n > max_bytes):
                pack, rows, size = pack + 1, 0, 0
            rows, size = rows + 1, size + int(n)
            packs.append(pack)
        batch["pack"] = packs
        yield batch


def _ahead(sizes: np.ndarray, max_rows: int, max_bytes: int) -> np.ndarray:
    """For each row, the row that begins the next pack if a pack begins here."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(len(sizes))
    by_bytes = np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1
    return np.maximum(at + 1, np.minimum(at + max_rows, by_bytes))


def _exits(frame: pd.DataFrame, block_rows: int, max_rows: int, max_bytes: int) -> pd.DataFrame:
    """Of a block, for every row that a pack may begin with when the block before is done: where the last pack ends in the next block, and how many packs begin here."""
    frame = frame.sort_values("place")
    ahead = _ahead(frame["n_bytes"].to_numpy(), max_rows, max_bytes)
    own = int((frame["place"] // block_rows == frame["block"]).sum())
    out, packs = np.arange(own + max_rows) - own, np.zeros(own + max_rows, dtype=np.int64)
    for i in range(own - 1, -1, -1):
        out[i], packs[i] = out[ahead[i]], packs[ahead[i]] + 1
    entries = np.arange(min(own, max_rows))
    return pd.DataFrame({"block": frame["block"].iloc[0], "entry": entries, "exit": out[: len(entries)], "packs": packs[: len(entries)]})


def _assigned(frame: pd.DataFrame, max_rows: int, max_bytes: int) -> pd.DataFrame:
    """A block's rows with their packs; rows before its entry belong to the pack that began in the block before."""
    frame = frame.sort_values("place")
    ahead, i, begins = _ahead(frame["n_bytes"].to_numpy(), max_rows, max_bytes), int(frame["entry"].iloc[0]), np.zeros(len(frame), dtype=np.int64)
    while i < len(frame):
        begins[i], i = 1, int(ahead[i])
    return frame.assign(pack=frame["first_pack"] - 1 + np.cumsum(begins))[["key", "n_bytes", "pack"]]


def packed(rows: DataFrame, key: str, max_rows: int, max_bytes: int, block_rows: int = 1 << 20) -> DataFrame:
    """Consecutive rows packed greedily into requests of bounded rows and bytes, numbered from 0.

    A pack closes before the row that would be one too many or too large; a row larger than a pack
    is a pack alone. Sizes that are null count 0; rows of one key are ordered by size.

    Where a pack begins depends on all packs before, so rows are cut into blocks of ``block_rows``.
    A block sees the first rows of the next, and as a pack has at most ``max_rows`` rows, a block is
    entered at one of its first ``max_rows`` rows: each block says for every such entry where the
    next block is entered. The driver follows these (``max_rows`` small rows a block), and the blocks
    then assign their packs. A task holds one block.
    """
    block_rows = max(block_rows, max_rows)
    typed = rows.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col("n_bytes"), F.lit(0)).cast("long").alias("n_bytes"))
    n = max(1, -(-typed.count() // block_rows))
    # ranges come from a sample, so they are drawn once and kept
    dealt = typed.repartitionByRange(n, "key", "n_bytes").withColumn("part", F.spark_partition_id()).checkpoint()
    starts, seen = [], 0
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # one row a block
        starts.append((r.part, seen))
        seen += r["count"]
    spark = rows.sparkSession
    # one row a block
    first = F.broadcast(spark.createDataFrame(starts, "part int, start long"))
    order = Window.partitionBy("part").orderBy("key", "n_bytes")
    placed = dealt.join(first, "part").withColumn("place", F.col("start") + F.row_number().over(order) - 1).select("key", "n_bytes", "place", F.floor(F.col("place") / block_rows).alias("block"))
    again = placed.filter((F.col("block") > 0) & (F.col("place") % block_rows < max_rows)).withColumn("block", F.col("block") - 1)
    told = placed.unionByName(again).groupBy("block").applyInPandas(lambda f: _exits(f, block_rows, max_rows, max_bytes), "block long, entry long, exit long, packs long")
    table = {(r.block, r.entry): (r.exit, r.packs) for r in told.collect()}
    entries, entry, pack = [], 0, 0
    for block in range(-(-seen // block_rows)):
        entries.append((block, entry, pack))
        # the last block may be shorter than what the pack before reaches into it
        entry, more = table.get((block, entry), (0, 0))
        pack += more
    entered = F.broadcast(spark.createDataFrame(entries, "block long, entry long, first_pack long"))
    out = placed.join(entered, "block").groupBy("block").applyInPandas(lambda f: _assigned(f, max_rows, max_bytes), "key long, n_bytes long, pack long")
    return out.select(F.col("key").alias(key), "n_bytes", "pack")
