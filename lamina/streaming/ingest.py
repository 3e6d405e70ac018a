"""Windows of flat-file rows as they land, each published once.

What is streamed are notices: a few values a window, written after the window's rows are in place.
A notice names the window, its etag, when it landed and where its rows are. A batch takes each
window's newest notice, passes over windows whose etag is the published one, cleans the others'
rows, and publishes vocabulary and ledger together with the batch's number. So a changed window
replaces its partition exactly once: a batch that died before the manifest left nothing, and one
that died after it is recognised by its number when it is run again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import vocabulary
from lamina.sources.snapshots import Snapshots

NOTICE = "source_window string, etag string, landed_at timestamp_ntz, path string"
#: What a notice may do: nothing new, a replay of a batch, a changed window.
UNCHANGED, REPLAYED, INGESTED = "unchanged", "replayed", "ingested"


def landed_rows(spark: SparkSession, notices: list, schema: str) -> DataFrame:
    """The raw rows of windows, from where their notices say."""
    return spark.read.schema(schema).parquet(*(n.path for n in notices))


def ingest(store: Snapshots, notices: DataFrame, batch: int, raw_schema: str, stream: str = "windows") -> dict[str, str]:
    """Publish the changed windows of one batch of notices, and say what became of each window. Windows are few; their rows are not."""
    known = store.manifest()
    newest = notices.groupBy("source_window").agg(F.max_by(F.struct("etag", "landed_at", "path"), F.struct("landed_at", "etag")).alias("n")).select("source_window", "n.*").collect()
    if known["marks"].get(stream, -1) >= batch:
        return {n.source_window: REPLAYED for n in newest}
    etags = known["marks"].get("etags", {})
    changed = [n for n in newest if n.etag is None or etags.get(n.source_window) != n.etag]
    said = {n.source_window: INGESTED if n in changed else UNCHANGED for n in newest}
    if not changed:
        return said
    windows = [n.source_window for n in changed]
    # rows of a window's own file only, whatever window they claim
    raw = landed_rows(store.spark, changed, raw_schema).filter(F.col("source_window").isin(windows))
    rows = vocabulary.clean_rows(raw).withColumn("model_year", F.col("model_year").cast("int"))
    per_window = rows.groupBy("source_window").agg(F.count("*").alias("row_count"))
    told = store.spark.createDataFrame([(n.source_window, n.etag, n.landed_at) for n in changed], "source_window string, etag string, landed_at timestamp_ntz")
    ledger = told.join(per_window, "source_window", "left").select("source_window", "etag", "landed_at", F.coalesce("row_count", F.lit(0)).alias("row_count"))
    stage = store.stage({"vocabulary": vocabulary.vocabulary(rows), "ingests": ledger}, {"vocabulary": "source_window", "ingests": "source_window"}, known["version"])
    store.publish(stage, {"vocabulary": windows, "ingests": windows}, {stream: batch, "etags": etags | {n.source_window: n.etag for n in changed}})
    return said


def run_ingest(store: Snapshots, notices_folder: str, checkpoint: str, raw_schema: str, handle: Callable[..., dict] = ingest) -> None:
    """Stream the notices that have landed until none is left, one file a batch, in the order they landed."""
    stream = store.spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", 1).parquet(notices_folder)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda frame, batch: handle(store, frame, batch, raw_schema) and None).start()
    query.awaitTermination()


def missing_scans(store: Snapshots, scans: DataFrame) -> DataFrame:
    """car_id and source_window of cars that no scan of the window's published etag has seen (S02, J06): a window is stale for a car until then."""
    windows = store.read("ingests").select("source_window", "etag").collect() if "ingests" in store.manifest()["tables"] else []
    each = F.array(*[F.struct(F.lit(r.source_window).alias("source_window"), F.lit(r.etag).cast("string").alias("etag")) for r in windows]).cast("array<struct<source_window:string,etag:string>>")
    wanted = scans.select("car_id").distinct().withColumn("w", F.explode(each)).select("car_id", "w.*")
    done = scans.select("car_id", "source_window", "etag")
    same = (wanted.car_id == done.car_id) & (wanted.source_window == done.source_window) & wanted.etag.eqNullSafe(done.etag)
    return wanted.join(done, same, "left_anti").select("car_id", "source_window")
