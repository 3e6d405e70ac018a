"""Sources of windows: zipped CSV files, JSON payloads, and the ledger of what was read."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a window's file is named, and the first cell of its heading.
WINDOW_NAME, HEADING = r"RECEIVED_(\d{4}-\d{4})\.zip$", "TSB/Document ID"


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows found in a folder, sorted, once each, with their file and an etag of name, size and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "length", "modificationTime")
    named = files.withColumn("source_window", F.regexp_extract("path", WINDOW_NAME, 1)).filter("source_window <> ''")
    return named.groupBy("source_window").agg(F.max("path").alias("path"), F.max(F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256)).alias("etag")).orderBy("source_window")


def _rows(batches) -> Iterator:
    import pandas as pd

    csv.field_size_limit(2**31 - 1)  # a cell of any length
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as archive:
                for name in archive.namelist():
                    lines = io.TextIOWrapper(archive.open(name), encoding="utf-8", errors="replace", newline="")
                    rows, window = [], path.rsplit("RECEIVED_", 1)[-1][:9]
                    for cells in csv.reader(lines):
                        if len(cells) >= 5 and cells[0].strip() != HEADING:
                            rows.append([*cells[:5], window])
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=range(6))
                            rows = []
                    yield pd.DataFrame(rows, columns=range(6), dtype=object)


def zipped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of zipped CSV files, one file a task, in batches; bad UTF-8 replaced, quoted newlines kept."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder).select("path", "content")
    return files.mapInPandas(_rows, "raw_id string, raw_make string, raw_model string, raw_years string, summary string, source_window string")


def listed_cars(spark: SparkSession, text: str | None = None, path: str | None = None) -> DataFrame:
    """year, make, model of a JSON list of cars, given as text or as a file."""
    whole = spark.read.text(path, wholetext=True) if path else spark.createDataFrame([(text,)], "value string")
    return whole.select(F.explode(F.from_json("value", "array<struct<year: int, make: string, model: string>>")).alias("c")).select("c.*")


def payload_bulletin(payload: str = "payload", wanted: str = "bulletin_id"):
    """The bulletin of a JSON payload with the wanted id, else the first."""
    found = F.from_json(payload, "results ARRAY<STRUCT<id: STRING, number: STRING, summary: STRING>>")["results"]
    return F.coalesce(F.get(F.filter(found, lambda r: r["id"] == F.col(wanted)), F.lit(0)), F.get(found, F.lit(0)))
