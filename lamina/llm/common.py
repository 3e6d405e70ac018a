"""What several operators share: shared-folder tables, row keys, shard counts."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts after every real id; stands for a null id.
NULL_ORDER = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    There is no other to fall back on: a local folder is another one on each machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


_scopes: list[list[DataFrame]] = []


@contextmanager
def cleared() -> Iterator[None]:
    """Deletes, at its end, the tables that were written within it, but those that are to be kept."""
    _scopes.append([])
    try:
        yield
    finally:
        for table in _scopes.pop():
            dropped(table)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def dropped(table: DataFrame) -> None:
    """Delete a table that ``written`` made, once nothing reads it any more."""
    path = getattr(table, "written_at", None)
    if path:
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scan_partitions(df: DataFrame) -> int:
    """Partitions of the plan; a scan has them in proportion to its bytes. Runs no job."""
    return max(1, df._jdf.toJavaRDD().getNumPartitions())


def shard_count(df: DataFrame, per_partition: int = 4) -> int:
    """Shards in proportion to the input, so that one shard keeps its size as the input grows."""
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return per_partition * max(shuffle, scan_partitions(df))


def keyed_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc`` (a struct of all columns, so that no name can clash), ``row_key`` (unique) and ``row_order`` (the id, null last).

    Ids that are unique and not null are their own keys. Otherwise the rows are written once with
    a generated key, so that a later read sees the same keys even if executors were lost.
    """
    own = F.col(id_col).cast("long")
    clash = docs.select(own.alias("i")).groupBy("i").count().filter((F.col("count") > 1) | F.col("i").isNull())
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    if clash.isEmpty():
        # the filter drops nothing; joins would add it to one use of these rows and not to another
        return docs.filter(own.isNotNull()).select(doc, own.alias("row_key"), own.alias("row_order"))
    return written(docs.select(doc, F.monotonically_increasing_id().alias("row_key"), F.coalesce(own, F.lit(NULL_ORDER)).alias("row_order")), "keyed")


def slim(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, row_order, doc_id and text of keyed rows."""
    return rows.select("row_key", "row_order", F.col(f"doc.`{id_col}`").cast("long").alias("doc_id"), F.col(f"doc.`{text_col}`").cast("string").alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just row_key, row_order, doc_id and text of documents, with keys as in ``keyed_rows``."""
    return slim(keyed_rows(docs.select(id_col, text_col), id_col), id_col, text_col)
