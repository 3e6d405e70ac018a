"""Results of arms as lines of JSON, a folder for each arm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write(outputs: DataFrame, folder: str) -> None:
    """Write or replace the arms that the rows have; other arms stay. Rows need an arm."""
    outputs.filter("arm IS NOT NULL").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("arm").json(folder)


def read(spark: SparkSession, folder: str, schema: StructType, arms: Sequence[str] | None = None) -> DataFrame:
    """Rows of the wanted arms; an arm without results gives none.

    Only line feeds end a line, since other breaks stand raw inside texts; blank lines are left out,
    and a line that is no JSON raises an error. Only the folders of wanted arms are read.
    """
    rows = spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(folder)
    return rows if arms is None else rows.filter(F.col("arm").isin(*arms))
