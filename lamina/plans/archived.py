"""Archives of windows read member by member, and what texts name of a bulletin's cars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import vocabulary
from lamina.plans.oracle import TABLES
from lamina.sources import archives, derived, flatfile
from lamina.sources.snapshots import shared_folder


def _archives(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark, "archives")
    archives.write_archives(derived.filed_rows(spark, sf_dir), folder, per_member=500)
    return folder


def s03_archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean rows of zipped CSV files, a task for each member. S03, S04."""
    return vocabulary.clean_rows(archives.archived_rows(spark, _archives(spark, sf_dir)))


def s01_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that a folder of archives has, each with an etag. S01, S02."""
    return flatfile.windows(spark, _archives(spark, sf_dir)).select("source_window", (F.length("etag") == 64).alias("has_etag"))


def c28_applicability_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a text names of the years and models that a bulletin is for. C28."""
    stored = derived.read(spark, sf_dir, "part")
    # a small file holds many rows, each of which costs much more than its bytes: they are dealt by number, not by the file's splits
    dealt = stored.select("p_partkey", "p_name", "p_size", "p_brand").repartition(derived.row_partitions(stored, 20_000), "p_partkey")
    parts = dealt.selectExpr(
        "p_partkey",
        """filter(array(named_struct('year', CAST(2018 + p_partkey % 4 AS STRING), 'model', p_name), named_struct('year', 'n/a', 'model', concat('f-', CAST(p_size AS STRING))),
           named_struct('year', CAST(NULL AS STRING), 'model', concat(CAST(p_size AS STRING), '.5 (', p_brand, ')')), named_struct('year', '2030', 'model', ' ')), p -> p_partkey % 7 <> 0 OR p.year = '2030') AS products""",
        """CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN concat('Fits ', p_name, ', 2018 - 2020') WHEN 2 THEN concat('F ', CAST(p_size AS STRING), '0 of 2019 and 2030')
           WHEN 3 THEN concat('x', p_name, '; f-', CAST(p_size AS STRING), '.') WHEN 4 THEN concat(upper(p_name), '/', CAST(p_size AS STRING), '.5 (', lower(p_brand), ')')
           ELSE concat(CAST(p_size AS STRING), '.5 (', p_brand, ')x F', CAST(p_size AS STRING)) END AS applicability""",
    )
    return parts.withColumn("r", text.applicability_recall(F.col("products"), F.col("applicability"))).select("p_partkey", "r.*")


_NORMAL = "trim(regexp_replace(replace(upper({}), '-', ' '), '\\s+', ' ', 'g'))"
_C28 = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [] ELSE [2018 + p_partkey % 4] END || [2030] AS years,
  CASE WHEN p_partkey % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE [p_name, 'f-' || p_size, p_size || '.5 (' || p_brand || ')'] END AS models,
  coalesce(CASE p_partkey % 6 WHEN 1 THEN 'Fits ' || p_name || ', 2018 - 2020' WHEN 2 THEN 'F ' || p_size || '0 of 2019 and 2030' WHEN 3 THEN 'x' || p_name || '; f-' || p_size || '.'
   WHEN 4 THEN upper(p_name) || '/' || p_size || '.5 (' || lower(p_brand) || ')' WHEN 5 THEN p_size || '.5 (' || p_brand || ')x F' || p_size END, '') AS t FROM part),
 m AS (SELECT p_partkey, list_distinct(list_transform(models, lambda x: {_NORMAL.format('x')})) AS models, list_distinct(years) AS years, t, {_NORMAL.format('t')} AS h,
  CASE p_partkey % 6 WHEN 1 THEN [2018, 2019, 2020] WHEN 2 THEN [2019, 2030] ELSE CAST([] AS BIGINT[]) END AS named FROM p),
 n AS (SELECT p_partkey, len(years) AS ny, len(models) AS nm, len(list_filter(years, lambda y: list_contains(named, y))) AS hy,
  len(list_filter(models, lambda x: regexp_matches(h, '(^|[^A-Z0-9])' || regexp_escape(x) || '($|[^A-Z0-9])'))) AS hm FROM m)
SELECT p_partkey, round(hy / ny, 6) AS year_recall, CASE WHEN nm > 0 THEN round(hm / nm, 6) END AS model_recall, round((hy + hm) / (ny + nm), 6) AS recall FROM n"""

QUERIES = {f.__name__: f for f in (s03_archived_rows, s01_windows, c28_applicability_recall)}
ORACLE_SQL = {
    "s03_archived_rows": TABLES + "SELECT bulletin_id, make, model, model_year, summary, source_window FROM clean",
    "s01_windows": TABLES + "SELECT DISTINCT source_window, true AS has_etag FROM filed",
    "c28_applicability_recall": _C28,
}
