"""Flat files to a vocabulary, spellings and discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import vocabulary as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived

#: Makes the picker shows, in this order.
SHOWN_MAKES = ("MAKE 2", "MAKE 0", "MAKE 9")


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.clean_rows(derived.filed_rows(spark, sf_dir))


def s04_clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hygiene of flat-file rows, packed years split. S04, C01."""
    return _clean(spark, sf_dir)


def a01_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct bulletins by year, make, model and window, each bulletin in its newest window. A01, W05."""
    return ops.vocabulary(ops.newest_window(_clean(spark, sf_dir)))


_A01 = """, newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bulletin_id, make, model, model_year ORDER BY source_window DESC, summary) AS rn FROM clean) WHERE rn = 1)
SELECT model_year, make, model, source_window, count(DISTINCT bulletin_id) AS bulletins FROM newest GROUP BY ALL"""


def c04_resolved_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling and the name it is listed as. C02-C04, J16, A02."""
    return ops.resolved_models(ops.vocabulary(_clean(spark, sf_dir)))


_RESOLVED = """, counts AS (SELECT model_year, make, model, CAST(sum(bulletins) AS BIGINT) AS n FROM vocabulary GROUP BY ALL),
 named AS (SELECT *, regexp_matches(model, '^(REDUNDANT|DUPLICATE)\\s') AS junk, replace(replace(regexp_replace(model, '^(REDUNDANT|DUPLICATE)\\s+', ''), ' ', ''), '-', '') AS key FROM counts),
 listed AS (SELECT model_year, make, key, first(model ORDER BY n DESC, length(model) - length(replace(model, ' ', '')) DESC, model) AS listed FROM named WHERE NOT junk GROUP BY model_year, make, key),
 near AS (SELECT j.model_year, j.make, j.model, count(*) AS c, min(l.listed) AS one FROM named j JOIN listed l ON l.model_year = j.model_year AND l.make = j.make AND length(j.key) >= 3 AND (starts_with(l.key, j.key) OR ends_with(l.key, j.key)) WHERE j.junk GROUP BY ALL),
 resolved AS (SELECT n.model_year, n.make, n.model, CASE WHEN NOT n.junk THEN l.listed ELSE coalesce(l.listed, CASE WHEN r.c = 1 THEN r.one END, n.model) END AS listed
  FROM named n LEFT JOIN listed l ON l.model_year = n.model_year AND l.make = n.make AND l.key = n.key LEFT JOIN near r ON r.model_year = n.model_year AND r.make = n.make AND r.model = n.model)
"""


def w04_vehicle_bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletins of every listed car by any spelling, its own first. W04, J03, U05."""
    rows = _clean(spark, sf_dir)
    resolved = ops.resolved_models(ops.vocabulary(rows))
    cars = resolved.select("model_year", "make", F.col("listed").alias("car_model")).distinct()
    return ops.own_spelling_first(rows, resolved, cars)


_W04 = _RESOLVED + """, own AS (SELECT DISTINCT r.model_year, r.make, r.listed AS car_model FROM resolved r),
 own2 AS (SELECT o.*, r.listed FROM own o JOIN resolved r ON r.model_year = o.model_year AND r.make = o.make AND r.model = o.car_model),
 both_ AS (SELECT o.model_year, o.make, o.car_model, c.bulletin_id, c.model, c.summary, c.source_window FROM own2 o JOIN resolved r ON r.model_year = o.model_year AND r.make = o.make AND r.listed = o.listed
  JOIN clean c ON c.model_year = r.model_year AND c.make = r.make AND c.model = r.model)
SELECT model_year, make, car_model, bulletin_id, model, summary, source_window FROM (SELECT *, row_number() OVER (PARTITION BY model_year, make, car_model, bulletin_id ORDER BY model <> car_model, model, source_window, summary) AS rn FROM both_) WHERE rn = 1"""


def q11_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest years without 9999, shown makes in their order, listed models. L07, L08, F20."""
    resolved = ops.resolved_models(ops.vocabulary(_clean(spark, sf_dir)))
    years = resolved.select("model_year").distinct().filter("model_year <> 9999").orderBy(F.desc("model_year")).limit(30)
    makes = spark.createDataFrame([(m, i) for i, m in enumerate(SHOWN_MAKES)], "make string, make_order int")
    rows = resolved.join(F.broadcast(years), "model_year").join(F.broadcast(makes), "make")
    return rows.groupBy("model_year", "make", "make_order", "listed").agg(F.count("*").alias("n_spellings"))


_Q11 = _RESOLVED + """, shown(make, make_order) AS (VALUES ('MAKE 2', 0), ('MAKE 0', 1), ('MAKE 9', 2)), years AS (SELECT DISTINCT model_year FROM resolved WHERE model_year <> 9999 ORDER BY model_year DESC LIMIT 30)
SELECT model_year, make, make_order, listed, count(*) AS n_spellings FROM resolved JOIN shown USING (make) JOIN years USING (model_year) GROUP BY ALL"""


def j17_rekey_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed name of long model names, by longest beginning. J17, Q21."""
    vocab = ops.vocabulary(_clean(spark, sf_dir))
    names = vocab.select(F.concat("model", F.lit(" LTD")).alias("canonical")).distinct()
    return ops.longest_prefix(names, vocab)


_J17 = """, names AS (SELECT DISTINCT model || ' LTD' AS canonical FROM vocabulary), v AS (SELECT DISTINCT model FROM vocabulary),
 w AS (SELECT canonical, arg_max(model, length(model)) AS by_word FROM names JOIN v ON starts_with(canonical || ' ', model || ' ') GROUP BY canonical),
 k AS (SELECT replace(model, ' ', '') AS part, max(model) AS model FROM v GROUP BY 1),
 c AS (SELECT canonical, first(model ORDER BY length(part) DESC, model DESC) AS loose FROM names JOIN k ON part <> '' AND starts_with(replace(canonical, ' ', ''), part) GROUP BY canonical)
SELECT n.canonical, coalesce(w.by_word, c.loose) AS target FROM names n LEFT JOIN w USING (canonical) LEFT JOIN c USING (canonical)"""


def a15_merged_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cars that become one: keywords united, first sight kept. A15, A14, C33."""
    cars = derived.cars(spark, sf_dir).select("car_id", "year", "make", "model")
    linked = derived.links(spark, sf_dir).join(cars, "car_id").withColumn("keywords", F.array(F.lower("make"), F.lower("model")))
    return linked.groupBy("year", "make", "model", "bulletin_id").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords")))), ",").alias("keywords"), F.min("first_seen_at").alias("first_seen_at"), F.count("*").alias("n_links")
    )


_A15 = """SELECT year, make, model, bulletin_id, CASE WHEN lower(make) < lower(model) THEN lower(make) || ',' || lower(model) ELSE lower(model) || ',' || lower(make) END AS keywords,
 min(first_seen_at) AS first_seen_at, count(*) AS n_links FROM links JOIN cars USING (car_id) GROUP BY ALL"""


def q26_stale_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows whose content is not the recorded one. S02, J06, F11, Q26."""
    seen = _clean(spark, sf_dir).groupBy("source_window").agg(text.checksum(F.count("*").cast("string")).alias("etag"))
    recorded = seen.select("source_window", F.when(F.col("source_window") == "2015-2019", F.col("etag")).alias("etag"))
    return ops.stale_windows(seen, recorded)


_Q26 = """, seen AS (SELECT source_window, left(sha256(CAST(count(*) AS VARCHAR)), 16) AS etag FROM clean GROUP BY 1)
SELECT source_window, etag FROM seen WHERE etag IS DISTINCT FROM (CASE WHEN source_window = '2015-2019' THEN etag END)"""

QUERIES = {f.__name__: f for f in (s04_clean_rows, a01_vocabulary, c04_resolved_models, w04_vehicle_bulletins, q11_discovery, j17_rekey_plan, a15_merged_links, q26_stale_windows)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, ("SELECT bulletin_id, make, model, model_year, summary, source_window FROM clean", _A01, _RESOLVED + "SELECT * FROM resolved", _W04, _Q11, _J17, _A15, _Q26))}
