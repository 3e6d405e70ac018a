"""Pages with totals and lookups by id, name, list or beginning."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import bulletins as ops
from lamina.operators import vocabulary
from lamina.plans import vocabulary as vocabulary_plans
from lamina.plans.oracle import TABLES
from lamina.sources import derived, flatfile


def q01_page_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q01: a page of the folded list and how many there are in all."""
    rows = derived.bulletins(spark, sf_dir).filter(ops.Filters(severity="serious", since=datetime(1994, 1, 1)).condition())
    return ops.page_with_total(ops.latest(rows), number=3, size=20).select("bulletin_id", "published", "superseded", "total")


_Q01T = """, r AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY published DESC NULLS LAST, bulletin_id DESC) AS rn, count(*) OVER (PARTITION BY stem) - 1 AS superseded
 FROM stemmed WHERE severity = 'serious' AND published >= TIMESTAMP '1994-01-01')
SELECT bulletin_id, published, superseded, count(*) OVER () AS total FROM r WHERE rn = 1 ORDER BY published DESC NULLS LAST, bulletin_id DESC LIMIT 20 OFFSET 40"""


def q02_detail_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some bulletins by id, with all revisions of their families; the ids reach every scan."""
    return ops.details(derived.bulletins(spark, sf_dir), derived.papers(spark, sf_dir), derived.links(spark, sf_dir), ["10000001", "10000005", "10000007", "99999999"])


_Q02D = """SELECT bulletin_id, stem, (SELECT count(*) - 1 FROM stemmed o WHERE o.stem = s.stem) AS revisions, (SELECT count(*) FROM links l WHERE l.bulletin_id = s.bulletin_id) AS n_cars,
 (SELECT count(*) FROM papers p WHERE p.bulletin_id = s.bulletin_id) AS n_papers, (SELECT arg_min(paper_summary, paper_id) FROM papers p WHERE p.bulletin_id = s.bulletin_id AND paper_summary IS NOT NULL) AS paper_summary
FROM stemmed s WHERE bulletin_id IN ('10000001', '10000005', '10000007', '99999999')"""


def q07_filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One account's unread bulletins of two tiers with a tag, the gravest first, a page."""
    mine = derived.garage(spark, sf_dir).filter("user_id = 3").select("car_id")
    linked = derived.links(spark, sf_dir).join(F.broadcast(mine), "car_id", "left_semi").select("car_id", "bulletin_id")
    families = ops.fold(ops.stemmed(linked.join(derived.bulletins(spark, sf_dir), "bulletin_id")), ["car_id", "stem"])
    read = derived.reads(spark, sf_dir).filter("user_id = 3").select("bulletin_id")
    rows = ops.tagged(families.filter(F.col("severity").isin("serious", "medium")).join(read, "bulletin_id", "left_anti"), derived.papers(spark, sf_dir), "symptoms", ["NO START"])
    order = [F.when(F.col("severity") == "serious", 0).otherwise(1), F.col("published").desc_nulls_last(), F.col("bulletin_id").desc(), F.col("car_id")]
    return ops.page_with_total(rows, number=1, size=25, order=order).select("car_id", "bulletin_id", "severity", "published", "total")


_Q07P = """, r AS (SELECT f.* FROM car_families f WHERE car_id IN (SELECT car_id FROM garage WHERE user_id = 3) AND severity IN ('serious', 'medium')
  AND bulletin_id NOT IN (SELECT bulletin_id FROM reads WHERE user_id = 3) AND bulletin_id IN (SELECT bulletin_id FROM (SELECT bulletin_id, unnest(symptoms) AS s FROM papers) WHERE lower(s) = 'no start'))
SELECT car_id, bulletin_id, severity, published, count(*) OVER () AS total FROM r ORDER BY severity = 'serious' DESC, published DESC NULLS LAST, bulletin_id DESC, car_id LIMIT 25"""


def q10_lookup_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the cars with a year, make and model (car 1's, written by hand otherwise)."""
    cars = derived.cars(spark, sf_dir)
    asked = cars.filter("car_id = 1").first()
    return ops.lookup(cars, derived.links(spark, sf_dir), derived.bulletins(spark, sf_dir), asked["year"], asked["make"].lower(), asked["model"].replace(" ", "-"))


_Q10N = """, me AS (SELECT year, make, model FROM cars WHERE car_id = 1), f AS (SELECT * FROM car_families WHERE car_id IN (SELECT car_id FROM cars JOIN me USING (year, make, model)))
SELECT t.severity, count(f.bulletin_id) AS n, max(f.published) AS newest FROM (VALUES ('serious'), ('medium'), ('small')) t(severity) LEFT JOIN f ON f.severity = t.severity GROUP BY t.severity"""


def f10_families_by_beginning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bulletins whose number begins like one of a list, whatever the case, if their family is the one meant."""
    return ops.families_of(ops.stemmed(derived.bulletins(spark, sf_dir)), ["PIT12", "pit7", "N24248"]).select("bulletin_id", "number", "stem")


_F10 = """SELECT bulletin_id, number, stem FROM stemmed WHERE (ltrim(number) ILIKE 'PIT12%' OR ltrim(number) ILIKE 'pit7%' OR ltrim(number) ILIKE 'N24248%') AND stem IN ('PIT12', 'PIT7', 'N24248')"""


def j12_seeded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state of a small old table, once for each admin, where there is none yet."""
    old = spark.createDataFrame([(datetime(2024, 1, 5),)], "last_watermark timestamp_ntz")
    people = derived.accounts(spark, sf_dir)
    return people.filter("is_admin").select("user_id").crossJoin(F.broadcast(old)).join(people.filter("last_watermark IS NOT NULL").select("user_id"), "user_id", "left_anti")


_J12 = "SELECT user_id, TIMESTAMP '2024-01-05' AS last_watermark FROM accounts WHERE is_admin AND last_watermark IS NULL"

#: A list file of cars, as it is written.
SEEDS = '[{"year": 2020, "make": " make 0", "model": "f-12"}, {"year": 2021, "make": "Make 1", "model": "F  30"}, {"year": 2001, "make": "none", "model": "x"}]'


def q25_prefill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What listed cars would bring and cost."""
    vocab = vocabulary.vocabulary(vocabulary.clean_rows(derived.filed_rows(spark, sf_dir)))
    return vocabulary.prefill_plan(flatfile.listed_cars(spark, SEEDS), derived.cars(spark, sf_dir), vocab, documents_per_bulletin=1.5, cost_per_document=0.02)


_Q25 = vocabulary_plans._RESOLVED + """, seeds AS (SELECT CAST(s.year AS INT) AS year, upper(trim(s.make)) AS make, trim(regexp_replace(replace(upper(s.model), '-', ' '), '\\s+', ' ', 'g')) AS model
  FROM (SELECT unnest(from_json('""" + SEEDS + """', '[{"year":"INT","make":"VARCHAR","model":"VARCHAR"}]')) AS s)),
 b AS (SELECT r.model_year, r.make, r.listed, CAST(sum(v.bulletins) AS BIGINT) AS n FROM resolved r JOIN vocabulary v USING (model_year, make, model) GROUP BY ALL),
 o AS (SELECT s.*, (SELECT min(car_id) FROM cars c WHERE c.year = s.year AND c.make = s.make AND c.model = s.model) AS car_id,
  coalesce((SELECT b.n FROM resolved r JOIN b ON b.model_year = r.model_year AND b.make = r.make AND b.listed = r.listed WHERE r.model_year = s.year AND r.make = s.make AND r.model = s.model), 0) AS n_bulletins FROM seeds s)
SELECT year, make, model, car_id, n_bulletins, CAST(ceil(n_bulletins * 1.5) AS BIGINT) AS n_documents, round(ceil(n_bulletins * 1.5) * 0.02::DOUBLE, 4) AS cost_usd FROM o"""


def s08_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted bulletin of JSON lines, else their first; lines that are no JSON give none."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "attempts", "number")
    own = F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("id"), F.lit("n0").alias("number"), F.lit("first").alias("summary")), F.struct(F.when(F.col("attempts") > 0, F.col("bulletin_id")).otherwise("y").alias("id"), F.coalesce("number", F.lit("")).alias("number"), F.lit("own").alias("summary"))).alias("results")))
    found = rows.withColumn("payload", F.when(F.col("attempts") == 3, F.lit("{oops")).otherwise(own)).withColumn("p", flatfile.payload_bulletin())
    return found.select("bulletin_id", "p.id", F.col("p.number").alias("number"), F.col("p.summary").alias("summary"))


_S08 = """, p AS (SELECT bulletin_id, CASE WHEN attempts = 3 THEN '{oops' ELSE CAST(json_object('results', [{'id': 'x', 'number': 'n0', 'summary': 'first'}, {'id': CASE WHEN attempts > 0 THEN bulletin_id ELSE 'y' END, 'number': coalesce(number, ''), 'summary': 'own'}]) AS VARCHAR) END AS payload FROM bulletins),
 j AS (SELECT bulletin_id, CASE WHEN json_valid(payload) THEN from_json(json_extract(payload, '$.results'), '[{"id":"VARCHAR","number":"VARCHAR","summary":"VARCHAR"}]') END AS r FROM p),
 c AS (SELECT bulletin_id, coalesce(list_filter(r, lambda x: x.id = bulletin_id)[1], r[1]) AS b FROM j)
SELECT bulletin_id, b.id AS id, b.number AS number, b.summary AS summary FROM c"""


def c44_storable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without NUL."""
    return derived.read(spark, sf_dir, "documents").select("doc_id", text.checksum(text.storable(F.concat(F.lit("\0a\0"), "text", F.lit("\0")))).alias("checksum"))


_C44 = "SELECT doc_id, left(sha256(replace(chr(0) || 'a' || chr(0) || text || chr(0), chr(0), '')), 16) AS checksum FROM documents"


def c47_listed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma list of a request as a filter, blanks dropped."""
    return derived.bulletins(spark, sf_dir).filter(F.col("kind").isin(*text.csv_list(" TSB, ,RC,"))).select("bulletin_id", "kind")


QUERIES = {f.__name__: f for f in (q01_page_with_total, q02_detail_by_id, q07_filtered_page, q10_lookup_by_name, f10_families_by_beginning, j12_seeded_states, q25_prefill_plan, s08_payloads, c44_storable_texts, c47_listed_kinds)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_Q01T, _Q02D, _Q07P, _Q10N, _F10, _J12, _Q25, _S08, _C44, "SELECT bulletin_id, kind FROM bulletins WHERE kind IN ('TSB', 'RC')"))}
