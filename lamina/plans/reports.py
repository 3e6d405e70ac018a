"""Reports and evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import reports as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def a05_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A05."""
    return ops.status_counts(derived.bulletins(spark, sf_dir))


_A05 = "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("pending", "processed", "failed")) + ", count(*) FILTER (WHERE status = 'pending' AND attempts > 0) AS retrying, count(*) FILTER (WHERE published IS NULL) AS undated FROM bulletins"


def q19_severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19, Q19."""
    return ops.severity_report(derived.bulletins(spark, sf_dir), derived.papers(spark, sf_dir))


_Q19 = """SELECT severity, coalesce(kind, '(none)') AS kind, status, count(*) AS n, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_papers FROM bulletins LEFT JOIN (SELECT bulletin_id, count(*) AS c FROM papers GROUP BY 1) USING (bulletin_id) GROUP BY 1, 2, 3"""


def q20_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20, A18, A31."""
    return ops.identities(derived.cars(spark, sf_dir), derived.links(spark, sf_dir))


_Q20 = """SELECT year, make, model, count(*) AS n_cars, string_agg(CAST(car_id AS VARCHAR), ',' ORDER BY car_id) AS car_ids, CAST(sum(coalesce(c, 0)) AS BIGINT) AS n_links
FROM cars LEFT JOIN (SELECT car_id, count(DISTINCT bulletin_id) AS c FROM links GROUP BY 1) USING (car_id) GROUP BY 1, 2, 3 HAVING count(*) > 1"""


def q20_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links to bulletins that are not processed. J05."""
    done = derived.bulletins(spark, sf_dir).filter("status = 'processed'")
    return derived.links(spark, sf_dir).join(done, "bulletin_id", "left_anti").groupBy("car_id").agg(F.count("*").alias("n_orphans"))


_Q20O = "SELECT car_id, count(*) AS n_orphans FROM links l WHERE NOT EXISTS (SELECT 1 FROM bulletins b WHERE b.bulletin_id = l.bulletin_id AND b.status = 'processed') GROUP BY 1"


def q22_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a stratified sample of 300 takes from each cell. Q22, A27, L18."""
    rows = derived.papers(spark, sf_dir).withColumn("system", F.lower(F.get("systems", F.lit(0))))
    return ops.strata_allocation(rows, ["doc_kind", "audience", "system"], 300)


_Q22 = """, c AS (SELECT doc_kind, audience, lower(systems[1]) AS system, count(*) AS available FROM papers GROUP BY ALL),
 t AS (SELECT count(*) AS n_cells, sum(available - 1)::DOUBLE AS left_ FROM c),
 s AS (SELECT c.*, least(greatest(300 - n_cells, 0), left_) AS spare, least(greatest(300 - n_cells, 0), left_) * (available - 1) / left_ AS exact FROM c, t),
 h AS (SELECT *, CAST(floor(exact) AS BIGINT) AS share, round(exact - floor(exact), 9) AS rest FROM s),
 o AS (SELECT *, CAST(share < available - 1 AS INT) AS open, sum(share) OVER () AS given FROM h),
 k AS (SELECT *, row_number() OVER (ORDER BY open DESC, rest DESC, doc_kind, audience, system) AS rank FROM o)
SELECT doc_kind, audience, system, available, share + 1 + CASE WHEN open = 1 AND rank <= spare - given THEN 1 ELSE 0 END AS take FROM k"""


def l09_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five bulletins of each tier in an order fixed by a seed; the draw is the feature. L09."""
    return ops.hash_sample(derived.bulletins(spark, sf_dir), "severity", "bulletin_id", 5).select("severity", "bulletin_id")


_L09 = "SELECT severity, bulletin_id FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY md5('7:' || bulletin_id), bulletin_id) AS rn FROM bulletins) WHERE rn <= 5"


def q24_arm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q24: extractions by audience as arms, in short."""
    return ops.arm_scores(derived.papers(spark, sf_dir).select(F.col("audience").alias("arm"), F.col("remedy").isNotNull().alias("valid"), "tokens_in", (F.col("tokens_in") * 0.0001).alias("cost")))


_Q24 = "SELECT audience AS arm, count(*) AS n, round(avg(CASE WHEN remedy IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS validity, round(avg(tokens_in), 4) AS mean_tokens_in, round(sum(tokens_in * 0.0001::DOUBLE) * 1000 / count(*), 4) AS cost_per_1000 FROM papers GROUP BY 1"


def c29_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a bulletin's documents differ."""
    return ops.disagreement(derived.papers(spark, sf_dir).select(F.col("bulletin_id").alias("doc"), F.col("paper_id").alias("arm"), F.col("audience").alias("answer")))


_C29 = "SELECT a.bulletin_id AS doc, round(avg(CASE WHEN a.audience <> b.audience THEN 1.0::DOUBLE ELSE 0 END), 6) AS gap FROM papers a JOIN papers b ON a.bulletin_id = b.bulletin_id AND a.paper_id < b.paper_id GROUP BY 1"


def a25_mean_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and mean ranks of ordered labels."""
    ordered = derived.papers(spark, sf_dir).groupBy("bulletin_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tokens_in", "paper_id", "audience"))), lambda s: s["audience"]).alias("ranking"))
    return ops.mean_ranks(ordered)


_A25 = "SELECT audience AS arm, count(*) FILTER (WHERE r = 1) AS wins, round(avg(r), 6) AS mean_rank FROM (SELECT audience, row_number() OVER (PARTITION BY bulletin_id ORDER BY tokens_in, paper_id) AS r FROM papers) GROUP BY 1"


def a26_error_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A26."""
    return ops.error_reasons(derived.bulletins(spark, sf_dir))


_A26 = "SELECT trim(left(regexp_extract(reason, '^[^:(]*'), 40)) AS reason, count(*) AS n FROM bulletins WHERE reason IS NOT NULL GROUP BY 1"


def s10_nested_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S10, J15."""
    return ops.nested_records(derived.bulletins(spark, sf_dir), derived.papers(spark, sf_dir))


_S10 = """SELECT b.bulletin_id, coalesce(n, 0) AS n_papers, j AS papers_json FROM bulletins b LEFT JOIN (SELECT bulletin_id, count(*) AS n,
 '[' || string_agg('{"paper_id":' || paper_id || ',"doc_kind":"' || doc_kind || '","audience":"' || audience || '"}', ',' ORDER BY paper_id) || ']' AS j FROM papers GROUP BY 1) USING (bulletin_id)"""


def c40_request_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into requests of 100 rows and 60,000 bytes. C40."""
    rows = derived.papers(spark, sf_dir).select("paper_id", F.col("tokens_in").alias("n_bytes"))
    return ops.packed(rows, "paper_id", 100, 60_000)


_C40 = TABLES.replace("WITH bulletins", "WITH RECURSIVE bulletins", 1) + """, r AS MATERIALIZED (SELECT paper_id, tokens_in AS n_bytes, row_number() OVER w AS i, sum(tokens_in) OVER w AS total FROM papers WINDOW w AS (ORDER BY paper_id ROWS UNBOUNDED PRECEDING)),
 ahead AS MATERIALIZED (SELECT a.i, coalesce(min(b.i), a.i + 100) AS j FROM r a LEFT JOIN r b ON b.i > a.i AND b.i <= a.i + 100 AND (b.i = a.i + 100 OR b.total - a.total + a.n_bytes > 60000) GROUP BY a.i),
 begun(i, pack) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT ahead.j, pack + 1 FROM begun JOIN ahead USING (i))
SELECT r.paper_id, r.n_bytes, b.pack FROM r ASOF JOIN begun b ON r.i >= b.i"""

QUERIES = {f.__name__: f for f in (a05_status_counts, q19_severity_report, q20_identities, q20_orphans, q22_strata, q24_arm_scores, c29_disagreement, a25_mean_ranks, a26_error_reasons, s10_nested_records, l09_hash_sample, c40_request_packs)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_A05, _Q19, _Q20, _Q20O, _Q22, _Q24, _C29, _A25, _A26, _S10, _L09))} | {"c40_request_packs": _C40}
