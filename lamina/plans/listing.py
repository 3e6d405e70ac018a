"""Bulletin lists (Q01-Q03, Q07-Q10, Q18): filters, folds, facets and pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import bulletins as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived
from lamina.sources.snapshots import stored


def q01_list_communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters, newest revision per family, documents rolled up, one page. F01-F03, F07, F16, W01, J08-J10, L01."""
    rows, papers = derived.bulletins(spark, sf_dir), derived.papers(spark, sf_dir)
    rows = rows.filter(ops.Filters(status="processed", since=datetime(1995, 6, 1), until=datetime(2001, 6, 1)).condition())
    rows = ops.tagged(rows, papers, "systems", ["BRAKES", "infotainment"])
    listed = ops.page(ops.latest(rows), number=2, size=50)
    # only the page's documents are rolled up
    own = papers.join(F.broadcast(listed.select("bulletin_id")), "bulletin_id", "left_semi")
    out = ops.with_papers(listed, own, "symptoms", "systems")
    return out.select("bulletin_id", "number", "published", "severity", F.coalesce("summary", F.lit("")).alias("summary"), "superseded", "n_papers", "paper_summary", *[F.array_join(c, "|").alias(c) for c in ("symptoms", "systems")])


_Q01 = """, hit AS (SELECT * FROM stemmed WHERE status = 'processed' AND published >= TIMESTAMP '1995-06-01' AND published <= TIMESTAMP '2001-06-01'
  AND bulletin_id IN (SELECT bulletin_id FROM (SELECT bulletin_id, unnest(systems) AS s FROM papers) WHERE lower(s) IN ('brakes', 'infotainment'))),
 ranked AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY stem) - 1 AS superseded FROM hit WINDOW w AS (PARTITION BY stem ORDER BY published DESC NULLS LAST, bulletin_id DESC)),
 pg AS (SELECT * FROM ranked WHERE rn = 1 ORDER BY published DESC NULLS LAST, bulletin_id DESC LIMIT 50 OFFSET 50)
SELECT bulletin_id, number, published, severity, coalesce(summary, '') AS summary, superseded,
 (SELECT count(*) FROM papers p WHERE p.bulletin_id = pg.bulletin_id) AS n_papers,
 (SELECT arg_min(paper_summary, paper_id) FROM papers p WHERE p.bulletin_id = pg.bulletin_id AND paper_summary IS NOT NULL) AS paper_summary,
 coalesce((SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM (SELECT unnest(symptoms) AS s FROM papers p WHERE p.bulletin_id = pg.bulletin_id)), '') AS symptoms,
 coalesce((SELECT string_agg(DISTINCT s, '|' ORDER BY s) FROM (SELECT unnest(systems) AS s FROM papers p WHERE p.bulletin_id = pg.bulletin_id)), '') AS systems
FROM pg"""


def q02_get_communications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bulletin with its cars, documents and revisions of the whole corpus. J01, W09, F14, S14."""
    rows = ops.stemmed(derived.bulletins(spark, sf_dir).select("bulletin_id", "number", "processed_at"))
    revisions = rows.groupBy("stem").agg((F.count("*") - 1).alias("revisions"))
    years = derived.cars(spark, sf_dir).select("car_id", "year")
    linked = derived.links(spark, sf_dir).select("bulletin_id", "car_id").join(years, "car_id").groupBy("bulletin_id").agg(F.count("*").alias("n_cars"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    # what belongs to a bulletin is narrow by the time it is joined, all of it by the bulletin's id
    out = ops.with_papers(rows.join(linked, "bulletin_id", "left"), derived.papers(spark, sf_dir), "components").join(revisions, "stem")
    return out.select("bulletin_id", "stem", "revisions", F.coalesce("n_cars", F.lit(0)).alias("n_cars"), "first_year", "last_year", "n_papers", F.col("processed_at").isNotNull().alias("is_processed"), F.array_join("components", "|").alias("components"))


_Q02 = """SELECT s.bulletin_id, s.stem, count(*) OVER (PARTITION BY stem) - 1 AS revisions, coalesce(n_cars, 0) AS n_cars, first_year, last_year,
 coalesce(n_papers, 0) AS n_papers, processed_at IS NOT NULL AS is_processed, coalesce(components, '') AS components
FROM stemmed s LEFT JOIN (SELECT bulletin_id, count(*) AS n_cars, min(year) AS first_year, max(year) AS last_year FROM links JOIN cars USING (car_id) GROUP BY 1) c ON c.bulletin_id = s.bulletin_id
LEFT JOIN (SELECT bulletin_id, count(*) AS n_papers FROM papers GROUP BY 1) p ON p.bulletin_id = s.bulletin_id
LEFT JOIN (SELECT bulletin_id, string_agg(DISTINCT x, '|' ORDER BY x) AS components FROM (SELECT bulletin_id, unnest(components) AS x FROM papers) GROUP BY 1) t ON t.bulletin_id = s.bulletin_id"""


def q03_tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags merged over case with their commonest spelling. A10; the limit is the feature."""
    papers = derived.papers(spark, sf_dir)
    return ops.tag_vocabulary(papers, "systems", 50).unionByName(ops.tag_vocabulary(papers, "symptoms", 50)).unionByName(ops.tag_vocabulary(papers, "components", 50))


_Q03 = ", tags AS (" + " UNION ALL ".join(f"SELECT '{c}' AS facet, unnest({c}) AS tag FROM papers" for c in ("systems", "symptoms", "components")) + """),
 spelled AS (SELECT facet, tag, count(*) AS c FROM tags GROUP BY ALL),
 merged AS (SELECT facet, lower(tag) AS key, first(tag ORDER BY c DESC, tag) AS label, CAST(sum(c) AS BIGINT) AS n FROM spelled GROUP BY facet, lower(tag))
SELECT facet, key, label, n FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, key) AS rn FROM merged) WHERE rn <= 50"""


def _car_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = derived.links(spark, sf_dir).select("car_id", "bulletin_id").join(derived.bulletins(spark, sf_dir), "bulletin_id")
    return ops.fold(ops.stemmed(listed), ["car_id", "stem"])


def q07_my_bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each car's folded list with what a free sample shows: the quota counts over the whole list. W02, A17, L02."""
    return ops.with_quota(_car_families(spark, sf_dir), ["car_id"]).select("car_id", "bulletin_id", "severity", "superseded", "readable")


_QUOTA = "CASE severity WHEN 'serious' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"
_Q07 = f"""SELECT car_id, bulletin_id, severity, superseded, row_number() OVER (PARTITION BY car_id, severity ORDER BY published DESC NULLS LAST, bulletin_id DESC) <= {_QUOTA} AS readable FROM car_families"""


def q07_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of each account's lists, and unread ones among them, whatever tier or unread filter is set. A16, F12, F13."""
    mine = derived.garage(spark, sf_dir).select("user_id", "car_id").join(_car_families(spark, sf_dir), "car_id")
    read = derived.reads(spark, sf_dir).withColumn("was_read", F.lit(1))
    both = mine.join(read, ["user_id", "bulletin_id"], "left")
    return both.groupBy("user_id", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("was_read").isNull()).alias("unread"))


_Q07F = """SELECT g.user_id, f.severity, count(*) AS n, count(*) FILTER (WHERE r.user_id IS NULL) AS unread FROM garage g JOIN car_families f USING (car_id)
LEFT JOIN reads r ON r.user_id = g.user_id AND r.bulletin_id = f.bulletin_id GROUP BY ALL"""


def q08_bulletin_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest bulletin of each car with its documents' tags: united in order of first use, then sorted, as the SQL returns them. Q08, A34."""
    newest = _car_families(spark, sf_dir).groupBy("car_id").agg(F.max_by("bulletin_id", F.struct("published", "bulletin_id")).alias("bulletin_id"))
    out = ops.with_papers(newest, derived.papers(spark, sf_dir), "symptoms", "components", first_use=True)
    return out.select("car_id", "bulletin_id", "n_papers", "paper_summary", *[F.array_join(F.array_sort(c), "|").alias(c) for c in ("symptoms", "components")])


_Q08 = """, newest AS (SELECT car_id, first(bulletin_id ORDER BY published DESC NULLS LAST, bulletin_id DESC) AS bulletin_id FROM car_families GROUP BY car_id)
SELECT n.car_id, n.bulletin_id, coalesce(p.c, 0) AS n_papers, p.s AS paper_summary, coalesce(a.x, '') AS symptoms, coalesce(b.x, '') AS components FROM newest n
LEFT JOIN (SELECT bulletin_id, count(*) AS c, arg_min(paper_summary, paper_id) FILTER (WHERE paper_summary IS NOT NULL) AS s FROM papers GROUP BY 1) p USING (bulletin_id)
LEFT JOIN (SELECT bulletin_id, string_agg(DISTINCT t, '|' ORDER BY t) AS x FROM (SELECT bulletin_id, unnest(symptoms) AS t FROM papers) GROUP BY 1) a USING (bulletin_id)
LEFT JOIN (SELECT bulletin_id, string_agg(DISTINCT t, '|' ORDER BY t) AS x FROM (SELECT bulletin_id, unnest(components) AS t FROM papers) GROUP BY 1) b USING (bulletin_id)"""


def q09_unread_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread families by account and car, all and of the last week before the newest. A04, J04."""
    held = derived.garage(spark, sf_dir).select("user_id", "car_id")
    garage = held.repartition(derived.partitions(spark, sf_dir, "events", "orders", "lineitem"), "user_id")
    links = stored(derived.links(spark, sf_dir, held).select("car_id", "bulletin_id"), "links")
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "number", "published")
    families = stored(ops.fold(ops.stemmed(links.join(rows, "bulletin_id")), ["car_id", "stem"]).select("car_id", "bulletin_id", "published"), "families")
    return ops.unread_counts(garage, families, derived.reads_of(garage, links), datetime(2001, 7, 25))


_Q09 = """SELECT g.user_id, g.car_id, count(*) FILTER (WHERE r.user_id IS NULL) AS unread, count(*) FILTER (WHERE r.user_id IS NULL AND f.published > TIMESTAMP '2001-07-25') AS unread_recent, count(*) AS n
FROM garage g JOIN car_families f USING (car_id) LEFT JOIN reads r ON r.user_id = g.user_id AND r.bulletin_id = f.bulletin_id GROUP BY ALL"""


def q09_mark_all_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that marking everything read adds. D02, J11, F12."""
    mine = derived.garage(spark, sf_dir).select("user_id", "car_id").join(_car_families(spark, sf_dir), "car_id").select("user_id", "bulletin_id")
    return ops.unread(mine, derived.reads(spark, sf_dir), derived.partitions(spark, sf_dir, "events", "orders", "lineitem"))


_Q09M = "SELECT DISTINCT g.user_id, f.bulletin_id FROM garage g JOIN car_families f USING (car_id) WHERE NOT EXISTS (SELECT 1 FROM reads r WHERE r.user_id = g.user_id AND r.bulletin_id = f.bulletin_id)"


def q10_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of one car with zeros, and the car that has most families. A03, W03, C46."""
    # families are counted by their stems; only the one car's links are folded
    links, rows = derived.links(spark, sf_dir).select("car_id", "bulletin_id"), derived.bulletins(spark, sf_dir)
    stems = links.join(ops.stemmed(rows.select("bulletin_id", "number")), "bulletin_id").groupBy("car_id").agg(F.countDistinct("stem").alias("n_stems"))
    most = stems.orderBy(F.desc("n_stems"), "car_id").limit(1).select("car_id")
    families = ops.fold(ops.stemmed(links.join(F.broadcast(most), "car_id", "left_semi").join(rows, "bulletin_id")), ["car_id", "stem"])
    counted = ops.severity_counts(families, F.max("published").alias("newest"), F.max("car_id").alias("car_id"))
    return counted.select("severity", "n", "newest", F.concat(F.col("n").cast("string"), F.when(F.col("n") == 1, " bulletin").otherwise(" bulletins")).alias("label"))


_Q10 = """, most AS (SELECT car_id FROM car_families GROUP BY car_id ORDER BY count(*) DESC, car_id LIMIT 1)
SELECT t.severity, count(f.bulletin_id) AS n, max(f.published) AS newest, count(f.bulletin_id) || CASE WHEN count(f.bulletin_id) = 1 THEN ' bulletin' ELSE ' bulletins' END AS label
FROM (VALUES ('serious'), ('medium'), ('small')) t(severity) LEFT JOIN (SELECT * FROM car_families WHERE car_id = (SELECT car_id FROM most)) f ON f.severity = t.severity GROUP BY t.severity"""


def q18_list_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cars with how many bulletins they have, a page. J08, L12."""
    counts = derived.links(spark, sf_dir).groupBy("car_id").agg(F.count("*").alias("n_bulletins"))
    out = derived.cars(spark, sf_dir).orderBy(F.desc("year"), F.desc("car_id")).limit(40).join(counts, "car_id", "left")
    return out.select("car_id", "year", "make", "model", F.coalesce("n_bulletins", F.lit(0)).alias("n_bulletins"))


_Q18 = "SELECT car_id, year, make, model, (SELECT count(*) FROM links l WHERE l.car_id = c.car_id) AS n_bulletins FROM cars c ORDER BY year DESC, car_id DESC LIMIT 40"


def f08_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletins whose summary, or a document's, has every term. F08, F05, F06."""
    hit = ops.with_text(derived.bulletins(spark, sf_dir), derived.papers(spark, sf_dir), "the service bulletin")
    return ops.in_scope(hit, derived.links(spark, sf_dir), 7).select("bulletin_id", "summary", "status")


_F08 = """SELECT bulletin_id, summary, status FROM bulletins b WHERE bulletin_id IN (SELECT bulletin_id FROM links WHERE car_id = 7) AND
 (list_has_all(string_split_regex(lower(coalesce(summary, '')), '[^a-z0-9]+'), ['service', 'bulletin'])
  OR bulletin_id IN (SELECT bulletin_id FROM papers WHERE list_has_all(string_split_regex(lower(coalesce(paper_summary, '')), '[^a-z0-9]+'), ['service', 'bulletin'])))"""

QUERIES = {f.__name__: f for f in (q01_list_communications, q02_get_communications, q03_tag_vocabulary, q07_my_bulletins, q07_facets, q08_bulletin_detail, q09_unread_counts, q09_mark_all_read, q10_lookup, q18_list_vehicles, f08_text_match)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_Q01, _Q02, _Q03, _Q07, _Q07F, _Q08, _Q09, _Q09M, _Q10, _Q18, _F08))}
