"""Reports over the store and by car, texts of alerts, states from events, yields of pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import text, vectors
from lamina.operators import bulletins as lists
from lamina.operators import overview as ops
from lamina.operators.work import at
from lamina.plans.ledger import _Q12
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def a06_status_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    papers = derived.papers(spark, sf_dir).selectExpr("remedy AS extracted_text", "paper_summary", "if(paper_id % 3 = 0, NULL, 1) AS embedding")
    report = ops.status_report(derived.bulletins(spark, sf_dir), papers, derived.ledger(spark, sf_dir).filter("kind = 'purchase'"))
    return report.withColumn("spend", F.round("spend", 4))


_A06 = """SELECT (SELECT count(*) FROM bulletins) AS bulletins, (SELECT count(*) FROM bulletins WHERE status = 'pending') AS pending, (SELECT count(*) FROM bulletins WHERE status = 'processed') AS processed,
 (SELECT count(*) FROM bulletins WHERE status = 'failed') AS failed, (SELECT count(*) FROM papers) AS papers, (SELECT count(*) FROM papers WHERE remedy IS NOT NULL) AS extracted,
 (SELECT count(*) FROM papers WHERE paper_summary IS NOT NULL) AS summarised, (SELECT count(*) FROM papers WHERE paper_id % 3 <> 0) AS embedded, (SELECT round(coalesce(sum(cost), 0), 4) FROM ledger WHERE kind = 'purchase') AS spend"""


def a19_report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every count of the report of tiers."""
    rows = derived.bulletins(spark, sf_dir).withColumn("severity_source", F.when(F.col("status") == "processed", "document").otherwise("type"))
    papers = derived.papers(spark, sf_dir).filter("paper_id % 4 > 0")
    ledger = derived.ledger(spark, sf_dir).filter("k > 50").withColumnRenamed("kind", "input")
    return ops.report_sections(rows, papers, ledger).withColumn("cost", F.round("cost", 4))


_A19 = """, f AS (SELECT bulletin_id, arg_min(doc_kind, paper_id) AS doc_kind, arg_min(audience, paper_id) AS audience FROM papers WHERE paper_id % 4 > 0 GROUP BY 1),
 m AS (SELECT * EXCLUDE (doc_kind, audience), doc_kind, audience FROM bulletins LEFT JOIN f USING (bulletin_id) WHERE kind = 'MC')
SELECT 'tier and source' AS section, severity AS label, CASE WHEN status = 'processed' THEN 'document' ELSE 'type' END AS other, count(*) AS n, NULL::DOUBLE AS cost FROM bulletins GROUP BY 2, 3
UNION ALL SELECT 'kind', NULL, NULL, count(*), NULL FROM m HAVING count(*) > 0 UNION ALL SELECT 'kind by tier', severity, NULL, count(*), NULL FROM m GROUP BY 2
UNION ALL SELECT 'kind by document', doc_kind, NULL, count(*), NULL FROM m GROUP BY 2 UNION ALL SELECT 'kind by audience', audience, NULL, count(*), NULL FROM m GROUP BY 2
UNION ALL SELECT 'unfinished', status, reason, count(*), NULL FROM bulletins WHERE status IN ('pending', 'failed') GROUP BY 2, 3
UNION ALL SELECT 'ledger', model, kind, count(*), round(coalesce(sum(cost), 0), 4) FROM ledger WHERE k > 50 GROUP BY 2, 3"""


def a32_ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since a run began, and since a time after all events. A32."""
    ledger = derived.ledger(spark, sf_dir)
    both = [ops.ledger_totals(ledger, at(t), ("view", "click")).withColumn("since", at(t)) for t in (datetime(2024, 1, 12), datetime(2094, 1, 1))]
    return both[0].unionByName(both[1]).withColumn("cost", F.round("cost", 4))


_A32 = """SELECT s AS since, CAST(coalesce(sum(tokens_in), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out), 0) AS BIGINT) AS tokens_out, round(coalesce(sum(cost), 0), 4) AS cost
FROM (VALUES (TIMESTAMP '2024-01-12'), (TIMESTAMP '2094-01-01')) t(s) LEFT JOIN ledger ON occurred_at >= s AND kind IN ('view', 'click') GROUP BY s"""


def l18_strata_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a sample, some of which are equally large."""
    rows = derived.papers(spark, sf_dir).join(derived.bulletins(spark, sf_dir).select("bulletin_id", "kind"), "bulletin_id")
    return ops.strata_table(rows, ["doc_kind", "kind"])


_L18 = """SELECT doc_kind, kind, n, row_number() OVER (ORDER BY n DESC, doc_kind NULLS LAST, kind NULLS LAST) AS place FROM (SELECT doc_kind, kind, count(*) AS n FROM papers JOIN bulletins USING (bulletin_id) GROUP BY ALL)"""


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five listed bulletins, some of which stand by their summary alone."""
    return derived.bulletins(spark, sf_dir).filter("CAST(bulletin_id AS BIGINT) % 5 > 0").withColumn("reason", F.expr("if(CAST(bulletin_id AS BIGINT) % 9 = 0, 'summary only', reason)"))


_STORED = ", stored AS (SELECT * REPLACE (CASE WHEN CAST(bulletin_id AS BIGINT) % 9 = 0 THEN 'summary only' ELSE reason END AS reason) FROM bulletins WHERE CAST(bulletin_id AS BIGINT) % 5 > 0)"


def u02_bulletins_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U01, U02."""
    return ops.to_fetch(derived.links(spark, sf_dir), _stored(spark, sf_dir))


_U02 = _STORED + """ SELECT car_id, count(*) AS found, count(s.bulletin_id) AS skipped_known, count(*) - count(s.bulletin_id) AS "new", count(*) FILTER (s.reason = 'summary only') AS rechecked,
 count(*) FILTER (s.bulletin_id IS NULL OR s.reason = 'summary only') AS to_fetch FROM links l LEFT JOIN stored s USING (bulletin_id) GROUP BY 1"""


def q12_car_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some cars are not listed, and some of these not scanned."""
    cars = derived.cars(spark, sf_dir).withColumn("is_scanned", F.col("car_id") % 2 == 0)
    links = derived.links(spark, sf_dir)
    return ops.previews(cars, links.filter("car_id % 7 > 0"), _stored(spark, sf_dir), derived.papers(spark, sf_dir), links, per_bulletin=1.5, per_paper=0.004)


_WORDS = _Q12.split("AS seconds,", 1)[1].rsplit(" FROM s", 1)[0]
_Q12C = _STORED + """, n AS (SELECT car_id, count(*) AS listed, count(*) FILTER (s.bulletin_id IS NULL) AS new_bulletins FROM links LEFT JOIN stored s USING (bulletin_id) WHERE car_id % 7 > 0 GROUP BY 1),
 u AS (SELECT car_id, count(*) AS unfinished FROM links JOIN stored USING (bulletin_id) JOIN papers USING (bulletin_id) WHERE status = 'pending' AND paper_summary IS NULL GROUP BY 1),
 b AS (SELECT car_id, car_id % 2 = 0 AS is_scanned, coalesce(listed, 0) AS listed, coalesce(new_bulletins, 0) AS new_bulletins, coalesce(unfinished, 0) AS unfinished FROM cars LEFT JOIN n USING (car_id) LEFT JOIN u USING (car_id)),
 d AS (SELECT *, listed = 0 AND NOT is_scanned AS scan_pending, CAST(round_even(new_bulletins * 1.5::DOUBLE, 0) AS BIGINT) + unfinished AS documents FROM b), s AS (SELECT *, new_bulletins * 0.8::DOUBLE + documents * 0.7::DOUBLE AS sec FROM d)
SELECT car_id, listed, new_bulletins, unfinished, documents, NOT scan_pending AND documents = 0 AS up_to_date, scan_pending, round(documents * 0.004::DOUBLE * 0.75::DOUBLE, 4) AS cost_low, round(documents * 0.004::DOUBLE * 1.25::DOUBLE, 4) AS cost_high, CAST(floor(sec) AS BIGINT) AS seconds,
""" + _WORDS + " FROM s"


def q20_identity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q20, A31."""
    cars, links = derived.cars(spark, sf_dir).withColumn("active", F.col("car_id") % 6 > 0), derived.links(spark, sf_dir)
    baseline = derived.cars(spark, sf_dir).filter("car_id % 4 > 0").selectExpr("car_id", "car_id % 40 AS linked")
    return ops.identity_report(cars, links, links.filter("car_id % 3 > 0"), baseline)


_Q20 = """, n AS (SELECT car_id, count(DISTINCT bulletin_id) AS n FROM links GROUP BY 1), t AS (SELECT car_id, year || ' ' || make || ' ' || model AS identity, coalesce(n, 0) AS linked, CASE WHEN car_id % 3 > 0 THEN coalesce(n, 0) ELSE 0 END AS listed FROM cars LEFT JOIN n USING (car_id) WHERE car_id % 6 > 0),
 b AS (SELECT car_id, car_id % 40 AS baseline FROM cars WHERE car_id % 4 > 0)
SELECT car_id, identity, linked, listed, baseline, linked - baseline AS delta, CASE WHEN identity IS NULL THEN 'missing' WHEN linked < baseline THEN 'below baseline' ELSE 'ok' END AS status FROM t FULL JOIN b USING (car_id)"""

# the text of an event, in words that both engines know
_EVENT = """'{"id":"sub_' || entitlement_id || '","status":"' || CASE user_id % 8 WHEN 0 THEN 'active' WHEN 1 THEN 'trialing' WHEN 2 THEN 'past_due' WHEN 3 THEN 'unpaid' WHEN 4 THEN 'canceled' WHEN 5 THEN 'incomplete_expired' ELSE 'paused' END || '",'
 || CASE user_id % 3 WHEN 0 THEN '"current_period_end":' || (1700000000 + user_id) || ',' ELSE '' END || '"items":{"data":['
 || CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN '{"price":"price_m"}' WHEN 2 THEN '{"current_period_end":' || (1800000000 + user_id) || ',"price":{"id":"price_a","n":1}}' WHEN 3 THEN '{"price":{"id":"price_x"}},{"price":"price_a"}' ELSE '{"current_period_end":"soon","price":null}' END || ']}}'"""


def c45_subscription_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C45."""
    events = derived.entitlements(spark, sf_dir).select(F.expr(_EVENT).alias("event"))
    return events.select(ops.subscription_change(F.col("event"), {"price_m": "monthly", "price_a": "all_access"}).alias("c")).select("c.*")


_C45 = f""", e AS (SELECT json({_EVENT}) AS j FROM entitlements), i AS (SELECT j, j->>'$.items.data[0].current_period_end' AS own, j->>'$.current_period_end' AS top,
 [coalesce(j->>'$.items.data[0].price.id', j->>'$.items.data[0].price'), coalesce(j->>'$.items.data[1].price.id', j->>'$.items.data[1].price')] AS prices FROM e)
SELECT j->>'$.id' AS subscription_id, CASE WHEN j->>'$.status' IN ('active', 'trialing') THEN 'active' WHEN j->>'$.status' IN ('past_due', 'unpaid') THEN 'past_due' WHEN j->>'$.status' IN ('canceled', 'incomplete_expired') THEN 'canceled' END AS status,
 CASE list_filter(prices, lambda p: p IN ('price_m', 'price_a'))[1] WHEN 'price_m' THEN 'monthly' WHEN 'price_a' THEN 'all_access' END AS plan,
 TIMESTAMP '1970-01-01' + to_seconds(TRY_CAST(coalesce(own, top) AS BIGINT)) AS period_end FROM i"""


def c46_alert_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subject of each account's alert on bulletins since a date, and the note of its most revised family. C46, W03."""
    linked = derived.links(spark, sf_dir).select("car_id", "bulletin_id").join(lists.stemmed(derived.bulletins(spark, sf_dir)).select("bulletin_id", "stem", "published"), "bulletin_id")
    families = lists.fold(linked, ["car_id", "stem"]).filter("published >= TIMESTAMP_NTZ '1998-01-01 00:00:00'").groupBy("car_id").agg(F.count("*").alias("n"), F.max("superseded").alias("most"))
    label = F.concat_ws(" ", "year", "make", text.display_name(F.col("model")))
    own = derived.garage(spark, sf_dir).select("user_id", "car_id").distinct().join(derived.cars(spark, sf_dir).select("car_id", label.alias("label")), "car_id").join(families, "car_id", "left")
    alerts = own.groupBy("user_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_items"), F.array_sort(F.collect_set("label")).alias("labels"), F.coalesce(F.max("most"), F.lit(0)).alias("most"))
    return alerts.select("user_id", text.alert_subject(F.col("n_items"), F.col("labels")).alias("subject"), text.revision_note(F.col("most")).alias("note"))


_C46 = """, f AS (SELECT car_id, count(*) AS n, max(superseded) AS most FROM car_families WHERE published >= TIMESTAMP '1998-01-01' GROUP BY 1),
 a AS (SELECT user_id, coalesce(sum(n), 0) AS n, count(DISTINCT car_id) AS k, count(DISTINCT year || ' ' || make || ' ' || model) AS n_labels, max(year || ' ' || make || ' ' || model) AS label, coalesce(max(most), 0) AS most
  FROM (SELECT DISTINCT user_id, car_id FROM garage) JOIN cars USING (car_id) LEFT JOIN f USING (car_id) GROUP BY 1)
SELECT user_id, CASE WHEN n > 0 THEN CAST(n AS BIGINT) || ' new bulletin' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' for your ' || CASE WHEN n_labels = 1 THEN label ELSE 'cars' END
  WHEN n_labels = 1 THEN 'Your ' || label || ' is ready to read' ELSE 'Your cars are ready to read' END AS subject, CASE WHEN most > 0 THEN ' (latest of ' || (most + 1) || ' revisions)' ELSE '' END AS note FROM a"""


def c14_vector_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: whole texts at eight digits."""
    return derived.read(spark, sf_dir, "embeddings").select("vec_id", vectors.vector_text(F.col("embedding")).alias("vector"))


_C14 = "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.8f', x::DOUBLE)), ',') || ']' AS vector FROM embeddings"


def s09_page_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's lines as pages."""
    found = text.extraction_yield(F.split("text", "\n"), low=120.0)
    return derived.read(spark, sf_dir, "documents").select("doc_id", found.alias("y")).select("doc_id", *(f"y.{c}" for c in ("page_count", "char_count", "chars_per_page", "alpha_ratio", "empty_pages", "method", "error")), F.length("y.text").alias("kept_chars"))


_S09 = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS pages, replace(text, chr(0), '') AS t FROM documents), y AS (SELECT *, round(length(t) / len(pages), 2) AS per FROM d)
SELECT doc_id, len(pages) AS page_count, length(t) AS char_count, per AS chars_per_page, CASE WHEN t IS NOT NULL THEN coalesce(round(len(regexp_extract_all(t, '\p{L}')) / nullif(length(t), 0), 3), 0) END AS alpha_ratio,
 len(list_filter(pages, lambda p: length(p) < 50)) AS empty_pages, CASE WHEN per < 120 THEN 'vision-fallback' WHEN t IS NOT NULL THEN 'text' END AS method, CASE WHEN t IS NULL THEN 'zero pages' END AS error, CASE WHEN per >= 120 THEN length(t) END AS kept_chars FROM y"""

QUERIES = {f.__name__: f for f in (a06_status_report, a19_report_sections, a32_ledger_totals, l18_strata_table, u02_bulletins_to_fetch, q12_car_previews, q20_identity_report, c45_subscription_changes, c46_alert_texts, c14_vector_texts, s09_page_yields)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, (_A06, _A19, _A32, _L18, _U02, _Q12C, _Q20, _C45, _C46))} | {"c14_vector_texts": _C14, "s09_page_yields": _S09}
