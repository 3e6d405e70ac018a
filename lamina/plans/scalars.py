"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import classify, text
from lamina.operators import bulletins as ops
from lamina.plans.oracle import TABLES
from lamina.sources import derived


def c05_revision_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C05, F23."""
    return ops.stemmed(derived.bulletins(spark, sf_dir)).select("bulletin_id", "number", "stem")


def c06_bulletin_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types read again from number, summary and titles of every known form, and their tiers."""
    rows = derived.bulletins(spark, sf_dir).withColumn("n", F.col("bulletin_id").cast("long"))
    number = F.when(F.col("attempts") == 3, F.col("number")).when(F.col("attempts") == 2, F.lit("24-na-125")).when(F.col("attempts") == 1, F.lit("X1"))
    phrase = F.get(F.array(*(F.lit(p) for p, _ in classify.SUMMARY_PHRASES)), (F.col("n") % 19).cast("int"))
    title = F.get(F.array(*(F.lit(t) for t, _ in classify.DOCUMENT_TITLES)), (F.col("n") % 7).cast("int"))
    kind = classify.bulletin_type(number, F.concat(F.lit("The "), F.upper(phrase), F.lit(" text")), F.array(F.lit("x"), F.concat(F.lit(" "), F.upper(title))))
    return rows.select("bulletin_id", kind.alias("type"), classify.type_severity(kind).alias("tier"), classify.type_severity(F.col("kind")).alias("kind_tier"))


def _values(rows) -> str:
    """Fixed values as rows of SQL; lists of words as lists."""
    quoted = lambda v: "[" + ", ".join(quoted(w) for w in v) + "]" if isinstance(v, tuple) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(quoted, r))})" for i, r in enumerate(rows)) + ")"


_C06 = f""", i AS (SELECT bulletin_id, kind, CAST(bulletin_id AS BIGINT) AS n, CASE attempts WHEN 3 THEN number WHEN 2 THEN '24-na-125' WHEN 1 THEN 'X1' END AS number FROM bulletins),
 p(place, phrase, code) AS {_values(classify.SUMMARY_PHRASES)}, d(place, title, code) AS {_values(classify.DOCUMENT_TITLES)},
 r AS (SELECT i.*, 'The ' || upper(p.phrase) || ' text' AS summary, ' ' || upper(d.title) AS shown FROM i LEFT JOIN p ON p.place = n % 19 LEFT JOIN d ON d.place = n % 7),
 said AS (SELECT bulletin_id, arg_min(p.code, p.place) AS code FROM r JOIN p ON contains(lower(r.summary), p.phrase) GROUP BY 1),
 t AS (SELECT r.bulletin_id, r.kind, CASE WHEN upper(left(number, 3)) IN ('TSB', 'PIT', 'PIC', 'PIP') THEN upper(left(number, 3)) WHEN said.code IS NOT NULL THEN said.code WHEN d.code IS NOT NULL THEN d.code
  WHEN upper(number) LIKE '%-NA-%' OR upper(number) LIKE '%-NA' THEN 'NA' ELSE 'OTHER' END AS type FROM r LEFT JOIN said USING (bulletin_id) LEFT JOIN d ON d.title = lower(trim(shown)))
SELECT bulletin_id, type, CASE WHEN type IN ('TSB', 'CSP', 'RC') THEN 'serious' WHEN type IN ('PIT', 'PIC', 'SB', 'TB', 'SU', 'WA', 'SC') THEN 'medium' ELSE 'small' END AS tier,
 CASE WHEN kind IN ('TSB', 'RC') THEN 'serious' WHEN kind = 'PIT' THEN 'medium' ELSE 'small' END AS kind_tier FROM t"""


def c08_document_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C08, F15."""
    verdict = classify.document_severity(F.col("doc_kind"), F.col("symptoms"), F.col("remedy"), F.col("audience"))
    return derived.papers(spark, sf_dir).select("paper_id", verdict["severity"].alias("severity"), verdict["reason"].alias("reason"))


_C08 = """, v AS (SELECT paper_id, audience, CASE WHEN doc_kind = 'recall' THEN 'recall' WHEN doc_kind = 'customer_letter' AND remedy IS NOT NULL THEN 'owner letter with remedy'
  WHEN doc_kind = 'service_procedure' THEN 'service procedure' WHEN doc_kind = 'informational' AND remedy IS NOT NULL THEN 'informational with symptoms and remedy' ELSE 'no escalating signal' END AS r FROM papers),
 w AS (SELECT *, CASE WHEN r IN ('recall', 'owner letter with remedy') THEN 'serious' WHEN r LIKE '%signal' THEN 'small' ELSE 'medium' END AS s FROM v)
SELECT paper_id, CASE WHEN audience = 'dealer' AND s = 'serious' THEN 'medium' ELSE s END AS severity, CASE WHEN audience = 'dealer' AND s = 'serious' THEN 'dealer-facing capped' ELSE r END AS reason FROM w"""


def c09_keywords_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of a summary, dates written in several ways."""
    words = F.array(*[F.lit(w) for w in ("Brakes", "screen", "PROGRAM", "x")])
    shown = F.when(F.col("attempts") == 0, F.date_format("published", "yyyy-MM-dd")).when(F.col("attempts") == 1, F.date_format("published", "MM/dd/yyyy")).when(F.col("attempts") == 2, F.date_format("published", "yyyyMMdd")).otherwise("soon")
    return derived.bulletins(spark, sf_dir).select("bulletin_id", F.array_join(text.matched_keywords(F.col("summary"), words), ",").alias("keywords"), text.lenient_timestamp(shown).alias("read_date"))


_C09 = """, s AS (SELECT *, CASE attempts WHEN 0 THEN strftime(published, '%Y-%m-%d') WHEN 1 THEN strftime(published, '%m/%d/%Y') WHEN 2 THEN strftime(published, '%Y%m%d') ELSE 'soon' END AS shown FROM bulletins)
SELECT bulletin_id, array_to_string(list_filter(['Brakes', 'screen', 'PROGRAM', 'x'], lambda k: coalesce(contains(lower(summary), lower(k)), false)), ',') AS keywords,
 try_strptime(shown, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%m/%d/%Y', '%Y%m%d']) AS read_date FROM s"""


def c11_compose_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11, C19, C35."""
    whole = text.compose_input(F.col("paper_summary"), F.col("symptoms"), F.col("systems"), F.col("components"))
    return derived.papers(spark, sf_dir).select("paper_id", whole.alias("input"), text.approx_tokens(whole).alias("tokens"))


_C11 = """, c AS (SELECT paper_id, concat_ws(chr(10), paper_summary, 'Symptoms: ' || array_to_string(symptoms, ', '), 'Systems: ' || array_to_string(systems, ', '), 'Components: ' || array_to_string(components, ', ')) AS input FROM papers)
SELECT paper_id, input, greatest(1, length(input) // 4) AS tokens FROM c"""


#: What the driver of a car says, and tags that documents have besides their own.
COMPLAINT = "Brake noise, screen blank, no heat, door leaks, tire worn, stalls, cruise off"
MORE_TAGS = ("HVAC", "Tire Pressure", "Steering", "Body Glass", "Driver Assistance", "Engine", "Electrical", "Safety Camera", "none")


def c15_shared_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain substrings on both sides."""
    more = F.get(F.array(*map(F.lit, MORE_TAGS)), (F.col("paper_id") % 9).cast("int"))
    tags = F.concat("systems", F.array(more))
    return derived.papers(spark, sf_dir).select("paper_id", F.array_join(classify.shared_systems(COMPLAINT, tags), ",").alias("shared"))


_C15 = f""", rules(place, name, asks, tags) AS {_values(classify.SYSTEM_RULES)}, more(place, tag) AS {_values((t,) for t in MORE_TAGS)},
 asked AS (SELECT * FROM rules WHERE len(list_filter(asks, lambda w: contains(lower('{COMPLAINT}'), w))) > 0),
 p AS (SELECT paper_id, lower(systems[1] || ' ' || tag) AS said FROM papers JOIN more ON place = paper_id % 9)
SELECT paper_id, coalesce(string_agg(name, ',' ORDER BY place), '') AS shared FROM p LEFT JOIN asked ON len(list_filter(asked.tags, lambda w: contains(said, w))) > 0 GROUP BY paper_id"""


def c21_display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C21."""
    raw = F.concat_ws(" ", "make", "model", F.lit("silverado-ev  MCLAREN mazda3 rav4 gmc brightdrop-600 amg usa x5 tlx eq"))
    return derived.cars(spark, sf_dir).select("car_id", text.display_name(raw).alias("shown"))


_C21 = f""", w AS (SELECT car_id, list_filter(string_split_regex(make || ' ' || model || ' silverado-ev  MCLAREN mazda3 rav4 gmc brightdrop-600 amg usa x5 tlx eq', '\\s+'), lambda p: p <> '') AS words FROM cars)
SELECT car_id, array_to_string(list_transform(words, lambda p: array_to_string(list_transform(string_split(upper(p), '-'), lambda u: CASE WHEN u = 'MCLAREN' THEN 'McLaren' WHEN u = 'BRIGHTDROP' THEN 'BrightDrop'
 WHEN list_contains(string_split('{' '.join(text.ACRONYMS)}', ' '), u) THEN u
 WHEN regexp_matches(u, '[0-9]') AND NOT (regexp_full_match(u, '[A-Z]{{4,}}[0-9]+') AND regexp_matches(u, '[AEIOU]')) THEN u
 WHEN length(u) <= 2 OR NOT regexp_matches(u, '[AEIOU]') THEN u ELSE left(u, 1) || lower(substr(u, 2)) END), '-')), ' ') AS shown FROM w"""


def c22_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teasers and checksums of whole texts."""
    return derived.read(spark, sf_dir, "documents").select("doc_id", text.opening(F.regexp_replace("text", "[^a-zA-Z ,.]", "x")).alias("opening"), text.checksum(F.col("text")).alias("checksum"))


_C22 = """, o AS (SELECT doc_id, text, trim(regexp_replace(regexp_replace(text, '[^a-zA-Z ,.]', 'x', 'g'), ' +', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN text IS NULL THEN '' WHEN length(t) <= 110 THEN t ELSE regexp_replace(regexp_replace(left(t, 110), ' [^ ]*$', ''), '[,;:.]+$', '') || '…' END AS opening, left(sha256(text), 16) AS checksum FROM o"""


def c23_guarded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of bulletins that were not retrieved go."""
    rows = derived.bulletins(spark, sf_dir).select("bulletin_id", "attempts")
    answer = F.concat(F.lit("See ["), F.col("bulletin_id"), F.lit("] and  [ 99999999 ] or ["), F.col("bulletin_id"), F.lit("], [12] or [777777]."))
    got = text.guarded_citations(answer, F.when(F.col("attempts") == 3, F.array("bulletin_id", F.lit("777777"))).when(F.col("attempts") > 0, F.array("bulletin_id")).otherwise(F.array(F.lit("99999999"))))
    return rows.select("bulletin_id", got["clean"].alias("clean"), F.array_join(got["valid"], ",").alias("valid"), F.array_join(got["hallucinated"], ",").alias("hallucinated"))


_C23 = r""", a AS (SELECT bulletin_id, 'See [' || bulletin_id || '] and  [ 99999999 ] or [' || bulletin_id || '], [12] or [777777].' AS answer, CASE WHEN attempts = 3 THEN [bulletin_id, '777777'] WHEN attempts > 0 THEN [bulletin_id] ELSE ['99999999'] END AS known FROM bulletins),
 e AS (SELECT *, regexp_extract_all(answer, '\[\s*(\d{6,})\s*\]', 1) AS every FROM a),
 c AS (SELECT *, list_filter(every, lambda x, i: list_position(every, x) = i) AS cited FROM e),
 b AS (SELECT *, list_filter(cited, lambda x: NOT list_contains(known, x)) AS bad FROM c)
SELECT bulletin_id, trim(regexp_replace(list_reduce(list_prepend(answer, bad), lambda acc, x: regexp_replace(acc, '\[\s*' || x || '\s*\]', '', 'g')), '[ \t]{2,}', ' ', 'g')) AS clean,
 array_to_string(list_filter(cited, lambda x: list_contains(known, x)), ',') AS valid, array_to_string(bad, ',') AS hallucinated FROM b"""


def c25_clean_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers checked against their contract, every clause broken by some."""
    n = F.col("paper_id")
    kind, reader = F.when(n % 7 == 0, "memo").otherwise(F.col("doc_kind")), F.when(n % 11 == 0, "all").otherwise(F.col("audience"))
    years = F.array((n % 300 + 1900).cast("string"), F.lit("1900"), F.lit("x"), F.lit(" 2001"), F.lit("2001"))
    models = F.array(F.lit(" a "), F.lit(""), F.concat(F.lit("m"), (n % 3).cast("string")), F.lit("m0"))
    good = F.to_json(F.struct(F.coalesce("paper_summary", F.lit(" ")).alias("summary"), "symptoms", F.lit("r").alias("remedy"), kind.alias("doc_kind"), reader.alias("audience"), years.alias("applicability_years"), models.alias("applicability_models")))
    payload = F.when(n % 5 == 0, F.lit("{oops")).when(n % 5 == 1, F.lit('{"summary": "x", "symptoms": []}')).otherwise(good)
    got = classify.clean_extraction(payload)
    shown = lambda c: F.when(F.col("got.error").isNull(), F.array_join(F.array_sort(f"got.{c}").cast("array<string>"), ","))
    return derived.papers(spark, sf_dir).select("paper_id", got.alias("got")).select("paper_id", "got.error", shown("years").alias("years"), shown("models").alias("models"))


_C25 = """, p AS (SELECT paper_id, CASE paper_id % 5 WHEN 0 THEN '{oops' WHEN 1 THEN '{"summary": "x", "symptoms": []}' ELSE CAST(json_object('summary', coalesce(paper_summary, ' '), 'symptoms', symptoms, 'remedy', 'r',
  'doc_kind', CASE WHEN paper_id % 7 = 0 THEN 'memo' ELSE doc_kind END, 'audience', CASE WHEN paper_id % 11 = 0 THEN 'all' ELSE audience END,
  'applicability_years', [CAST(paper_id % 300 + 1900 AS VARCHAR), '1900', 'x', ' 2001', '2001'], 'applicability_models', [' a ', '', 'm' || (paper_id % 3), 'm0']) AS VARCHAR) END AS payload FROM papers),
 j AS (SELECT paper_id, CASE WHEN json_valid(payload) THEN payload END AS j FROM p),
 m AS (SELECT *, list_filter(['summary', 'symptoms', 'remedy', 'doc_kind', 'audience'], lambda k: NOT list_contains(json_keys(j), k)) AS missing FROM j),
 e AS (SELECT *, CASE WHEN j IS NULL THEN 'invalid JSON' WHEN len(missing) > 0 THEN 'missing fields: ' || array_to_string(missing, ', ')
  WHEN json_extract_string(j, '$.doc_kind') NOT IN ('recall', 'customer_letter', 'service_procedure', 'informational') THEN 'doc_kind not allowed' WHEN json_extract_string(j, '$.audience') NOT IN ('owner', 'dealer', 'both') THEN 'audience not allowed'
  WHEN trim(json_extract_string(j, '$.summary')) = '' THEN 'summary is empty' END AS error FROM m)
SELECT paper_id, error,
 CASE WHEN error IS NULL THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(CAST(json_extract(j, '$.applicability_years') AS VARCHAR[]), lambda y: TRY_CAST(trim(y) AS INT)), lambda y: y BETWEEN 1950 AND 2100))), ',') END AS years,
 CASE WHEN error IS NULL THEN array_to_string(list_sort(list_distinct(list_filter(list_transform(CAST(json_extract(j, '$.applicability_models') AS VARCHAR[]), lambda v: trim(v)), lambda v: v <> ''))), ',') END AS models FROM e"""


def c28_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set and word agreement, years named with ranges."""
    other = F.array(F.lit("BRAKES "), F.lit("no start"))
    says = F.concat(F.lit("Built 1999-2001 or "), (F.col("paper_id") % 5 + 2003).cast("string"), F.lit(" to 2010, 1900 - 1999, 2012 thru 2011"))
    return derived.papers(spark, sf_dir).select(
        "paper_id", F.round(text.jaccard(F.concat("systems", "symptoms"), other), 6).alias("jaccard"), F.round(text.token_f1(F.concat("paper_summary", F.lit(" of of, summary")), F.lit("summary of 7 summary")), 6).alias("f1"),
        F.size(text.years_named(says)).alias("n_years"),
    )


_C28 = r""", p AS (SELECT paper_id, list_distinct(list_filter(list_transform(systems || symptoms, lambda v: lower(trim(v))), lambda v: v <> '')) AS a, ['brakes', 'no start'] AS b,
  list_filter(string_split_regex(lower(coalesce(paper_summary || ' of of, summary', '')), '\W+'), lambda w: w <> '') AS wa, ['summary', 'of', '7', 'summary'] AS wb,
  'Built 1999-2001 or ' || (paper_id % 5 + 2003) || ' to 2010, 1900 - 1999, 2012 thru 2011' AS says FROM papers),
 y AS (SELECT *, regexp_extract_all(says, '\b(?:19|20)\d{2}\b') AS named, regexp_extract_all(says, '(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to|through|thru)\s*((?:19|20)\d{2})\b', 1) AS lo,
  regexp_extract_all(says, '(?i)\b((?:19|20)\d{2})\s*(?:-|–|—|to|through|thru)\s*((?:19|20)\d{2})\b', 2) AS hi FROM p)
SELECT paper_id, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)), 6) AS jaccard,
 round(2 * coalesce(list_sum(list_transform(list_distinct(wa), lambda w: least(len(list_filter(wa, lambda x: x = w)), len(list_filter(wb, lambda x: x = w))))), 0)::DOUBLE / (len(wa) + len(wb)), 6) AS f1,
 CAST(len(list_distinct(CAST(named AS BIGINT[]) || flatten(list_transform(range(1, len(lo) + 1), lambda i: CASE WHEN CAST(lo[i] AS BIGINT) <= CAST(hi[i] AS BIGINT) AND CAST(hi[i] AS BIGINT) - CAST(lo[i] AS BIGINT) <= 40
  THEN range(CAST(lo[i] AS BIGINT), CAST(hi[i] AS BIGINT) + 1) ELSE [] END)))) AS INT) AS n_years FROM y"""


def c30_safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safe links, file names, lengths of pages."""
    return derived.read(spark, sf_dir, "pages").select("page_id", text.safe_link(F.col("url")).alias("safe"), text.archive_name(F.col("url")).alias("file"), F.length("html").alias("n_chars"))


_C30 = "SELECT page_id, coalesce(regexp_matches(url, '(?i)^https?://'), false) AS safe, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 200) AS file, length(html) AS n_chars FROM pages"

QUERIES = {f.__name__: f for f in (c05_revision_stems, c06_bulletin_types, c08_document_severity, c09_keywords_and_dates, c11_compose_inputs, c15_shared_systems, c21_display_names, c22_openings, c23_guarded_citations, c25_clean_extractions, c28_agreement, c30_safe_links)}
ORACLE_SQL = {n: TABLES + s for n, s in zip(QUERIES, ("SELECT bulletin_id, number, stem FROM stemmed", _C06, _C08, _C09, _C11, _C15, _C21, _C22, _C23, _C25, _C28, _C30))}
