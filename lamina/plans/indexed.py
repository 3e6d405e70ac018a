"""Searches by stored indexes, with the same SQL as those that scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import bulletins, postings, retrieval, search, vector_index
from lamina.plans import listing
from lamina.plans import retrieval as scanned
from lamina.sources import derived
from lamina.sources.snapshots import Snapshots, shared_folder

VECTOR_ROWS = "doc_id long, cosine double"


def q04_indexed_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q04 by postings and cells: only the query's terms and the nearest cells are read. L04, L05, Q04, C17."""
    docs = derived.searchable(spark, sf_dir)
    store = Snapshots(spark, f"{shared_folder(spark, 'search')}/store")
    text = postings.TextIndex(store, ["doc_id"])
    text.add(docs.select("doc_id", "text"))
    vector_index.build(store, docs)
    query = scanned._vector(docs)
    near, _ = vector_index.nearest(store, query, retrieval.VECTOR_POOL, exact=True)
    near = retrieval.ranked(spark.createDataFrame(near, VECTOR_ROWS), "cosine", "vector_rank", retrieval.VECTOR_POOL)
    hits = retrieval.ranked(text.matches(scanned.SEARCH_TEXT), "rank_score", "text_rank", retrieval.TEXT_POOL)
    matches = retrieval.fused(docs, scanned.QUERY, query, scanned.SEARCH_TEXT, k=10, near=near, hits=hits)
    return retrieval.current_revisions(matches, docs).select("stem", "bulletin_id", "doc_id", "score", "superseded", "family_size")


def f08_indexed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f08 by postings of summaries and of documents' summaries, some of which were indexed twice and some removed again. F08, F05, F06."""
    store = Snapshots(spark, f"{shared_folder(spark, 'search')}/store")
    rows = derived.bulletins(spark, sf_dir)
    store.publish(store.stage({"papers": derived.papers(spark, sf_dir).select("paper_id", "bulletin_id", "paper_summary")}))  # grouped once for all changes of the index
    papers = store.read("papers")
    own, theirs = postings.TextIndex(store, ["bulletin_id"], "own"), postings.TextIndex(store, ["paper_id", "bulletin_id"], "papers")
    own.add(rows.selectExpr("bulletin_id", "'service bulletin' AS text"))  # as they were
    own.add(rows.selectExpr("bulletin_id", "summary AS text"))
    theirs.add(papers.selectExpr("paper_id", "bulletin_id", "CASE WHEN paper_id % 2 = 0 THEN paper_summary ELSE 'service bulletin' END AS text"))
    theirs.remove(papers.filter("paper_id % 2 = 1"))
    theirs.add(papers.filter("paper_id % 2 = 1").selectExpr("paper_id", "bulletin_id", "paper_summary AS text"))
    query, links = "the service bulletin", derived.links(spark, sf_dir).filter("car_id = 7")
    ids = links.select("bulletin_id")
    found = own.matches(query, ids).select("bulletin_id").union(theirs.matches(query, ids).select("bulletin_id"))
    return bulletins.in_scope(rows, links, 7).join(found, "bulletin_id", "left_semi").select("bulletin_id", "summary", "status")


def l04_indexed_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 40 nearest vectors by cells, read until no cell left can hold a better one. L04, C13."""
    docs = derived.searchable(spark, sf_dir)
    store = Snapshots(spark, f"{shared_folder(spark, 'search')}/store")
    vector_index.build(store, docs)
    near, _ = vector_index.nearest(store, scanned._vector(docs), retrieval.VECTOR_POOL, exact=True)
    return retrieval.ranked(spark.createDataFrame(near, VECTOR_ROWS), "cosine", "vector_rank", retrieval.VECTOR_POOL)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = derived.searchable(spark, sf_dir)
    found = retrieval.fused(docs, scanned.QUERY, scanned._vector(docs), scanned.SEARCH_TEXT)
    return found.withColumn("bulletin_id", F.concat(F.lit("10"), F.lpad("bulletin_id", 6, "0")))


def _answer(matches):
    """Cites the first match, the last, and one that was never retrieved."""
    ids = F.transform(matches, lambda m: m["bulletin_id"])
    return F.concat(F.lit("See ["), F.get(ids, F.lit(0)), F.lit("] and  [99999999], then ["), F.element_at(ids, -1), F.lit("]."))


def q06_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search end to end: its matches with those that the answer cites, the guarded answer and what was charged. Q06, C23, C24, S16."""
    matches = _matches(spark, sf_dir)
    payload, usage = search.search(matches, scanned.QUERY, _answer, "q-1", 7, 3)
    charged = usage.agg(F.count("*").alias("n_charged"), F.sum("tokens_in").alias("tokens_in"), F.max(F.when(F.col("kind") == "answer_compose", F.col("meta"))).alias("meta"))
    found = payload.select("answer", "refused", "confidence", F.array_join("hallucinated", ",").alias("hallucinated"), F.explode("matches").alias("m")).select("answer", "refused", "confidence", "hallucinated", "m.*")
    return found.crossJoin(F.broadcast(charged))  # one row


def q06_refused_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a threshold that nothing reaches: no matches are shown and only the embedding is charged. Q06, C24."""
    payload, usage = search.search(_matches(spark, sf_dir), scanned.QUERY, _answer, "q-1", 7, 3, threshold=1.5)
    charged = usage.agg(F.count("*").alias("n_charged"), F.max("kind").alias("kind"), F.max("meta").alias("meta"))
    return payload.select("refused", "answer_generated", "confidence", F.size("matches").alias("n_matches")).crossJoin(F.broadcast(charged))  # one row each


_MATCHES = scanned._Q04.rsplit("SELECT t.stem", 1)[0].replace("LIMIT 10", "LIMIT 5") + """, m AS (SELECT '10' || lpad(bid, 6, '0') AS bulletin_id, t.score, v.cosine, t.superseded FROM top t LEFT JOIN vec v ON v.doc_id = t.doc_id),
 o AS (SELECT *, row_number() OVER (ORDER BY score DESC, bulletin_id) AS n FROM m), g AS (SELECT coalesce(max(cosine) FILTER (n <= 4), 0) AS confidence, count(*) AS k, max(bulletin_id) FILTER (n = 1) AS a, arg_max(bulletin_id, n) AS z FROM o)"""
_Q06S = _MATCHES + f""" SELECT 'See [' || a || '] and , then [' || z || '].' AS answer, false AS refused, round(confidence, 4) AS confidence, '99999999' AS hallucinated, bulletin_id, round(score, 6) AS score, round(cosine, 4) AS cosine, superseded,
 bulletin_id = a OR bulletin_id = z AS cited, 2 AS n_charged, {len(scanned.QUERY) // 4} * (k + 2) AS tokens_in, '{{"car_id":3,"user_id":7,"refused":false,"answer_generated":true}}' AS meta FROM o, g WHERE confidence >= 0.55"""
_Q06R = _MATCHES + """ SELECT true AS refused, false AS answer_generated, round(confidence, 4) AS confidence, 0 AS n_matches, 1 AS n_charged, 'search_embed' AS kind, '{"car_id":3,"user_id":7}' AS meta FROM g"""

QUERIES = {f.__name__: f for f in (q04_indexed_retrieve, f08_indexed_match, l04_indexed_nearest, q06_search, q06_refused_search)}
ORACLE_SQL = {"q04_indexed_retrieve": scanned.ORACLE_SQL["q04_retrieve"], "f08_indexed_match": listing.ORACLE_SQL["f08_text_match"], "l04_indexed_nearest": scanned._DOCS + " SELECT doc_id, cosine, vector_rank FROM vec", "q06_search": _Q06S, "q06_refused_search": _Q06R}
