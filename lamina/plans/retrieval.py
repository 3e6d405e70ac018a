"""Vectors, text search and their fusion (Q04-Q06, Q23)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import vectors
from lamina.operators import retrieval as ops
from lamina.sources import derived

#: The query: its words point at systems, its text is searched, its vector is that of this document.
QUERY, SEARCH_TEXT, QUERY_DOC = "the brake absolute happen", "la", 0


def _vector(docs: DataFrame) -> list[float]:
    return docs.filter(F.col("doc_id") == QUERY_DOC).select("embedding").first()[0]


def q04_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors and text hits fused, folded by family and cut to the top. L04-L06, U03, C13, C15-C17, W06, W07."""
    docs = derived.searchable(spark, sf_dir)
    matches = ops.fused(docs, QUERY, _vector(docs), SEARCH_TEXT, k=10)
    return ops.current_revisions(matches, docs).select("stem", "bulletin_id", "doc_id", "score", "superseded", "family_size")


_DOCS = """WITH docs AS (SELECT doc_id, text, embedding, CAST(doc_id // 2 AS VARCHAR) AS bulletin_id, 'PIT' || (doc_id // 6) AS stem, 'PIT' || (doc_id // 6) || substr('ABC', CAST((doc_id // 2) % 3 AS INT) + 1, 1) AS number,
  CASE WHEN (doc_id // 2) % 17 <> 0 THEN DATE '2024-01-01' + CAST((doc_id // 2) % 50 AS INT) END AS published, label
 FROM embeddings JOIN documents ON vec_id = doc_id),
 q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM docs WHERE doc_id = 0),
 cos AS (SELECT doc_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), v) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(v, v))), 6) AS cosine FROM docs, q),
 vec AS (SELECT *, row_number() OVER (ORDER BY cosine DESC, doc_id) AS vector_rank FROM cos QUALIFY vector_rank <= 40),
 tf AS (SELECT doc_id, len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w = 'la')) AS n FROM docs),
 txt AS (SELECT doc_id, row_number() OVER (ORDER BY round(ln(1 + n), 6) DESC, doc_id) AS text_rank FROM tf WHERE n > 0 QUALIFY text_rank <= 40)
"""
_Q04 = _DOCS + """, scored AS (SELECT d.*, vector_rank, round(coalesce(2.0::DOUBLE / (60 + vector_rank), 0) + coalesce(0.5::DOUBLE / (60 + text_rank), 0) + 0.001::DOUBLE * CASE WHEN label = 0 THEN 1 WHEN label = 1 THEN 1 ELSE 0 END, 8) AS score
  FROM (SELECT doc_id, vector_rank, text_rank FROM vec FULL JOIN txt USING (doc_id)) b JOIN docs d USING (doc_id)),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bulletin_id ORDER BY score DESC, coalesce(vector_rank, 1000), doc_id) AS rn FROM scored) WHERE rn = 1),
 fold AS (SELECT stem, first(doc_id ORDER BY published DESC NULLS LAST, number DESC) AS doc_id, first(bulletin_id ORDER BY published DESC NULLS LAST, number DESC) AS bid, max(score) AS score, count(*) - 1 AS superseded FROM best GROUP BY stem),
 top AS (SELECT * FROM fold ORDER BY score DESC, bid LIMIT 10),
 now AS (SELECT stem, first(bulletin_id ORDER BY published DESC NULLS LAST, number DESC) AS bulletin_id, count(*) AS family_size FROM (SELECT DISTINCT stem, bulletin_id, number, published FROM docs) GROUP BY stem)
SELECT t.stem, n.bulletin_id, t.doc_id, t.score, t.superseded, n.family_size FROM top t JOIN now n USING (stem)"""


def c12_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors at length one and their distance to the query. C12-C14."""
    docs = derived.read(spark, sf_dir, "embeddings")
    query = docs.filter(F.col("vec_id") == QUERY_DOC).select("embedding").first()[0]
    scaled = docs.withColumn("u", vectors.unit(F.col("embedding")))
    return scaled.select("vec_id", (F.round(1 - vectors.cosine(F.col("embedding"), vectors.literal(query)), 5) + F.lit(0.0)).alias("distance"), F.round(vectors.norm(F.col("u")), 6).alias("length"), F.length(vectors.vector_text(F.slice("u", 1, 1), 4)).alias("n_chars_text"))


_C12 = """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
 u AS (SELECT vec_id, x, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS u FROM e)
SELECT vec_id, round(1 - list_inner_product(x, v) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(v, v))), 5) + 0.0 AS distance, round(sqrt(list_inner_product(u, u)), 6) AS length,
 CAST(length('[' || printf('%.4f', u[1]) || ']') AS INT) AS n_chars_text FROM u, q"""


def q06_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a search is sure enough to answer. C24, Q06."""
    docs = derived.searchable(spark, sf_dir)
    return ops.is_confident(ops.fused(docs, QUERY, _vector(docs), SEARCH_TEXT))


def q23_retrieval_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit@k and reciprocal rank of nearest neighbours by label, for queries of a stated set. A22, C43, Q23.

    Query vectors are those whose id divides by 50, in blocks against all rows.
    """
    rows = derived.read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    queries = rows.filter("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q", "label AS wanted")
    top = ops.nearest_of_queries(rows, queries)
    ranked = top.join(rows.select("vec_id", F.col("label").alias("item")), "vec_id").select("query_id", "item", "place")
    return ops.rank_metrics(ranked, queries.selectExpr("query_id", "wanted AS item"))


_Q23 = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, q.label AS wanted, r.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.x, r.x) / (sqrt(list_inner_product(q.x, q.x)) * sqrt(list_inner_product(r.x, r.x))), 5) DESC, r.vec_id) AS place
  FROM e q JOIN e r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
 f AS (SELECT query_id, min(CASE WHEN place <= 5 AND label = wanted THEN place END) AS place FROM s GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END), 6) AS hit_at_1, round(avg(CASE WHEN place <= 3 THEN 1.0 ELSE 0 END), 6) AS hit_at_3, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / place, 0)), 6) AS mrr FROM f"""
_Q06 = _Q04.rsplit("SELECT t.stem", 1)[0].replace("LIMIT 10", "LIMIT 5") + "SELECT coalesce(max(cosine), 0) >= 0.55 AS answered, max(cosine) AS best_cosine FROM (SELECT v.cosine FROM top t LEFT JOIN vec v ON v.doc_id = t.doc_id ORDER BY t.score DESC, t.bid LIMIT 4)"

QUERIES = {f.__name__: f for f in (q04_retrieve, c12_unit_vectors, q06_gate, q23_retrieval_evaluation)}
ORACLE_SQL = dict(zip(QUERIES, (_Q04, _C12, _Q06, _Q23)))
