"""Hybrid retrieval: exact nearest vectors and text search, fused by reciprocal rank, folded by family."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import classify, text, vectors
from lamina.operators.bulletins import stemmed

#: Candidates taken from each list, damping, weights, results, and the confidence a query needs.
VECTOR_POOL, TEXT_POOL, DAMPING, W_VECTOR, W_TEXT, TOP_K, CONFIDENCE = 40, 40, 60, 2.0, 0.5, 5, 0.55


def nearest(docs: DataFrame, query_vector: Sequence[float], k: int = VECTOR_POOL) -> DataFrame:
    """doc_id, cosine and rank of the nearest k (L04). Top-k is taken in each task; only k rows a task move."""
    scored = docs.select("doc_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal(query_vector)), 6).alias("cosine")).filter("cosine IS NOT NULL")
    return scored.orderBy(F.desc("cosine"), "doc_id").limit(k).withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "doc_id")))


#: Queries that are sent to the tasks at once, rows of a task that are scored at once, and digits of a cosine.
QUERY_BLOCK, ROW_SLICE, DIGITS = 2048, 512, 5


def _running_top(query_ids: np.ndarray, queries: np.ndarray, k: int):
    """Vectors to each query's best k of a task: (query_id, vec_id, cosine), ties to the smaller id, a query's own row left out."""
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least = np.full(len(unit), -np.inf)
        for batch in batches:
            vectors_ = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
            names = batch.column(0).to_numpy(zero_copy_only=False)
            size = np.linalg.norm(vectors_, axis=1)
            for i in range(0, len(names), ROW_SLICE):
                own = slice(i, i + ROW_SLICE)
                cosine = (unit @ vectors_[own].T) / size[own]
                cosine = np.copysign(np.floor(np.abs(cosine) * 10**DIGITS + 0.5), cosine) / 10**DIGITS
                q, r = np.nonzero((cosine >= least[:, None]) & (names[own][None, :] != query_ids[:, None]))
                of, ids, scores = np.concatenate((of, q)), np.concatenate((ids, names[own][r])), np.concatenate((scores, cosine[q, r]))
                order = np.lexsort((ids, -scores, of))
                of, ids, scores = of[order], ids[order], scores[order]
                place = np.arange(len(of)) - np.searchsorted(of, of)
                last = place == k - 1
                least[of[last]] = scores[last]
                of, ids, scores = of[place < k], ids[place < k], scores[place < k]
        yield pa.RecordBatch.from_arrays([pa.array(query_ids[of]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "cosine"])

    return run


def nearest_of_queries(rows: DataFrame, queries: DataFrame, k: int = TOP_K, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, vec_id, cosine, place: the best k rows (vec_id, embedding) of every query (query_id, q), exactly (Q23).

    Queries go to the tasks in blocks of about so many, one pass over the rows a block; a task keeps
    a running best k of each query, so it sends k rows a query whatever it has read. Null and zero
    vectors have no cosine.
    """
    has_length = lambda c: F.coalesce(vectors.norm(F.col(c)), F.lit(0.0)) > 0
    asked, scanned = queries.filter(has_length("q")), rows.filter(has_length("embedding")).select(F.col("vec_id").cast("long"), "embedding")
    schema = "query_id long, vec_id long, cosine double"
    n = -(-asked.count() // block)
    out = rows.sparkSession.createDataFrame([], schema)
    for number in range(n):
        some = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == number).select("query_id", "q").collect()  # about a block
        if some:
            out = out.unionByName(scanned.mapInArrow(_running_top(np.array([r[0] for r in some], np.int64), np.array([r[1] for r in some], np.float64), k), schema))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return out.withColumn("place", place).filter(F.col("place") <= k)


def text_hits(docs: DataFrame, query: str, k: int = TEXT_POOL) -> DataFrame:
    """doc_id and rank of the best k documents that have every term."""
    terms = [t for t in dict.fromkeys(query.lower().split()) if t not in text.STOP_WORDS]
    lexed = docs.select("doc_id", text.tokens(F.col("text")).alias("lexemes")).filter(text.matches_all(F.col("lexemes"), terms))
    scored = lexed.select("doc_id", F.round(text.text_rank(F.col("lexemes"), terms), 6).alias("rank_score"))
    return scored.orderBy(F.desc("rank_score"), "doc_id").limit(k).withColumn("text_rank", F.row_number().over(Window.orderBy(F.desc("rank_score"), "doc_id")))


def ranked(found: DataFrame, column: str, place: str, k: int) -> DataFrame:
    """doc_id, the column, and the place of the best k by it, as both candidate lists have them."""
    return found.select("doc_id", column).orderBy(F.desc(column), "doc_id").limit(k).withColumn(place, F.row_number().over(Window.orderBy(F.desc(column), "doc_id")))


def fused(docs: DataFrame, query: str, query_vector: Sequence[float], search_text: str | None = None, k: int = TOP_K, near: DataFrame | None = None, hits: DataFrame | None = None) -> DataFrame:
    """Best document per bulletin, newest bulletin per family with the family's best score, then the top k.

    Both candidate lists are bounded by their pools, so what follows them is small at any input size.
    They are scanned for, or given (``near``: doc_id, cosine, vector_rank; ``hits``: doc_id, text_rank) where indexes are stored.
    """
    both = (nearest(docs, query_vector) if near is None else near).join(text_hits(docs, search_text or query) if hits is None else hits, "doc_id", "full_outer")
    rrf = F.coalesce(W_VECTOR / (DAMPING + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(W_TEXT / (DAMPING + F.col("text_rank")), F.lit(0.0))
    rows = docs.select("doc_id", "bulletin_id", "number", "published", "systems").join(F.broadcast(both), "doc_id")
    matched = classify.shared_systems(query, F.col("systems"))
    scored = rows.withColumn("score", F.round(rrf + classify.TAG_BOOST * F.size(matched), 8))
    order = F.struct(F.col("score"), -F.coalesce("vector_rank", F.lit(1000)), -F.col("doc_id"))
    cols = ["doc_id", "number", "published", "score", "cosine", "vector_rank", "text_rank"]
    best = scored.groupBy("bulletin_id").agg(F.max_by(F.struct(*cols), order).alias("b")).select("bulletin_id", "b.*")
    newest = F.max_by(F.struct("bulletin_id", "doc_id", "number", "published", "cosine"), F.struct("published", "number", "bulletin_id"))
    folded = stemmed(best).groupBy("stem").agg(newest.alias("b"), F.max("score").alias("score"), (F.count("*") - 1).alias("superseded"))
    return folded.select("b.*", "stem", "score", "superseded").orderBy(F.desc("score"), "bulletin_id").limit(k)


def current_revisions(matches: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Each match replaced by the newest revision among all rows, its score kept, missing values filled from the match."""
    newest = F.max_by(F.struct("bulletin_id", "number", "published"), F.struct("published", "number", "bulletin_id"))
    families = stemmed(all_rows.select("bulletin_id", "number", "published").distinct()).join(F.broadcast(matches.select("stem")), "stem", "left_semi")
    now = families.groupBy("stem").agg(newest.alias("n"), F.count("*").alias("family_size"))
    out = matches.join(F.broadcast(now), "stem", "left")
    return out.select("stem", *[F.coalesce(f"n.{c}", c).alias(c) for c in ("bulletin_id", "number", "published")], "doc_id", "score", "cosine", "superseded", F.coalesce("family_size", F.lit(1)).alias("family_size"))


def is_confident(matches: DataFrame, threshold: float = CONFIDENCE, top: int = 4) -> DataFrame:
    """Whether the best cosine of the first matches reaches the threshold."""
    first = matches.orderBy(F.desc("score"), "bulletin_id").limit(top)
    return first.agg((F.coalesce(F.max("cosine"), F.lit(0.0)) >= threshold).alias("answered"), F.max("cosine").alias("best_cosine"))


def rank_metrics(ranked: DataFrame, expected: DataFrame, depths: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """hit@k and mean reciprocal rank over queries; a query without a hit counts zero."""
    first = expected.join(ranked, ["query_id", "item"], "left").groupBy("query_id").agg(F.min("place").alias("place"))
    hits = [F.round(F.avg(F.when(F.col("place") <= d, 1.0).otherwise(0.0)), 6).alias(f"hit_at_{d}") for d in depths]
    return first.agg(F.count("*").alias("n_queries"), *hits, F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))
