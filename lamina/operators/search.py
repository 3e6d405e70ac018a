"""A search as one call: matches, gate, answer with guarded citations, and what it is charged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators.retrieval import CONFIDENCE

#: Matches that decide whether a search is sure enough, and what is said without an answer.
GATE_TOP, NO_ANSWER = 4, "These bulletins match; no summary of them could be made."
NO_MATCH = "No bulletin matches this description well enough."


def search(matches: DataFrame, description: str, compose: Callable[[Column], Column], query_id: str, user_id: int, car_id: int, models: tuple[str, str] = ("m-small", "m-large"), threshold: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(one row with the answer and its matches, the ledger rows of the search).

    ``matches`` are the few that retrieval gave: bulletin_id, score, cosine, superseded. ``compose``
    makes an answer from their array, best first; it is a parameter, as is any model behind it, and
    null where it failed. Below the threshold the search is refused: no answer is asked for, no
    matches are shown, and only the embedding is charged. Citations of what was not retrieved are cut.
    """
    each = F.struct((-F.col("score")).alias("minus"), "bulletin_id", "score", "cosine", "superseded")
    one = matches.agg(F.array_sort(F.collect_list(each)).alias("m"))  # as many as retrieval's top, in one row
    cosines = F.transform(F.slice("m", 1, GATE_TOP), lambda x: x["cosine"])
    best = F.coalesce(F.array_max(cosines), F.lit(0.0))
    gated = one.select("m", best.alias("confidence"), (best < threshold).alias("refused"))
    answered = gated.withColumn("said", F.when(~F.col("refused"), compose(F.col("m"))))
    guarded = answered.withColumn("g", text.guarded_citations(F.coalesce("said", F.lit("")), F.transform("m", lambda x: x["bulletin_id"])))
    shown = F.transform("m", lambda x: F.struct(x["bulletin_id"].alias("bulletin_id"), F.round(x["score"], 6).alias("score"), F.round(x["cosine"], 4).alias("cosine"), x["superseded"].alias("superseded"), F.array_contains("g.valid", x["bulletin_id"]).alias("cited")))
    payload = guarded.select(
        F.when(F.col("refused"), NO_MATCH).when(F.col("said").isNull(), NO_ANSWER).otherwise(F.col("g.clean")).alias("answer"), "refused", F.round("confidence", 4).alias("confidence"),
        F.col("said").isNotNull().alias("answer_generated"), F.when(F.col("refused"), F.slice(shown, 1, 0)).otherwise(shown).alias("matches"), F.col("g.valid").alias("cited_ids"), F.col("g.hallucinated").alias("hallucinated"),
        F.col("said"), F.size("m").alias("n_retrieved"),
    )
    asked = F.greatest(F.lit(1), F.length(F.lit(description)) / 4).cast("long")
    meta = lambda *more: F.to_json(F.struct(F.lit(car_id).alias("car_id"), F.lit(user_id).alias("user_id"), *more))
    row = lambda kind, model, tokens_in, tokens_out, *more: F.struct(F.lit(kind).alias("kind"), F.lit(model).alias("model"), tokens_in.alias("tokens_in"), tokens_out.alias("tokens_out"), F.lit(query_id).alias("query_id"), meta(*more).alias("meta"))
    embedded = row("search_embed", models[0], asked, F.lit(0).cast("long"))
    composed = row("answer_compose", models[1], asked * (F.col("n_retrieved") + 1), text.approx_tokens(F.coalesce("said", F.lit(""))).cast("long"), "refused", "answer_generated")
    usage = payload.select(F.explode(F.when(F.col("refused"), F.array(embedded)).otherwise(F.array(embedded, composed))).alias("u")).select("u.*")
    return payload.drop("said", "n_retrieved"), usage
