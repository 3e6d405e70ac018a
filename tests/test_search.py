"""The search call where the answer fails, cites nothing, or nothing was found."""

import json

from pyspark.sql import functions as F

from lamina.operators import search

MATCHES = "bulletin_id string, score double, cosine double, superseded long"


def run(spark, rows, answer, **kwargs):
    payload, usage = search.search(spark.createDataFrame(rows, MATCHES), "a brake noise", lambda m: answer, "q", 1, 2, **kwargs)
    return payload.first(), sorted(usage.collect(), key=lambda r: r.kind)


def test_a_failed_answer_still_shows_matches_and_is_charged(spark):
    said, used = run(spark, [("100001", 0.5, 0.9, 0), ("100002", 0.4, None, 2)], F.lit(None).cast("string"))
    assert said.answer == search.NO_ANSWER and not said.refused and not said.answer_generated and [m.bulletin_id for m in said.matches] == ["100001", "100002"]
    assert [u.kind for u in used] == ["answer_compose", "search_embed"] and json.loads(used[0].meta)["answer_generated"] is False


def test_only_what_was_retrieved_is_cited(spark):
    said, _ = run(spark, [("100001", 0.5, 0.9, 0), ("100002", 0.6, 0.1, 0)], F.lit("As [100001] says, and [ 777777 ] too."))
    assert said.answer == "As [100001] says, and too." and said.cited_ids == ["100001"] and said.hallucinated == ["777777"]
    assert [(m.bulletin_id, m.cited) for m in said.matches] == [("100002", False), ("100001", True)]


def test_a_refused_search_and_one_that_found_nothing(spark):
    for rows in ([("100001", 0.5, 0.2, 0)], [("100001", 0.5, None, 0)], []):
        said, used = run(spark, rows, F.lit("never"))
        assert said.refused and said.answer == search.NO_MATCH and said.matches == [] and [u.kind for u in used] == ["search_embed"]


def test_matches_beyond_the_gate_do_not_count(spark):
    rows = [(f"10000{i}", 1.0 - i / 10, 0.1, 0) for i in range(4)] + [("100009", 0.1, 0.99, 0)]
    assert run(spark, rows, F.lit("x"))[0].refused
