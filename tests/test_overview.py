"""Scores of arms, reports and texts: nulls, empty tables and cases that the derived tables do not reach."""

import pytest
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.operators import overview, scores
from lamina.sources import results

OUTPUT = "struct<summary:string,symptoms:array<string>,systems:array<string>,components:array<string>,remedy:string,doc_kind:string>"
ARMS = f"arm string, doc long, mode string, valid boolean, output {OUTPUT}, latency_s double, tokens_in long, tokens_out long, cost_usd double"
FULL, BLANK = ("a b b", ["X ", "y"], ["s"], [], "r", "k"), (" ", [" ", None], None, [], None, None)


def test_arms_with_nothing_valid_or_billed(spark):
    rows = spark.createDataFrame([("a", 1, "live", True, FULL, 2.0, 10, 1, 0.5), ("a", 2, "live", True, BLANK, None, 10, 1, 0.0), ("a", 3, "live", True, None, 4.0, 10, 1, None), ("b", 1, "batch", None, FULL, None, None, None, None)], ARMS)
    got = {r.arm: r for r in scores.arm_report(rows).collect()}
    assert set(got) == {"a", "b", scores.ALL_ARMS}
    assert (got["a"].n_valid, got["a"].empty_summary, got["a"].empty_symptoms, got["a"].empty_components, got["a"].mean_latency) == (2, 0.5, 0.5, 1.0, 3.0)
    assert (got["a"].billed, got["a"].per_1000, got["a"].per_1000_batch) == (1, 500.0, 250.0)
    assert (got["b"].n_valid, got["b"].empty_summary, got["b"].usd, got["b"].per_1000) == (0, None, 0.0, None)
    assert (got["(all)"].n, got["(all)"].validity, got["(all)"].per_1000_batch) == (4, 0.5, None)
    pair = scores.pairwise(rows.withColumn("valid", F.lit(True))).collect()
    assert [(r.arm, r.other_arm, r.n, r.symptoms, r.summary) for r in pair] == [("a", "b", 1, 1.0, 1.0)]
    stored = spark.createDataFrame([(1, ("b", ["x"], [], None, None, "k")), (2, None)], f"doc long, output {OUTPUT}")
    (one,) = scores.agreements(rows, stored, "a").collect()
    assert (one.arm, one.against, one.n, one.symptoms, one.systems, one.components, one.summary, one.remedy) == ("a", "stored", 1, 0.5, 0.0, 1.0, 0.5, 0.0)
    assert scores.agreements(rows.limit(0), stored, "a").count() == 0 and scores.pairwise(rows.limit(0)).count() == 0


def test_a_broken_line_raises(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "arm string, doc long")
    results.write(rows, str(tmp_path / "run"))
    results.write(rows.filter("arm = 'b'").withColumn("doc", F.lit(5).cast("long")), str(tmp_path / "run"))
    assert sorted(tuple(r) for r in results.read(spark, str(tmp_path / "run"), rows.schema).select("arm", "doc").collect()) == [("a", 1), ("b", 5)]
    (tmp_path / "run" / "arm=b" / "more.json").write_text('\n{"doc": \n')
    assert results.read(spark, str(tmp_path / "run"), rows.schema, ["a"]).count() == 1
    with pytest.raises(Exception, match="(?i)malformed"):
        results.read(spark, str(tmp_path / "run"), rows.schema, ["b"]).collect()


@pytest.mark.parametrize(
    ("event", "want"),
    [
        ('{"id":"s","status":"unpaid","current_period_end":10,"items":{"data":[{"current_period_end":0,"price":{"id":"p"}}]}}', ("s", "past_due", "monthly", 10)),
        ('{"id":"s","status":"new","current_period_end":"soon"}', ("s", None, None, None)),
        ('{"id":"s","status":null,"items":{"data":[]},"current_period_end":999999999999999}', ("s", None, None, None)),
        ("no json", (None, None, None, None)), (None, (None, None, None, None)),
    ],
)
def test_what_an_event_says(spark, event, want):
    rows = spark.createDataFrame([(event,)], "event string").select(overview.subscription_change(F.col("event"), {"p": "monthly"}).alias("c")).select("c.*")
    got = rows.withColumn("period_end", F.unix_seconds(F.col("period_end").cast("timestamp"))).first()
    assert tuple(got) == want


def test_pages_that_give_little(spark):
    rows = spark.createDataFrame([(["a" * 60, None, "\x00b"],), ([],), (None,), ([""],)], "pages array<string>")
    got = [tuple(r.y) for r in rows.select(text.extraction_yield(F.col("pages"), 10.0).alias("y")).collect()]
    assert got[0][:7] == (3, 63, 21.0, 0.968, 2, "text", "a" * 60 + "\n\nb")
    assert got[1] == got[2] == (None,) * 7 + ("zero pages",)
    assert got[3] == (1, 0, 0.0, 0.0, 1, "vision-fallback", None, None)


def test_texts_of_alerts(spark):
    rows = spark.createDataFrame([(0, 0, []), (1, 1, ["A"]), (2, 2, ["A", "B"]), (0, 3, ["A"])], "n int, older int, labels array<string>")
    got = [tuple(r) for r in rows.select(text.alert_subject(F.col("n"), F.col("labels")), text.revision_note(F.col("older"))).collect()]
    assert got == [("Your cars are ready to read", ""), ("1 new bulletin for your A", " (latest of 2 revisions)"), ("2 new bulletins for your cars", " (latest of 3 revisions)"), ("Your A is ready to read", " (latest of 4 revisions)")]


def test_reports_of_empty_tables(spark):
    links = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "car_id long, bulletin_id string")
    bulletins = spark.createDataFrame([("a", "pending", None), ("c", "pending", "summary only")], "bulletin_id string, status string, reason string")
    papers = spark.createDataFrame([("a", None), ("a", "s")], "bulletin_id string, paper_summary string")
    cars = spark.createDataFrame([(1, True, True), (2, False, True), (3, False, True), (4, True, False)], "car_id long, is_scanned boolean, active boolean").selectExpr("*", "2000 AS year", "'M' AS make", "'X' AS model")
    assert {r.car_id: tuple(r)[1:] for r in overview.to_fetch(links, bulletins).collect()} == {1: (2, 1, 1, 0, 1), 2: (1, 1, 0, 1, 1)}
    got = {r.car_id: tuple(r)[1:7] for r in overview.previews(cars, links, bulletins, papers, links.distinct(), 2.5, 0.1).collect()}
    assert got == {1: (2, 1, 1, 3, False, False), 2: (1, 0, 0, 0, True, False), 3: (0, 0, 0, 0, False, True), 4: (0, 0, 0, 0, True, False)}
    baseline = spark.createDataFrame([(1, 3), (2, 1), (4, 1), (9, 1)], "car_id long, linked long")
    told = {r.car_id: (r.linked, r.delta, r.status) for r in overview.identity_report(cars, links, links, baseline).collect()}
    assert told == {1: (2, -1, "below baseline"), 2: (1, 0, "ok"), 3: (0, None, "ok"), 4: (None, None, "missing"), 9: (None, None, "missing")}
    assert overview.to_fetch(links.limit(0), bulletins).count() == 0 and overview.strata_table(papers.limit(0), ["bulletin_id"]).count() == 0
