"""Small literal cases of the operators."""

import random
import zipfile
from collections import deque
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lamina.functions import classify, text
from lamina.operators import bulletins, ledger, reports, state, vocabulary
from lamina.plans import reports as report_plans
from lamina.sources import derived, flatfile
from lamina.streaming import events as streams
from tests.oracle import SF


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_normal_models(spark):
    assert values(spark, text.normal_model(F.col("x")), "F-150", "F--150   SUPER", None, " ") == ["F 150", "F 150 SUPER", "", ""]
    assert values(spark, text.compact_model(F.col("x")), "c-max hd", None) == ["CMAXHD", ""]


def test_stems(spark):
    got = values(spark, text.revision_stem(F.col("x"), F.lit("9")), "PIT6202A", "N252521591-02", "24-NA-125", "653.30", "N242484500", "\tpit1c\n", " ", None)
    assert got == ["PIT6202", "N252521591", "24-NA-125", "653.30", "N242484500", "PIT1", "id:9", "id:9"]


def test_resolved_models(spark):
    rows = [("F 250 SD", 5), ("F 53", 4), ("F53", 9), ("F-53 X", 1), ("REDUNDANT F 250", 2), ("REDUNDANT F 53", 1), ("MUSTANG MACH E", 3), ("DUPLICATE MACH E", 1), ("REDUNDANT Z", 1), ("RA 12", 2), ("RA1 2", 2), ("REDUNDANT MACH", 1)]
    vocab = spark.createDataFrame([(2099, "M", m, "w", n) for m, n in rows], "model_year int, make string, model string, source_window string, bulletins long")
    got = {r.model: r.listed for r in vocabulary.resolved_models(vocab).collect()}
    assert got["REDUNDANT F 250"] == "F 250 SD" and got["F 53"] == "F53" and got["REDUNDANT F 53"] == "F53"
    assert got["DUPLICATE MACH E"] == "MUSTANG MACH E" and got["REDUNDANT Z"] == "REDUNDANT Z" and got["RA1 2"] == "RA 12"
    assert got["REDUNDANT MACH"] == "REDUNDANT MACH" and len(got) == len(rows)


def test_fold_and_sample(spark):
    rows = spark.createDataFrame([("1", "PIT6202", datetime(2024, 9, 1), "serious"), ("2", "PIT6202A", datetime(2024, 9, 2), "serious"), ("3", "PIT6202C", None, "serious"), ("4", None, None, "small"), ("5", "", None, "small"), ("6", "X", datetime(2024, 1, 1), "serious")], "bulletin_id string, number string, published timestamp, severity string")
    got = {r.stem: (r.bulletin_id, r.superseded) for r in bulletins.latest(rows).collect()}
    assert got == {"PIT6202": ("2", 2), "id:4": ("4", 0), "id:5": ("5", 0), "X": ("6", 0)}
    assert {r.bulletin_id for r in bulletins.sample_ids(bulletins.latest(rows)).collect()} == {"2", "4", "5"}
    assert bulletins.latest(rows.limit(0)).count() == 0


def test_display_names(spark):
    assert values(spark, text.display_name(F.col("x")), "CHEVROLET silverado ev", "MAZDA3 RAV4 GMC", "MCLAREN", None, "AMG  F-150") == ["Chevrolet Silverado EV", "Mazda3 RAV4 GMC", "McLaren", "", "AMG F-150"]


def test_openings(spark):
    long = "word " * 30
    assert values(spark, text.opening(F.col("x")), " a  b ", None, long) == ["a b", "", ("word " * 22).strip() + "…"]


def test_types_and_tiers(spark):
    got = values(spark, classify.bulletin_type(F.col("x"), F.lit(None).cast("string"), F.array().cast("array<string>")), "PITx", "24-NA-12", None, "tsb9")
    assert got == ["PIT", "NA", "OTHER", "TSB"]
    assert values(spark, classify.type_severity(F.col("x")), "RC", "WA", None) == ["serious", "medium", "small"]


def test_sliding_limit_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice([1, 1, 1, 2]), datetime.fromtimestamp(1_700_000_000 + rnd.randrange(4000))) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, occurred_at timestamp")
    got = {r.event_id: r.allowed for r in ledger.sliding_limit(df, 5, 60).collect()}
    hits, want = {}, {}
    for i, user, at in sorted(rows, key=lambda r: (r[2], r[0])):
        queue = hits.setdefault(user, deque())
        while queue and queue[0] <= at.timestamp() - 60:
            queue.popleft()
        want[i] = len(queue) < 5
        if want[i]:
            queue.append(at.timestamp())
    assert got == want


def test_usage_totals_reconcile(spark):
    got = ledger.summary(derived.ledger(spark, SF)).collect()
    total = next(r for r in got if r.breakdown == "total")
    for part in ("kind", "model", "day"):
        assert sum(r.n_events for r in got if r.breakdown == part) == total.n_events
        assert sum(r.spend for r in got if r.breakdown == part) == pytest.approx(total.spend, abs=0.01)


def test_packs_against_a_loop(spark):
    got = reports.packed(derived.papers(spark, SF).select("paper_id", F.col("tokens_in").alias("n_bytes")), "paper_id", 100, 60_000).orderBy("paper_id").collect()
    pack, rows, size = 0, 0, 0
    for r in got:
        if rows and (rows >= 100 or size + r.n_bytes > 60_000):
            pack, rows, size = pack + 1, 0, 0
        rows, size = rows + 1, size + r.n_bytes
        assert r.pack == pack
    assert report_plans.c40_request_packs(spark, SF).count() == len(got)


def test_zipped_rows_and_windows(spark, tmp_path):
    for window, lines in (("2015-2019", b'TSB/Document ID,a,b,c,d\n1,Ford,F-150,"2017,2018","two\nlines"\n2,BMW,bmw,2019,x\nshort,row\n'), ("2020-2024", b"3,Kia,Soul \xff,9999,ok\n4,Kia,,2020,x\n5,Kia,Soul,n/a,x\n")):
        with zipfile.ZipFile(tmp_path / f"MFR_COMMS_RECEIVED_{window}.zip", "w") as z:
            z.writestr("rows.csv", lines)
    assert [r.source_window for r in flatfile.windows(spark, str(tmp_path)).collect()] == ["2015-2019", "2020-2024"]
    got = {(r.bulletin_id, r.make, r.model, r.model_year) for r in vocabulary.clean_rows(flatfile.zipped_rows(spark, str(tmp_path))).collect()}
    assert got == {("1", "FORD", "F 150", 2017), ("1", "FORD", "F 150", 2018), ("3", "KIA", "SOUL �", 9999)}


def test_partition_replaced(spark, tmp_path):
    path = str(tmp_path / "w")
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int").write.partitionBy("k").parquet(path)
    state.replace_partition(spark, spark.createDataFrame([("a", 9)], "k string, v int"), path, "k")
    assert {(r.k, r.v) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_payloads(spark):
    df = spark.createDataFrame([("2", '{"results":[{"id":"1","number":"a"},{"id":"2","number":"b"}]}'), ("9", '{"results":[{"id":"1","number":"a"}]}'), ("1", "{}")], "bulletin_id string, payload string")
    assert [r[0] for r in df.select(flatfile.payload_bulletin()["number"]).collect()] == ["b", "a", None]


def test_stream_equals_batch(spark, tmp_path):
    events = derived.read(spark, SF, "events").withColumn("at", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.union(events.filter("event_id % 7 = 0")).repartitionByRange(4, "at").write.parquet(folder)
    stream = streams.once_each(streams.event_stream(spark, folder, events.schema, 100))
    streams.drained(stream, f"file://{tmp_path}/state", str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == events.count() == out.select("event_id").distinct().count()
    assert sorted(map(tuple, streams.windowed_counts(out).collect())) == sorted(map(tuple, streams.windowed_counts(events).collect()))


def test_delivered_once(spark):
    news = spark.createDataFrame([(1, datetime(2024, 1, 2)), (1, datetime(2024, 1, 4)), (2, datetime(2024, 1, 1))], "user_id int, news_at timestamp")
    marks = spark.createDataFrame([(1, datetime(2024, 1, 3)), (3, None)], "user_id int, last_watermark timestamp")
    fresh, after = streams.deliver(news, marks)
    assert sorted(r.user_id for r in fresh.collect()) == [1, 2]
    assert streams.deliver(news, after)[0].count() == 0


def test_hash_sample_is_stable(spark):
    first = sorted(map(tuple, report_plans.l09_hash_sample(spark, SF).collect()))
    assert first == sorted(map(tuple, report_plans.l09_hash_sample(spark, SF).repartition(3).collect())) and len(first) == 15


def test_a_run_without_a_heartbeat_keeps_its_lock(spark):
    from datetime import datetime

    from lamina.operators import work

    runs = spark.createDataFrame([(1, True, "running", None), (2, True, "running", datetime(2024, 1, 1)), (3, None, "done", None)], "run_id long, is_active boolean, status string, heartbeat_at timestamp_ntz")
    got = {r.run_id: (r.is_active, r.status) for r in work.reaped(runs, datetime(2024, 1, 20)).collect()}
    assert got == {1: (True, "running"), 2: (False, "failed"), 3: (None, "done")}


def test_a_seventh_arm_raises(spark):
    import pytest

    from lamina.operators import evaluation

    arms = lambda n: evaluation.labelled_arms(spark.range(n).selectExpr("1 AS doc", "concat('arm', id) AS arm"))
    assert sorted(r.label for r in arms(6).collect()) == list("ABCDEF")
    with pytest.raises(Exception, match="more than 6 arms"):
        arms(7).collect()


def test_signs_of_patterns_in_a_stem_stand_for_themselves(spark):
    from lamina.operators import bulletins

    rows = spark.createDataFrame([("A_1", "A_1"), ("AX1", "A_1"), ("50%", "50%"), ("50 X", "50%")], "number string, stem string")
    assert sorted(r.number for r in bulletins.families_of(rows, ["a_1", "50%"]).collect()) == ["50%", "A_1"]


def test_forced_rows_stand_before_the_draw(spark):
    from lamina.operators import evaluation

    rows = spark.range(40).selectExpr("id", "id % 2 AS cell", "id < 6 AS is_forced")
    takes = spark.createDataFrame([(0, 5), (1, 2)], "cell long, take int")
    got = evaluation.drawn(rows, takes, ["cell"], "id").collect()
    assert {r.id for r in got if r.is_forced} == set(range(6))
    assert sorted(r.place for r in got if r.cell == 0) == [1, 2, 3, 4, 5] and sorted(r.place for r in got if r.cell == 1) == [1, 2, 3]
