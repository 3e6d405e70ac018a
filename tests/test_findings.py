"""Cases of a review: what a query gave otherwise than its SQL, and steps whose work grew faster than their input."""

import re
import time
from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from lamina.functions import classify, text, vectors
from lamina.operators import bulletins, evaluation, members, scores
from lamina.plans import indexed
from lamina.sources import derived
from lamina.sources.snapshots import Snapshots, stored


def test_exact_halves_of_a_vector_go_to_the_even_digit(spark):
    half = 2.0**-9  # 0.001953125, as the nine digits say
    given = [0.103515625, half, 3 * half, -half, 1.5, -0.0, -1e-10, 123456.5, None, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(given,), ([],), (None,)], "v array<float>")
    want = duckdb.sql("SELECT '[' || array_to_string(list_transform($v::FLOAT[], lambda x: printf('%.8f', x::DOUBLE)), ',') || ']'", params={"v": given}).fetchall()[0][0]
    assert [r[0] for r in rows.select(vectors.vector_text(F.col("v"))).collect()] == [want, "[]", None]
    assert want.startswith("[0.10351562,0.00195312,0.00585938,-0.00195312,")


def test_a_confident_search_tells_what_its_answer_was_charged_for(spark, tmp_path):
    docs = [(i, "la maison " * (i % 3 + 1) if i % 2 else "no word", "fr", "s", 10) for i in range(24)]
    near = [(i, [1.0, i / 50, 0.0, 0.1], i % 3) for i in range(24)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = indexed.q06_search(spark, str(tmp_path))
    want = con.execute(indexed.ORACLE_SQL["q06_search"]).fetchall()
    assert len(want) > 1 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {r.meta for r in got.collect()} == {'{"car_id":3,"user_id":7,"refused":false,"answer_generated":true}'}


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_texts_are_sorted_once_to_be_compared(spark):
    words = [f"w{i % 700}" for i in range(2000)]
    rows = spark.createDataFrame([(" ".join(words), " ".join(words[:1000] + ["x"] * 1000))], "a string, b string")
    began = time.time()
    assert rows.select(text.token_f1(F.col("a"), F.col("b"))).first()[0] == 0.5
    assert time.time() - began < 30


def test_words_that_come_more_than_once_count_so_often(spark):
    rows = spark.createDataFrame([("a a a b", "a a c b b"), ("", None), ("a", ""), (" ".join("abcdefghijk" * 2), " ".join("abcdefghijk" * 3))], "a string, b string")
    assert [round(r[0], 6) for r in rows.select(text.token_f1(F.col("a"), F.col("b"))).collect()] == [0.666667, 1.0, 0.0, 0.8]


def test_a_long_text_is_cut_to_units_once_to_find_names(spark):
    rows = spark.createDataFrame([(" ".join(f"U{i}" for i in range(4000)) + " F 150, X", ["F 150", "U3999 F", "50", "X"])], "t string, names array<string>")
    began = time.time()
    assert rows.select(text.names_in(F.col("t"), F.col("names"))).first()[0] == ["F 150", "U3999 F", "X"]
    assert time.time() - began < 20


def test_an_answer_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"summary": "s", "symptoms": [" a "], "remedy": "r", "doc_kind": "recall", "audience": "both", "applicability_years": ["x", "2001", "1 2", "99999999999"]}',), ("{oops",), (None,)], "p string")
    got = rows.select(classify.clean_extraction(F.col("p")).alias("g")).select("g.error", "g.years", "g.symptoms", "g.summary")
    assert [tuple(r) for r in got.collect()][0] == (None, [2001], ["a"], "s") and [r.error for r in got.collect()][1:] == ["invalid JSON"] * 2
    assert plan(got).count("from_json") == 1


@pytest.fixture
def lines(spark, tmp_path, monkeypatch):
    rows = [(o, o * 3, o % 5, n, float(n), "ANR"[(o + n) % 3], "FO"[o % 2]) for o in range(300) for n in (1, 1, 2, 3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(derived, "PART_BYTES", 1000)
    return str(tmp_path)


def test_documents_are_dealt_in_proportion_to_the_table(spark, lines):
    papers = derived.papers(spark, lines)
    n = derived.partitions(spark, lines, "lineitem")
    assert n > 4 and papers.rdd.getNumPartitions() == n and papers.count() == 900
    grouped = papers.groupBy("bulletin_id").count()
    assert grouped.rdd.getNumPartitions() == n and {r["count"] for r in grouped.collect()} == {3}  # by the same shuffle


def test_arms_are_added_up_without_a_sort(spark):
    rows = spark.createDataFrame([], "arm string, doc long, mode string, valid boolean, output struct<summary:string,symptoms:array<string>,systems:array<string>,components:array<string>,remedy:string,doc_kind:string>, latency_s double, tokens_in long, tokens_out long, cost_usd double")
    tree = scores.arm_report(rows)._jdf.queryExecution().sparkPlan().toString()
    assert [line.split("(")[0].split()[-1] for line in tree.splitlines() if "Aggregate(" in line][-2:] == ["HashAggregate"] * 2, tree


def test_a_draw_shuffles_no_row_for_its_cells(spark):
    rows, takes = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", False)], "id long, cell string, is_forced boolean"), spark.createDataFrame([("a", 1), ("b", 1)], "cell string, take int")
    with_hint = evaluation.drawn(rows, takes, ["cell"], "id")
    assert sorted(r.id for r in with_hint.collect()) == [2, 3] and "rightHint=(strategy=broadcast)" in plan(with_hint)


def test_only_wanted_bulletins_documents_are_rolled_up(spark, lines):
    some = spark.createDataFrame([("10000007",), ("x",)], "bulletin_id string")
    got = bulletins.with_papers(some, derived.papers(spark, lines), "symptoms")
    assert {r.bulletin_id: r.n_papers for r in got.collect()} == {"10000007": 3, "x": 0} and "LeftSemi" in plan(got)


def test_unread_pairs_are_found_by_one_grouping(spark):
    mine = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, None)], "user_id long, bulletin_id string")
    reads = spark.createDataFrame([(1, "b"), (9, "a"), (3, None)], "user_id long, bulletin_id string")
    got = bulletins.unread(mine, reads, 3)
    assert sorted(map(str, map(tuple, got.collect()))) == ["(1, 'a')", "(2, 'a')", "(3, None)"]
    assert "Join" not in plan(got) and got.rdd.getNumPartitions() == 3


def exchanges(df) -> list[str]:
    """Keys by which rows are dealt in a plan."""
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def dealt_garage(spark):
    """A garage too large to be broadcast, dealt by account; no row of it is made."""
    return spark.range(2_000_000).selectExpr("id AS user_id", "id % 100 AS car_id").repartition(7, "user_id")


def test_unread_counts_shuffle_no_pair(spark):
    garage, links = dealt_garage(spark), spark.createDataFrame([("10000001", 1)], "bulletin_id string, car_id long")
    families = links.withColumn("published", F.lit(None).cast("timestamp_ntz"))
    keys = exchanges(bulletins.unread_counts(garage, stored(families, "families"), derived.reads_of(garage, stored(links, "links")), datetime(2001, 7, 25)))
    assert [k for k in keys if k.endswith(", 7")] and not [k for k in keys if "bulletin_id" in k], keys


def test_unread_counts_are_a_cars_count_less_the_reads(spark):
    garage = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 10), (None, 10), (3, 30)], "user_id long, car_id long")
    old, new = datetime(2001, 1, 1), datetime(2001, 8, 1)
    families = spark.createDataFrame([(10, "a", new), (10, "b", None), (10, "c", old), (20, "a", new)], "car_id long, bulletin_id string, published timestamp_ntz")
    reads = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "c"), (2, None), (None, "a"), (9, "a")], "user_id long, bulletin_id string")
    got = {tuple(r) for r in bulletins.unread_counts(garage, families, reads, datetime(2001, 7, 25)).collect()}
    assert got == {(1, 10, 2, 0, 3), (1, 20, 0, 0, 1), (2, 10, 4, 2, 6), (None, 10, 3, 1, 3)}  # a car that stands twice counts twice, as in a join


def test_links_of_some_cars_are_filtered_before_they_are_grouped(spark):
    cars = spark.createDataFrame([(3,), (3,), (7,), (-1,), (None,)], "car_id long")
    some, every = derived.links(spark, "/root/testdata/sf0.001", cars), derived.links(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, some.select(*every.columns).collect()), key=str) == sorted(map(tuple, every.filter("car_id IN (3, 7)").collect()), key=str)
    tree = plan(some)
    assert tree.rindex("Aggregate [k") < tree.index("Union") < tree.index("xxhash64")


@pytest.fixture
def staged_frames(spark, tmp_path, monkeypatch):
    """A store of reads, and the frames of all its later stages."""
    store, frames = Snapshots(spark, f"file://{tmp_path}/store"), {}
    members.create_reads(store, spark.createDataFrame([(1, "a"), (2, "a")], "user_id long, bulletin_id string"))
    stage = store.stage
    monkeypatch.setattr(store, "stage", lambda more, *rest, **named: frames.update(more) or stage(more, *rest, **named))
    return store, frames


def test_requests_are_answered_where_they_lie(spark, staged_frames):
    store, frames = staged_frames
    garage = spark.range(2_000_000).filter("id < 8").selectExpr("id AS user_id", "id % 4 AS car_id").repartition(members.READ_BUCKETS, "user_id")  # Spark takes it for a large one
    links = stored(spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 9)], "bulletin_id string, car_id long"), "links")
    asked = garage.selectExpr("user_id", "explode(array(1, 2, 9)) AS car_id").join(links, "car_id").select("user_id", "bulletin_id")
    _, answers = members.mark_read(store, asked, garage, links)
    assert {(r.user_id, r.bulletin_id) for r in answers.filter("marked").collect()} == {(1, "a"), (1, "b"), (2, "b"), (5, "a"), (5, "b"), (6, "b")} and answers.count() == 24
    keys = sorted(re.sub(r"#\w+", "", k) for k in exchanges(frames["answers"]))
    assert keys == ["bulletin_id, 4", *[f"user_id, {members.READ_BUCKETS}"] * 2], keys  # links are grouped by bulletin; no request is dealt by its bulletin or car


def test_reads_are_made_of_the_staged_answers(spark, staged_frames, monkeypatch):
    store, frames = staged_frames
    garage, links = spark.createDataFrame([(1, 1), (3, 1)], "user_id long, car_id long"), spark.createDataFrame([("b", 1)], "bulletin_id string, car_id long")
    asked = stored(spark.createDataFrame([(1, "b"), (1, "b"), (2, "b"), (None, "b")], "user_id long, bulletin_id string"), "asked")
    after, _ = members.mark_read(store, asked, garage, links)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "a"), (1, "b"), (2, "a")]
    assert frames["reads"].inputFiles() and all("/store/" in f for f in frames["reads"].inputFiles())  # the requests are not made again
    version, stage = store.version(), store.stage
    monkeypatch.setattr(store, "stage", lambda more, *rest, **named: 1 / 0 if "reads" in more else stage(more, *rest, **named))
    with pytest.raises(ZeroDivisionError):
        members.mark_read(store, asked.unionByName(asked.selectExpr("3L AS user_id", "bulletin_id")), garage, links)
    assert store.version() == version and store.read("reads").count() == 3


def test_a_partition_of_dealt_reads_has_one_folder(spark):
    rows = members.dealt(spark.range(-500, 3000).selectExpr("id AS user_id"), members.READ_BUCKETS + 1)
    assert rows.rdd.getNumPartitions() == 2 * members.READ_BUCKETS
    found = rows.select(F.spark_partition_id().alias("p"), members._bucket()).groupBy("p").agg(F.countDistinct("bucket").alias("n")).collect()
    assert len(found) == 2 * members.READ_BUCKETS and {r.n for r in found} == {1}


def test_a_detail_has_tags_in_order_of_first_use(spark):
    papers = spark.createDataFrame([
        ("b", 10, ["x", "a"], ["p"], "ten"), ("b", 2, ["z", None, "m", "z"], [], None), ("b", 3, ["m", "x", "only here"], None, "three"), ("c", 1, None, [None], None),
    ], "bulletin_id string, paper_id long, symptoms array<string>, components array<string>, paper_summary string")
    rows = spark.createDataFrame([("b",), ("c",), ("d",)], "bulletin_id string")
    shape = lambda df: {r.bulletin_id: (r.n_papers, r.paper_summary, r.symptoms, r.components) for r in df.collect()}
    rest = {"c": (1, None, [], []), "d": (0, None, [], [])}
    assert shape(bulletins.with_papers(rows, papers, "symptoms", "components", first_use=True)) == rest | {"b": (3, "three", ["z", "m", "x", "only here", "a"], ["p"])}
    assert shape(bulletins.with_papers(rows, papers, "symptoms", "components")) == rest | {"b": (3, "three", ["a", "m", "only here", "x", "z"], ["p"])}
