"""Stored indexes against scans: the same rows, fewer reads, measured recall."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import postings, retrieval, vector_index
from lamina.sources.snapshots import Snapshots, shared_folder

WORDS = ["brake", "radio", "screen", "blank", "engine", "the", "noise", "door"]


@pytest.fixture
def store(spark):
    return Snapshots(spark, f"{shared_folder(spark, 'test')}/store")


def texts(spark, seed, ids):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(rng.choice(WORDS, rng.integers(0, 12))) if i % 11 else None) for i in ids]
    return spark.createDataFrame(rows, "doc_id long, text string")


def ranks(found):
    return sorted((r.doc_id, r.rank_score) for r in found.collect())


def scanned(docs, query):
    from lamina.functions import text

    terms = postings.query_terms(query)
    lexed = docs.select("doc_id", text.tokens(F.col("text")).alias("l")).filter(text.matches_all(F.col("l"), terms))
    return sorted((r.doc_id, r.s) for r in lexed.select("doc_id", F.round(text.text_rank(F.col("l"), terms), 6).alias("s")).collect())


QUERIES = ("brake", "radio screen", "the Brake door brake", "absent", "the", "brake absent", "")


def test_an_index_that_grows_and_forgets_equals_a_scan(spark, store):
    first, second, gone = texts(spark, 1, range(200)), texts(spark, 2, range(150, 260)), spark.range(140, 160).toDF("doc_id")
    index = postings.TextIndex(store, ["doc_id"], buckets=8)
    index.add(first)
    assert [ranks(index.matches(q)) for q in QUERIES] == [scanned(first, q) for q in QUERIES]
    index.add(second)
    both = first.join(second, "doc_id", "left_anti").unionByName(second)
    assert [ranks(index.matches(q)) for q in QUERIES] == [scanned(both, q) for q in QUERIES]
    index.remove(gone)
    left = both.join(gone, "doc_id", "left_anti")
    assert [ranks(index.matches(q)) for q in QUERIES] == [scanned(left, q) for q in QUERIES]
    index.compacted()
    assert [ranks(index.matches(q)) for q in QUERIES] == [scanned(left, q) for q in QUERIES]
    index.add(gone.join(first, "doc_id"))  # back again
    assert ranks(index.matches("brake")) == scanned(left.unionByName(gone.join(first, "doc_id")), "brake")


def test_only_the_query_s_buckets_are_read(spark, store):
    index = postings.TextIndex(store, ["doc_id"], buckets=8)
    index.add(texts(spark, 1, range(100)))
    index.add(texts(spark, 2, range(100, 200)))
    files = index.postings_of(["brake"]).inputFiles()
    bucket = f"{zlib.crc32(b'brake') % 8:04d}"
    mine = [f for f in files if "postings" in f]
    assert mine and all(f"-{bucket}/" in f for f in mine)
    assert "In(term" in index.postings_of(["brake", "radio"])._jdf.queryExecution().executedPlan().toString()


def test_a_search_within_some_rows_equals_the_search_cut_to_them(spark, store):
    index = postings.TextIndex(store, ["doc_id"], buckets=8)
    index.add(texts(spark, 1, range(100)))
    index.remove(spark.range(10, 20).toDF("doc_id"))
    again = texts(spark, 2, range(15, 120))
    index.add(again.unionByName(again.filter("doc_id < 30")))  # some given twice
    for query in QUERIES:
        whole = ranks(index.matches(query))
        assert ranks(index.matches(query, spark.range(5, 60).toDF("doc_id"))) == [r for r in whole if 5 <= r[0] < 60]
    assert not {r[0] for r in ranks(index.matches("brake"))} & set(range(10, 15))


def test_documents_are_grouped_once_for_all_index_changes(spark, monkeypatch):
    """Each change read lineitem and grouped it anew; only the stored documents may be read after the first."""
    from lamina.plans import indexed

    plans, stage = [], Snapshots.stage
    monkeypatch.setattr(Snapshots, "stage", lambda self, frames, *a, **k: plans.extend(f._jdf.queryExecution().optimizedPlan().toString() for f in frames.values()) or stage(self, frames, *a, **k))
    indexed.f08_indexed_match(spark, "/root/testdata/sf0.001")
    assert len(plans) > 9 and sum("l_linenumber" in p for p in plans) == 1


def vectors_of(spark, n, clusters, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, 16))
    rows = centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.35, size=(n, 16))
    return rows, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(n, [0.0] * 16), (n + 1, None)], "doc_id long, embedding array<double>")


def test_cells_read_until_none_can_be_better_give_what_a_scan_gives(spark, store):
    rows, docs = vectors_of(spark, 1500, 20)
    assert vector_index.build(store, docs) == pytest.approx(38, abs=2)
    assert store.read("vectors_rows").count() == 1500  # every vector that has a cosine
    read = []
    for i in (0, 700, 1400):
        found, n = vector_index.nearest(store, rows[i].tolist(), 40, exact=True)
        assert found == [(r.doc_id, r.cosine) for r in retrieval.nearest(docs, rows[i].tolist(), 40).orderBy("vector_rank").collect()]
        read.append(n)
    assert min(read) < 38  # the bound saves cells
    assert vector_index.nearest(store, [0.0] * 16) == ([], 0)


def test_recall_of_few_cells_is_nine_tenths(spark, store):
    rows, docs = vectors_of(spark, 1500, 20)
    vector_index.build(store, docs)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    hit = 0
    queries = range(0, 1500, 50)
    for i in queries:
        want = set(np.argsort(-(unit @ unit[i]), kind="stable")[:40].tolist())
        found, n = vector_index.nearest(store, rows[i].tolist(), 40, probes=4)
        hit += len(want & {d for d, _ in found})
    assert hit / (40 * len(queries)) >= 0.9


def test_small_tables(spark, store):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0])], "doc_id long, embedding array<double>")
    vector_index.build(store, docs, cells=5)
    assert vector_index.nearest(store, [2.0, 0.0], 40)[0] == [(1, 1.0), (2, 1.0), (3, 0.0)]
    with pytest.raises(ValueError):
        vector_index.build(store, docs.limit(0))


def test_best_of_many_queries_in_blocks(spark):
    rng = np.random.default_rng(9)
    found = rng.integers(-2, 3, size=(400, 6)).astype(float)  # few values: many equal cosines, some zero vectors
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)] + [(900, None)], "vec_id long, embedding array<double>").repartition(3)
    queries = rows.filter("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    size = np.linalg.norm(found, axis=1)
    want = []
    for q in range(0, 400, 7):
        if size[q]:
            scored = sorted((-round(float(found[q] @ found[i] / size[q] / size[i]) + 0.0, 5), i) for i in range(400) if i != q and size[i])
            want += [(q, i, place + 1) for place, (_, i) in enumerate(scored[:5])]
    for block in (10, 1000):
        got = retrieval.nearest_of_queries(rows, queries, 5, block)
        assert sorted((r.query_id, r.vec_id, r.place) for r in got.collect()) == sorted(want)
