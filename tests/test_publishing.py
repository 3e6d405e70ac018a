"""Stages, manifests, ingest, leases and re-keying: what must hold when a writer dies, comes twice or comes second."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lamina.operators import leases, publish
from lamina.sources.snapshots import LostUpdate, Snapshots, shared_folder
from lamina.streaming import ingest

NOW, LEASE = datetime(2024, 1, 20), timedelta(minutes=30)
RAW = "raw_id string, raw_make string, raw_model string, raw_years string, summary string, source_window string"


@pytest.fixture
def store(spark):
    return Snapshots(spark, f"{shared_folder(spark, 'test')}/store")


def numbers(store, version=None):
    return sorted(r.id for r in store.read("t", version).collect())


def test_a_reader_keeps_its_version_and_a_dry_run_leaves_nothing(spark, store):
    rows = spark.range(9).selectExpr("id", "concat('p ', id % 3) AS part")
    stage = store.stage({"t": rows}, {"t": "part"})
    assert store.publish(stage, dry_run=True) == {"t": 9} and store.version() == 0 and store._names(f"{store.root}/data") == []
    store.publish(store.stage({"t": rows}, {"t": "part"}))
    before = store.read("t")
    store.publish(store.stage({"t": rows.filter("id = 1")}, {"t": "part"}), {"t": ["p 1", "p 2"]})
    assert numbers(store) == [0, 1, 3, 6] and sorted(r.id for r in before.collect()) == list(range(9))
    assert [r.id for r in store.read("t", only=lambda p: p == "p 1").collect()] == [1]
    assert numbers(store, 1) == list(range(9))
    store.publish(store.stage({"t": rows.limit(0)}, {"t": "part"}))
    assert numbers(store) == [] and store.vacuum() == 3  # the empty stage as well


def test_a_failure_before_the_manifest_changes_nothing(spark, store, monkeypatch):
    store.publish(store.stage({"t": spark.range(3)}))
    with pytest.raises(ValueError, match="too few"):
        store.publish(store.stage({"t": spark.range(1)}), check=lambda n: (_ for _ in ()).throw(ValueError("too few")))
    monkeypatch.setattr(Snapshots, "_commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        store.publish(store.stage({"t": spark.range(1)}))
    assert numbers(store) == [0, 1, 2] and len(store._names(f"{store.root}/data")) == 1


def test_the_later_of_two_writers_is_told(spark, store):
    first, second = store.stage({"t": spark.range(1)}), store.stage({"t": spark.range(2)})
    store.publish(first)
    with pytest.raises(LostUpdate):
        store.publish(second)
    assert numbers(store) == [0]


def test_a_row_without_a_partition_is_refused(spark, store):
    with pytest.raises(Exception, match="without a partition"):
        store.stage({"t": spark.range(2).selectExpr("id", "CAST(NULL AS STRING) AS part")}, {"t": "part"})


def land(spark, folder, n, window, etag, models):
    path = f"{folder}/rows/{n}"
    spark.createDataFrame([(str(i), "Make", m, "2020", "s", window) for i, m in enumerate(models)], RAW).write.parquet(path)
    spark.createDataFrame([(window, etag, NOW + timedelta(days=n), path)], ingest.NOTICE).coalesce(1).write.mode("append").parquet(f"{folder}/notices")


def models(store):
    return sorted((r.source_window, r.model) for r in store.read("vocabulary").collect())


def test_a_batch_that_died_after_its_write_is_published_once(spark, monkeypatch):
    folder = shared_folder(spark, "ingest")
    store = Snapshots(spark, f"{folder}/store")
    land(spark, folder, 0, "2015-2019", "a", ["A", "B"])
    land(spark, folder, 1, "2020-2024", "a", ["C"])
    land(spark, folder, 2, "2015-2019", "b", ["B", "D"])
    commit, calls = Snapshots._commit, []

    def dies(self, *args):
        calls.append(1)
        if len(calls) == 3:
            raise OSError("killed after the write")
        return commit(self, *args)

    def dies_after(self, *args):
        commit(self, *args)
        raise OSError("killed after the manifest")

    monkeypatch.setattr(Snapshots, "_commit", dies)
    with pytest.raises(Exception, match="killed after the write"):
        ingest.run_ingest(store, f"{folder}/notices", f"{folder}/checkpoint", RAW)
    assert models(store) == [("2015-2019", "A"), ("2015-2019", "B"), ("2020-2024", "C")]
    monkeypatch.setattr(Snapshots, "_commit", dies_after)
    with pytest.raises(Exception, match="killed after the manifest"):
        ingest.run_ingest(store, f"{folder}/notices", f"{folder}/checkpoint", RAW)
    monkeypatch.setattr(Snapshots, "_commit", lambda *_: pytest.fail("a replayed batch publishes nothing"))
    ingest.run_ingest(store, f"{folder}/notices", f"{folder}/checkpoint", RAW)
    assert models(store) == [("2015-2019", "B"), ("2015-2019", "D"), ("2020-2024", "C")] and store.version() == 3
    assert sorted(tuple(r)[:2] + (r.row_count,) for r in store.read("ingests").collect()) == [("2015-2019", "b", 2), ("2020-2024", "a", 1)]


def test_windows_of_one_batch(spark):
    folder = shared_folder(spark, "ingest")
    store = Snapshots(spark, f"{folder}/store")
    land(spark, folder, 0, "w1", "a", ["A"])
    land(spark, folder, 1, "w1", "b", ["B"])  # the newest of a batch counts
    land(spark, folder, 2, "w2", "a", ["C"])
    notices = spark.read.schema(ingest.NOTICE).parquet(f"{folder}/notices")
    assert ingest.ingest(store, notices, 0, RAW) == {"w1": "ingested", "w2": "ingested"} and models(store) == [("w1", "B"), ("w2", "C")]
    assert ingest.ingest(store, notices, 0, RAW) == {"w1": "replayed", "w2": "replayed"}
    assert ingest.ingest(store, notices, 1, RAW) == {"w1": "unchanged", "w2": "unchanged"}
    land(spark, folder, 3, "w1", "c", [])  # all withdrawn
    assert ingest.ingest(store, spark.read.schema(ingest.NOTICE).parquet(f"{folder}/notices").filter("etag = 'c'"), 2, RAW) == {"w1": "ingested"}
    assert models(store) == [("w2", "C")]
    scans = spark.createDataFrame([(1, "w1", "c"), (1, "w2", "a"), (2, "w1", "a"), (2, "w2", None)], "car_id long, source_window string, etag string")
    assert sorted(tuple(r) for r in ingest.missing_scans(store, scans).collect()) == [(2, "w1"), (2, "w2")]


def queue_of(spark, store, n=6):
    leases.create(store, spark.range(n).select(F.col("id").alias("car_id"), F.lit(NOW).cast("timestamp_ntz").alias("requested_at")))


def holders(store):
    return {r.car_id: r.holder for r in store.read("queue").collect()}


def test_two_claimants_never_hold_one_row(spark, store, monkeypatch):
    queue_of(spark, store)
    publish_, rival = Snapshots.publish, []

    def overtaken(self, *args, **kwargs):
        if not rival:
            rival.append(1)
            assert leases.claim(store, "second", NOW, 2, LEASE) == 2  # while the first is about to publish
        return publish_(self, *args, **kwargs)

    monkeypatch.setattr(Snapshots, "publish", overtaken)
    assert leases.claim(store, "first", NOW, 3, LEASE) == 3
    assert holders(store) == {0: "second", 1: "second", 2: "first", 3: "first", 4: "first", 5: None}
    assert sorted((r.batch, r.n_claimed) for r in store.read("batches").collect()) == [("first", 3), ("second", 2)]


def test_an_expired_lease_is_free_and_its_old_holder_settles_nothing(spark, store):
    queue_of(spark, store, 3)
    leases.claim(store, "old", NOW, 2, LEASE)
    later = NOW + LEASE
    assert leases.claim(store, "early", later - timedelta(seconds=1), 3, LEASE) == 1
    assert leases.claim(store, "new", later, 3, LEASE) == 2
    results = spark.createDataFrame([(0, True, None), (1, False, "x" * 600)], "car_id long, ok boolean, error string")
    assert leases.settle(store, "old", results, later) and holders(store)[0] == "new"
    assert leases.settle(store, "new", results, later) and not leases.settle(store, "new", results, later)
    assert {r.car_id: (r.attempts, r.last_error, r.holder) for r in store.read("queue").collect()} == {1: (1, "x" * 500, None), 2: (0, None, "early")}
    assert {r.batch: (r.n_done, r.n_failed, r.closed_at is None) for r in store.read("batches").collect()} == {"old": (0, 0, False), "early": (None, None, True), "new": (1, 1, False)}


def test_drain_gives_up_after_three_tries(spark, store):
    queue_of(spark, store, 4)
    read = lambda rows: rows.selectExpr("car_id", "car_id <> 2 AS ok", "'no' AS error")
    assert leases.drain(store, read, NOW, 2) > 3
    assert [(r.car_id, r.attempts) for r in store.read("queue").collect()] == [(2, 3)]
    assert leases.drain(store, read, NOW, 2) == 0


def test_chains_end_in_their_last_car_and_circles_raise(spark):
    merges = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(30, 29)], "car_id long, into long")
    assert {r.car_id: r.into for r in publish.final_survivors(merges).collect()} == {i: 0 for i in range(1, 20)} | {30: 29}
    for circle in ([(1, 2), (2, 1)], [(1, 2), (2, 3), (3, 1)], [(1, 2), (2, 3), (3, 4), (4, 2)]):
        with pytest.raises(ValueError, match="circle"):
            publish.final_survivors(spark.createDataFrame(circle, "car_id long, into long"))
    assert publish.final_survivors(merges.limit(0)).count() == 0


def test_rekeyed_links_unite(spark):
    cars = spark.createDataFrame([(1, 2020, "M", "A", ["x"], False), (2, 2020, "M", "A B", ["y"], True), (3, 2020, "M", "A C", None, False)], "car_id long, year int, make string, model string, keywords array<string>, active boolean")
    plan = spark.createDataFrame([(1, None, "PLAIN"), (2, 1, None), (3, 2, None)], "car_id long, into long, model_after string")
    links = spark.createDataFrame([("b", 1, ["k"], NOW), ("b", 3, ["j"], NOW - LEASE), ("c", 2, ["k"], NOW)], "bulletin_id string, car_id long, keywords array<string>, first_seen_at timestamp_ntz")
    runs = spark.createDataFrame([(7, 3)], "run_id long, car_id long")
    cars_, links_, runs_ = publish.rekeyed(cars, links, runs, plan)
    assert [(r.car_id, r.model, r.keywords, r.active) for r in cars_.collect()] == [(1, "PLAIN", ["x", "y"], True)]
    assert sorted((r.bulletin_id, r.car_id, r.keywords, r.first_seen_at) for r in links_.collect()) == [("b", 1, ["j", "k"], NOW - LEASE), ("c", 1, ["k"], NOW)]
    assert [(r.run_id, r.car_id) for r in runs_.collect()] == [(7, 1)]
    with pytest.raises(ValueError, match="isn't there"):
        publish.rekeyed(cars, links, runs, plan.selectExpr("car_id", "9L AS into", "model_after"))


def test_an_empty_table_is_not_published(spark, store):
    cars = spark.createDataFrame([(1,)], "car_id long")
    links = spark.createDataFrame([(1, "a"), (2, "b")], "car_id long, bulletin_id string")
    assert publish.copied_index(store, {"links": links}, cars) == {"links": 1, "dropped": 1}
    with pytest.raises(ValueError, match="nothing to publish"):
        publish.copied_index(store, {"links": links}, cars.filter("car_id = 5"))
    assert store.version() == 1
