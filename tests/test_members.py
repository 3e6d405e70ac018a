"""Requests of members: nulls, empty tables, repeated requests, and cases that the derived tables do not reach."""

from datetime import datetime

import pytest

from lamina.operators import bulletins, members
from lamina.sources.snapshots import LostUpdate, Snapshots

CARS, GARAGE = "car_id long, year int, make string, model string, active boolean", "user_id long, car_id long, created_at timestamp_ntz, alerts_enabled boolean"
PEOPLE = "user_id long, is_admin boolean"
ENTITLED = "entitlement_id long, user_id long, kind string, car_id long, status string, plan string, created_at timestamp_ntz"
T = datetime(2024, 1, 1)


def _car(n):
    return (n, 2020, "KIA", f"M {n}", n != 3)


def test_why_a_car_is_refused(spark):
    cars = spark.createDataFrame([_car(n) for n in range(30)], CARS)
    held = [(1, n, T, True) for n in range(10)] + [(2, 1, T, True), (3, 1, T, True), (3, 2, T, True)]
    garage = spark.createDataFrame(held, GARAGE)
    people = spark.createDataFrame([(1, True), (2, False), (3, False), (4, False)], PEOPLE)
    entitled = spark.createDataFrame([(1, 3, "subscription", None, "active", None, T), (2, 4, "unlock", 7, "active", None, T), (3, 4, "subscription", None, "canceled", "all_access", T)], ENTITLED)
    grants = spark.createDataFrame([(2, 1), (2, 2), (4, 7), (4, 8)], "user_id long, car_id long")
    asked = [(1, "Kia", "m-20"), (1, " kia ", "M  5"), (2, "kia", "m 2"), (2, "kia", "m 9"), (2, "kia", "m 9"), (3, "kia", "m 9"), (3, "kia", "m 1"), (4, "kia", "m 9"), (5, "kia", "m 9"), (2, None, "m 1"), (2, "kia", None)]
    requests = spark.createDataFrame([(u, 2020, make, model) for u, make, model in asked], "user_id long, year int, make string, model string")
    got = sorted(((r.user_id, r.make, r.model, r.refusal) for r in members.car_requests(requests, cars, garage, people, entitled, grants).collect()), key=str)
    want = [
        "vehicle limit", None, None, "sample limit", "sample limit", "plan limit", None, None, None, "sample limit", "sample limit",
    ]
    assert got == sorted(((u, make, model, w) for (u, make, model), w in zip(asked, want)), key=str)
    none = members.car_requests(requests, cars.limit(0), garage.limit(0), people.limit(0), entitled.limit(0), grants.limit(0)).collect()
    assert len(none) == len(asked) and not any(r.refusal for r in none)


def test_ones_own_cars(spark):
    cars = spark.createDataFrame([_car(n) for n in range(5)], CARS)
    garage = spark.createDataFrame([(1, 1, T, True), (1, 3, T, True), (2, 1, T, False), (2, 4, T, None)], GARAGE)
    people = spark.createDataFrame([(1, True), (2, False)], PEOPLE)
    rows = spark.createDataFrame([("1", "PIT1A", T, "serious", "processed"), ("2", "PIT1B", datetime(2024, 2, 1), "small", "processed"), ("3", None, None, None, "processed"), ("4", "X", T, "medium", "pending")], "bulletin_id string, number string, published timestamp_ntz, severity string, status string")
    links = spark.createDataFrame([(b, 1) for b in "1234"] + [("4", 4)], "bulletin_id string, car_id long")
    reads = spark.createDataFrame([(1, "2"), (1, "2"), (1, "1"), (2, "9"), (3, "2")], "user_id long, bulletin_id string")
    out = members.my_cars(garage, cars, people, spark.createDataFrame([], ENTITLED), rows, links, reads, datetime(2024, 2, 8))
    got = {(r.user_id, r.car_id): (r.serious, r.medium, r.small, r.unread_small, r.new_this_week, r.availability, r.access) for r in out.collect()}
    # the older revision counts for nothing, a bulletin without a tier makes a car ready, one that is not active is not listed
    assert got == {(1, 1): (0, 0, 1, 0, 1, "ready", "full"), (2, 1): (0, 0, 1, 1, 1, "ready", "sample"), (2, 4): (0, 0, 0, 0, 0, "processing", "sample")}
    assert members.my_cars(garage, cars, people, spark.createDataFrame([], ENTITLED), rows.limit(0), links, reads.limit(0), T).filter("availability = 'ready'").isEmpty()


def test_marking_read_is_told_and_published_once(spark, tmp_path):
    store = Snapshots(spark, f"file://{tmp_path}/store")
    reads = "user_id long, bulletin_id string"
    members.create_reads(store, spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], reads))
    garage = spark.createDataFrame([(1, 10), (2, 20), (2, 20)], "user_id long, car_id long")
    links = spark.createDataFrame([("a", 10), ("b", 20), ("c", 10), ("c", 20)], "bulletin_id string, car_id long")
    asked = spark.createDataFrame([(1, "c"), (1, "c"), (1, "a"), (1, "b"), (9, "c"), (None, "c"), (1, None)], reads)
    first = store.version()
    folders = store.manifest()["tables"]["reads"]["folders"]
    after, answers = members.mark_read(store, asked, garage, links)
    assert sorted(tuple(r) for r in after.collect()) == [(1, "a"), (1, "c"), (2, "b")]
    assert {(r.user_id, r.bulletin_id): r.marked for r in answers.collect()} == {(1, "c"): True, (1, "a"): True, (1, "b"): False, (9, "c"): False, (None, "c"): False, (1, None): False}
    now = store.manifest()["tables"]["reads"]["folders"]
    assert sum(now[k] == p for k, p in folders.items()) == len(folders) - 1  # only the asking account's folder is new
    assert store.read("reads", first).count() == 2
    again, _ = members.mark_read(store, asked, garage, links)
    assert again.count() == 3
    none, told = members.mark_read(store, asked.limit(0), garage, links)
    assert (none.count(), told.count()) == (3, 0)
    stale = store.stage({"reads": store.read("reads")}, {"reads": "bucket"}, first)
    with pytest.raises(LostUpdate):
        store.publish(stale, {"reads": ()})


def test_sign_ins(spark):
    users = spark.createDataFrame([("a", 1, "a@x", "A", True, T), ("b", 7, "b@x", "B", False, None), ("c", 2, "c@x", None, None, T)], "uid string, user_id long, email string, display_name string, is_admin boolean, last_seen_at timestamp_ntz")
    later, last = datetime(2024, 1, 2), datetime(2024, 1, 3)
    rows = [("a", "a2@x", None, False, later), ("b", "old@x", "Old", True, later), ("b", "new@x", "New", None, last), ("z", "z@x", None, None, T), ("z", "z@x", None, None, T), ("y", "y@x", "Y", True, T), (None, "n@x", "N", True, T)]
    sign_ins = spark.createDataFrame(rows, "uid string, email string, display_name string, is_admin boolean, at timestamp_ntz")
    got = {r.uid: tuple(r)[1:] for r in members.signed_in(users, sign_ins).select("uid", "user_id", "email", "display_name", "is_admin", "last_seen_at").collect()}
    assert {r[0] for r in (got.pop("y"), got.pop("z"))} == {8, 9}
    assert got == {"a": (1, "a2@x", None, True, later), "b": (7, "new@x", "New", True, last), "c": (2, "c@x", None, False, T)}
    assert members.signed_in(users, sign_ins.limit(0)).count() == 3
    assert sorted(r.user_id for r in members.signed_in(users.limit(0), sign_ins).collect()) == [1, 2, 3, 4]


def test_numbers_leave_no_gap(spark):
    rows = spark.range(5000).selectExpr("CAST(id AS STRING) AS k")
    got = members.numbered(rows, "k", "n", digits=1).orderBy("n").selectExpr("n", "md5(CAST(k AS BINARY)) AS h").collect()
    assert [r.n for r in got] == list(range(1, 5001)) and [r.h for r in got] == sorted(r.h for r in got)


def test_options_and_pages(spark):
    rows = spark.createDataFrame([(f"m {i:03d}",) for i in range(90)] + [("M 001",), (None,)], "model string")
    assert members.shown_options(rows, "model", None).count() == 80
    assert [r.model for r in members.shown_options(rows, "model", " M 00").collect()][:2] == ["M 001", "m 000"]
    assert members.shown_options(rows, "model", "%").isEmpty()
    pages = spark.range(45).selectExpr("CAST(id AS STRING) AS bulletin_id", "date_add(DATE '2024-01-01', CAST(id AS INT)) AS published")
    got = bulletins.page_with_total(pages, 2, 20).collect()
    assert [r.bulletin_id for r in got] == [str(i) for i in range(24, 4, -1)] and {r.total for r in got} == {45}
    assert [tuple(r) for r in bulletins.page_with_total(pages, 4, 20).collect()] == [(None, None, 45)]
    assert [r.total for r in bulletins.page_with_total(pages.limit(0)).collect()] == [0]
