"""Cars that come back, the search gate, leftovers: cases that the derived tables do not reach."""

from datetime import datetime

from lamina.operators import scoped

CARS = "car_id long, year int, make string, model string, keywords array<string>, active boolean"


def test_the_active_twin_is_taken_and_keywords_stay(spark):
    cars = spark.createDataFrame([(1, 2020, "M", "A", ["old"], False), (2, 2020, "M", "A", ["mine"], True), (3, 2021, "M", "B", ["b"], False), (4, None, "M", "C", None, True)], CARS)
    incoming = spark.createDataFrame([(2020, "M", "A", None), (2020, "M", "A", []), (2021, "M", "B", ["x"]), (2022, "N", "Z", ["z"]), (2022, "N", "Y", None), (2021, "N", "Y", None)], "year int, make string, model string, keywords array<string>")
    got = {r.car_id: (r.model, r.keywords, r.active, r.outcome) for r in scoped.revived(cars, incoming).collect()}
    assert got == {
        1: ("A", ["old"], False, None), 2: ("A", ["mine"], True, "kept"), 3: ("B", ["x"], True, "revived"), 4: ("C", None, True, None),
        5: ("Y", [], True, "inserted"), 6: ("Y", [], True, "inserted"), 7: ("Z", ["z"], True, "inserted"),
    }
    assert scoped.revived(cars.limit(0), incoming.limit(1)).first().car_id == 1
    assert scoped.revived(cars, incoming.limit(0)).filter("outcome IS NOT NULL").count() == 0


def test_a_payment_and_a_day_run_out(spark):
    day = datetime(2024, 1, 20)
    accounts = spark.createDataFrame([(1, True, None), (2, True, datetime(2024, 1, 19)), (3, False, None)], "user_id long, is_admin boolean, searches_reset_at timestamp_ntz")
    garage = spark.createDataFrame([(u, 7, day) for u in (1, 2, 3)], "user_id long, car_id long, created_at timestamp_ntz")
    entitlements = spark.createDataFrame([], "entitlement_id long, user_id long, kind string, car_id long, status string, plan string, created_at timestamp_ntz")
    ledger = spark.createDataFrame([(1, "asked", datetime(2024, 1, 1))] * 2 + [(2, "asked", datetime(2024, 1, 1))] * 2 + [(3, "answered", day)], "user_id long, kind string, occurred_at timestamp_ntz")
    requests = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, 8)], "user_id long, car_id long")
    refusals = lambda daily: {(r.user_id, r.car_id): r.refusal for r in scoped.search_refusals(requests, garage, accounts, entitlements, ledger, day, ("answered", "asked"), daily, 2).collect()}
    assert refusals(1) == {(1, 7): "payment limit", (2, 7): None, (3, 7): "locked", (1, 8): "not tracked"}


def test_counts_of_a_car_without_bulletins(spark):
    bulletins = spark.createDataFrame([("a", "failed", "timeout: x"), ("b", "processed", scoped.SUMMARY_ONLY), ("c", None, None)], "bulletin_id string, status string, reason string")
    papers = spark.createDataFrame([("a", None, False), ("b", "s", False)], "bulletin_id string, paper_summary string, is_embedded boolean")
    links = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "car_id long, bulletin_id string")
    cars = spark.createDataFrame([(1,), (2,)], "car_id long")
    got = {r.car_id: tuple(r)[1:] for r in scoped.work_by_car(bulletins, papers, links, cars).collect()}
    assert got == {1: (0, 0, 0, 1, 1, 1, 1, 0), 2: (0,) * 8}
