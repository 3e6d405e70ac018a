"""Targets against a plain loop; taken words against targets."""

import random

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared(sizes):
    """sizes: by source in order; weights 1, 2, 3, repeating."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in sizes if s not in capped]
        w = sum(weights[s] for s in free)
        share = {s: rest * weights[s] / w for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randint(0, 60))), "en", r.choice(["b", "a", "é", "Z", None, "b", "b", "b"]), 1) for i in range(3000)]
    rows += [(9000, "tiny words", "en", "aa", 1), (9001, None, "en", "nothing", 1), (5, rows[5][1], "en", rows[5][3], 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = mixing.mix_plan(df).withColumn("taken", F.col("copies") * F.col("size")).collect()
    assert len(out) == len(rows)
    sizes = {}
    for s in sorted({x[3] for x in rows}, key=lambda s: (s is None, s or "")):
        sizes[s] = sum(len((x[1] or "").split()) for x in rows if x[3] == s)
    want = shared(sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        own = [x for x in out if x.source == s]
        assert all(abs(x.target - want[s]) < 1e-6 and x.source_size == sizes[s] for x in own)
        assert abs(sum(x.taken for x in own) - want[s]) <= 60
    assert all(0 <= x.copies <= 3 for x in out)
    again = mixing.mix_plan(df.repartition(2)).collect()
    assert sorted((x.doc_id, x.copies) for x in again) == sorted((x.doc_id, x.copies) for x in out)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(x.copies for x in out)


def test_two_groupings(spark):
    """Token targets for sources and languages at once."""
    cells = spark.createDataFrame([("a", "en", 100.0), ("a", "de", 50.0), ("b", "en", 80.0), ("b", "de", 120.0)], "source string, lang string, mass double")
    by_source = spark.createDataFrame([("a", 200.0), ("b", 150.0)], "source string, target double")
    by_lang = spark.createDataFrame([("en", 190.0), ("de", 160.0)], "lang string, target double")
    out = mixing.entropy_balance(cells, {"source": by_source, "lang": by_lang}).withColumn("took", F.col("mass") * F.col("rate"))
    for g, t in (("source", by_source), ("lang", by_lang)):
        got = {r[0]: r[1] for r in out.groupBy(g).agg(F.sum("took")).collect()}
        assert all(abs(got[r[0]] - r[1]) < 1e-3 for r in t.collect())


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None), (None, "", None, "s", None)], SCHEMA)
    assert [x.copies * x.size for x in mixing.mix_plan(blank).collect()] == [0, 0]


def test_columns_of_any_name_and_repeated_rows(spark):
    """A third of all rows are one row; the user's columns keep their values."""
    names = ("_h", "_id", "_hash", "_row_key", "_spread", "_bucket", "_own", "_copy", "copies", "rows", "of", "doc", "part", "target")
    rows = [(None, "a b c d", "hot", i) for i in range(500)] + [(i, "w " * (i % 30), "hot" if i % 2 else f"s{i % 40}", i) for i in range(1000)] + [(2000, "long " * 200_000, "big", 7)]
    df = spark.createDataFrame([(*x, *[x[3]] * len(names)) for x in rows], "doc_id long, text string, source string, n long, " + ", ".join(f"{c} long" for c in names)).repartition(6)
    plan = mixing.mix_plan(df)
    assert plan.count() == len(rows)
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    found = mixed.collect()
    assert all(set(tuple(x)[3:]) == {x.n} for x in found)
    assert len(found) == plan.agg(F.sum("copies")).first()[0]
    of_one = sorted(x.copies for x in plan.filter("doc_id is null").collect())
    assert of_one[-1] - of_one[0] <= 1


def test_many_sources(spark, monkeypatch):
    """Sources beyond a broadcast: the same plan by a salted join."""
    df = spark.createDataFrame([(i, "w " * (i % 17), f"s{i % 60}") for i in range(2000)], "doc_id long, text string, source string")
    few = sorted(tuple(x) for x in mixing.mix_plan(df).collect())
    monkeypatch.setattr(mixing, "with_facts", lambda rows, facts, f=mixing.with_facts: f(rows, facts, few=3))
    assert sorted(tuple(x) for x in mixing.mix_plan(df).collect()) == few


def test_targets_that_cannot_be_met(spark):
    cells = spark.createDataFrame([("a", "en", 100.0), ("b", "de", 80.0)], "source string, lang string, mass double")
    by_source = spark.createDataFrame([("a", 150.0), ("b", 50.0)], "source string, target double")
    by_lang = spark.createDataFrame([("en", 50.0), ("de", 150.0)], "lang string, target double")
    with pytest.raises(ArithmeticError):
        mixing.entropy_balance(cells, {"source": by_source, "lang": by_lang}, steps=3)
