"""Vector codes against plain Lloyd rounds in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from lamina.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"


def brute(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, sha256) of rows of (vec_id, vector, label), by scanning everything in every round."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in kept], np.int64).reshape(len(kept), -1)
    at = [i * whole.shape[1] // parts for i in range(parts + 1)]
    books, codes, errors = [], [], np.zeros(len(kept), np.int64)
    for a, b in zip(at[:-1], at[1:]):
        own, book = whole[:, a:b], whole[:entries, a:b].copy()
        nearest = lambda: np.array([((x - book) ** 2).sum(axis=1).argmin() for x in own])  # noqa: B023, E731
        for _ in range(rounds):
            of = nearest()
            for j in range(len(book)):
                if (of == j).any():
                    book[j] = own[of == j].sum(axis=0) // (of == j).sum()
        of = nearest()
        books.append(book)
        codes.append(of)
        errors += ((own - book[of]) ** 2).sum(axis=1)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    by = {}
    for (_, _, label), e in zip(kept, errors.tolist()):
        by[label] = by.get(label, 0) + e
    return [(i, "".join(f"{c[n]:02x}" for c in codes), int(errors[n]), by[label], sha) for n, (i, _, label) in enumerate(kept)]


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(queries.op13_vector_codes(spark, SF)) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("n", [3, 40, 700])
def test_odd_rows_and_ties(spark, n, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK", 8 * 64)  # many blocks
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 3, 8)], int(i % 3) if i % 5 else None) for i in range(n)]  # few values: many ties
    rows += [(n + i, [1.5] * 8, 9) for i in range(n // 2)]  # a third of all rows are copies
    rows += [(-1, None, 1), (-2, [1.0, None, *[0.0] * 6], 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, 1), (None, [0.25] * 8, None), (1, [2.0] * 8, 0), (1, [-2.0] * 8, 0), (5000, [1.0] * 4, 2), (5001, [], 2)]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, code int").repartition(3)
    assert rows_of(vector_codes.vector_codes(table)) == sorted(map(repr, brute(rows)))


def test_other_shapes(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 300, 7)], i % 2) for i in range(200)]  # a length that parts don't divide, large values
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(vector_codes.vector_codes(table, parts=3, entries=20, rounds=6)) == sorted(map(repr, brute(rows, 3, 20, 6)))


def test_empty_tables_and_empty_vectors(spark):
    table = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(table).count() == 0
    assert vector_codes.vector_codes(table.limit(0)).count() == 0
    assert [r.code for r in vector_codes.vector_codes(spark.createDataFrame([(1, [], 1)], "vec_id long, embedding array<float>, label int")).collect()] == ["00000000"]


def test_components_beyond_exact_squares_are_refused():
    with pytest.raises(ValueError):
        vector_codes.distances(np.full((1, 4), 1 << 30), np.zeros((1, 4), np.int64))


def test_only_used_up_parts_are_scanned(monkeypatch):
    rng = np.random.default_rng(1)
    values = np.vstack([rng.normal(c, 5, (200, 8)) for c in (0, 1000, 2000)]).astype(np.int64)
    books = vector_codes.Books([values[::200]])
    heaps = [vector_codes.Heaps(np.zeros(0), np.zeros(0, np.int32), np.zeros(3, np.int32))]
    entry, changes = vector_codes.assigned(values, None, heaps, books)
    books = books.moved([(0, e, place, x) for e, amounts in changes for place, x in enumerate(amounts)])
    scanned, plain = [], vector_codes.distances
    monkeypatch.setattr(vector_codes, "distances", lambda x, book: scanned.append(len(x)) or plain(x, book))
    again, changes = vector_codes.assigned(values, entry, heaps, books)
    assert not scanned and not changes and (again == entry).all()
