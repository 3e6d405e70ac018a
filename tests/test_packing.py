"""Requests packed block by block against a plain loop."""

import random

import pytest

from lamina.operators import reports


def loop(rows, max_rows, max_bytes):
    out, pack, n, size = [], 0, 0, 0
    for key, n_bytes in sorted(rows):
        if n and (n >= max_rows or size + n_bytes > max_bytes):
            pack, n, size = pack + 1, 0, 0
        n, size = n + 1, size + n_bytes
        out.append((key, n_bytes, pack))
    return out


@pytest.mark.parametrize(("block_rows", "n"), [(7, 400), (10, 401), (64, 403), (1000, 400), (7, 1), (7, 8)])
def test_blocks_equal_a_loop(spark, block_rows, n):
    r = random.Random(block_rows)
    rows = [(i * 3, r.choice([0, 1, 5, 30, 99, 100, 101, 250])) for i in range(n)]
    got = reports.packed(spark.createDataFrame(rows, "k long, n_bytes long").repartition(5), "k", 7, 100, block_rows).collect()
    assert sorted(tuple(x) for x in got) == loop(rows, 7, 100)


def test_empty_null_and_repeated(spark):
    empty = spark.createDataFrame([], "k long, n_bytes long, more string")
    assert reports.packed(empty, "k", 7, 100).collect() == []
    rows = spark.createDataFrame([(None, 60), (1, None), (1, 50), (1, 50), (2, 50)], "k long, n_bytes long")
    got = sorted(((x.k or -1, x.n_bytes, x.pack) for x in reports.packed(rows, "k", 7, 100, 2).collect()))
    assert got == [(-1, 60, 0), (1, 0, 0), (1, 50, 1), (1, 50, 1), (2, 50, 2)]
