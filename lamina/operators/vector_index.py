"""Nearest vectors by an inverted file: cells around centroids, read nearest first, ranked exactly.

Centroids are fitted on a sample of at most ``SAMPLE`` vectors (an order by a hash of the id picks
it); every vector is then put in the cell of its nearest centroid. A search reads the nearest cells,
ranks their vectors by their exact cosine, and doubles the cells until the best k no longer change.
With ``exact`` it goes on until no cell left unread can hold a better one: on the unit sphere a cell
has nothing nearer than the distance to its centroid less its radius. Null and zero vectors have no
cosine and are in no cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import vectors
from lamina.sources.snapshots import Snapshots

#: Vectors that centroids are fitted on at most, rounds of fitting, cells at most, and what rounding may hide of a cosine.
SAMPLE, ROUNDS, MOST_CELLS, ROUNDING = 8192, 8, 4096, 2e-6


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Centroids of unit vectors, by Lloyd's rounds from a seeded choice; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    found = sample[np.sort(rng.choice(len(sample), min(cells, len(sample)), replace=False))]
    for _ in range(ROUNDS):
        of = (sample @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, of, sample)
        size = np.linalg.norm(sums, axis=1)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-12)[:, None], found)
    return found


def unit_rows(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _assigner(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                unit = unit_rows(batch.column(1))
                cell = (unit @ centroids.T).argmax(axis=1)
                off = np.linalg.norm(unit - centroids[cell], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(off)], ["doc_id", "embedding", "cell", "off"])

    return run


def build(store: Snapshots, docs: DataFrame, cells: int | None = None, name: str = "vectors", sample_size: int = SAMPLE) -> int:
    """Index doc_id and embedding of all rows; how many cells there are. By default as many as the root of the rows."""
    rows = docs.select("doc_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.coalesce(vectors.norm(F.col("embedding")), F.lit(0.0)) > 0)
    n = rows.count()
    cells = cells or max(1, min(MOST_CELLS, math.isqrt(n)))
    # a share by hash first, so that all tasks together send about twice the sample and not each of them a whole one
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.lit(min(1 << 40, (2 * sample_size << 40) // max(1, n)))
    sample = [r.embedding for r in rows.filter(share).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample_size).collect()]
    if not sample:
        raise ValueError("there is no vector to index")
    matrix = np.array(sample)
    centroids = fitted(matrix / np.linalg.norm(matrix, axis=1, keepdims=True), cells)
    placed = rows.mapInArrow(_assigner(centroids), "doc_id long, embedding array<double>, cell int, off double")
    stage = store.stage({f"{name}_rows": placed.hint("rebalance", "cell")}, {f"{name}_rows": "cell"})
    written = store.spark.read.schema("cell int, off double").parquet(*stage.folders[f"{name}_rows"].values())
    radius = {r.cell: (r.n, r.radius) for r in written.groupBy("cell").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()}  # one row a cell
    table = store.spark.createDataFrame([(i, *radius[i], centroids[i].tolist()) for i in sorted(radius)], "cell int, n long, radius double, centroid array<double>")
    more = store.stage({f"{name}_cells": table}, base=stage.base)
    stage.folders |= more.folders
    stage.rows |= more.rows
    stage.schemas |= more.schemas
    store.publish(stage)
    return len(radius)


def nearest(store: Snapshots, query: Sequence[float], k: int = 40, probes: int = 4, exact: bool = False, name: str = "vectors") -> tuple[list[tuple[int, float]], int]:
    """The k nearest (doc_id, cosine at 6 digits; ties to the smaller id) and how many cells were read."""
    cells = store.read(f"{name}_cells").collect()
    q = np.array(query, np.float64)
    if not np.linalg.norm(q):
        return [], 0
    q /= np.linalg.norm(q)
    away = np.linalg.norm(np.array([c.centroid for c in cells]) - q, axis=1)
    # what the best vector of a cell can have as its cosine
    could = 1 - np.maximum(0, away - np.array([c.radius for c in cells]) - 1e-9) ** 2 / 2
    order = np.argsort(-could if exact else away, kind="stable")
    best: list[tuple[int, float]] = []
    done, step = 0, probes
    while done < len(order):
        new = {str(cells[i].cell) for i in order[done : done + step]}
        rows = store.read(f"{name}_rows", only=lambda v: v in new)
        scored = rows.select("doc_id", F.round(vectors.cosine(F.col("embedding"), vectors.literal(query)), 6).alias("cosine"))
        found = [(r.doc_id, r.cosine) for r in scored.orderBy(F.desc("cosine"), "doc_id").limit(k).collect()]  # k rows
        before, best = best, sorted(best + found, key=lambda r: (-r[1], r[0]))[:k]
        done, step = done + step, max(step, done + step)
        if len(best) < k:
            continue
        if exact and (done >= len(order) or could[order[done]] + ROUNDING < best[-1][1]) or not exact and best == before:
            break
    return best, min(done, len(order))
