"""Vector code compression: a codebook for each part of a vector, fitted by Lloyd's rounds that keep heaps.

Vectors become whole numbers and are cut into parts. Each block of vectors (a row of a written
table) has, for each part and codebook entry, a heap of the parts assigned to it. A part's key is
its slack when it was last scanned: lower bound (distance to the second nearest entry) minus upper
bound (distance to its own), plus the drift its entry had then. An entry's drift is how far it has
moved since the start, and how far any other of its part has moved, added up. While the top of a
heap has a key beyond the entry's drift, no part below it can have changed its entry, so only parts
with keys used up are popped and scanned against the whole codebook, exactly. Parts that change
their entry send what they add and take away; Spark sums that, and only the sums of the codebook
(``parts * entries * part length`` numbers, whatever the input's size) reach the driver.

Results: one row per kept row, so repeated rows come as often as they are there. A row is dropped
if its vector is null, holds a null or a component that is not finite, or has another length than
the kept vector with the smallest id. An empty vector counts as a vector of no components. Ids may
be null (they come last as first entries) and repeat (their vectors' order decides). Fewer vectors
than entries give a shorter codebook; an empty table gives no rows. Components beyond some 2 ** 28
after scaling raise an error, as their squares don't fit. Extra columns are left out. A label's
total is joined through the pairs of label and block, so a label with a third of all rows has no
more rows in a task than there are blocks.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from lamina.llm.common import dropped, written

#: Components in a block of vectors, and what a key must exceed its entry's drift by, as roots are rounded.
BLOCK, MARGIN = 1 << 18, 1e-5


@dataclass
class Books:
    """A codebook for each part, the drift of each entry, and the sums and counts of the parts assigned to it."""

    entries: list[np.ndarray]
    drift: list[np.ndarray] = field(default_factory=list)
    sums: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.drift = self.drift or [np.zeros(len(x)) for x in self.entries]
        self.sums = self.sums or [np.zeros((len(x), x.shape[1] + 1), np.int64) for x in self.entries]

    def moved(self, changes: list[tuple[int, int, int, int]]) -> Books:
        """After a round: changes are part, entry, place (0: how many) and what is added there."""
        sums = [x.copy() for x in self.sums]
        for part, entry, place, amount in changes:
            sums[part][entry, place] += amount
        entries, drift = [], []
        for old, total, before in zip(self.entries, sums, self.drift, strict=True):
            used = total[:, 0] > 0
            new = old.copy()
            new[used] = total[used, 1:] // total[used, :1]
            step = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
            first = int(step.argmax())
            others = np.full(len(step), step[first])
            others[first] = np.delete(step, first).max(initial=0)
            entries.append(new)
            drift.append(before + step + others)
        return Books(entries, drift, sums)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.entries for x in book.ravel().tolist()).encode()).hexdigest()


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; equal where the length allows."""
    return [i * length // parts for i in range(parts + 1)]


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of parts to all entries, exact: in floats while all sums stay below 2 ** 53, else in integers."""
    top = max((int(np.abs(v).max(initial=0)) for v in (x, book)), default=0)
    room = 4 * max(1, x.shape[1]) * top * top
    if room >= 1 << 62:
        raise ValueError("components are too large for exact squared distances")
    kind = np.float64 if room < 1 << 53 else np.int64
    x, book = x.astype(kind), book.astype(kind)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)


class Heaps:
    """For one part of a block: a heap for each entry, of slack and vector number."""

    def __init__(self, keys: np.ndarray, numbers: np.ndarray, sizes: np.ndarray):
        at = np.concatenate(([0], np.cumsum(sizes)))
        self.stored = [(keys[a:b], numbers[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        self.open: dict[int, list[tuple[float, int]]] = {}

    def _opened(self, entry: int) -> list[tuple[float, int]]:
        if entry not in self.open:
            keys, numbers = self.stored[entry]
            self.open[entry] = list(zip(keys.tolist(), numbers.tolist(), strict=True))
        return self.open[entry]

    def popped(self, drift: np.ndarray) -> np.ndarray:
        """Numbers of the vectors whose slack is used up."""
        out = []
        for entry, (keys, _) in enumerate(self.stored):
            limit = drift[entry] + MARGIN
            if len(keys) and keys[0] <= limit:
                heap = self._opened(entry)
                while heap and heap[0][0] <= limit:
                    out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, entries: np.ndarray, keys: np.ndarray, numbers: np.ndarray) -> None:
        order = np.argsort(entries, kind="stable")
        edges = np.flatnonzero(np.diff(entries[order], prepend=-1)).tolist()
        for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
            own, heap = order[a:b], self._opened(int(entries[order[a]]))
            new = list(zip(keys[own].tolist(), numbers[own].tolist(), strict=True))
            if len(new) > len(heap) // 4:
                heap += new
                heapq.heapify(heap)
            else:
                for x in new:
                    heapq.heappush(heap, x)

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for entry, heap in self.open.items():
            self.stored[entry] = (np.array([x[0] for x in heap], np.float64), np.array([x[1] for x in heap], np.int32))
        sizes = np.array([len(k) for k, _ in self.stored], np.int32)
        return np.concatenate([k for k, _ in self.stored]), np.concatenate([n for _, n in self.stored]), sizes


def assigned(values: np.ndarray, entry: np.ndarray | None, heaps: list[Heaps], books: Books) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """One round over a block: each part's entry, and by changed entry (numbered through all parts) the count and sums to add.

    Without earlier entries all parts are scanned.
    """
    at, n = cuts(values.shape[1], len(books.entries)), len(values)
    out, changes, base = np.empty((len(books.entries), n), np.int32), [], 0
    for p, (book, drift) in enumerate(zip(books.entries, books.drift, strict=True)):
        own = values[:, at[p] : at[p + 1]]
        todo = np.arange(n) if entry is None else heaps[p].popped(drift)
        out[p] = -1 if entry is None else entry[p]
        if len(todo):
            d = distances(own[todo], book)
            row = np.arange(len(todo))
            best = d.argmin(axis=1)
            near = np.sqrt(d[row, best].astype(np.float64))
            d = d.astype(np.float64)
            d[row, best] = np.inf
            slack = np.sqrt(d.min(axis=1)) - near
            heaps[p].push(best, slack + drift[best], todo)
            change = np.flatnonzero(best != out[p, todo])
            total = np.zeros((len(book), own.shape[1] + 1), np.int64)
            moved = np.hstack((np.ones((len(change), 1), np.int64), own[todo[change]]))
            before = out[p, todo[change]]
            np.add.at(total, best[change], moved)
            np.subtract.at(total, before[before >= 0], moved[before >= 0])
            touched = np.unique(np.concatenate((best[change], before[before >= 0])))
            changes += [(base + j, total[j].tolist()) for j in touched.tolist()]
            out[p, todo] = best
        base += len(book)
    return out, changes


def block_schema(label: StructField) -> StructType:
    return StructType([
        StructField("block", LongType()), StructField("width", IntegerType()), StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(label.dataType)),
        StructField("vectors", BinaryType()), StructField("entry", BinaryType()), StructField("keys", BinaryType()), StructField("numbers", BinaryType()), StructField("sizes", BinaryType()),
        StructField("changes", ArrayType(StructType([StructField("entry", IntegerType()), StructField("amounts", ArrayType(LongType()))]))),
    ])


_CHANGES = pa.list_(pa.struct([("entry", pa.int32()), ("amounts", pa.list_(pa.int64()))]))


def _block_row(block: int, ids: pa.Array, labels: pa.Array, values: np.ndarray, entry: np.ndarray, heaps: list[Heaps], changes: list[tuple[int, list[int]]]) -> pa.RecordBatch:
    packed = [h.packed() for h in heaps]
    top = int(np.abs(values).max(initial=0))
    width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    blobs = [values.astype(f"<i{width}").tobytes(), entry.astype("<u2").tobytes(), *(np.concatenate([x[i] for x in packed]).astype(kind).tobytes() for i, kind in enumerate(("<f8", "<i4", "<i4")))]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
    arrays = [pa.array([block], pa.int64()), pa.array([width], pa.int32()), *lists, *(pa.array([x], pa.binary()) for x in blobs), pa.array([[{"entry": e, "amounts": a} for e, a in changes]], _CHANGES)]
    return pa.RecordBatch.from_arrays(arrays, ["block", "width", "ids", "labels", "vectors", "entry", "keys", "numbers", "sizes", "changes"])


def first_round(books: Books, length: int, scale: int):
    """Rows of id, label, vector to blocks, with every part scanned."""
    per_block = max(1, BLOCK // max(1, length))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, len(batch), per_block):
                part = batch.slice(at, per_block)
                found = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(part), length)
                scaled = np.floor(found * float(scale))
                if np.abs(scaled).max(initial=0) >= 1 << 30:
                    raise ValueError("components are too large for exact squared distances")
                values = scaled.astype(np.int64)
                heaps = [Heaps(np.zeros(0), np.zeros(0, np.int32), np.zeros(len(b), np.int32)) for b in books.entries]
                entry, changes = assigned(values, None, heaps, books)
                yield _block_row(block, part.column(0), part.column(1), values, entry, heaps, changes)
                block += 1

    return run


def _opened(batch: pa.RecordBatch, i: int, books: Books, length: int) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    n = len(batch.column(2)[i].values)
    width, blobs = batch.column(1)[i].as_py(), [np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in ((5, "<u2"), (6, "<f8"), (7, "<i4"), (8, "<i4"))]
    values = np.frombuffer(batch.column(4)[i].as_buffer(), f"<i{width}").astype(np.int64).reshape(n, length)
    entry, heaps, at = blobs[0].astype(np.int32).reshape(len(books.entries), n), [], 0
    for p, book in enumerate(books.entries):
        heaps.append(Heaps(blobs[1][p * n : (p + 1) * n], blobs[2][p * n : (p + 1) * n], blobs[3][at : at + len(book)]))
        at += len(book)
    return values, entry, heaps


def next_round(books: Books, length: int):
    """Blocks to blocks: only parts whose slack is used up are scanned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                values, entry, heaps = _opened(batch, i, books, length)
                entry, changes = assigned(values, entry, heaps, books)
                yield _block_row(batch.column(0)[i].as_py(), batch.column(2)[i].values, batch.column(3)[i].values, values, entry, heaps, changes)

    return run


def last_round(books: Books, length: int):
    """Blocks to rows: block, id, label, code, error."""
    digits = max(2, len(f"{max((len(x) for x in books.entries), default=1) - 1:x}"))
    at = cuts(length, len(books.entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                values, entry, heaps = _opened(batch, i, books, length)
                entry, _ = assigned(values, entry, heaps, books)
                error = np.zeros(len(values), np.int64)
                for p, book in enumerate(books.entries):
                    error += ((values[:, at[p] : at[p + 1]] - book[entry[p]]) ** 2).sum(axis=1)
                code = ["".join(f"{x:0{digits}x}" for x in own) for own in entry.T.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * len(values), pa.int64()), batch.column(2)[i].values, batch.column(3)[i].values, pa.array(code, pa.string()), pa.array(error)], ["block", "id", "label", "code", "error"])

    return run


def _changes_of(blocks: DataFrame, books: Books) -> list[tuple[int, int, int, int]]:
    """What a round changed, summed by Spark: part, entry, place, amount."""
    each = blocks.select(F.explode("changes").alias("c")).select(F.col("c.entry").alias("entry"), F.posexplode("c.amounts").alias("place", "amount"))
    of = [(p, j) for p, book in enumerate(books.entries) for j in range(len(book))]
    return [(*of[r.entry], r.place, r.amount) for r in each.groupBy("entry", "place").agg(F.sum("amount").alias("amount")).collect()]


def compressed(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books | None]:
    """block, id, label, code and error of each kept vector, and the codebooks (None without vectors)."""
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    kept = rows.filter(F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    schema = block_schema(rows.schema["label"])
    flat = StructType([StructField("block", LongType()), StructField("id", LongType()), StructField("label", rows.schema["label"].dataType), *vectors.sparkSession.createDataFrame([], "code string, error long").schema])
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], flat), None
    length = len(first[0].vector)
    kept = kept.filter(F.size("vector") == length)
    found = [r.vector for r in kept.orderBy(*order).limit(entries).collect()]
    seeds = np.floor(np.array(found, np.float64).reshape(len(found), length) * float(scale)).astype(np.int64)
    at = cuts(length, parts)
    books = Books([seeds[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
    blocks = written(kept.mapInArrow(first_round(books, length, scale), schema), "vector-blocks")
    for i in range(rounds):
        books = books.moved(_changes_of(blocks, books))
        if i + 1 < rounds:
            before, blocks = blocks, written(blocks.mapInArrow(next_round(books, length), schema), "vector-blocks")
            dropped(before)
    coded = written(blocks.mapInArrow(last_round(books, length), flat), "vector-codes")
    dropped(blocks)
    return coded, books


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each kept vector."""
    coded, books = compressed(vectors, parts, entries, rounds, scale, id_col, vector_col, label_col)
    totals = coded.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    # a label's total goes to each of its blocks first, and to the block's rows from there
    pairs = coded.select(F.col("label").alias("of"), F.col("block").alias("in")).distinct().join(totals, F.col("of").eqNullSafe(F.col("l"))).drop("l")
    found = coded.join(pairs, (F.col("block") == F.col("in")) & F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))
