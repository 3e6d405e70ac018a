"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of words with smallest period q, at least ``least`` words and ``exponent * q``
words long, that no neighbouring word extends. A text is halved again and again. A run within a
segment that crosses its midpoint has at least half its words on one side, so the words from the
midpoint on (or back from it) are found again q words further: the Z-function of that half tells
for each q how far they agree. The stretch is then extended over the midpoint and kept if it ends
within the segment; else a larger segment has it. Segments whose midpoint's first words are not
found again within reach cannot have such a run and are left out by one lookup in a table of next
and previous places of equal word groups, so that ordinary prose costs some array work a word and
only repetitive places a Z-function. Equal intervals keep their smallest period.

Results: one row per row. A null, empty or blank text has no words and no runs; a text of any
length is searched whole; repeated rows are each searched; an id may be null. Extra columns are
left out. A text stands whole in a task, and the work on it grows as n log n at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm import seqs

#: Words and periods that a run has at least, bytes of text searched at once.
LEAST, EXPONENT, LOT = 24, 3, 1 << 21
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def z_function(v: list[int], upto: int) -> list[int]:
    """How many words from each place 1 to ``upto`` on agree with the first ones (place 0 has none)."""
    n, z, left, right = len(v), [0] * (upto + 1), 0, 0
    for i in range(1, upto + 1):
        k = 0
        if i < right:
            k = z[i - left]
            if k > right - i:
                k = right - i
        while i + k < n and v[k] == v[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def agreement(a: np.ndarray, b: np.ndarray) -> int:
    """How many first symbols are equal, looked at in doubling steps."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = np.flatnonzero(a[at : min(at + step, n)] != b[at : min(at + step, n)])
        if len(differ):
            return at + int(differ[0])
        at, step = min(at + step, n), step * 2
    return n


def crossing(ids: np.ndarray, lo: int, mid: int, hi: int, first: int, last: int, least: int, exponent: int, left: bool) -> Iterator[tuple[int, int, int]]:
    """Runs (start, end, period) within [lo, hi) with at least half their words on one side of mid; first and last are the text's ends."""
    reach = (hi - lo) // exponent
    half, other = (ids[lo:mid][::-1], ids[mid:hi]) if left else (ids[mid:hi], ids[lo:mid][::-1])
    upto = min(reach, len(half) - 1)
    period = np.arange(upto + 1)
    z = np.array(z_function(half.tolist(), upto))
    left_over = np.flatnonzero(z[1:] >= (np.maximum(least, exponent * period[1:]) + 1) // 2 - period[1:]) + 1
    while len(left_over):
        q = int(left_over[0])
        near = q + int(z[q])
        # a multiple of q within reach of the same stretch has the same interval
        left_over = left_over[(left_over % q != 0) | (left_over > near)]
        # over the midpoint: words there equal those q words further on this side
        far = agreement(other, np.concatenate((half[:q][::-1], other)) if len(other) > q else half[:q][::-1])
        start, end = (mid - near, mid + far) if left else (mid - far, mid + near)
        if near + far < max(least, exponent * q) or (start > first and ids[start - 1] == ids[start - 1 + q]) or (end < last and ids[end] == ids[end - q]):
            continue
        yield start, end, q


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> np.ndarray:
    """Rows of text, start (within the text), length and period, ascending, of texts given as word ids and the n + 1 offsets."""
    if exponent < 3:
        raise ValueError("runs of fewer than 3 periods are not looked for")
    sizes = np.diff(first)
    text = np.flatnonzero(sizes >= least)
    if not len(text):
        return np.zeros((0, 4), np.int64)
    # words that surely agree with those q words further, on one side of a midpoint
    group = max(1, min((max(least, exponent * q) + 1) // 2 - q for q in range(1, least + 1)))
    later, earlier = neighbours(ids, group)
    lo, hi = first[text], first[text + 1]
    found = []
    while len(lo):
        mid = (lo + hi) // 2
        reach = (hi - lo) // exponent
        to_right = later[mid] if len(later) else mid
        right = (to_right > mid) & (to_right - mid <= reach) & (to_right + group <= hi)
        back = mid - group
        to_left = earlier[back]
        to_left_ok = (to_left >= lo) & (back - to_left <= reach)
        for i in np.flatnonzero(right | to_left_ok).tolist():
            for left in (False, True):
                if (to_left_ok if left else right)[i]:
                    t = int(text[i])
                    found += [(t, s, e, q) for s, e, q in crossing(ids, int(lo[i]), int(mid[i]), int(hi[i]), int(first[t]), int(first[t + 1]), least, exponent, left)]
        lo, hi, text = np.concatenate((lo, mid)), np.concatenate((mid, hi)), np.concatenate((text, text))
        large = hi - lo >= least
        lo, hi, text = lo[large], hi[large], text[large]
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.unique(np.array(found, np.int64), axis=0)  # by text, start, end, period
    rows = rows[np.concatenate(([True], (rows[1:, :3] != rows[:-1, :3]).any(axis=1)))]
    rows[:, 2] -= rows[:, 1]
    rows[:, 1] -= first[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def neighbours(ids: np.ndarray, group: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the next and the previous place with an equal group of words (-1: none). Hashes may agree by chance, which costs a look."""
    later, earlier = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
    hashed = seqs.shingles(ids.astype(np.uint64), group)
    order = np.argsort(hashed, kind="stable")
    same = np.flatnonzero(hashed[order[1:]] == hashed[order[:-1]])
    later[order[same]] = order[same + 1]
    earlier[order[same + 1]] = order[same]
    return later, earlier


def dropped_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words is within a run after its first period."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edge)[:n] > 0


def searcher(least: int, exponent: int):
    """Ids and texts to runs and collapsed texts."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(1))
            for i, j in seqs.slices(offsets, LOT):
                buf, start, end, first = seqs.split_words([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)])
                ids = seqs.distinct_spans(buf, start, end)[1].astype(np.int64) if len(start) else np.zeros(0, np.int64)
                runs = runs_of(ids, first, least, exponent)
                at = np.searchsorted(runs[:, 0], np.arange(j - i + 1))
                kept = []
                for r in range(j - i):
                    a, b = int(first[r]), int(first[r + 1])
                    if a == b:
                        kept.append(b"")
                    elif at[r] == at[r + 1]:
                        kept.append(buf[start[a] : end[b - 1]].tobytes())
                    else:
                        stay = a + np.flatnonzero(~dropped_words(b - a, runs[at[r] : at[r + 1]]))
                        size = end[stay] - start[stay]
                        size[:-1] += 1  # with the space after it, where there is one to take
                        kept.append(seqs.gather(buf, start[stay], size).tobytes())
                structs = pa.StructArray.from_arrays([pa.array(runs[:, c]) for c in (1, 2, 3)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), structs), pa.array(kept, pa.binary()).view(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return search


def periodic_runs(docs: DataFrame, least: int = LEAST, exponent: int = EXPONENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the text without what runs repeat, its words joined by one space."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(searcher(least, exponent), RUNS)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equals the first, then that of the smallest period. Null without runs."""

    def before(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, before), F.lit(0))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text, where the texts of a tenth of all ids, told by a checksum of the id, go over into a repetition.

    From word a on, word i becomes word a + (i - a) % p, where a and p come from the checksum. A null id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("words").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    split = rows.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    planted = split.select("doc_id", "text", "words", F.when(n > 0, F.struct(a.alias("a"), p.alias("p"))).alias("by"))
    index = lambda i: F.when(i < F.col("by.a"), i).otherwise(F.col("by.a") + (i - F.col("by.a")) % F.col("by.p"))
    changed = F.array_join(F.transform("words", lambda w, i: F.get("words", index(i.cast("long")).cast("int"))), " ")
    return planted.select("doc_id", F.when(F.col("by").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
