"""Suffix-array removal of repeated byte strings, by a logarithmic family of indexes.

Within a shard (see ``repeats``) the distinct runs of windows arrive by ascending document, in
batches. A batch gets a suffix array: its runs' suffixes from their anchors on, sorted, with the
longest common prefix of neighbours; the text left of the anchors is sorted the same way,
reversed. The batch is merge-scanned against each level of the family: in merged order, the
suffixes that agree over ``window - o`` bytes from the anchor are neighbours, and those of them
that agree over the ``o`` bytes before it share the window that starts there. Each such class
takes its smallest document. Then the batch becomes a level, and equal-sized levels merge, so a
run is merged into a larger level only logarithmically often.

Results: one row per document. A null text counts as empty, a null id as larger than all others;
documents with equal ids remove nothing from each other; texts shorter than the window keep all;
long ones are cut into pieces that overlap by a window; extra columns, of whatever names, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import repeats

WINDOW = 50
#: Runs in a batch, the size of the family's smallest level.
BATCH = 1 << 15


class Level:
    """A sorted set of runs: rows of bytes right of the anchor (from it on) and left of it (from it back), 0 beyond the run's ends."""

    def __init__(self, right: np.ndarray, left: np.ndarray, lead: np.ndarray, windows: np.ndarray, order: np.ndarray, place: np.ndarray):
        # kept in suffix order, so that merging two levels is one pass over sorted rows
        by = np.argsort(right.view(f"S{right.shape[1]}").ravel(), kind="stable")
        self.right, self.left, self.lead, self.windows, self.order, self.place = (x[by] for x in (right, left, lead, windows, order, place))

    def __len__(self) -> int:
        return len(self.order)

    def merge(self, other: Level) -> Level:
        both = (np.concatenate((getattr(self, x), getattr(other, x))) for x in ("right", "left", "lead", "windows", "order", "place"))
        return Level(*both)


def agreement(rows: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row with the one before it (0 for the first)."""
    out = np.zeros(len(rows), np.int16)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def scan(level: Level, window: int, least: np.ndarray) -> None:
    """Lower least (by window, at each run's place) to the smallest document that shares it in the level."""
    common_right = agreement(level.right)
    by = np.argsort(level.left.view(f"S{level.left.shape[1]}").ravel(), kind="stable")
    common_left = agreement(level.left[by])
    wide = np.int64(len(level) + 1)
    for o in range(int(level.lead.max()) + 1):
        at = np.flatnonzero((level.lead >= o) & (level.lead - o < level.windows))
        if len(at) < 2:
            continue
        right = np.cumsum(common_right < window - o)[at]
        left = np.empty(len(level), np.int64)
        left[by] = np.cumsum(common_left < o) if o else 0
        both = right * wide + left[at]
        sort = np.argsort(both, kind="stable")
        both = both[sort]
        cut = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
        if len(cut) == len(both):
            continue
        lowest = np.minimum.reduceat(level.order[at][sort], cut)
        slot = (level.place + level.lead - o)[at][sort]
        least[slot] = np.minimum(least[slot], np.repeat(lowest, np.diff(np.concatenate((cut, [len(both)])))))


def least_of(window: int, batch: int):
    """The smallest document of every window of a shard's distinct runs (see ``repeats.shard_answer``)."""

    def rows(start: np.ndarray, length: np.ndarray, width: int, step: int, symbols: np.ndarray) -> np.ndarray:
        """UTF-8 has no byte 0xFF, so bytes count from 1 and 0 stands for the end."""
        index = start[:, None] + step * np.arange(width)
        out = symbols[np.clip(index, 0, len(symbols) - 1)] + np.uint8(1)
        out[np.arange(width) >= length[:, None]] = 0
        return np.ascontiguousarray(out)

    def find(runs: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
        n = len(runs["order"])
        place = np.cumsum(runs["windows"]) - runs["windows"]
        least = np.repeat(runs["order"], runs["windows"])
        anchor, lead_most = runs["at"] + runs["lead"], max(1, int(runs["lead"].max()))
        arrival = np.argsort(runs["order"], kind="stable")
        family: list[tuple[int, Level]] = []
        for i in range(0, n, batch):
            b = arrival[i : i + batch]
            right = rows(anchor[b], np.minimum(window, runs["size"][b] - runs["lead"][b]), window, 1, symbols)
            left = rows(anchor[b] - 1, runs["lead"][b], lead_most, -1, symbols)
            new = Level(right, left, runs["lead"][b], runs["windows"][b], runs["order"][b], place[b])
            if not family:
                scan(new, window, least)
            for _, level in family:
                scan(new.merge(level), window, least)
            family.append((1, new))
            while len(family) > 1 and family[-1][0] == family[-2][0]:
                (size, a), (_, b2) = family.pop(), family.pop()
                family.append((2 * size, b2.merge(a)))
        return least

    return find


def remove_repeats(docs: DataFrame, window: int = WINDOW, batch: int = BATCH, shards: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document without the bytes of repeated windows."""
    return repeats.removed(docs, window, "byte", least_of(window, batch), shards).withColumnRenamed("n_units", "n_bytes")


def repeated_spans(docs: DataFrame, window: int = WINDOW, batch: int = BATCH) -> DataFrame:
    """doc_id, first_byte, last_byte: the ranges (end exclusive, possibly overlapping) that ``remove_repeats`` removes."""
    ranges = repeats.removal_ranges(docs, window, "byte", least_of(window, batch))
    return ranges.select("doc_id", F.explode("ranges").alias("r")).select("doc_id", F.col("r.first").alias("first_byte"), F.col("r.last").alias("last_byte"))
