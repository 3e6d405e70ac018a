"""Removal of repeated word windows, by compressed FM-indexes in each shard.

Within a shard (see ``repeats``) the distinct runs of words arrive by ascending document, in
batches; a run's symbols with an end mark after them stand in one text. A batch is streamed
through the indexes of the batches before it, of which none holds the streamed documents, and then
gets an index of its own; equal-sized indexes are built anew as one, so a shard has logarithmically
many. As an index is built, its own windows get the smallest document of their interval.

An index is the Burrows-Wheeler transform in a wavelet matrix of packed bits, whose words of equal
bits are not stored, the common prefix of neighbouring rows up to the window (a byte a row), and
for each depth a bit vector of where rows begin to differ. No suffix is kept. Streaming goes from a
run's last word back: a step takes the interval of ``w + pattern`` from that of the pattern by two
ranks. If that is empty, the pattern is shortened at its right end to the next depth at which its
interval grows, and so on; a match beyond the window is cut to it in the same way. So each position
gets its matching statistic, capped at the window, and where that reaches the window its interval
tells the smallest document.

Results: one row per document. A null text has no words, a null id is larger than all others;
documents with equal ids remove nothing from each other; texts of any length are cut into pieces
that overlap by a window; extra columns, of whatever names, are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import repeats, seqs

WINDOW = 13
#: Symbols of a batch, the size of the smallest indexes.
BATCH = 1 << 17


class BitVector:
    """Packed bits with a running count for each 64 of them; all-zero and all-one words are stored once."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words)
        self.before = np.concatenate(([0], np.cumsum(ones))).astype(np.uint32)
        self.ones = int(self.before[-1])
        mixed = (ones > 0) & (ones < 64)
        self.slot = np.where(mixed, np.cumsum(mixed) + 1, ones == 64).astype(np.uint32)
        self.words = np.concatenate((np.array([0, 2**64 - 1], np.uint64), words[mixed]))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[self.slot[word]] & below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the kth one, from 0; the size where there is none."""
        there = np.flatnonzero(k < self.ones)
        word = np.searchsorted(self.before, k[there], "right") - 1
        bits = np.unpackbits(self.words[self.slot[word]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        left = (k[there] - self.before[word]).astype(np.int64)
        out = np.full(len(k), self.size, np.int64)
        out[there] = word * 64 + (np.cumsum(bits, axis=1) > left[:, None]).argmax(1)
        return out


class WaveletMatrix:
    """Counts of a symbol before a position, in a bit for each position and level."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.depth, self.size, self.levels = max(1, int(kinds - 1).bit_length()), len(symbols), []
        for d in range(self.depth - 1, -1, -1):
            bits = ((symbols >> d) & 1).astype(np.uint8)
            level = BitVector(bits)
            self.levels.append((d, level, len(symbols) - level.ones))
            symbols = np.concatenate((symbols[bits == 0], symbols[bits == 1]))
        every = np.arange(kinds, dtype=np.int64)
        self.start = self._walk(every, np.zeros(kinds, np.int64))

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for d, level, zeros in self.levels:
            ones = level.rank(i)
            i = np.where((symbol >> d) & 1 == 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._walk(symbol, i) - self.start[symbol]


class FMIndex:
    """Backward search over a text of symbols (0 is the end mark), to patterns of ``window`` symbols.

    order: the document's rank for each position. ``own`` has, for each position of the text, the
    smallest document of what stands there over the window.
    """

    def __init__(self, text: np.ndarray, order: np.ndarray, window: int, kinds: int):
        self.window, self.size = window, len(text)
        ranks, depth, n = text.astype(np.int64), 1, len(text)
        suffixes = np.argsort(ranks, kind="stable")
        while depth < window:
            wide = np.int64(ranks.max() + 2)
            shifted = np.full(n, 0, np.int64)
            shifted[: n - depth] = ranks[depth:] + 1
            pair = ranks * wide + shifted
            suffixes = np.argsort(pair, kind="stable")
            ranks = np.empty(n, np.int64)
            ranks[suffixes] = np.cumsum(np.concatenate(([False], pair[suffixes][1:] != pair[suffixes][:-1])))
            depth *= 2
        self.bwt = WaveletMatrix(text[suffixes - 1], kinds)
        self.below = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds))[:-1]))
        # common prefixes of neighbouring rows, and where rows begin to differ at each depth
        same, common, self.edges = np.ones(n - 1, bool), np.zeros(n - 1, np.uint8), [None]
        for q in range(window):
            at = suffixes + q
            symbol = np.where(at < n, text[np.minimum(at, n - 1)], -1)
            same &= symbol[1:] == symbol[:-1]
            common += same
            self.edges.append(BitVector(np.concatenate(([True], ~same))))
        self.common = np.concatenate((np.zeros(1, np.uint8), common, np.zeros(1, np.uint8)))
        differ = np.concatenate(([True], ~same))
        self.lowest = np.minimum.reduceat(order[suffixes], np.flatnonzero(differ))
        self.own = np.empty(n, np.int64)
        self.own[suffixes] = self.lowest[np.cumsum(differ) - 1]

    def smallest(self, low: np.ndarray) -> np.ndarray:
        """The smallest document of intervals of the window's depth."""
        return self.lowest[self.edges[self.window].rank(low + 1) - 1]

    def _widened(self, depth: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of depth symbols (0: all) around rows."""
        first, last = np.zeros(len(low), np.int64), np.full(len(low), self.size, np.int64)
        for d in np.unique(depth[depth > 0]):
            own = np.flatnonzero(depth == d)
            k = self.edges[d].rank(low[own] + 1)
            first[own], last[own] = self.edges[d].select(k - 1), self.edges[d].select(k)
        return first, last

    def matching_statistics(self, text: np.ndarray, end: np.ndarray, length: np.ndarray):
        """Stream texts (text[end - length : end]) from their ends.

        Yields, by step, the streams at work, their position, the length matched from it (up to
        the window) and the rows low to high of that match.
        """
        low, high, depth = np.zeros(len(end), np.int64), np.full(len(end), self.size, np.int64), np.zeros(len(end), np.int64)
        for j in range(1, int(length.max()) + 1 if len(length) else 0):
            at = np.flatnonzero(length >= j)
            waiting = at
            while len(waiting):
                symbol = text[end[waiting] - j]
                first = self.below[symbol] + self.bwt.rank(symbol, low[waiting])
                last = self.below[symbol] + self.bwt.rank(symbol, high[waiting])
                found = last > first
                hit, missed = waiting[found], waiting[~found]
                low[hit], high[hit], depth[hit] = first[found], last[found], depth[hit] + 1
                waiting = missed[depth[missed] > 0]
                depth[waiting] = np.maximum(self.common[low[waiting]], self.common[high[waiting]])
                low[waiting], high[waiting] = self._widened(depth[waiting], low[waiting])
            deep = at[depth[at] > self.window]
            depth[deep] = self.window
            low[deep], high[deep] = self._widened(depth[deep], low[deep])
            yield at, end[at] - j, depth[at], low[at], high[at]


def least_of(window: int, batch: int = BATCH):
    """An earlier document, if there is one, of every window of a shard's distinct runs (see ``repeats.shard_answer``)."""

    def find(runs: dict[str, np.ndarray], symbols: np.ndarray) -> np.ndarray:
        size = runs["size"].astype(np.int64)
        buf = seqs.gather(symbols, runs["at"], size)
        stop = np.cumsum(size)
        # a word ends at a space or at its run's end
        is_end = np.zeros(len(buf) + 1, bool)
        is_end[:-1] = buf == 0x20
        inner = np.flatnonzero(is_end)
        begin = np.sort(np.concatenate((stop - size, inner + 1)))
        finish = np.sort(np.concatenate((stop, inner)))
        words, word = seqs.distinct_spans(buf, begin, finish)
        count = runs["windows"] + window - 1
        # the text: each run's words from 1 on, then 0
        text = np.zeros(int(count.sum()) + len(count), np.int64)
        end = np.cumsum(count + 1) - 1
        is_word = np.ones(len(text), bool)
        is_word[end] = False
        text[is_word] = word + 1
        place, first = np.cumsum(runs["windows"]) - runs["windows"], end - count
        least = np.empty(int(runs["windows"].sum()), np.int64)
        arrival = np.argsort(runs["order"], kind="stable")
        cuts = np.flatnonzero(np.diff(np.cumsum(count[arrival] + 1) // batch, prepend=-1))
        family: list[tuple[int, np.ndarray, FMIndex]] = []

        def indexed(own: np.ndarray) -> FMIndex:
            return FMIndex(seqs.gather(text, first[own], count[own] + 1), np.repeat(runs["order"][own], count[own] + 1), window, len(words) + 1)

        for own in np.split(arrival, cuts[1:]):
            index = indexed(own)
            ends = np.cumsum(count[own] + 1)
            slots = seqs.gather(np.arange(len(least)), place[own], runs["windows"][own])
            least[slots] = seqs.gather(index.own, ends - count[own] - 1, runs["windows"][own])
            index.own = None
            for _, _, level in family:
                # a run all of whose windows stand in an earlier document has nothing left to find
                slots = seqs.gather(np.arange(len(least)), place[own], runs["windows"][own])
                known = least[slots] < np.repeat(runs["order"][own], runs["windows"][own])
                left = own[~np.logical_and.reduceat(known, np.cumsum(runs["windows"][own]) - runs["windows"][own])]
                for at, position, matched, low, _ in level.matching_statistics(text, end[left], count[left]):
                    whole = np.flatnonzero(matched == window)
                    run = left[at[whole]]
                    slot = place[run] + position[whole] - first[run]
                    least[slot] = np.minimum(least[slot], level.smallest(low[whole]))
            family.append((1, own, index))
            while len(family) > 1 and family[-1][0] == family[-2][0]:
                (n, a, _), (_, b, _) = family.pop(), family.pop()
                both = np.concatenate((b, a))
                family.append((2 * n, both, indexed(both)))
                family[-1][2].own = None
        return least

    return find


def remove_repeats(docs: DataFrame, window: int = WINDOW, batch: int = BATCH, shards: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_sha256 of each document without the words of repeated windows."""
    return repeats.removed(docs, window, "word", least_of(window, batch), shards).withColumnRenamed("n_units", "n_words")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, first_word, last_word: the ranges (end exclusive, possibly overlapping) that ``remove_repeats`` removes."""
    ranges = repeats.removal_ranges(docs, window, "word", least_of(window))
    return ranges.select("doc_id", F.explode("ranges").alias("r")).select("doc_id", F.col("r.first").alias("first_word"), F.col("r.last").alias("last_word"))
