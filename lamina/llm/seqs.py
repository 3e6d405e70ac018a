"""Array helpers for text inside tasks: bytes, words, hashes and content-selected anchors.

All hashes are 64-bit and seeded by constants, so every task and every rerun agrees.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240229)
BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_POS_BITS = np.uint64(24)
_POS_MASK = np.uint64((1 << 24) - 1)
#: A key for each place of a span (places beyond have two), and a value for each byte (0 for the space, which may stand between spans).
_KEYS = 1 << 12
_PLACE_KEY = _RANDOM.integers(1, 2**63, _KEYS, dtype=np.uint64)
_BYTE_VALUE = np.arange(1, 257, dtype=np.uint64)
_BYTE_VALUE[0x20] = 0
_AT_ONCE = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _weighed(block: np.ndarray, place: np.ndarray) -> np.ndarray:
    key = _PLACE_KEY[place & (_KEYS - 1)]
    if len(place) and int(place.max()) >= _KEYS:
        key = key * (mix((place >> 12).astype(np.uint64)) | np.uint64(1))
    return _BYTE_VALUE[block] * key


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of byte ranges, ascending, apart and not empty, with at most spaces between them.

    Multilinear: each place of a range has a random key of its own, so two ranges agree by chance
    alone. (A polynomial modulo 2**64 has ranges that agree for any base.)
    """
    out = np.empty(len(start), np.uint64)
    if not len(start):
        return out
    for i, j in slices(np.append(start, end[-1]), _AT_ONCE):
        if j - i == 1:  # a long range by parts
            parts = range(int(start[i]), int(end[i]), _AT_ONCE)
            out[i] = np.sum([_weighed(buf[a : min(a + _AT_ONCE, end[i])], np.arange(a, min(a + _AT_ONCE, end[i])) - start[i]).sum(dtype=np.uint64) for a in parts], dtype=np.uint64)
        else:
            first, last = int(start[i]), int(end[j - 1])
            size = np.diff(np.append(start[i:j], last))
            place = np.arange(first, last) - np.repeat(start[i:j], size)
            out[i:j] = np.add.reduceat(_weighed(buf[first:last], place), start[i:j] - first)
    return mix(out + (end - start).astype(np.uint64) * BASE)


def distinct_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words among ranges with just spaces between them, compared byte by byte, and the number of each range's word."""
    data = buf[int(start[0]) : int(end[-1])] if len(start) else buf[:0]
    offsets = np.concatenate(([0], np.cumsum(end - start, dtype=np.int64)))
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[data != 0x20]))])
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def utf8_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    return binary_column(column)


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a column of large strings or binaries without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes together (a longer row stands alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACES = bytes(0x20 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts: a buffer of words joined by one space, each word's start and end, and the n + 1 offsets of texts in words."""
    raw = np.frombuffer(b" ".join(texts).translate(_SPACES), np.uint8)
    if not len(raw):
        return raw, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    blank = raw == 0x20
    after = np.empty(len(raw), bool)  # whether a blank, or nothing, stands before
    after[0], after[1:] = True, blank[:-1]
    begin = np.flatnonzero(after & ~blank)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    first = np.searchsorted(begin, edges)
    if not len(begin):
        return raw[:0], begin, begin, first
    buf = raw[~(blank & after)]
    buf = buf[:-1] if buf[-1] == 0x20 else buf
    gaps = np.flatnonzero(buf == 0x20)
    return buf, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(buf)])), first


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring symbols (n - k + 1 values; none if n < k)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = out * BASE + words[j : len(words) - k + 1 + j]
    return mix(out)


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbouring bytes; k is a power of two."""
    h, base, step = BYTE_CODE[buf], int(BASE), 1
    while step < k:
        if len(h) <= step:
            return np.zeros(0, np.uint64)
        h = h[:-step] * np.uint64(base) + h[step:]
        base, step = (base * base + 2) % 2**64 | 1, step * 2
    return mix(h)


def anchors(grams: np.ndarray, k: int, window: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share the position of their smallest k-gram.

    grams: hash of the k symbols from each position (over neighbouring texts, whose n + 1 offsets
    are in first). A window is ``window`` symbols of one text. Its anchor is its smallest gram,
    leftmost of equals, so equal windows have equal anchors at equal places. Every window is in
    just one run. Returns text, first window, number of windows, and anchor position of each run
    (positions count over all texts).
    """
    w, n = window - k + 1, len(grams)
    none = np.zeros(0, np.int64)
    if n < w or n >= 1 << 24:
        if n >= 1 << 24:
            raise ValueError("cut the text into smaller pieces")
        return none, none, none, none
    packed = (grams & ~_POS_MASK) | np.arange(n, dtype=np.uint64)
    low, step = packed, 1
    while step * 2 <= w:
        low, step = np.minimum(low[:-step], low[step:]), step * 2
    m = n - w + 1
    low = np.minimum(low[:m], low[w - step : w - step + m]) if step < w else low[:m]
    valid = np.zeros(m + 1, np.int32)
    fits = first[1:] - first[:-1] >= window
    np.add.at(valid, first[:-1][fits], 1)
    np.add.at(valid, first[1:][fits] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid)[:m])
    if not len(at):
        return none, none, none, none
    place = (low[at] & _POS_MASK).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    count = np.diff(np.concatenate((cut, [len(at)])))
    return np.searchsorted(first, at[cut], "right") - 1, at[cut], count, place[cut]


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ranges of data one after the other."""
    total = int(length.sum())
    if not total:
        return data[:0]
    ends = np.cumsum(length)
    index = np.arange(total, dtype=np.int64) + np.repeat(start - (ends - length), length)
    return data[index]
