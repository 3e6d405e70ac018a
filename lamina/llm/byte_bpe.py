"""Byte-level BPE by a rank file: encoding to ids and decoding back, without regular expressions.

Text becomes an array of code points and these an array of classes (letter, number, space, other
white space, apostrophe that begins a contraction, other). A class is a function from the state
before a character to the state after it. Such functions compose associatively, so the state before
every character comes from a scan: equal stretches of the text are composed side by side, the
stretches' functions are scanned by doubling, and the states within follow. Class and state tell
where a piece begins, but for white space, which looks one character ahead. Each distinct piece is
merged once, and remembered with its bytes as the key: a piece of the vocabulary is its own id, any
other starts as bytes and joins the neighbouring pair of lowest rank, leftmost first, many pieces
side by side (long ones with a heap). The byte offset of every id's text stays with the ids, and
decoding puts each id's bytes there.

Results: one row per row. Null and empty texts have no ids; repeated rows come as often; an id may
be null; extra columns are left out. A text of any length is encoded whole: one beyond ``LOT`` bytes
is taken in parts that end before white space after a visible ASCII character, where a piece always
begins. Bytes that aren't UTF-8 count as U+FFFD. The ids of a text stand together in a task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import seqs

#: Bytes of text encoded at once, pieces remembered, bytes beyond which a piece is merged with a heap, characters of a stretch.
LOT, REMEMBERED, LONG, STRETCH = 1 << 21, 1 << 18, 128, 64
#: Letters and numbers that Unicode 16.0 added to 15.1, and white space.
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
WHITE_SPACE = ((0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))

#: Classes of characters: letter, number, other, apostrophe before one letter or two of a contraction, white space, the space, end of a text.
LETTER, NUMBER, OTHER, SHORT, WIDE, BLANK, SPACE, END = range(8)
#: States: a piece begins here whatever comes; within letters, numbers, others; after white space, after the space; one or two letters of a contraction to come.
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, SPACED, ONE, TWO = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By class and state: the state after, and whether a piece begins at such a character."""
    after, begins = np.zeros((8, 8), np.uint8), np.ones((8, 8), bool)
    for kind, state in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS), (BLANK, BLANKS), (SPACE, SPACED), (END, FRESH)):
        after[kind] = state
    after[LETTER, ONE], after[LETTER, TWO] = FRESH, ONE
    after[SHORT], after[WIDE] = ONE, TWO
    for kind in (SHORT, WIDE):  # within others, or after a space, it is one of them
        after[kind, [OTHERS, SPACED]] = OTHERS
    begins[LETTER, [LETTERS, SPACED, ONE, TWO]] = False
    begins[NUMBER, [NUMBERS, SPACED]] = False
    for kind in (OTHER, SHORT, WIDE):
        begins[kind, [OTHERS, SPACED]] = False
    for kind in (BLANK, SPACE):
        begins[kind, [BLANKS, SPACED]] = False
    return after, begins


AFTER, BEGINS = _tables()


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    first = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode()[::2], np.uint8)
    out = np.full(0x110000, OTHER, np.uint8)
    out[first == ord("L")] = LETTER
    out[first == ord("N")] = NUMBER
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS), (BLANK, WHITE_SPACE)):
        for a, b in ranges:
            out[a : b + 1] = kind
    out[0x20] = SPACE
    return out


def states_before(kinds: np.ndarray) -> np.ndarray:
    """The state before each character, by an associative scan of transition functions from the fresh state."""
    n = len(kinds)
    rows = -(-n // STRETCH)
    lanes = np.full(rows * STRETCH, END, np.uint8)
    lanes[:n] = kinds
    lanes = np.ascontiguousarray(lanes.reshape(rows, STRETCH).T)
    table = AFTER.ravel()
    # each stretch's own function: where each state leads
    whole = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for own in lanes:
        whole = table[(own << 3)[:, None] | whole]
    # the function of all stretches before, by doubling
    step, scanned = 1, whole
    while step < rows:
        scanned = np.concatenate((scanned[:step], np.take_along_axis(scanned[step:], scanned[:-step].astype(np.intp), axis=1)))
        step *= 2
    state = np.concatenate((np.zeros(1, np.uint8), scanned[:-1, FRESH]))
    out = np.empty_like(lanes)
    for i, own in enumerate(lanes):
        out[i] = state
        state = table[(own << 3) | state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 texts: all their bytes, the n + 1 offsets of pieces in these, and the offsets of texts in pieces."""
    joined = b"\0".join(texts) + b"\0"
    raw = np.frombuffer(joined, np.uint8)
    points = np.frombuffer(joined.decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((raw & 0xC0) != 0x80)
    kinds = char_classes()[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    stop = np.searchsorted(lead, ends)
    kinds[stop] = END
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        quote = quote[kinds[quote] == OTHER]
        one, two = points[quote + 1], points[np.minimum(quote + 2, len(points) - 1)]
        kinds[quote[np.isin(one, [*map(ord, "stmd")])]] = SHORT
        pairs = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        kinds[quote[pairs]] = WIDE
    before = states_before(kinds)
    begins = BEGINS.ravel()[(kinds << 3) | before]
    # of several white-space characters the last stands apart, if more text follows
    blank = (kinds == BLANK) | (kinds == SPACE)
    begins[:-1] |= blank[:-1] & ~blank[1:] & (kinds[1:] != END)
    at = np.flatnonzero(begins)
    text_of = np.searchsorted(stop, at)
    inner = kinds[at] != END
    data = np.delete(raw, ends)
    offsets = np.concatenate((lead[at[inner]] - text_of[inner], [len(data)]))
    return data, offsets, np.searchsorted(text_of[inner], np.arange(len(texts) + 1))


class Ranks:
    """A vocabulary of byte strings by rank, which is the id, and what has been merged so far."""

    NONE = np.int64(1 << 30)

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, i in self.ranks.items():
            tokens[i] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        find, pairs = self.ranks.get, {}
        for token, i in self.ranks.items():
            for k in range(1, len(token)):
                a, b = find(token[:k]), find(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids, self.at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each two neighbours' union, NONE if it has none."""
        key = a << 32 | b
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place], self.NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has."""
        own = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        split = own < 0
        size = np.array([len(w) for w in words], np.int64)
        long = np.flatnonzero(split & (size > LONG))
        short = np.flatnonzero(split & (size <= LONG))
        found = [self._by_heap(words[i]) for i in long.tolist()]
        ids, count = self._together([words[i] for i in short.tolist()])
        order = np.concatenate((np.flatnonzero(~split), long, short))
        every, counts = np.concatenate((own[~split].astype(np.uint32), *found, ids)), np.concatenate((np.ones(len(words) - len(long) - len(short), np.int64), np.array([len(x) for x in found], np.int64), count))
        starts, back = np.cumsum(counts) - counts, np.argsort(order)
        return seqs.gather(every, starts[back], counts[back]), counts[back]

    def _together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merges of many pieces side by side: each step joins the best pair of every piece that has one."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        word, done = np.arange(len(words)), []
        rank = np.append(self.pair_rank(symbol[:-1], symbol[1:]), self.NONE) if len(symbol) else symbol
        rank[np.cumsum(sizes) - 1] = self.NONE
        while len(word):
            start = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), start)
            going = best >> 32 < self.NONE
            if not going.all():
                stays = np.repeat(going, sizes)
                done.append((word[~going], sizes[~going], symbol[~stays]))
                place = np.cumsum(stays) - 1
                word, sizes, best, symbol, rank = word[going], sizes[going], best[going], symbol[stays], rank[stays]
                if not len(word):
                    break
                at, start = place[best & 0xFFFFFFFF], np.cumsum(sizes) - sizes
            else:
                at = best & 0xFFFFFFFF
            symbol[at] = best >> 32
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # the joined pair's neighbours, before and after
            right = at + 2 < start + sizes
            rank[at] = self.NONE
            rank[at[right]] = self.pair_rank(symbol[at[right]], symbol[at[right] + 2])
            left = at[at > start]
            rank[left - 1] = self.pair_rank(symbol[left - 1], symbol[left])
            symbol, rank, sizes = symbol[keep], rank[keep], sizes - 1
        if not done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        of, size, ids = (np.concatenate([d[i] for d in done]) for i in range(3))
        order = np.argsort(of)
        starts = np.cumsum(size) - size
        return seqs.gather(ids, starts[order], size[order]).astype(np.uint32), size[order]

    def _by_heap(self, word: bytes) -> np.ndarray:
        """The same for one long piece: a heap of pairs by rank and place over a linked list."""
        n = len(word)
        symbol, after, before = self.byte_id[np.frombuffer(word, np.uint8)], list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_rank(symbol[:-1], symbol[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r < self.NONE]
        heapq.heapify(heap)
        of, bounds = symbol.tolist(), {}
        rank = {i: r for r, i in heap}
        find, token = self.ranks.get, lambda i: bounds.get(i, i + 1)
        while heap:
            r, i = heapq.heappop(heap)
            if rank.get(i) != r:
                continue
            j = after[i]
            of[i], bounds[i], after[i] = r, token(j), after[j]
            rank.pop(j, None)
            of[j] = -1
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n:
                    new = find(word[a : token(after[a])])
                    if new is None:
                        rank.pop(a, None)
                    else:
                        rank[a] = new
                        heapq.heappush(heap, (new, a))
                elif a >= 0:
                    rank.pop(a, None)
        return np.array([x for x in of if x >= 0], np.uint32)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of UTF-8 texts one after the other, and how many each has."""
        data, offsets, first = pieces(texts)
        if len(offsets) == 1:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        words = coded.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.forget()
        find = self.known.get
        numbers = np.array([find(w, -1) for w in words], np.int64)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            ids, count = self.merged(fresh)
            numbers[new] = len(self.at) - 1 + np.arange(len(new))
            self.known.update(zip(fresh, numbers[new].tolist(), strict=True))
            self.ids, self.at = np.concatenate((self.ids, ids)), np.concatenate((self.at, self.at[-1] + np.cumsum(count)))
        numbers = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        count = self.at[numbers + 1] - self.at[numbers]
        ends = np.concatenate(([0], np.cumsum(count)))
        return seqs.gather(self.ids, self.at[numbers], count), np.diff(ends[first])

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> bytes:
        """The bytes of ids, each put at its offset."""
        size = self.sizes[ids]
        if not len(ids):
            return b""
        first, total = int(starts[0]), int(starts[-1] + size[-1] - starts[0])
        out = np.empty(total, np.uint8)
        into = np.arange(int(size.sum())) + np.repeat(starts.astype(np.int64) - first - (np.cumsum(size) - size), size)
        out[into] = seqs.gather(self.bytes, self.starts[ids], size)
        return out.tobytes()


@cache
def ranks_of(path: str) -> Ranks:
    """One vocabulary for all tasks of a worker."""
    return Ranks(path)


def parts_of(text: bytes, most: int) -> list[bytes]:
    """A text in parts of about so many bytes, each but the first beginning with white space after a visible ASCII character."""
    out, at = [], 0
    while len(text) - at > most:
        raw = np.frombuffer(text, np.uint8)
        cut, look = 0, at + most
        while not cut and look < len(text):
            window = raw[look - 1 : look + most]
            white = (window[1:] == 0x20) | (window[1:] >= 0x9) & (window[1:] <= 0xD)
            found = np.flatnonzero(white & (window[:-1] > 0x20) & (window[:-1] < 0x7F))
            cut = look + int(found[0]) if len(found) else 0
            look += most
        if not cut:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def valid(text: bytes) -> bytes:
    try:
        text.decode("utf-8")
    except UnicodeDecodeError:
        return text.decode("utf-8", "replace").encode()
    return text


def encoder(path: str, lot: int = LOT) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Ids and texts to ids, token ids and their offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(1))
            for i, j in seqs.slices(offsets, lot):
                texts = [valid(data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(i, j)]
                if j - i == 1:
                    found = [ranks.encode([part])[0] for part in parts_of(texts[0], lot)]
                    ids, count = np.concatenate(found), np.array([sum(map(len, found))])
                else:
                    ids, count = ranks.encode(texts)
                at = np.concatenate(([0], np.cumsum(count)))
                size = ranks.sizes[ids]
                ends = np.concatenate(([0], np.cumsum(size)))
                starts = (ends[:-1] - np.repeat(ends[at[:-1]], count)).astype("<u4")
                blobs = (pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(x)]) for x in (ids.astype("<u4"), starts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(count, pa.int64()), *blobs], ["doc_id", "n_tokens", "ids", "starts"])

    return run


def decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Token ids and their offsets to bytes, with the ids kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = ranks_of(path)
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in batch.column(2)]
            starts = [np.frombuffer(x.as_buffer(), "<u4") if x.is_valid else np.zeros(0, "<u4") for x in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([ranks.decode(a, b) for a, b in zip(own, starts, strict=True)], pa.binary())], ["doc_id", "n_tokens", "ids", "bytes"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids and starts: the token ids, and the byte offset in the text of each, as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(encoder(path), "doc_id long, n_tokens long, ids binary, starts binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids and bytes of what ``encode`` gave (or of any stretch of a text's ids and starts)."""
    return tokens.select("doc_id", "n_tokens", "ids", "starts").mapInArrow(decoder(path), "doc_id long, n_tokens long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the bytes they decode to; ids don't leave the task in between."""
    encoded, decoded = encoder(path), decoder(path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in decoded(encoded(batches)):
            found = [pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column(c)]) for c in (2, 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *found], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
