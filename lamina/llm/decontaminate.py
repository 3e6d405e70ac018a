"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared as lower-case words joined by one space, where ASCII letters and
digits and all other characters beyond ASCII make words. An item of n bytes may differ by an error
budget of ``RATE * n`` edits. Cut into one piece more than the budget, any such copy holds one
piece unchanged. All pieces are searched at once (Aho-Corasick); around each hit, the item's best
match with free ends is measured by Myers' bit-parallel edit distance.

The budget is lowered so that no piece has fewer than ``MIN_PIECE`` bytes, and is returned. An item
of fewer than ``MIN_BYTES`` bytes may differ by nothing: it is searched as whole words.

The benchmark is searched in blocks of bounded size, each of which is one pass over the documents;
the driver holds one block at a time, which it broadcasts. An item without an id is an item like
others, with a null item_id in the result.

Results: one row per document and item it holds. Null or empty texts, and items without a word,
hold nothing and are held by nothing; repeated items count once for each id, repeated documents
each for itself; a text of any length is searched whole. ``clean_documents`` keeps extra columns of
whatever names; ``contaminations`` leaves them out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import seqs
from lamina.llm.common import dropped, written

#: Edits for each byte of an item, least bytes of a piece and of an item, bytes of a benchmark block.
RATE, MIN_PIECE, MIN_BYTES, BLOCK_BYTES = 0.08, 12, 30, 8_000_000
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def normal(text: bytes) -> bytes:
    """Words of a text already in lower case, joined by one space."""
    return b" ".join(text.translate(_WORDS).split())


def budget(size: int) -> int:
    return max(0, min(int(RATE * size), size // MIN_PIECE - 1))


def pieces(item: bytes) -> list[tuple[int, bytes]]:
    """(place, bytes) of budget + 1 pieces of an item."""
    n = budget(len(item)) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Myers:
    """Edit distance of a pattern to the best substring of texts, a word of bits for the whole pattern."""

    def __init__(self, pattern: bytes):
        self.size = len(pattern)
        self.mask, self.top = (1 << self.size) - 1, 1 << (self.size - 1)
        self.peq: dict[int, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i

    def best(self, text: bytes) -> tuple[int, int]:
        """The smallest distance and the end of the first substring that has it."""
        mask, top, peq = self.mask, self.top, self.peq
        vp, vn, score = mask, 0, self.size
        best, end = self.size, 0
        for i, c in enumerate(text):
            eq = peq.get(c, 0)
            x = eq | vn
            d0 = (((x & vp) + vp) ^ vp) | x
            hp = vn | (~(d0 | vp) & mask)
            hn = vp & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1) & mask
            hn = (hn << 1) & mask
            vp = hn | (~(d0 | hp) & mask)
            vn = hp & d0
            if score < best:
                best, end = score, i + 1
        return best, end


class Matcher:
    """Items to search for in many texts."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        import ahocorasick  # the driver does not need it

        self.items, self.myers = [x[1] for x in items], {}
        self.ids = [x[0] for x in items]
        found: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if len(item) < MIN_BYTES:
                found[b" %b " % item].append((i, -1))
            else:
                for place, piece in pieces(item):
                    found[piece].append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), where))
        self.automaton.make_automaton()

    def matches(self, text: bytes) -> dict[int, tuple[int, int]]:
        """By number of item: distance and end of its best match, if within budget; ends count from a space before the text."""
        tried: dict[int, list[int]] = defaultdict(list)
        out: dict[int, tuple[int, int]] = {}
        text = b" %b " % text
        for end, (size, where) in self.automaton.iter(text.decode("latin-1")):
            for i, place in where:
                if place < 0:
                    out.setdefault(i, (0, end))
                    continue
                start = end + 1 - size - place
                if out.get(i, (1,))[0] == 0 or any(abs(start - s) <= 1 for s in tried[i]):
                    continue
                tried[i].append(start)
                item = self.items[i]
                if start >= 0 and text[start : start + len(item)] == item:
                    out[i] = (0, start + len(item))
                    continue
                e = budget(len(item))
                low = max(0, start - 2 * e - 1)
                if i not in self.myers:
                    self.myers[i] = Myers(item)
                distance, at = self.myers[i].best(text[low : max(0, start) + len(item) + 2 * e + 1])
                if distance <= e and (i not in out or (distance, low + at) < out[i]):
                    out[i] = (distance, low + at)
        return out


def benchmark_blocks(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> list[DataFrame]:
    """Items (i, t) in blocks of bounded bytes, each of which a task can hold."""
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = 1 + 2 * size // BLOCK_BYTES
    return [rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n)]


def _passes(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The normal texts of each block's items, sent to the executors; empty blocks are left out."""
    for block in benchmark_blocks(benchmark):
        found = [(r.i, r.t) for r in block.toLocalIterator()]
        # lowered as the documents are: letter by letter, so that a final sigma or a dotted I is one letter on both sides
        data, offsets = _lowered(pa.array([t for _, t in found], pa.string()))
        items = sorted({(i, normal(data[a:b].tobytes())) for (i, _), a, b in zip(found, offsets[:-1], offsets[1:], strict=True)}, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        if items := [x for x in items if x[1]]:
            yield benchmark.sparkSession.sparkContext.broadcast(items)


def _lowered(column: pa.Array):
    return seqs.utf8_column(pc.utf8_lower(pc.fill_null(column, "")))


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, n_bytes (of the item's normal text), budget of each document and item it holds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, n_bytes long, budget long"
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _passes(benchmark):
        out = out.unionByName(rows.mapInArrow(_finder(items), schema))
    return out


def _finder(items: Broadcast):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items.value)
        for batch in batches:
            data, offsets = _lowered(batch.column(1))
            ids = batch.column(0).to_pylist()
            found = []
            for r in range(len(batch)):
                for i, (distance, _) in matcher.matches(normal(data[offsets[r] : offsets[r + 1]].tobytes())).items():
                    size = len(matcher.items[i])
                    found.append((ids[r], matcher.ids[i], distance, size, budget(size)))
            columns = list(zip(*found, strict=True)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "n_bytes", "budget"])

    return find


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with the columns they had; no row is shuffled, and what a block leaves is written before the next one."""
    at = docs.columns.index("text")

    def cleaner(items: Broadcast):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items.value)
            for batch in batches:
                data, offsets = _lowered(batch.column(at))
                keep = [not matcher.matches(normal(data[offsets[r] : offsets[r + 1]].tobytes())) for r in range(len(batch))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        return clean

    left, source = docs, None  # source: the written table that left reads
    for number, items in enumerate(_passes(benchmark)):
        if number:
            table = written(left, "clean")
            if source is not None:
                dropped(source)
            left = source = table
        left = left.mapInArrow(cleaner(items), docs.schema)
    return left
