"""Token ids on disk: a concatenated id array with Elias-Fano document boundaries.

A token table is a Parquet table of blocks in ascending document order. A block holds the ids of
its documents one after the other (2 bytes an id if the vocabulary allows, else 4) and the ends of
its documents as an Elias-Fano sequence: the low bits of each end packed, the high bits in unary,
with the place of every 64th one. ``select`` then gives any document's offset from about
``2 + log2(ids / documents)`` bits a document; a block's own start comes from the sums of the
blocks before it. Documents keep together; order is by id, nulls last, then by text.

Results: one row per document and copy. A null or empty text has the end id alone; a text of any
length is encoded whole; extra columns are left out. Rows are dealt to ranges by id and, within an
id (or none), by the beginning of the text.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm import seqs
from lamina.llm.common import scan_partitions, written

#: Ids after which a block ends, bytes of text encoded at once, bytes of remembered words in a task, words encoded as one text, and characters of a text that the ranges of rows go by.
BLOCK_IDS, LOT, MEMORY, TOGETHER, PREFIX = 1 << 20, 1 << 21, 24 << 20, 512, 32
#: Fixed value: the pattern of the tokenizers whose texts can be encoded word by word.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class EliasFano:
    """A non-decreasing sequence of whole numbers in near-minimal space."""

    STEP = 64

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8).ravel()
        places = (values >> low_bits) + np.arange(n)
        unary = np.zeros((int(places[-1]) + 1 if n else 0, ), np.uint8)
        unary[places] = 1
        return cls(n, low_bits, np.packbits(bits, bitorder="little"), np.packbits(unary, bitorder="little"), places[:: cls.STEP].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, body: bytes) -> EliasFano:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", body)
        at = struct.calcsize("<QBQQ")
        low, high = np.frombuffer(body, np.uint8, a, at), np.frombuffer(body, np.uint8, b, at + a)
        return cls(n, low_bits, low, high, np.frombuffer(body, "<u4", offset=at + a + b))

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for j in range(self.low_bits):
            at = i * self.low_bits + j
            out |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.int64) << j
        return out

    def select(self, i: int) -> int:
        """Value i: from the nearest sample, count ones byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // self.STEP]), i % self.STEP
        byte, bit = at >> 3, at & 7
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        place = byte * 8 + (word & -word).bit_length() - 1
        return (place - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def decode(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (places - i) << self.low_bits | self._low(i)


def by_words(tokenizer: dict) -> bool:
    """Whether a tokenizer's file is of the kind whose ids of a text are those of its words one after the other."""
    norm, split, model = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}, tokenizer.get("model") or {}
    steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex")) for x in norm.get("normalizers") or ()]
    first = (split.get("pretokenizers") or [{}])[0]
    pattern = (first.get("type"), (first.get("pattern") or {}).get("Regex"), first.get("behavior"), first.get("invert"))
    return steps == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] and pattern == ("Split", PATTERN, "Removed", True) and model.get("end_of_word_suffix") == "</w>"


class WordEncoder:
    """A tokenizer, applied once to each distinct word where its kind allows (see ``by_words``), else to whole texts.

    The pattern never joins symbols across ASCII white space, nor letters or digits with full stops
    and commas after them, so the ids of a text are those of such pieces one after the other. Words
    are told apart by their bytes. What is remembered is bounded in bytes and goes with the task.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        # hashes of known words, ascending, and their numbers; by number, the word's bytes and ids
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.words, self.word_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def held(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.numbers, self.words, self.word_at, self.ids, self.ids_at))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the number of ids of each."""
        if not self.by_words:
            return self._alone([t.decode("utf-8", "replace") for t in texts])
        buf, start, end, first = seqs.split_words(texts)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        # a full stop or comma after an ASCII letter or digit stands alone
        tail = buf[end - 1]
        before = buf[np.maximum(end - 2, 0)]
        lower = before | 0x20
        splits = ((tail == 0x2E) | (tail == 0x2C)) & (end - start > 1) & (((lower >= 0x61) & (lower <= 0x7A)) | ((before >= 0x30) & (before <= 0x39)))
        parts = np.ones(len(start), np.int64) + splits
        where = np.cumsum(parts) - parts
        s, e = np.repeat(start, parts), np.repeat(end, parts)
        cut = np.flatnonzero(splits)
        e[where[cut]] -= 1
        s[where[cut] + 1] = e[where[cut] + 1] - 1
        part_first = np.concatenate((where, [len(s)]))[first]
        kinds, inverse = seqs.distinct_spans(buf, s, e)
        numbers = self._numbers(kinds)[inverse]
        lengths = np.diff(self.ids_at)[numbers]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        return seqs.gather(self.ids, self.ids_at[numbers], lengths), np.diff(ends[part_first])

    def _numbers(self, kinds: pa.Array) -> np.ndarray:
        """The numbers of distinct words; new ones are encoded first."""
        if self.held() > MEMORY:
            self.forget()
        data, at = seqs.binary_column(kinds)
        size = np.diff(at)
        hashes = seqs.span_hashes(data, at[:-1], at[1:])
        place = np.searchsorted(self.hashes, hashes)
        known = np.zeros(len(hashes), bool)
        there = np.flatnonzero(place < len(self.hashes))
        known[there] = self.hashes[place[there]] == hashes[there]
        numbers = np.full(len(hashes), -1, np.int64)
        numbers[known] = self.numbers[place[known]]
        # an equal hash is not enough: lengths and bytes must be equal too
        alike = np.flatnonzero(known)
        alike = alike[size[alike] == np.diff(self.word_at)[numbers[alike]]]
        same = np.zeros(len(hashes), bool)
        if len(alike):
            equal = seqs.gather(data, at[alike], size[alike]) == seqs.gather(self.words, self.word_at[numbers[alike]], size[alike])
            same[alike] = np.logical_and.reduceat(equal, np.cumsum(size[alike]) - size[alike])
        new = np.flatnonzero(~same)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[new].tolist(), at[new + 1].tolist(), strict=True)]
            letters = np.array([w.isalpha() for w in words])
            by = np.concatenate((np.flatnonzero(letters), np.flatnonzero(~letters)))
            new = new[by]
            found = [self._together([words[i] for i in by[: letters.sum()]]), self._alone([words[i] for i in by[letters.sum() :]])]
            numbers[new] = len(self.word_at) - 1 + np.arange(len(new))
            self.words = np.concatenate((self.words, seqs.gather(data, at[new], size[new])))
            self.word_at = np.concatenate((self.word_at, self.word_at[-1] + np.cumsum(size[new])))
            self.ids = np.concatenate((self.ids, *(x[0] for x in found)))
            self.ids_at = np.concatenate((self.ids_at, self.ids_at[-1] + np.cumsum(np.concatenate([x[1] for x in found]))))
            # of words with one hash the first is remembered
            fresh = new[~known[new]]
            fresh = fresh[np.unique(hashes[fresh], return_index=True)[1]]
            place = np.searchsorted(self.hashes, hashes[fresh])
            self.hashes, self.numbers = np.insert(self.hashes, place, hashes[fresh]), np.insert(self.numbers, place, numbers[fresh].astype(np.int32))
        return numbers

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        return np.fromiter(chain.from_iterable(found), np.uint32, int(count.sum())), count

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, encoded many at once: each ends with one id that ends a word.

        If a lot has more such ids than words (a letter became a letter and a mark), it is encoded word by word.
        """
        lots = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            last = np.flatnonzero(self.ends_word[own])
            if len(last) == len(lot):
                count = np.diff(last, prepend=-1)
            else:
                own, count = self._alone(lot)
            ids.append(own)
            counts.append(count)
        return np.concatenate(ids), np.concatenate(counts)


BLOCKS = "part int, block int, n_docs long, n_ids long, width int, doc_ids array<long>, ends binary, ids binary"


def block_writer(path: str, end_id: int):
    """Documents in order to blocks."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, block = WordEncoder(path), TaskContext.get().partitionId(), 0
        docs: list[pa.Array] = []
        ids: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            width = max(encoder.width, 2 if end_id < 1 << 16 else 4)
            every, ends = np.concatenate(ids), np.cumsum(np.concatenate(counts))
            row = [part, block, len(ends), len(every), width, pa.concat_arrays(docs).to_pylist(), EliasFano.encode(ends).to_bytes(), every.astype(f"<u{width}").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["part", "block", "n_docs", "n_ids", "width", "doc_ids", "ends", "ids"])

        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(1))
            for i, j in seqs.slices(offsets, LOT):
                found, n = encoder.encode([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)])
                at = np.cumsum(n)
                ids.append(np.insert(found, at, np.uint32(end_id)))
                counts.append(n + 1)
                docs.append(batch.column(0).slice(i, j - i))
                held += len(ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    docs, ids, counts, held, block = [], [], [], 0, block + 1
        if counts:
            yield flush()

    return write


def blocks_of(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of all documents in ascending order of id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), scan_partitions(docs))
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    # ranges go by a part of the text as well, so rows without an id are spread
    return rows.repartitionByRange(parts, order[0], F.left("text", F.lit(PREFIX))).sortWithinPartitions(*order).mapInArrow(block_writer(tokenizer, end_id), BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token table of documents to a folder of its own."""
    blocks_of(docs, tokenizer, end_id, id_col, text_col).write.parquet(path)


def tokens_of(blocks: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of some documents: a document's ends are selected, and no other document of its block is decoded."""
    wanted = set(doc_ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ends, ids = EliasFano.from_bytes(r["ends"]), np.frombuffer(r["ids"], f"<u{r['width']}")
                for i in (i for i, d in enumerate(r["doc_ids"]) if d in wanted):
                    own = ids[ends.select(i - 1) if i else 0 : ends.select(i)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["doc_ids"][i]], pa.int64()), pa.array([own.astype(np.int64)], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return blocks.filter(F.arrays_overlap("doc_ids", F.lit(sorted(wanted)))).select("width", "doc_ids", "ends", "ids").mapInArrow(pick, "doc_id long, ids array<long>")


def read_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ends = EliasFano.from_bytes(r["ends"]).decode()
            starts = np.concatenate(([0], ends[:-1]))
            ids = np.frombuffer(r["ids"], f"<u{r['width']}").astype("<u4").tobytes()
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(ends)
            yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())], ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_tokens(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of each document of a token table."""
    sizes = blocks.select("part", "block", "n_ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    rows = blocks.select("part", "block", "width", "doc_ids", "ends", "ids").mapInArrow(read_block, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token table to the shared folder and read its documents back."""
    return read_tokens(written(blocks_of(docs, tokenizer, end_id), "tokens"))
