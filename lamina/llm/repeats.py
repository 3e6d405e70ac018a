"""Repeated windows across documents: what the two substring operators share.

Every window of ``window`` symbols (bytes or words) is assigned to its anchor, the smallest k-gram
in it. Windows that are equal have equal anchors, so documents need to meet only by anchor.

First only short prints of anchors travel, to find the anchors of more than one document; a print
that stands for two anchors just keeps more. Then the documents that have such anchors are cut
into runs of windows with one anchor, and each run goes, with the symbols around it, to the shard
of its anchor. The shard builds its index and answers, for each window, which is the smallest
document that has it. A symbol is removed if a window over it also starts in a document with a
smaller id.

Prints that one map task has for several documents are answered there, and it sends one of them;
so are runs with the same symbols, of which it sends the smallest document's. So a passage in a
third of all rows costs a shard one row per map task. Shards are in proportion to the input.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import seqs
from lamina.llm.common import keyed, shard_count

#: Bytes of text handled at once, and gathered before prints or runs are sent.
PIECE, FLUSH_PRINTS, FLUSH = 1 << 20, 24 << 20, 12 << 20
#: Symbols of an anchor.
GRAM = {"byte": 16, "word": 4}
FIELDS = (("print", np.uint32), ("key", np.int64), ("late", np.int64), ("start", np.int64), ("size", np.uint32), ("lead", np.uint8), ("windows", np.uint8))


def by_byte(x: np.ndarray) -> bytes:
    """Values by significance of their bytes, which compress better so."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def pack(runs: dict[str, np.ndarray], symbols: np.ndarray) -> bytes:
    """Runs and the bytes around them as one compressed value; keys and prints travel as differences."""
    parts = []
    for name, kind in FIELDS:
        x = np.ascontiguousarray(runs[name].astype(kind))
        parts.append(by_byte(np.diff(x, prepend=kind(0)) if name in ("key", "print") else x))
    return zstandard.compress(struct.pack("<q", len(runs["key"])) + b"".join(parts) + symbols.tobytes(), 3)


def unpack(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    body = zstandard.decompress(blob)
    n, at, runs = struct.unpack_from("<q", body)[0], 8, {}
    for name, kind in FIELDS:
        wide = np.dtype(kind).itemsize
        x = np.ascontiguousarray(np.frombuffer(body, np.uint8, n * wide, at).reshape(wide, n).T).view(kind).ravel()
        runs[name] = np.cumsum(x, dtype=kind) if name in ("key", "print") else x
        at += n * wide
    return runs, np.frombuffer(body, np.uint8, offset=at)


def print_of(anchor: np.ndarray, shards: int) -> np.ndarray:
    """What an anchor is known by within its shard."""
    return (anchor // np.uint64(shards) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def byte_runs(texts: list[bytes], window: int, k: int = GRAM["byte"]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Runs of byte windows; ``at`` and ``size`` give the bytes around a run in the buffer."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    grams = seqs.byte_grams(buf, k)
    text, start, count, place = seqs.anchors(grams, k, window, first)
    return {"text": text, "at": start, "start": start - first[text], "size": count + window - 1, "lead": place - start, "windows": count, "anchor": grams[place]}, buf


def word_runs(texts: list[bytes], window: int, k: int = GRAM["word"]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Runs of word windows; ``start`` and ``windows`` count words, ``at`` and ``size`` bytes of the joined words."""
    buf, begin, end, first = seqs.split_words(texts)
    grams = seqs.shingles(seqs.span_hashes(buf, begin, end), k)
    text, start, count, place = seqs.anchors(grams, k, window, first)
    last = end[start + count + window - 2] if len(start) else start
    return {"text": text, "at": begin[start], "start": start - first[text], "size": last - begin[start], "lead": place - start, "windows": count, "anchor": grams[place]}, buf


def pieces(data: np.ndarray, offsets: np.ndarray, cut: Callable[[bytes], list[tuple[int, bytes]]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows in lots of bounded bytes: (row, symbols before the piece, bytes); long rows come in pieces."""
    for i, j in seqs.slices(offsets, PIECE):
        if offsets[j] - offsets[i] <= 4 * PIECE:
            yield [(r, 0, data[offsets[r] : offsets[r + 1]].tobytes()) for r in range(i, j)]
        else:
            for before, part in cut(data[offsets[i] : offsets[j]].tobytes()):
                yield [(i, before, part)]


def byte_pieces(window: int) -> Callable[[bytes], list[tuple[int, bytes]]]:
    """Cut a long text so that each window is in one piece."""
    return lambda text: [(i, text[i : i + PIECE + window - 1]) for i in range(0, len(text), PIECE)]


def word_pieces(window: int) -> Callable[[bytes], list[tuple[int, bytes]]]:
    def cut(text: bytes) -> list[tuple[int, bytes]]:
        words, step = text.split(), PIECE // 8
        return [(i, b" ".join(words[i : i + step + window - 1])) for i in range(0, len(words), step)]

    return cut


PRINTS = "shard int, settled boolean, body binary"
SEEN = "row_key long, place int"


def bounds(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))


def to_rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    shard, settled, body = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(settled, pa.bool_()), pa.array(body, pa.binary())], ["shard", "settled", "body"])


def several(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each run of equal values of group, whether it has more than one order."""
    at = bounds(group)[:-1]
    return np.minimum.reduceat(order, at) < np.maximum.reduceat(order, at)


def print_sender(shards: int, window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map side of the first step: (row_key, row_order, text) to packed prints of anchors by shard."""
    find, cut = (byte_runs, byte_pieces(window)) if unit == "byte" else (word_runs, word_pieces(window))

    def flush(lots: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        anchor, key, order, place = (np.concatenate(x) for x in zip(*lots, strict=True))
        by = np.argsort(anchor, kind="stable")
        anchor, key, order, place = anchor[by], key[by], order[by], place[by]
        at = bounds(anchor)
        known = several(anchor, order)
        repeated = np.repeat(known, np.diff(at))
        rows: list[tuple[int, bool, bytes]] = []
        if known.any():
            home = (seqs.mix(key[repeated].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            sort = np.argsort(home, kind="stable")
            home, k, p = home[sort], key[repeated][sort], place[repeated][sort]
            for a, b in zip(bounds(home)[:-1], bounds(home)[1:], strict=True):
                rows.append((int(home[a]), True, zstandard.compress(np.stack([k[a:b], p[a:b]]).tobytes(), 1)))
        # one row for each anchor of several documents, and all rows of the others
        keep = ~repeated
        keep[at[:-1]] = True
        anchor, key, order, place, flag = anchor[keep], key[keep], order[keep], place[keep], repeated[keep]
        shard, rest = (anchor % np.uint64(shards)).astype(np.int64), print_of(anchor, shards)
        sort = np.lexsort((rest, shard))
        shard = shard[sort]
        for a, b in zip(bounds(shard)[:-1], bounds(shard)[1:], strict=True):
            part = sort[a:b]
            keys, local = np.unique(key[part], return_inverse=True)
            late = np.zeros(len(keys), np.int64)
            late[local] = order[part] - key[part]
            body = struct.pack("<qq", len(part), len(keys)) + np.diff(keys, prepend=0).tobytes() + late.tobytes() + np.diff(rest[part], prepend=np.uint32(0)).tobytes() + local.astype(np.uint32).tobytes() + place[part].astype(np.uint32).tobytes() + np.packbits(flag[part]).tobytes()
            rows.append((int(shard[a]), False, zstandard.compress(planes(body), 1)))
        yield to_rows(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            keys, orders = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = seqs.utf8_column(batch.column(2))
            for lot in pieces(data, offsets, cut):
                runs, _ = find([x[2] for x in lot], window)
                held += sum(len(x[2]) for x in lot)
                if len(runs["text"]):
                    row = np.array([x[0] for x in lot], np.int64)[runs["text"]]
                    place = runs["start"] + runs["lead"] + np.array([x[1] for x in lot], np.int64)[runs["text"]]
                    lots.append([runs["anchor"], keys[row], orders[row], place])
                if held >= FLUSH_PRINTS and lots:
                    yield from flush(lots)
                    lots, held = [], 0
        if lots:
            yield from flush(lots)

    return send


def planes(body: bytes) -> bytes:
    """Bytes of 4-byte values by significance, which compress better; turned back by unplanes."""
    body += bytes(-len(body) % 4)
    return np.frombuffer(body, np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(body: bytes) -> bytes:
    return np.frombuffer(body, np.uint8).reshape(4, -1).T.tobytes()


def print_answer(table: pa.Table) -> pa.Table:
    """The reduce side of the first step: the places whose anchor more than one document has."""
    keys, places, lots = [], [], []
    for settled, body in zip(table.column("settled").to_pylist(), table.column("body"), strict=True):
        body = zstandard.decompress(body.as_py())
        if settled:
            k, p = np.frombuffer(body, np.int64).reshape(2, -1)
            keys.append(k)
            places.append(p)
            continue
        body = unplanes(body)
        n, m = struct.unpack_from("<qq", body)
        row_keys = np.cumsum(np.frombuffer(body, np.int64, m, 16))
        late = np.frombuffer(body, np.int64, m, 16 + 8 * m)
        rest, local, place = np.frombuffer(body, np.uint32, 3 * n, 16 + 16 * m).reshape(3, n)
        flag = np.unpackbits(np.frombuffer(body, np.uint8, offset=16 + 16 * m + 12 * n))[:n].astype(bool)
        lots.append((np.cumsum(rest, dtype=np.uint32), row_keys[local], (row_keys + late)[local], place.astype(np.int64), flag))
    if lots:
        rest, key, order, place, flag = (np.concatenate(x) for x in zip(*lots, strict=True))
        by = np.argsort(rest, kind="stable")
        at = bounds(rest[by])
        hit = several(rest[by], order[by]) | np.logical_or.reduceat(flag[by], at[:-1])
        chosen = by[np.repeat(hit, np.diff(at)) & ~flag[by]]
        keys.append(key[chosen])
        places.append(place[chosen])
    none = [np.zeros(0, np.int64)]
    return pa.Table.from_arrays([pa.array(np.concatenate(none + keys)), pa.array(np.concatenate(none + places).astype(np.int32))], ["row_key", "place"])


SENT = "shard int, settled boolean, body binary"
FOUND = "row_key long, first long, last long"


def sender(shards: int, window: int, unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The map side of the second step: (row_key, row_order, doc_id, text, places) to packed runs by shard."""
    find, cut = (byte_runs, byte_pieces(window)) if unit == "byte" else (word_runs, word_pieces(window))

    def flush(lots: list[tuple[dict[str, np.ndarray], np.ndarray]]) -> Iterator[pa.RecordBatch]:
        runs = {name: np.concatenate([x[name] for x, _ in lots]) for name in lots[0][0]}
        symbols = np.concatenate([x for _, x in lots])
        at = np.cumsum(runs["size"]) - runs["size"]
        order = np.lexsort((runs["key"], runs["order"], runs["whole"], runs["anchor"]))
        same = (runs["anchor"][order][1:] == runs["anchor"][order][:-1]) & (runs["whole"][order][1:] == runs["whole"][order][:-1])
        lead = np.concatenate(([True], ~same))
        least = runs["order"][order][lead][np.cumsum(lead) - 1]
        # later rows with a larger id are repeats for certain; rows with the same id are not
        done = runs["order"][order] > least
        keep, gone = order[~done], order[done]
        shard = (runs["anchor"] % np.uint64(shards)).astype(np.int64)
        runs["print"] = print_of(runs["anchor"], shards)
        keep = keep[np.lexsort((runs["print"][keep], shard[keep]))]
        cuts = bounds(shard[keep])
        rows: list[tuple[int, bool, bytes]] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = keep[a:b]
            body = pack({name: runs[name][part] for name, _ in FIELDS}, seqs.gather(symbols, at[part], runs["size"][part]))
            rows.append((int(shard[part[0]]), False, body))
        if len(gone):
            gone = gone[np.lexsort((runs["start"][gone], runs["key"][gone]))]
            found = merged(runs["key"][gone], runs["start"][gone], runs["start"][gone] + runs["windows"][gone] + window - 1)
            home = (seqs.mix(found[0].astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            for s in np.unique(home):
                rows.append((int(s), True, zstandard.compress(by_byte(np.stack([x[home == s] for x in found]).ravel()), 1)))
        yield to_rows(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lots: list[tuple[dict[str, np.ndarray], np.ndarray]] = []
        held = 0
        for batch in batches:
            keys, orders = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            data, offsets = seqs.utf8_column(batch.column(3))
            places = batch.column(4)
            row_of = np.repeat(np.arange(len(batch)), np.diff(np.asarray(places.offsets)))
            wanted = np.sort(row_of << 40 | places.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
            for lot in pieces(data, offsets, cut):
                runs, buf = find([x[2] for x in lot], window)
                held += sum(len(x[2]) for x in lot)
                row = np.array([x[0] for x in lot], np.int64)[runs["text"]]
                runs["start"] = runs["start"] + np.array([x[1] for x in lot], np.int64)[runs["text"]]
                mark = row << 40 | (runs["start"] + runs["lead"])
                chosen = wanted[np.minimum(np.searchsorted(wanted, mark), len(wanted) - 1)] == mark
                if chosen.any():
                    row, runs = row[chosen], {name: x[chosen] for name, x in runs.items()}
                    runs["key"], runs["order"] = keys[row], orders[row]
                    runs["late"] = runs["order"] - runs["key"]
                    symbols = seqs.gather(buf, runs["at"], runs["size"])
                    stop = np.cumsum(runs["size"])
                    runs["whole"] = seqs.span_hashes(symbols, stop - runs["size"], stop)
                    lots.append(({n: runs[n] for n in ("anchor", "key", "order", "late", "start", "size", "lead", "windows", "whole")}, symbols))
                if held >= FLUSH and lots:
                    yield from flush(lots)
                    lots, held = [], 0
        if lots:
            yield from flush(lots)

    return send


def merged(key: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of a key as one; input ordered by key and start."""
    if not len(key):
        return key, start, end
    group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide)
    cut = np.concatenate(([True], (start[1:] + group[1:] * wide > reach[:-1])))
    at = np.flatnonzero(cut)
    return key[at], start[at], np.maximum.reduceat(end, at)


def shard_answer(window: int, least_of: Callable[[dict[str, np.ndarray], list[np.ndarray] | np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """The reduce side: least_of(contexts, symbols) returns the smallest document of every window of the distinct contexts, context after context."""

    def answer(table: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        lots = []
        for settled, body in zip(table.column("settled").to_pylist(), table.column("body"), strict=True):
            if settled:
                flat = np.frombuffer(zstandard.decompress(body.as_py()), np.uint8)
                found.append(tuple(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.int64).reshape(3, -1)))
            else:
                lots.append(unpack(body.as_py()))
        if lots:
            runs = {name: np.concatenate([x[name] for x, _ in lots]) for name in lots[0][0]}
            symbols = np.concatenate([x for _, x in lots])
            del lots
            runs, symbols = shared(runs, symbols)
            if len(runs["key"]):
                found.append(covered(runs, symbols))
        if not found:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 3, ["row_key", "first", "last"])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["row_key", "first", "last"])

    def shared(runs: dict[str, np.ndarray], symbols: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Without the anchors that only one document has."""
        runs["at"] = np.cumsum(runs["size"].astype(np.int64)) - runs["size"]
        order = np.argsort(runs["print"], kind="stable")
        a, doc = runs["print"][order], (runs["key"] + runs["late"])[order]
        keep = order[np.repeat(several(a, doc), np.diff(bounds(a)))]
        out = {n: x[keep] for n, x in runs.items()}
        symbols = seqs.gather(symbols, out["at"], out["size"].astype(np.int64))
        out["at"] = np.cumsum(out["size"].astype(np.int64)) - out["size"]
        return out, symbols

    def covered(runs: dict[str, np.ndarray], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size, windows, order = runs["size"].astype(np.int64), runs["windows"].astype(np.int64), runs["key"] + runs["late"]
        whole = seqs.span_hashes(symbols, runs["at"], runs["at"] + size)
        by = np.lexsort((order, whole, runs["print"]))
        lead = np.concatenate(([True], (whole[by][1:] != whole[by][:-1]) | (runs["print"][by][1:] != runs["print"][by][:-1])))
        rep = by[lead]  # the smallest document of each distinct context
        of = np.empty(len(by), np.int64)
        of[by] = np.cumsum(lead) - 1
        least = least_of({"at": runs["at"][rep], "size": size[rep], "lead": runs["lead"][rep].astype(np.int64), "windows": windows[rep], "order": order[rep]}, symbols)
        base = np.cumsum(windows[rep]) - windows[rep]
        each = np.repeat(np.arange(len(of)), windows)
        within = np.arange(len(each)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = least[base[of[each]] + within] < order[each]
        each, start = each[hit], (runs["start"][each] + within)[hit]
        by = np.lexsort((start, runs["key"][each]))
        return merged(runs["key"][each][by], start[by], start[by] + window)

    return answer


def repeated(rows: DataFrame, window: int, unit: str, least_of: Callable, shards: int) -> DataFrame:
    """(row_key, first, last): ranges, in bytes or words, to remove from keyed documents; ranges of a row may overlap."""
    prints = rows.select("row_key", "row_order", "text").mapInArrow(print_sender(shards, window, unit), PRINTS)
    seen = prints.groupBy("shard").applyInArrow(print_answer, SEEN).groupBy("row_key").agg(F.collect_list("place").alias("places"))
    sent = rows.join(seen, "row_key").select("row_key", "row_order", "doc_id", "text", "places").mapInArrow(sender(shards, window, unit), SENT)
    return sent.groupBy("shard").applyInArrow(shard_answer(window, least_of), FOUND)


def remover(unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row_key, row_order, doc_id, text, ranges) to counts and the digest of what is kept."""

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(3))
            ranges = batch.column(4)
            at = np.asarray(ranges.offsets)
            flat = ranges.flatten()  # starts with the first row's own values
            first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            lengths = np.diff(at) * np.asarray(ranges.is_valid())
            at = np.concatenate(([0], np.cumsum(lengths)))
            n, gone, spans, digest, left = [], [], [], [], []
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                a, b = first[at[i] : at[i + 1]], last[at[i] : at[i + 1]]
                by = np.argsort(a, kind="stable")
                _, a, b = merged(np.zeros(len(a), np.int64), a[by], b[by])
                total, removed = len(text), int((b - a).sum()) if len(a) else 0
                if unit == "byte":
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), len(text)] if len(a) else [0, len(text)]
                    kept = b"".join(text[edges[j] : edges[j + 1]] for j in range(0, len(edges), 2))
                else:
                    words = text.split()
                    total = len(words)
                    edges = [0, *np.stack([a, b], 1).ravel().tolist(), total] if len(a) else [0, total]
                    kept = b" ".join(w for j in range(0, len(edges), 2) for w in words[edges[j] : edges[j + 1]])
                n.append(total)
                gone.append(removed)
                spans.append(len(a))
                digest.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"])

    return remove


def removal_ranges(docs: DataFrame, window: int, unit: str, least_of: Callable, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_key, row_order, doc_id, text, ranges array<struct<first,last>>): every document with what it loses (null: nothing).

    Both joins read the same columns of the documents, so their shuffle is done once.
    """
    if not GRAM[unit] <= window < GRAM[unit] + 255:
        raise ValueError(f"a window has from {GRAM[unit]} to {GRAM[unit] + 254} {unit}s")  # places in a run travel as bytes
    rows = keyed(docs, id_col, text_col)
    found = repeated(rows, window, unit, least_of, shards or shard_count(docs))
    ranges = found.groupBy("row_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    return rows.join(ranges, "row_key", "left").select("row_key", "row_order", "doc_id", "text", "ranges")


def removed(docs: DataFrame, window: int, unit: str, least_of: Callable, shards: int | None = None) -> DataFrame:
    """One row per document: counts and digest of what is kept."""
    ranges = removal_ranges(docs, window, unit, least_of, shards)
    return ranges.mapInArrow(remover(unit), "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")
