"""Near-duplicate classes by an exact Jaccard join on word shingles, as T-occurrence search.

A document's set is its distinct shingles; documents with the same set are one node. Two nodes
link when their sets' overlap is at least the threshold's share of their union, so each shares at
least T = ceil(threshold * its size) shingles with the other.

1. Shingles are ordered by rarity, by a count of hash slots, so every task agrees. Slots grow with
   the input up to ``MOST_SLOTS``; beyond, order among shingles rarer than a slot's share is random.
   A node's ``size - T + 1`` rarest shingles are its short lists: linked nodes meet in one of them.
2. Lists of one node go. In lists of up to ``LONG_LIST`` nodes, parity sketches (a bit for each
   shingle's slot, xor-ed) give a lower bound of two sets' difference; pairs beyond the allowed
   difference go, and the others become searches of a centre among its partners, each pair once.
   A longer list first sends each member to one centre of the list, so that its links are n, not
   n * n; members that come into one class need no more search against each other. What is left
   of a long list, members of its largest class and the others, is searched in blocks: others
   against the class and against each other. Lists with the same largest class are one group.
3. In a search group, DivideSkip: a query's short inverted lists are merged to counts; candidates
   that reach T less the number of long lists are probed in the long ones by binary search. A
   candidate that is in the query's class already is skipped; just a spanning forest of the links
   found leaves the task. Groups are cut to blocks before texts are copied to them.
4. Links become classes by label propagation with pointer jumping, in written tables.

The two ways of 2 find the same links: LONG_LIST and BLOCK bound what a task holds, not what is found.

Results: one row per document. Null or empty texts have no shingles and link with nothing; a null
id counts as larger than all others; repeated rows have the same set; extra columns, of whatever
names, are kept by ``one_of_each`` and left out of the classes. A task holds a text's shingles, 8
bytes for each word, while it works on it.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm import seqs
from lamina.llm.common import NULL_ORDER, dropped, keyed, keyed_rows, scan_partitions, shard_count, slim, written
from lamina.llm.repeats import bounds, by_byte, to_rows

SHINGLE, PERCENT = 4, 85
#: Bytes handled at once and gathered before sending; members of a list whose pairs are compared at once, of a block of a search group, and seats in a bucket of groups.
PIECE, FLUSH, LONG_LIST, BLOCK, SEATS = 1 << 20, 24 << 20, 48, 128, 2048
#: Slots of the rarity count at least and at most, partitions of the input for the least, slots sent together, and tasks summed together.
SLOTS, MOST_SLOTS, SLOT_PARTS, SLICE, TASKS = 1 << 18, 1 << 22, 32, 1 << 14, 256
#: Tasks that the rows of one list, centre or class are dealt to where they get its facts.
SALTS = 16
#: DivideSkip's weight of long lists (a fixed value of the published method).
MU = 0.0085
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_FOLD = bytes.maketrans(_UPPER, _LOWER)


def need(size: int, percent: int) -> int:
    """T: shingles a set of this size shares with any set it links to."""
    return -(-size * percent // 100)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles, ascending; with fewer than k words the whole sequence as one."""
    buf, start, end, first = seqs.split_words([t.translate(_FOLD) for t in texts])
    words = seqs.span_hashes(buf, start, end)
    grams = seqs.shingles(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
        elif b > a:
            out.append(seqs.mix(seqs.shingles(words[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def signature(own: np.ndarray) -> int:
    """64 bits that equal sets share."""
    with np.errstate(over="ignore"):
        total = np.add.reduce(seqs.mix(own ^ np.uint64(0x5851F42D4C957F2D)))
    return int(seqs.mix(np.array([total + np.uint64(len(own))]))[0].view(np.int64))


def parity(own: np.ndarray) -> bytes:
    """A sketch of about as many bits as shingles: slots hit an odd number of times."""
    width = 1 << max(6, (len(own) - 1).bit_length())
    slot = (own >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=width) & 1).astype(np.uint8).tobytes()


def narrowed(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches (rows of bytes) folded to a smaller width."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


DESCRIBED = "row_key long, row_order long, doc_id long, n_shingles long, node long, sketch binary, slots binary"


def slot_count(partitions: int) -> int:
    return min(MOST_SLOTS, SLOTS << max(0, -(-partitions // SLOT_PARTS) - 1).bit_length())


def describer(k: int, slots: int):
    """Documents to their size, node and sketch; last, each task's counts of slots, in slices."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        names = [x.split()[0] for x in DESCRIBED.split(", ")]
        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(3))
            size, node, sketch = [], [], []
            for i, j in seqs.slices(offsets, PIECE):
                sets = shingle_sets([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)], k)
                np.add.at(counts, (np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), 1)
                size += [len(s) for s in sets]
                node += [signature(s) if len(s) else None for s in sets]
                sketch += [parity(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(sketch, pa.binary()), pa.nulls(len(batch), pa.binary())], names)
        n, task = slots // SLICE, TaskContext.get().partitionId()
        nulls = pa.nulls(n, pa.int64())
        bodies = [zstandard.compress(by_byte(x), 1) for x in counts.reshape(n, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), nulls, pa.array([task // TASKS] * n, pa.int64()), nulls, nulls, pa.nulls(n, pa.binary()), pa.array(bodies, pa.binary())], names)

    return describe


def rarity(described: DataFrame, slots: int) -> np.ndarray:
    """Counts of slots over all documents: a table of bounded size, summed by tasks and then by groups of them."""

    def counted(body: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(zstandard.decompress(body), np.uint8).reshape(8, -1).T).view(np.int64).ravel()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLICE, np.int64)
        for body in table.column("slots"):
            total += counted(body.as_py())
        return pa.Table.from_arrays([table.column("row_key")[:1].combine_chunks(), pa.array([zstandard.compress(by_byte(total), 1)], pa.binary())], ["row_key", "slots"])

    slices = described.filter("row_order is null and slots is not null").select("row_key", "doc_id", "slots")
    for keys in (["row_key", "doc_id"], ["row_key"]):
        slices = slices.groupBy(*keys).applyInArrow(add, "row_key long, slots binary")
    out = np.zeros(slots, np.int64)
    for r in slices.collect():
        out[r.row_key * SLICE : (r.row_key + 1) * SLICE] = counted(r.slots)
    return out


def rarest(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The short lists of a set."""
    order = np.lexsort((own, counts[(own & np.uint64(len(counts) - 1)).astype(np.int64)]))
    return own[order[: len(own) - need(len(own), percent) + 1]]


def list_sender(shards: int, k: int, percent: int, counts):
    """Documents to packed entries of their short lists, by shard; a node once for each flush."""

    def flush(nodes: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys = np.array(list(nodes), np.int64)
        sizes = np.array([n for n, _ in nodes.values()], np.int64)
        token = np.concatenate([t for _, t in nodes.values()])
        owner = np.repeat(np.arange(len(keys)), [len(t) for _, t in nodes.values()])
        shard = (token % np.uint64(shards)).astype(np.int64)
        rest = (token // np.uint64(shards) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        by = np.lexsort((rest, shard))
        cuts, rows = bounds(shard[by]), []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = by[a:b]
            own, local = np.unique(owner[part], return_inverse=True)
            body = struct.pack("<qq", len(part), len(own)) + keys[own].tobytes() + by_byte(sizes[own].astype(np.uint32)) + by_byte(np.diff(rest[part], prepend=np.uint32(0))) + by_byte(local.astype(np.uint32))
            rows.append((int(shard[part[0]]), False, zstandard.compress(body, 1)))
        yield to_rows(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: dict[int, tuple[int, np.ndarray]] = {}
        held = 0
        for batch in batches:
            data, offsets = seqs.utf8_column(batch.column(0))
            for i, j in seqs.slices(offsets, PIECE):
                for own in shingle_sets([data[offsets[r] : offsets[r + 1]].tobytes() for r in range(i, j)], k):
                    if len(own) and (node := signature(own)) not in nodes:
                        nodes[node] = (len(own), rarest(own, counts.value, percent))
                held += int(offsets[j] - offsets[i])
                if held >= FLUSH and nodes:
                    yield from flush(nodes)
                    nodes, held = {}, 0
        if nodes:
            yield from flush(nodes)

    return send


def list_members(percent: int):
    """A shard's entries to the members of lists that a pair of fitting sizes is in, with their number and a centre (of middle size)."""

    def members(table: pa.Table) -> pa.Table:
        lots = []
        for body in table.column("body"):
            body = zstandard.decompress(body.as_py())
            n, m = struct.unpack_from("<qq", body)
            keys = np.frombuffer(body, np.int64, m, 16)

            def wide(count: int, at: int, body: bytes = body) -> np.ndarray:
                return np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * count, at).reshape(4, count).T).view(np.uint32).ravel()

            at = 16 + 8 * m
            sizes, rest, local = wide(m, at), wide(n, at + 4 * m), wide(n, at + 4 * m + 4 * n)
            lots.append((np.cumsum(rest, dtype=np.uint32), keys[local], sizes[local].astype(np.int64)))
        rest, node, size = (np.concatenate(x) for x in zip(*lots, strict=True))
        by = np.lexsort((node, size, rest))
        rest, node, size = rest[by], node[by], size[by]
        new = np.concatenate(([True], (rest[1:] != rest[:-1]) | (node[1:] != node[:-1])))
        rest, node, size = rest[new], node[new], size[new]
        fits = (rest[1:] == rest[:-1]) & (size[:-1] * 100 >= size[1:] * percent)
        keep = np.concatenate((fits, [False])) | np.concatenate(([False], fits))
        shard = np.int64(table.column("shard")[0].as_py())
        rest, node = rest[keep], node[keep]
        cuts = bounds(rest) if len(rest) else np.zeros(1, np.int64)
        length = np.diff(cuts)
        centre = np.repeat(node[cuts[:-1] + length // 2], length)
        return pa.Table.from_arrays([pa.array(shard << 32 | rest.astype(np.int64)), pa.array(node), pa.array(np.repeat(length, length)), pa.array(centre)], ["list", "node", "n", "centre"])

    return members


def meetings(percent: int):
    """Lists with their members' sizes and sketches to pairs, a centre and a partner."""

    def folded(rows: list[np.ndarray], width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint8)
        by_width: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_width.setdefault(len(r), []).append(i)
        for own in by_width.values():
            out[own] = narrowed(np.stack([rows[i] for i in own]), width)
        return out

    def meet(table: pa.Table) -> pa.Table:
        lists, node, size = (table.column(c).to_numpy() for c in ("list", "node", "n_shingles"))
        by = np.lexsort((node, size, lists))
        lists, node, size = lists[by], node[by], size[by]
        left, right = [], []
        for d in range(1, LONG_LIST):
            i = np.flatnonzero(lists[d:] == lists[:-d])
            if not len(i):
                break
            i = i[size[i] * 100 >= size[i + d] * percent]
            left.append(i)
            right.append(i + d)
        pairs = np.zeros((0, 2), np.int64)
        if left:
            x, y = np.concatenate(left), np.concatenate(right)
            _, once = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1), axis=0, return_index=True)
            x, y = x[once], y[once]
            raw = table.column("sketch").combine_chunks()
            sketch = {int(i): np.frombuffer(raw[int(by[i])].as_py(), np.uint8) for i in np.unique(np.concatenate((x, y)))}
            wide = np.array([[len(sketch[i]), len(sketch[j])] for i, j in zip(x.tolist(), y.tolist(), strict=True)]).reshape(-1, 2).min(1)
            ok = np.zeros(len(x), bool)
            for w in np.unique(wide):
                for at in np.array_split(np.flatnonzero(wide == w), max(1, int((wide == w).sum() * w) >> 23)):
                    one, two = (folded([sketch[i] for i in z[at].tolist()], int(w)) for z in (x, y))
                    gap = np.bitwise_count(one ^ two).sum(1, dtype=np.int64)
                    # |A - B| + |B - A| <= (1 - t) / (1 + t) * (|A| + |B|)
                    ok[at] = gap * (100 + percent) <= (100 - percent) * (size[x[at]] + size[y[at]])
            pairs = np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])], 1)[ok]
        return pa.Table.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["centre", "node"])

    return meet


class Classes:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def roots(self) -> np.ndarray:
        p = self.parent
        while not np.array_equal(p, p[p]):
            p = p[p]
        self.parent = p
        return p


def divide_skip(sets: list[np.ndarray], queries: range | list[int], percent: int) -> list[tuple[int, int]]:
    """Links of queries with sets of smaller number, less those within a class that links found before join."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    wide = np.int64(len(sets))
    entry = np.sort(token * wide + owner)  # inverted lists, one after the other, members ascending
    begin = np.searchsorted(entry, np.arange(token.max() + 1) * wide)
    member = entry % wide
    first = np.concatenate(([0], np.cumsum(sizes)))
    classes, found = Classes(len(sets)), []
    for q in queries:
        t = need(int(sizes[q]), percent)
        own = token[first[q] : first[q + 1]]
        length = np.searchsorted(entry, own * wide + q) - begin[own]  # members below the query
        there = length > 0
        if there.sum() < t:
            continue
        own, length = own[there], length[there]
        by = np.argsort(length, kind="stable")
        longest = min(t - 1, int(t / (MU * math.log2(int(length[by[-1]]) + 1) + 1)))
        short, long = by[: len(by) - longest], own[by[len(by) - longest :]]
        count = np.bincount(seqs.gather(member, begin[own[short]], length[short]), minlength=q)
        fits = (sizes[:q] * 100 >= sizes[q] * percent) & (sizes[q] * 100 >= sizes[:q] * percent)
        candidates = np.flatnonzero((count >= t - longest) & fits)
        candidates = candidates[np.argsort(-count[candidates], kind="stable")]
        lot = 4
        while len(candidates):
            now, candidates = candidates[:lot], candidates[lot:]
            lot = min(4 * lot, 512)
            probe = long[:, None] * wide + now[None, :]
            at = np.minimum(np.searchsorted(entry, probe), len(entry) - 1)
            overlap = count[now] + (entry[at] == probe).sum(0)
            for c in now[overlap * 100 >= percent * (sizes[q] + sizes[now] - overlap)].tolist():
                a, b = classes.find(q), classes.find(c)
                if a != b:
                    classes.parent[max(a, b)] = min(a, b)
                    found.append((c, int(q)))
            if len(candidates):
                roots = classes.roots()
                candidates = candidates[roots[candidates] != roots[q]]
    return found


def searcher(k: int, percent: int):
    """(group, node, part, body) of whole search groups to links."""

    def search(table: pa.Table) -> pa.Table:
        group, node = table.column("group").to_numpy(), table.column("node").to_numpy()
        part = table.column("part").to_numpy()
        bodies = table.column("body")
        distinct, where = np.unique(node, return_index=True)
        sets = dict(zip(distinct.tolist(), shingle_sets([zstandard.decompress(bodies[int(i)].as_py()) for i in where], k), strict=True))
        by = np.lexsort((node, part, group))
        links = []
        cuts = bounds(group[by])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = by[a:b]
            members = node[at].tolist()
            split = int(np.searchsorted(part[at], 1))  # part 0 is searched by part 1, and each by itself if it is alone
            queries = range(len(members)) if split in (0, len(members)) else range(split, len(members))
            links += [(members[i], members[j]) for i, j in divide_skip([sets[m] for m in members], queries, percent)]
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return search


def classes_of(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node: the smallest node of its class.

    Labels spread along links and jump to their label's label until none changes; each round is a
    written table, the one before it is deleted, and only its number of changes comes to the driver.
    """
    both = written(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        spread = written(spread, "labels")
        jump = spread.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        moved = written(spread.join(jump, spread["root"] == jump["_n"]).select("node", F.least("root", "_r").alias("root"), (F.least("root", "_r") != F.col("old")).alias("moved")), "labels")
        dropped(labels)
        dropped(spread)
        if moved.filter("moved").isEmpty():
            dropped(both)
            return moved.select("node", "root")
        labels = moved.select("node", "root")
        labels.written_at = moved.written_at


def _with_facts(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Rows with the one row of facts of their key; a key of many rows is dealt to SALTS tasks by node, its facts to each."""
    own = rows.withColumn("_salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    each = facts.withColumnRenamed(key, "_key").withColumn("_each", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return own.join(each, (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_each"))).drop("_key", "_salt", "_each")


def _star_seats(stars: DataFrame) -> DataFrame:
    """(group, node, part) of centres and partners, in blocks of partners with the centre in each."""
    blocks = stars.groupBy("centre").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    placed = _with_facts(stars, blocks, "centre").withColumn("group", F.xxhash64("centre", F.pmod(F.xxhash64("node"), F.col("n"))))
    centres = placed.select("group", F.col("centre").alias("node"), F.lit(1).alias("part")).distinct()
    return placed.select("group", "node", F.lit(0).alias("part")).union(centres)


def _long_seats(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """(group, node, part) of what is left to search in long lists: others against the largest class, and against each other.

    lists: list, node; roots: node, root of the classes so far. A list within one class is done.
    Blocks of the class are part 0 and blocks of the others part 1; of two blocks of others, the
    second is part 1, and one by itself is part 0.
    """
    roots = roots.select(F.col("node").alias("_node"), "root")
    own = lists.join(roots, F.col("node") == F.col("_node"), "left").select("list", "node", F.coalesce("root", "node").alias("root"))
    largest = own.groupBy("list", "root").count().groupBy("list").agg(F.max_by("root", F.struct("count", "root")).alias("base"), F.count("*").alias("classes"))
    largest = largest.filter("classes > 1").select("list", "base")
    placed = _with_facts(own, largest, "list").select("base", "node", (F.col("root") != F.col("base")).alias("other")).distinct()
    number = lambda of: F.ceil(F.greatest(F.count_if(of), F.lit(1)) / BLOCK).cast("int")
    sizes = placed.groupBy("base").agg(number(~F.col("other")).alias("n_base"), number(F.col("other")).alias("n_other"))
    placed = _with_facts(placed, sizes, "base")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("other"), F.col("n_other")).otherwise(F.col("n_base"))).cast("int")
    placed = placed.withColumn("block", block)
    seat = lambda kind, i, j, part: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), part.alias("part"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    base = F.transform(each("n_other"), lambda o: seat(0, F.col("block"), o, F.lit(0)))
    against = F.transform(each("n_base"), lambda c: seat(0, c, F.col("block"), F.lit(1)))
    mutual = F.transform(each("n_other"), lambda o: seat(1, F.least("block", o), F.greatest("block", o), (F.col("block") > o).cast("int")))
    placed = placed.select("base", "node", F.explode(F.when(F.col("other"), F.concat(against, mutual)).otherwise(base)).alias("s"))
    return placed.select(F.xxhash64("base", "s.kind", "s.i", "s.j").alias("group"), "node", F.col("s.part").alias("part"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_key, row_order, doc_id, n_shingles, class_id (null without shingles), component_id of every document."""
    return _near(keyed(docs, id_col, text_col), k, percent, shards or shard_count(docs))


def _near(rows: DataFrame, k: int, percent: int, shards: int) -> DataFrame:
    """near_duplicates of keyed rows."""
    spark, slots = rows.sparkSession, slot_count(scan_partitions(rows))
    described = written(rows.select("row_key", "row_order", "doc_id", "text").mapInArrow(describer(k, slots), DESCRIBED), "sets")
    counts = spark.sparkContext.broadcast(rarity(described, slots))
    own = described.filter("row_order is not null")
    nodes = own.filter("node is not null").groupBy("node").agg(F.min("row_order").alias("least"), F.min_by("row_key", F.struct("row_order", "row_key")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    nodes = written(nodes, "nodes")
    entries = rows.select("text").mapInArrow(list_sender(shards, k, percent, counts), "shard int, settled boolean, body binary")
    members = written(entries.groupBy("shard").applyInArrow(list_members(percent), "list long, node long, n long, centre long"), "lists")
    short = members.filter(F.col("n") <= LONG_LIST).select("list", "node").join(nodes.select("node", "n_shingles", "sketch"), "node")
    short = short.withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(shards)).cast("int"))
    stars = short.groupBy("bucket").applyInArrow(meetings(percent), "centre long, node long")
    long = members.filter(F.col("n") > LONG_LIST)
    stars = written(stars.union(long.filter("node <> centre").select(F.least("centre", "node"), F.greatest("centre", "node"))).distinct(), "stars")

    def searched(seats: DataFrame) -> DataFrame:
        """Links of search groups, whose nodes get their texts."""
        seats = written(seats, "seats")
        buckets = max(shards, seats.count() // SEATS)
        wanted = seats.select("node").distinct().join(nodes.select("node", "rep"), "node")
        packed = wanted.join(rows.select("row_key", "text"), F.col("rep") == F.col("row_key")).select("node", "text").mapInArrow(_pack, "node long, body binary")
        seated = seats.join(packed, "node").withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)).cast("int"))
        return written(seated.groupBy("bucket").applyInArrow(searcher(k, percent), "a long, b long"), "links")

    links = searched(_star_seats(stars))
    roots = classes_of(links)
    if not long.isEmpty():
        links = links.union(searched(_long_seats(long.select("list", "node"), roots)))
        roots = classes_of(links)
    owned = nodes.select("node", "least").join(roots, "node")
    smallest = owned.groupBy("root").agg(F.min("least").alias("component"))
    component = owned.join(smallest, "root").select("node", F.col("root").alias("class_id"), "component")
    lone = nodes.join(roots, "node", "left_anti").select("node", F.col("node").alias("class_id"), F.col("least").alias("component"))
    component = component.unionByName(lone).withColumnRenamed("node", "_node")
    out = own.join(component, F.col("node") == F.col("_node"), "left")
    component_id = F.when(F.col("component") == NULL_ORDER, F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("row_key", "row_order", "doc_id", "n_shingles", "class_id", component_id.cast("long").alias("component_id"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = seqs.utf8_column(batch.column(1))
        body = [zstandard.compress(data[offsets[r] : offsets[r + 1]].tobytes(), 3) for r in range(len(batch))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], ["node", "body"])


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document of smallest id of each class, and every document without shingles, with the columns they had.

    Of a class's documents with equal ids, one stays.
    """
    rows = keyed_rows(docs)
    found = _near(slim(rows), k, percent, shard_count(docs))
    first = found.filter("class_id is not null").groupBy("class_id").agg(F.min(F.struct("row_order", "row_key")).alias("m"))
    kept = first.select(F.col("m.row_key").alias("_kept")).union(found.filter("class_id is null").select("row_key"))
    return rows.join(kept, F.col("row_key") == F.col("_kept"), "left_semi").select("doc.*")
