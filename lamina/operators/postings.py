"""A stored text index: postings of term, row and count, read by term.

Postings stand in segments, one for each batch of rows that was added, and within a segment in
buckets by a checksum of the term, sorted by term. A search reads only its terms' buckets and, by
the files' statistics, only the row groups with the terms. Rows that come again supersede their
older postings, and rows may be removed: either writes the rows and the segment since which their
older postings are dead, which a search leaves out. ``compacted`` rewrites all segments as one.

A row with a null or empty text, or with stop words alone, has no postings and is not found.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import text
from lamina.sources.snapshots import Snapshots


def query_terms(query: str) -> list[str]:
    """Distinct terms of a query; stop words and words that are no lexemes fall out as they do in texts."""
    return [t for t in dict.fromkeys(query.lower().split()) if t not in text.STOP_WORDS]


def _within(rows: DataFrame, within: DataFrame | None) -> DataFrame:
    return rows if within is None else rows.join(within, within.columns, "left_semi")


class TextIndex:
    """The index of a column over rows that ``keys`` tell apart."""

    def __init__(self, store: Snapshots, keys: Sequence[str], name: str = "text", buckets: int = 64):
        self.store, self.keys, self.name, self.buckets = store, list(keys), name, buckets

    def _tables(self) -> tuple[str, str, str]:
        return f"{self.name}_postings", f"{self.name}_rows", f"{self.name}_dead"

    def _last(self) -> int:
        return self.store.manifest()["marks"].get(self.name, -1)

    def _slot(self, term, segment):
        bucket = F.pmod(F.crc32(term), F.lit(self.buckets)).cast("string")
        return F.concat(F.format_string("%06d-", segment), F.lpad(bucket, 4, "0"))  # a segment is one literal, so only the bucket is written for each posting

    def _postings(self, rows: DataFrame, column: str, segment: int) -> DataFrame:
        """Terms of each row with their counts, from runs of equal terms in order, so that counting needs no shuffle.

        A generator of one element keeps the ordered terms and the places where runs begin as columns;
        the optimizer would work them out anew for every term. A run ends where the next begins.
        """

        def with_begins(terms):
            begins = F.filter(F.sequence(F.lit(0), F.size(terms) - 1), lambda i: (i == 0) | (F.get(terms, i) != F.get(terms, i - 1)))
            return F.struct(terms.alias("terms"), F.when(F.size(terms) > 0, begins).alias("begins"))

        kept = rows.select(*self.keys, F.explode(F.array(text.let(F.sort_array(text.tokens(F.col(column))), with_begins))).alias("kept"))
        runs = kept.select(*self.keys, F.col("kept.terms").alias("terms"), F.col("kept.begins").alias("begins"), F.posexplode("kept.begins").alias("run", "begin"))
        n = F.coalesce(F.get("begins", F.col("run") + 1), F.size("terms")) - F.col("begin")
        return self._laid_out(runs.select(*self.keys, F.get("terms", F.col("begin")).alias("term"), n.alias("n"), F.lit(segment).alias("segment")))

    def _laid_out(self, postings: DataFrame) -> DataFrame:
        """Few files a bucket, each sorted by term; a bucket with a term that every text has is split by size."""
        return postings.withColumn("slot", self._slot(F.col("term"), F.col("segment"))).hint("rebalance", "slot").sortWithinPartitions("slot", "term")

    def _publish(self, postings: DataFrame, rows: DataFrame, dead: DataFrame, segment: int, whole: bool = False) -> None:
        tables = self._tables()
        base = self.store.version()
        stage = self.store.stage(dict(zip(tables, (postings, rows, dead), strict=True)), dict(zip(tables, ("slot", "segment", "by_segment"), strict=True)), base)
        self.store.publish(stage, {} if whole else {t: [] for t in tables}, {self.name: segment})

    def add(self, rows: DataFrame, column: str = "text") -> int:
        """Index rows, in a segment of their own; those indexed before are superseded. Returns the segment.

        The rows are worked out up to three times, so what is costly to work out should be stored first.
        """
        segment = self._last() + 1
        ids = rows.select(*self.keys, F.lit(segment).alias("segment"))
        self._publish(self._postings(rows, column, segment), ids, self._superseded(rows, segment), segment)
        return segment

    def remove(self, rows: DataFrame) -> int:
        """Rows that are not to be found any more."""
        segment = self._last() + 1
        postings, known, _ = (self.store.read(t).limit(0) for t in self._tables())
        self._publish(postings, known, rows.select(*self.keys, F.lit(segment).alias("by_segment")), segment)
        return segment

    def _superseded(self, rows: DataFrame, segment: int) -> DataFrame:
        """Those of the rows that were indexed before. A row given twice may stand here twice, which no join for what is not dead minds."""
        ids = rows.select(*self.keys)
        if segment:
            ids = ids.join(self.store.read(self._tables()[1]).select(*self.keys), self.keys, "left_semi")
        return (ids if segment else ids.limit(0)).select(*self.keys, F.lit(segment).alias("by_segment"))

    def _live(self, postings: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """Without those of an earlier segment than one that superseded or removed their row."""
        if self._last() <= 0:
            return postings
        dead = _within(self.store.read(self._tables()[2]), within).alias("dead")
        same = F.col("kept.segment") < F.col("dead.by_segment")
        for key in self.keys:
            same &= F.col(f"kept.{key}") == F.col(f"dead.{key}")
        return postings.alias("kept").join(dead, same, "left_anti")

    def compacted(self) -> None:
        """All segments as one, without what is dead."""
        segment = self._last() + 1
        postings = self._live(self.store.read(self._tables()[0])).drop("slot").withColumn("segment", F.lit(segment))
        rows = self._live(self.store.read(self._tables()[1])).withColumn("segment", F.lit(segment))
        dead = self.store.read(self._tables()[2]).limit(0)
        self._publish(self._laid_out(postings), rows, dead, segment, whole=True)

    def _found(self, terms: Sequence[str]) -> DataFrame:
        """Postings of some terms, dead ones too; no other bucket is read."""
        wanted = {f"{zlib.crc32(t.encode()) % self.buckets:04d}" for t in terms}
        return self.store.read(self._tables()[0], only=lambda slot: slot[-4:] in wanted).filter(F.col("term").isin(list(terms)))

    def postings_of(self, terms: Sequence[str]) -> DataFrame:
        """Postings of some terms, of rows as they are now; no other bucket is read."""
        return self._live(self._found(terms))

    def matches(self, query: str, within: DataFrame | None = None) -> DataFrame:
        """Keys and rank_score of rows that have every term of the query; a query without terms finds nothing.

        ``within`` holds values of some of the keys: no other rows are looked at. What a row has alive stands in one segment, so a row is one group, and only groups with every term are held against what is dead.
        """
        terms = query_terms(query)
        times = [F.sum(F.when(F.col("term") == t, F.col("n"))).alias(f"n{i}") for i, t in enumerate(terms)]  # a row's keys may have been given twice
        counted = _within(self._found(terms), within).groupBy(*self.keys, "segment").agg(F.count("*").alias("n_postings"), *times)
        every = F.lit(bool(terms))
        for i in range(len(terms)):
            every &= F.col(f"n{i}").isNotNull()
        rank = F.round(sum((F.log(1.0 + F.col(f"n{i}")) for i in range(len(terms))), F.lit(0.0)), 6)
        return self._live(counted.filter(every), within).select(*self.keys, rank.alias("rank_score"))
