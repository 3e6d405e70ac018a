"""Lists of bulletins: filters, revision folds, tags, facets, quotas and pages."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import text

#: How many bulletins of each tier a free sample shows.
SAMPLE_QUOTA = {"serious": 1, "medium": 2, "small": 3}


@dataclass
class Filters:
    """Any of these, all optional; dates are closed on both sides and drop rows without a date."""

    kind: str | None = None
    status: str | None = None
    severity: str | None = None
    since: datetime | None = None
    until: datetime | None = None

    def condition(self) -> Column:
        found = F.lit(True)
        for name, value in (("kind", self.kind), ("status", self.status), ("severity", self.severity)):
            if value is not None:
                found = found & (F.col(name) == value)
        if self.since is not None:
            found = found & (F.col("published") >= F.lit(self.since))
        if self.until is not None:
            found = found & (F.col("published") <= F.lit(self.until))
        return found


def half_open(column: str, since: datetime | None, until: datetime | None) -> Column:
    """since <= column < until, each end optional."""
    found = F.lit(True)
    if since is not None:
        found = found & (F.col(column) >= F.lit(since))
    if until is not None:
        found = found & (F.col(column) < F.lit(until))
    return found


def in_scope(rows: DataFrame, links: DataFrame, car_id: int | None) -> DataFrame:
    """Bulletins of one car, or all of them; never repeats a row."""
    return rows if car_id is None else rows.join(links.filter(F.col("car_id") == car_id).select("bulletin_id"), "bulletin_id", "left_semi")


def tagged(rows: DataFrame, papers: DataFrame, column: str, wanted: Sequence[str] | None) -> DataFrame:
    """Bulletins with a document that has any of the tags, whatever the case."""
    return rows if not wanted else rows.join(papers.filter(text.any_tag(F.col(column), wanted)).select("bulletin_id"), "bulletin_id", "left_semi")


def with_text(rows: DataFrame, papers: DataFrame, query: str) -> DataFrame:
    """Bulletins whose own summary, or one document's, has every term of the query."""
    terms = [t for t in query.lower().split() if t not in text.STOP_WORDS]
    own = rows.filter(text.matches_all(text.tokens(F.col("summary")), terms)).select("bulletin_id")
    theirs = papers.filter(text.matches_all(text.tokens(F.col("paper_summary")), terms)).select("bulletin_id")
    return rows.join(own.union(theirs), "bulletin_id", "left_semi")


def unread(mine: DataFrame, reads: DataFrame, partitions: int) -> DataFrame:
    """The distinct pairs (user_id, bulletin_id) of ``mine`` that are none of ``reads``.

    One grouping of all pairs, in so many partitions, that says whether any is a read: no side is sorted. A null
    equals nothing, so such pairs stay.
    """
    pair = ["user_id", "bulletin_id"]
    both = mine.select(*pair, F.lit(False).alias("read")).unionByName(reads.filter("user_id IS NOT NULL AND bulletin_id IS NOT NULL").select(*pair, F.lit(True).alias("read")))
    return both.repartition(partitions, *pair).groupBy(*pair).agg(F.max("read").alias("read")).filter("NOT read").select(*pair)


def unread_counts(garage: DataFrame, families: DataFrame, reads: DataFrame, since: datetime) -> DataFrame:
    """Unread families of each account's cars, all and those published after ``since``, and how many there are.

    Unread is a car's count less what the account has read of it, so no account is joined with every
    family of its cars. Reads that are dealt by account are counted where they lie, if the families
    are small enough to be broadcast.
    """
    recent = F.col("published") > F.lit(since)
    counted = families.groupBy("car_id").agg(F.count("*").alias("n"), F.count_if(recent).alias("recent"))
    seen = reads.select("user_id", "bulletin_id").distinct().join(families.select("car_id", "bulletin_id", "published"), "bulletin_id").groupBy("user_id", "car_id").agg(F.count("*").alias("read"), F.count_if(recent).alias("read_recent"))
    held = garage.groupBy("user_id", "car_id").agg(F.count("*").alias("times"))  # 1, unless a car stands twice
    both = held.join(counted, "car_id").join(seen, ["user_id", "car_id"], "left").fillna(0, ["read", "read_recent"])
    counts = {"unread": F.col("n") - F.col("read"), "unread_recent": F.col("recent") - F.col("read_recent"), "n": F.col("n")}
    return both.select("user_id", "car_id", *((F.col("times") * c).alias(name) for name, c in counts.items()))


def stemmed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("stem", text.revision_stem(F.col("number"), F.col("bulletin_id")))


def fold(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = ("published", "bulletin_id")) -> DataFrame:
    """The newest row of each key group and how many it supersedes.

    One aggregate with partial results before the shuffle: a struct's maximum sorts a null date
    last, so a group costs one row a task whatever its size.
    """
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("newest"), (F.count("*") - 1).alias("superseded")).select(*keys, "newest.*", "superseded")


def latest(rows: DataFrame) -> DataFrame:
    return fold(stemmed(rows), ["stem"])


def page(rows: DataFrame, number: int = 1, size: int = 50, order: Sequence[Column] | None = None) -> DataFrame:
    """Newest first, undated last, one page."""
    order = order or [F.col("published").desc_nulls_last(), F.col("bulletin_id").desc()]
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_with_total(rows: DataFrame, number: int = 1, size: int = 50, order: Sequence[Column] | None = None) -> DataFrame:
    """A page and, on each of its rows, how many rows there are; a page past the end is one row of nulls with the total (Q01)."""
    total = rows.agg(F.count("*").alias("total"))  # one row
    return total.join(F.broadcast(page(rows, number, size, order)), F.lit(True), "left").select(*rows.columns, "total")


def details(rows: DataFrame, papers: DataFrame, links: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Bulletins by id with what belongs to them; ids are filters of every scan, and only their families are counted."""
    own = lambda table: table.filter(F.col("bulletin_id").isin(*ids))
    wanted, every = stemmed(own(rows)), stemmed(rows).select("stem")
    revisions = every.join(F.broadcast(wanted.select("stem").distinct()), "stem", "left_semi").groupBy("stem").agg((F.count("*") - 1).alias("revisions"))
    cars = own(links).groupBy("bulletin_id").agg(F.count("*").alias("n_cars"))
    both = with_papers(wanted.join(revisions, "stem").join(cars, "bulletin_id", "left"), own(papers))
    return both.select("bulletin_id", "stem", "revisions", F.coalesce("n_cars", F.lit(0)).alias("n_cars"), "n_papers", "paper_summary")


def lookup(cars: DataFrame, links: DataFrame, bulletins: DataFrame, year: int, make: str, model: str) -> DataFrame:
    """Tiers of the families of the cars of that name; their links are taken before anything is folded (Q10)."""
    mine = cars.filter((F.col("year") == year) & (F.col("make") == F.upper(F.trim(F.lit(make)))) & (F.col("model") == text.normal_model(F.lit(model)))).select("car_id")
    linked = links.join(F.broadcast(mine), "car_id", "left_semi").select("car_id", "bulletin_id")
    return severity_counts(fold(stemmed(linked.join(bulletins, "bulletin_id")), ["car_id", "stem"]), F.max("published").alias("newest"))


def families_of(rows: DataFrame, stems: Sequence[str]) -> DataFrame:
    """Bulletins of families, found by how their number begins and then by their stem (F10); signs of patterns in a stem stand for themselves."""
    begins = F.lit(False)
    for s in stems:
        begins = begins | F.ltrim("number").ilike(re.sub(r"([\\%_])", r"\\\1", s) + "%")
    return rows.filter(begins & F.col("stem").isin(*(s.upper() for s in stems)))


def _tag(kind: str, tag: Column, place: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), tag.alias("tag"), place.alias("place"))


def union_of_tags(papers: DataFrame, *columns: str, first_use: bool = False) -> DataFrame:
    """Documents of a bulletin rolled up: count, distinct tags, first summary by document id.

    Tags are sorted, as a list has them (J10), or with ``first_use`` in the order in which the
    documents, by id, and the places in each first have them, as a detail has them (A34). They are
    first grouped to distinct ones, so a bulletin's lists are as long as its vocabulary.
    """
    first = F.min_by("paper_summary", F.when(F.col("paper_summary").isNotNull(), F.col("paper_id"))).alias("paper_summary")
    out = papers.groupBy("bulletin_id").agg(F.count("*").alias("n_papers"), first)
    if columns:
        every = F.concat(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), partial(_tag, c)) for c in columns))
        tags = papers.select("bulletin_id", "paper_id", F.explode(every).alias("t")).select("bulletin_id", "paper_id", "t.*")
        if first_use:
            tags = tags.filter("tag IS NOT NULL").groupBy("bulletin_id", "kind", "tag").agg(F.min(F.struct("paper_id", "place")).alias("first"))
            lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.struct("first", "tag"))))["tag"].alias(c) for c in columns]
        else:
            tags = tags.select("bulletin_id", "kind", "tag").distinct()
            lists = [F.array_sort(F.collect_set(F.when(F.col("kind") == c, F.col("tag")))).alias(c) for c in columns]
        out = out.join(tags.groupBy("bulletin_id").agg(*lists), "bulletin_id", "left")
    return out


def with_papers(rows: DataFrame, papers: DataFrame, *columns: str, first_use: bool = False) -> DataFrame:
    """Rolled-up documents beside bulletins; nothing is 0, null and empty lists. Only those bulletins' documents are rolled up."""
    own = papers.join(rows.select("bulletin_id"), "bulletin_id", "left_semi")
    out = rows.join(union_of_tags(own, *columns, first_use=first_use), "bulletin_id", "left")
    return out.withColumns({"n_papers": F.coalesce("n_papers", F.lit(0))} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in columns})


def tag_vocabulary(papers: DataFrame, column: str, limit: int) -> DataFrame:
    """Tags by lower case: how often, the commonest spelling (ties: the smallest), most frequent first (A10)."""
    spelled = papers.select(F.explode(column).alias("tag")).groupBy("tag").count()
    merged = spelled.groupBy(F.lower("tag").alias("key")).agg(F.sum("count").alias("n"), F.max("count").alias("most"), F.collect_list(F.struct("count", "tag")).alias("spellings"))
    label = F.array_min(F.transform(F.filter("spellings", lambda s: s["count"] == F.col("most")), lambda s: s["tag"]))
    return merged.select(F.lit(column).alias("facet"), "key", label.alias("label"), "n").orderBy(F.desc("n"), "key").limit(limit)


def sample_ids(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The newest few of each tier (A17): the rank limit is applied before the shuffle too."""
    newest = Window.partitionBy(*keys, "severity").orderBy(F.col("published").desc_nulls_last(), F.col("bulletin_id").desc())
    ranked = rows.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= max(SAMPLE_QUOTA.values()))
    allowed = F.lit(0)
    for tier, n in SAMPLE_QUOTA.items():
        allowed = F.when(F.col("severity") == tier, n).otherwise(allowed)
    return ranked.filter(F.col("place") <= allowed).drop("place")


def with_quota(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every row, and whether it is among the newest few of its tier."""
    newest = Window.partitionBy(*keys, "severity").orderBy(F.col("published").desc_nulls_last(), F.col("bulletin_id").desc())
    allowed = F.lit(0)
    for tier, n in SAMPLE_QUOTA.items():
        allowed = F.when(F.col("severity") == tier, n).otherwise(allowed)
    return rows.withColumn("readable", F.row_number().over(newest) <= allowed)


def severity_counts(rows: DataFrame, *more: Column) -> DataFrame:
    """One row a tier, zero where there is none."""
    tiers = rows.sparkSession.createDataFrame([(t,) for t in SAMPLE_QUOTA], "severity string")
    got = rows.groupBy("severity").agg(F.count("*").alias("n"), *more)
    return tiers.join(got, "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))
