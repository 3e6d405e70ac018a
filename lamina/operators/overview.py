"""Reports over the whole store and by car (A06, A19, A32, L18, Q12, Q20, U02), and states of subscriptions as payment events tell them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ledger import estimate
from lamina.operators.scoped import SUMMARY_ONLY

#: States of a subscription as payment events name them, and as they are kept here.
SUBSCRIPTION_STATES = {"active": "active", "trialing": "active", "past_due": "past_due", "unpaid": "past_due", "canceled": "canceled", "incomplete_expired": "canceled"}


def status_report(bulletins: DataFrame, papers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: bulletins by status, how far their papers are, and what runs have cost (A06); one pass a table."""
    state = F.col("status")
    stored = bulletins.agg(F.count("*").alias("bulletins"), *(F.count_if(state == s).alias(s) for s in ("pending", "processed", "failed")))
    done = papers.agg(F.count("*").alias("papers"), *(F.count(c).alias(n) for n, c in (("extracted", "extracted_text"), ("summarised", "paper_summary"), ("embedded", "embedding"))))
    spent = runs.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spend"))
    return stored.crossJoin(F.broadcast(done)).crossJoin(F.broadcast(spent))  # one row each


def ledger_totals(ledger: DataFrame, since: Column, kinds: Sequence[str]) -> DataFrame:
    """One row: tokens and cost of some kinds since a time, zeros where there are none."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out", "cost")]
    return ledger.filter((F.col("occurred_at") >= since) & F.col("kind").isin(*kinds)).agg(*sums)


def report_sections(bulletins: DataFrame, papers: DataFrame, ledger: DataFrame, kind: str = "MC") -> DataFrame:
    """All counts of the report of tiers, a row each: section, label, other, n, cost.

    A bulletin says in one pass which counts it belongs to; those of one kind are counted by tier and
    by the first paper's kind and audience too (null: there is no paper). The ledger is counted by
    model and input.
    """
    first = papers.groupBy("bulletin_id").agg(F.min_by(F.struct("doc_kind", "audience"), "paper_id").alias("first"))
    own = F.col("kind") == kind
    none = F.lit(None).cast("string")
    entry = lambda section, label, other=none: F.struct(F.lit(section).alias("section"), label.alias("label"), other.alias("other"))
    said = F.array(
        entry("tier and source", F.col("severity"), F.col("severity_source")), F.when(own, entry("kind", none)), F.when(own, entry("kind by tier", F.col("severity"))),
        F.when(own, entry("kind by document", F.col("first.doc_kind"))), F.when(own, entry("kind by audience", F.col("first.audience"))),
        F.when(F.col("status").isin("pending", "failed"), entry("unfinished", F.col("status"), F.col("reason"))),
    )
    each = bulletins.join(first, "bulletin_id", "left").select(F.explode(F.filter(said, lambda s: s.isNotNull())).alias("s"))
    counts = each.groupBy("s.section", "s.label", "s.other").agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("cost"))
    spent = ledger.groupBy(F.lit("ledger").alias("section"), F.col("model").alias("label"), F.col("input").alias("other")).agg(F.count("*").alias("n"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return counts.unionByName(spent)


def strata_table(sample: DataFrame, cells: Sequence[str]) -> DataFrame:
    """How many rows of a sample fall in each cell, and the cells' places: largest first, then by name (L18). Only cells are ordered."""
    counted = sample.groupBy(*cells).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), *(F.col(c).asc_nulls_last() for c in cells))))


def to_fetch(listed: DataFrame, bulletins: DataFrame) -> DataFrame:
    """For each car, which listed bulletins a sync asks for: those not stored, and stored ones that stand by their summary alone."""
    stored = bulletins.select("bulletin_id", F.lit(True).alias("known"), F.col("reason").eqNullSafe(SUMMARY_ONLY).alias("again"))
    known, again = F.coalesce("known", F.lit(False)), F.coalesce("again", F.lit(False))
    found = listed.select("car_id", "bulletin_id").distinct().join(stored, "bulletin_id", "left")
    return found.groupBy("car_id").agg(F.count("*").alias("found"), F.count_if(known).alias("skipped_known"), F.count_if(~known).alias("new"), F.count_if(again).alias("rechecked"), F.count_if(~known | again).alias("to_fetch"))


def previews(cars: DataFrame, listed: DataFrame, bulletins: DataFrame, papers: DataFrame, links: DataFrame, per_bulletin: float, per_paper: float) -> DataFrame:
    """What a refresh of each car would do, cost and take.

    cars have is_scanned: whether every window that may list them was read. A car without a listed
    bulletin waits for the scan if not. Papers left unread by pending bulletins are work as well.
    """
    stored = bulletins.select("bulletin_id", F.lit(True).alias("known"))
    counted = listed.select("car_id", "bulletin_id").distinct().join(stored, "bulletin_id", "left").groupBy("car_id").agg(F.count("*").alias("listed"), F.count_if(F.col("known").isNull()).alias("new_bulletins"))
    unread = papers.filter("paper_summary IS NULL").groupBy("bulletin_id").agg(F.count("*").alias("n"))
    waiting = bulletins.filter("status = 'pending'").select("bulletin_id").join(unread, "bulletin_id")
    left = links.select("car_id", "bulletin_id").join(waiting, "bulletin_id").groupBy("car_id").agg(F.sum("n").alias("unfinished"))
    both = cars.select("car_id", "is_scanned").join(counted, "car_id", "left").join(left, "car_id", "left").fillna(0, ["listed", "new_bulletins", "unfinished"])
    rows = both.withColumns({
        "scan_pending": (F.col("listed") == 0) & ~F.col("is_scanned"), "documents": F.bround(F.col("new_bulletins") * F.lit(float(per_bulletin))).cast("long") + F.col("unfinished"),
    })
    out = rows.withColumn("e", estimate(F.col("new_bulletins"), F.col("documents"), F.lit(float(per_paper))))
    return out.select("car_id", "listed", "new_bulletins", "unfinished", "documents", (~F.col("scan_pending") & (F.col("documents") == 0)).alias("up_to_date"), "scan_pending", "e.*")


def identity_report(cars: DataFrame, links: DataFrame, listed: DataFrame, baseline: DataFrame) -> DataFrame:
    """Each tracked car's linked and listed bulletins against a baseline (car_id, linked), and the baseline's cars that are not tracked (Q20)."""
    linked = links.groupBy("car_id").agg(F.countDistinct("bulletin_id").alias("linked"))
    index = listed.groupBy("car_id").agg(F.count("*").alias("listed"))
    tracked = cars.filter("active").join(linked, "car_id", "left").join(index, "car_id", "left").fillna(0, ["linked", "listed"])
    tracked = tracked.select("car_id", F.concat_ws(" ", "year", "make", "model").alias("identity"), "linked", "listed")
    both = tracked.join(baseline.select("car_id", F.col("linked").alias("baseline")), "car_id", "full_outer")
    status = F.when(F.col("identity").isNull(), "missing").when(F.col("linked") < F.col("baseline"), "below baseline").otherwise("ok")
    return both.withColumns({"delta": F.col("linked") - F.col("baseline"), "status": status})


def subscription_change(event: Column, plans: Mapping[str, str]) -> Column:
    """What a payment event's subscription, as JSON, says: id, status as kept here, plan by the price's id, end of the paid period.

    A status that is not mapped gives null, and is not to be applied; so does a text that is no JSON.
    A price is an object or its id. The end is the first item's, else the subscription's own, in
    seconds of this era; anything but a whole number gives null.
    """
    sub = F.from_json(event, "id string, status string, current_period_end string, items struct<data array<struct<current_period_end string, price string>>>")
    items = F.coalesce(sub["items"]["data"], F.array().cast("array<struct<current_period_end:string,price:string>>"))
    mapped = lambda values, key: F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)
    said = lambda end: F.when(end != "0", F.nullif(F.trim(end), F.lit("")))
    end = F.coalesce(said(F.get(items, F.lit(0))["current_period_end"]), said(sub["current_period_end"]))
    seconds = F.when(end.rlike(r"^[+-]?[0-9]{1,11}$"), end.cast("long"))
    ids = F.transform(items, lambda i: F.when(F.startswith(i["price"], F.lit("{")), F.get_json_object(i["price"], "$.id")).otherwise(i["price"]))
    plan = F.get(F.filter(F.transform(ids, lambda i: mapped(plans, i)), lambda p: p.isNotNull()), F.lit(0))
    return F.struct(sub["id"].alias("subscription_id"), mapped(SUBSCRIPTION_STATES, sub["status"]).alias("status"), plan.alias("plan"), F.timestamp_seconds(seconds).cast("timestamp_ntz").alias("period_end"))
