"""Requests of members and the tables after them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators import bulletins as lists
from lamina.operators import members as ops
from lamina.operators import state, vocabulary
from lamina.plans.oracle import TABLES
from lamina.plans.publishing import _WITHDRAWN
from lamina.sources import derived
from lamina.sources.snapshots import Snapshots, shared_folder, stored

NOW = datetime(2001, 8, 1)


def q01_page_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page past the last one keeps the total. Q01, L02."""
    rows = lists.latest(derived.bulletins(spark, sf_dir).filter("status = 'processed'"))
    return lists.page_with_total(rows, number=1_000_000, size=50).select("bulletin_id", "published", "superseded", "total")


_Q01E = "SELECT CAST(NULL AS VARCHAR) AS bulletin_id, CAST(NULL AS TIMESTAMP) AS published, CAST(NULL AS BIGINT) AS superseded, count(DISTINCT stem) AS total FROM stemmed WHERE status = 'processed'"


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of cars as they are typed: one's own, and others near by."""
    wanted = derived.garage(spark, sf_dir).selectExpr("user_id", "explode(array(car_id, (car_id + 1) % 100, (car_id + 50) % 100)) AS car_id")
    named = derived.cars(spark, sf_dir).selectExpr("car_id", "year", "concat(' ', lower(make)) AS make", "replace(lower(model), ' ', '- ') AS model")
    return wanted.join(named, "car_id").drop("car_id")


def q15_car_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which cars an account may add by name, with the free sample's slots. Q15, A29, F13, C01."""
    garage = derived.garage(spark, sf_dir)
    grants = garage.selectExpr("user_id", "car_id").filter("(user_id + car_id) % 3 <> 0").unionByName(garage.selectExpr("user_id", "(car_id + 1) % 100 AS car_id").filter("user_id % 2 = 0"))
    return ops.car_requests(_asked(spark, sf_dir), derived.cars(spark, sf_dir), garage, derived.accounts(spark, sf_dir), derived.entitlements(spark, sf_dir), grants)


_Q15 = """, grants AS (SELECT user_id, car_id FROM garage WHERE (user_id + car_id) % 3 <> 0 UNION SELECT user_id, (car_id + 1) % 100 FROM garage WHERE user_id % 2 = 0),
 r AS (SELECT user_id, c.* FROM (SELECT user_id, unnest([car_id, (car_id + 1) % 100, (car_id + 50) % 100]) AS car_id FROM garage) JOIN cars c USING (car_id)),
 h AS (SELECT user_id, count(*) AS total, count(*) FILTER (WHERE NOT is_unlocked) AS on_plan FROM seats GROUP BY 1),
 g AS (SELECT user_id, count(*) AS n FROM grants WHERE (user_id, car_id) NOT IN (SELECT (user_id, car_id) FROM unlocked) GROUP BY 1)
SELECT user_id, year, ' ' || lower(make) AS make, replace(lower(model), ' ', '- ') AS model, coalesce(g.n, 0) AS grants_in_use,
 CASE WHEN EXISTS (SELECT 1 FROM garage o JOIN cars c USING (car_id) WHERE o.user_id = r.user_id AND c.year = r.year AND c.make = r.make AND c.model = r.model) THEN NULL
  WHEN places IS NOT NULL AND NOT is_admin THEN CASE WHEN on_plan >= places THEN 'plan limit' END
  WHEN total >= 10 THEN 'vehicle limit'
  WHEN is_admin OR places IS NOT NULL OR coalesce(g.n, 0) < 2 OR EXISTS (SELECT 1 FROM grants o JOIN cars c USING (car_id) WHERE o.user_id = r.user_id AND c.year = r.year AND c.make = r.make AND c.model = r.model) THEN NULL
  ELSE 'sample limit' END AS refusal
FROM r JOIN accounts USING (user_id) JOIN h USING (user_id) LEFT JOIN plan_of USING (user_id) LEFT JOIN g USING (user_id)"""


def q28_my_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each account's active cars with tiers, unread, new, availability and access. Q28, A03, A04, Q14."""
    cars = derived.cars(spark, sf_dir).withColumn("active", F.col("car_id") % 10 != 9)
    args = derived.garage(spark, sf_dir), cars, derived.accounts(spark, sf_dir), derived.entitlements(spark, sf_dir), derived.bulletins(spark, sf_dir), derived.links(spark, sf_dir), derived.reads(spark, sf_dir)
    return ops.my_cars(*args, NOW)


_Q28 = """, fam AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY car_id, stem ORDER BY published DESC NULLS LAST, bulletin_id DESC) AS rn FROM listed_cars WHERE status = 'processed') WHERE rn = 1),
 j AS (SELECT x.user_id, x.car_id, f.bulletin_id, f.severity, f.published, r.bulletin_id IS NULL AS unread FROM access x JOIN fam f ON f.car_id = x.car_id LEFT JOIN reads r ON r.user_id = x.user_id AND r.bulletin_id = f.bulletin_id),
 n AS (SELECT user_id, car_id, count(*) AS n, count(*) FILTER (severity = 'serious') AS serious, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'small') AS small,
  count(*) FILTER (severity = 'serious' AND unread) AS us, count(*) FILTER (severity = 'medium' AND unread) AS um, count(*) FILTER (severity = 'small' AND unread) AS ul, count(*) FILTER (published >= TIMESTAMP '2001-07-25') AS week FROM j GROUP BY 1, 2)
SELECT x.user_id, x.car_id, c.year, c.make, c.model, x.created_at AS added_at, x.alerts_enabled, coalesce(serious, 0) AS serious, coalesce(medium, 0) AS medium, coalesce(small, 0) AS small,
 coalesce(us, 0) AS unread_serious, coalesce(um, 0) AS unread_medium, coalesce(ul, 0) AS unread_small, coalesce(week, 0) AS new_this_week, CASE WHEN n > 0 THEN 'ready' ELSE 'processing' END AS availability, x.access
FROM access x JOIN cars c ON c.car_id = x.car_id AND c.car_id % 10 <> 9 LEFT JOIN n ON n.user_id = x.user_id AND n.car_id = x.car_id"""


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every account with an even number asks for bulletins of its cars, some of them twice, and for one car's that is not its own."""
    store = Snapshots(spark, f"{shared_folder(spark, 'reads')}/store")
    n = derived.partitions(spark, sf_dir, "events", "orders", "lineitem")
    held = derived.garage(spark, sf_dir).select("user_id", "car_id")
    links = stored(derived.links(spark, sf_dir, held.selectExpr("explode(array(car_id, (car_id + 1) % 100)) AS car_id")).select("car_id", "bulletin_id"), "links")
    garage = ops.dealt(held, n)
    ops.create_reads(store, derived.reads_of(garage, links), n)
    near = garage.filter("user_id % 2 = 0").selectExpr("user_id", "explode(array(car_id, car_id, (car_id + 1) % 100)) AS car_id", "pmod(1 - user_id, 4) AS rest")
    # of numbers above zero, as these are, the sum leaves 1 where the remainders match
    linked = links.selectExpr("car_id", "bulletin_id", "pmod(CAST(bulletin_id AS BIGINT), 4) AS rest")
    asked = near.join(linked, ["car_id", "rest"]).select("user_id", "bulletin_id")
    return ops.mark_read(store, asked, garage, links, n)


def q09_marked_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each request to mark a bulletin read is told. Q09, F21."""
    return _marked(spark, sf_dir)[1]


_MARKED = """, q AS (SELECT DISTINCT user_id, bulletin_id FROM (SELECT user_id, unnest([car_id, (car_id + 1) % 100]) AS car_id FROM garage WHERE user_id % 2 = 0) JOIN links USING (car_id) WHERE (CAST(bulletin_id AS BIGINT) + user_id) % 4 = 1),
 near AS (SELECT DISTINCT user_id, bulletin_id FROM garage JOIN links USING (car_id))"""
_Q09A = _MARKED + " SELECT user_id, bulletin_id, (user_id, bulletin_id) IN (SELECT (user_id, bulletin_id) FROM near) AS marked FROM q"


def q09_reads_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published reads after those requests, those of accounts that did not ask among them. Q09, D02, D04."""
    return _marked(spark, sf_dir)[0]


_Q09R = _MARKED + " SELECT user_id, bulletin_id FROM reads UNION SELECT user_id, bulletin_id FROM q JOIN near USING (user_id, bulletin_id)"


def d04_replaced_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary after one window was loaded again with rows withdrawn; the other window's folder is untouched. D04."""
    path = f"{shared_folder(spark, 'windows')}/vocabulary"
    rows = derived.filed_rows(spark, sf_dir)
    state.replace_partition(spark, vocabulary.vocabulary(vocabulary.clean_rows(rows)), path, "source_window")
    again = rows.filter("source_window = '2020-2024' AND NOT startswith(raw_model, 'F  ')")
    state.replace_partition(spark, vocabulary.vocabulary(vocabulary.clean_rows(again)), path, "source_window")
    return spark.read.parquet(path).select("model_year", "make", "model", "source_window", "bulletins")


_D04 = _WITHDRAWN + "SELECT model_year, make, model, source_window, bulletins FROM vocabulary"


def d15_signed_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users after their sign-ins, known ones and new. D15, F14."""
    users = derived.accounts(spark, sf_dir).filter("user_id % 3 <> 0").selectExpr(
        "concat('uid-', CAST(user_id AS STRING)) AS uid", "user_id", "concat('a', CAST(user_id AS STRING), '@mail.example') AS email", "CASE WHEN user_id % 2 = 0 THEN concat('Name ', CAST(user_id AS STRING)) END AS display_name", "is_admin", "last_watermark AS last_seen_at",
    )
    sign_ins = derived.ledger(spark, sf_dir).filter("kind IN ('signup', 'click')").selectExpr(
        "concat('uid-', CAST(user_id AS STRING)) AS uid", "concat('b', CAST(event_id % 50 AS STRING), '@mail.example') AS email", "CASE WHEN event_id % 3 <> 0 THEN concat('New ', CAST(event_id AS STRING)) END AS display_name", "event_id % 40 = 0 AS is_admin", "occurred_at AS at",
    )
    return ops.signed_in(users, sign_ins).select("uid", "user_id", "email", "display_name", "is_admin", "last_seen_at")


_D15 = """, u AS (SELECT 'uid-' || user_id AS uid, user_id, 'a' || user_id || '@mail.example' AS email, CASE WHEN user_id % 2 = 0 THEN 'Name ' || user_id END AS display_name, is_admin, last_watermark AS seen FROM accounts WHERE user_id % 3 <> 0),
 s AS (SELECT 'uid-' || user_id AS uid, 'b' || (event_id % 50) || '@mail.example' AS email, CASE WHEN event_id % 3 <> 0 THEN 'New ' || event_id END AS display_name, event_id % 40 = 0 AS is_admin, occurred_at AS seen FROM ledger WHERE kind IN ('signup', 'click')),
 l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY uid ORDER BY seen DESC, email DESC, display_name DESC NULLS LAST) = 1),
 a AS (SELECT uid, bool_or(is_admin) AS adm FROM s GROUP BY 1),
 n AS (SELECT uid, (SELECT max(user_id) FROM u) + row_number() OVER (ORDER BY md5(uid), uid) AS user_id FROM l WHERE uid NOT IN (SELECT uid FROM u))
SELECT uid, coalesce(u.user_id, n.user_id) AS user_id, CASE WHEN l.uid IS NULL THEN u.email ELSE l.email END AS email, CASE WHEN l.uid IS NULL THEN u.display_name ELSE l.display_name END AS display_name,
 coalesce(u.is_admin, false) OR coalesce(adm, false) AS is_admin, greatest(u.seen, l.seen) AS last_seen_at
FROM u FULL JOIN l USING (uid) LEFT JOIN a USING (uid) LEFT JOIN n USING (uid)"""


def f20_shown_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that the picker shows for what was typed. F20, L03."""
    return ops.shown_options(vocabulary.clean_rows(derived.filed_rows(spark, sf_dir)), "model", " f 1 ")


_F20 = "SELECT DISTINCT model FROM clean WHERE contains(lower(model), 'f 1') ORDER BY model LIMIT 80"

QUERIES = {f.__name__: f for f in (q01_page_past_end, q15_car_requests, q28_my_cars, q09_marked_reads, q09_reads_after, d04_replaced_window, d15_signed_in, f20_shown_models)}
ORACLE_SQL = dict(zip(QUERIES, (TABLES + _Q01E, TABLES + _Q15, TABLES + _Q28, TABLES + _Q09A, TABLES + _Q09R, _D04, TABLES + _D15, TABLES + _F20)))
