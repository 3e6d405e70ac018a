"""Bulletin tables derived from the driver's tables; ``plans.oracle.TABLES`` says the same in SQL.

Every function is a lazy DataFrame over Parquet scans: filters and column choices of the caller
reach the scan, and nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a stored table for each partition that its rows are dealt to.
PART_BYTES = 2 << 20
#: Values of the hash by which links of some cars are found before they are grouped.
CAR_HASHES = 1 << 16


def partitions(spark: SparkSession, sf_dir: str, *names: str) -> int:
    """Partitions in proportion to what is stored of some tables, so that a task's share does not grow with them."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet") for name in names]
    stored = sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in paths)
    return max(1, -(-stored // PART_BYTES))


def row_partitions(stored: DataFrame, rows: int) -> int:
    """Partitions of about so many rows of a stored table; only the files' footers are read to count them."""
    return max(1, -(-stored.count() // rows))


def bulletins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per bulletin: number in every revision form, some dates and numbers null."""
    return read(spark, sf_dir, "orders").select(
        F.expr("CAST(10000000 + o_orderkey AS STRING)").alias("bulletin_id"),
        F.expr(
            """CASE WHEN o_orderkey % 23 = 0 THEN NULL
               WHEN o_orderkey % 7 = 0 THEN concat('N', CAST(242480000 + o_custkey AS STRING), '-0', CAST(o_orderkey % 3 AS STRING))
               WHEN o_orderkey % 5 = 0 THEN concat(' pit', CAST(o_custkey AS STRING), ' ')
               ELSE concat('PIT', CAST(o_custkey AS STRING), substr('ABCDE', CAST(o_orderkey % 5 AS INT) + 1, 1)) END"""
        ).alias("number"),
        F.expr("CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate END").alias("published"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'O' THEN 'pending' ELSE 'failed' END").alias("status"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'TSB' WHEN '2-HIGH' THEN 'RC' WHEN '3-MEDIUM' THEN 'PIT' WHEN '5-LOW' THEN NULL ELSE 'MC' END").alias("kind"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'serious' WHEN '2-HIGH' THEN 'serious' WHEN '3-MEDIUM' THEN 'medium' ELSE 'small' END").alias("severity"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 DAY END").alias("processed_at"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN CASE o_orderkey % 3 WHEN 0 THEN 'timeout: upstream' WHEN 1 THEN 'rate limit (429)' ELSE 'invalid json' END END").alias("reason"),
        F.expr("CAST(o_orderkey % 4 AS INT)").alias("attempts"),
        F.expr(
            """CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CASE o_orderkey % 6
               WHEN 0 THEN 'This service bulletin provides steps' WHEN 1 THEN 'A Customer Satisfaction program'
               WHEN 2 THEN 'Preliminary information on brakes' WHEN 3 THEN 'Safety recall notice'
               WHEN 4 THEN 'Radio screen goes blank' ELSE 'Warranty administration note' END END"""
        ).alias("summary"),
    )


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of a bulletin, with its tags; dealt by bulletin to partitions in proportion to the table.

    The least flags are strings, so lines are sorted to be grouped: a task sorts its share once, and
    whatever is grouped or joined by bulletin afterwards needs no other shuffle.
    """
    rows = read(spark, sf_dir, "lineitem").withColumn("bulletin_id", F.expr("CAST(10000000 + l_orderkey AS STRING)"))
    lines = rows.repartition(partitions(spark, sf_dir, "lineitem"), "bulletin_id").groupBy("bulletin_id", "l_orderkey", "l_linenumber").agg(
        F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("line_status"), F.max("l_partkey").alias("part"),
        F.max("l_suppkey").alias("supp"), F.sum("l_quantity").cast("long").alias("quantity"),
    )
    return lines.select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("paper_id"),
        "bulletin_id",
        F.expr("array(CASE flag WHEN 'A' THEN if(l_linenumber % 2 = 0, 'Brakes', 'brakes') WHEN 'N' THEN 'Infotainment' ELSE 'Air Conditioning' END)").alias("systems"),
        F.expr("concat(array(if(line_status = 'F', 'no start', 'Blank Screen')), if(l_linenumber > 5, array('leak'), CAST(array() AS ARRAY<STRING>)))").alias("symptoms"),
        F.expr("array(concat('part ', CAST(part % 7 AS STRING)))").alias("components"),
        F.expr("CASE WHEN l_linenumber > 1 THEN concat('Summary ', CAST(part AS STRING)) END").alias("paper_summary"),
        F.expr("CASE WHEN l_linenumber % 2 = 1 THEN 'Replace part' END").alias("remedy"),
        F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'recall' WHEN 1 THEN 'customer_letter' WHEN 2 THEN 'service_procedure' ELSE 'informational' END").alias("doc_kind"),
        F.expr("CASE supp % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'dealer' ELSE 'both' END").alias("audience"),
        (F.col("quantity") * 100).alias("tokens_in"), (F.col("quantity") * 10).alias("tokens_out"),
    )


def links(spark: SparkSession, sf_dir: str, cars: DataFrame | None = None) -> DataFrame:
    """Bulletin to car, many to many; those of some cars (car_id) where they are given.

    Then lines are filtered before they are grouped, by a broadcast list of at most ``CAR_HASHES`` hashes of the cars, and the groups by the cars themselves.
    """
    own = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_custkey AS car_id", "o_orderdate AS seen")
    other = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS k", "l_suppkey AS car_id", "l_shipdate AS seen")
    rows = own.unionByName(other)
    if cars is not None:
        hashed = F.pmod(F.xxhash64(F.col("car_id").cast("long")), F.lit(CAR_HASHES))
        rows = rows.join(F.broadcast(cars.select(hashed.alias("car_hash")).distinct()), hashed == F.col("car_hash"), "left_semi")
    pairs = rows.groupBy("k", "car_id").agg(F.min("seen").alias("first_seen_at"))
    if cars is not None:
        pairs = pairs.join(cars.select("car_id").distinct(), "car_id", "left_semi")
    return pairs.select(F.expr("CAST(10000000 + k AS STRING)").alias("bulletin_id"), "car_id", "first_seen_at", F.expr("k % 3 = 0").alias("alert_pending"))


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS car_id", "CAST(2000 + c_custkey % 25 AS INT) AS year", "c_mktsegment AS make", "concat('M ', CAST(c_nationkey AS STRING)) AS model",
        "CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP_NTZ '1998-01-01 00:00:00' END AS ready_at",
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").selectExpr(
        "event_id", "ts AS occurred_at", "user_id", "event_type AS kind", "value AS cost", "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CASE user_id % 3 WHEN 0 THEN 'm-small' WHEN 1 THEN 'm-large' ELSE 'm-x' END AS model", "event_id % 1000 AS tokens_in", "event_id % 90 AS tokens_out",
    )


def filed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows as a flat file holds them, with every kind of bad row."""
    return read(spark, sf_dir, "part").selectExpr(
        "CASE WHEN p_partkey % 29 = 0 THEN ' ' ELSE concat(' ', CAST(20000000 + p_partkey % 997 AS STRING)) END AS raw_id",
        "concat('Make ', CAST(p_partkey % 3 AS STRING)) AS raw_make",
        """CASE WHEN p_partkey % 31 = 0 THEN concat('MAKE ', CAST(p_partkey % 3 AS STRING)) ELSE CASE p_partkey % 6
           WHEN 0 THEN concat('f-', CAST(p_size AS STRING)) WHEN 1 THEN concat('F  ', CAST(p_size AS STRING)) WHEN 2 THEN concat('F', CAST(p_size AS STRING), ' SD')
           WHEN 3 THEN concat('REDUNDANT F ', CAST(p_size AS STRING)) WHEN 4 THEN p_name ELSE concat('Duplicate ', p_name) END END AS raw_model""",
        "CASE WHEN p_partkey % 17 = 0 THEN 'n/a' WHEN p_partkey % 13 = 0 THEN '9999' WHEN p_partkey % 5 = 0 THEN '2020, 2021' ELSE CAST(2020 + p_partkey % 2 AS STRING) END AS raw_years",
        "p_type AS summary", "CASE WHEN p_partkey % 4 < 2 THEN '2015-2019' ELSE '2020-2024' END AS source_window",
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id").distinct().selectExpr(
        "user_id", "user_id % 37 = 0 AS is_admin", "TIMESTAMP_NTZ '1998-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(user_id AS INT)) AS created_at",
        "CASE WHEN user_id % 3 <> 0 THEN TIMESTAMP_NTZ '1999-01-01 00:00:00' END AS last_watermark", "user_id % 11 = 0 AS unsubscribed",
    )


def garage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account to car."""
    return accounts(spark, sf_dir).selectExpr("user_id", "explode(sequence(0, CAST(user_id % 5 AS INT))) AS i").selectExpr(
        "user_id", "(user_id * 7 + i * 13) % 100 AS car_id", "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, i) AS created_at", "(user_id + i) % 4 <> 0 AS alerts_enabled",
    )


def entitlements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accounts(spark, sf_dir).filter("user_id % 4 < 3").selectExpr(
        "user_id * 10 AS entitlement_id", "user_id", "if(user_id % 4 = 1, 'unlock', 'subscription') AS kind",
        "CASE WHEN user_id % 4 = 1 THEN (user_id * 7) % 100 END AS car_id", "if(user_id % 4 = 2, 'canceled', 'active') AS status",
        "CASE WHEN user_id % 8 = 4 THEN 'all_access' WHEN user_id % 16 = 0 THEN 'monthly' END AS plan", "TIMESTAMP_NTZ '1999-06-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(user_id AS INT)) AS created_at",
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletins an account has read: those of its cars whose number and its own give a multiple of 5."""
    return reads_of(garage(spark, sf_dir), links(spark, sf_dir))


def reads_of(garage: DataFrame, links: DataFrame) -> DataFrame:
    """The reads by accounts' cars and their links, which are joined by remainder too. A garage that is dealt by account stays so where the links are small enough to be broadcast; then no pair is shuffled."""
    linked = links.selectExpr("bulletin_id", "car_id", "pmod(CAST(bulletin_id AS BIGINT), 5) AS rest")
    return garage.selectExpr("user_id", "car_id", "pmod(-user_id, 5) AS rest").join(linked, ["car_id", "rest"]).select("user_id", "bulletin_id").distinct()


def searchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an embedding: two to a bulletin, three bulletins to a family."""
    named = F.array(*[F.lit(s) for s in ("Brakes", "Radio Display", "Engine", "Electrical", "Suspension", "HVAC", "Tire", "Steering", "Body Glass", "Camera")])
    both = read(spark, sf_dir, "embeddings").join(read(spark, sf_dir, "documents").select("doc_id", "text"), F.col("vec_id") == F.col("doc_id"))
    return both.select(
        "doc_id", "text", "embedding", F.expr("CAST(doc_id DIV 2 AS STRING)").alias("bulletin_id"),
        F.expr("concat('PIT', CAST(doc_id DIV 6 AS STRING), substr('ABC', CAST((doc_id DIV 2) % 3 AS INT) + 1, 1))").alias("number"),
        F.expr("CASE WHEN (doc_id DIV 2) % 17 <> 0 THEN date_add(DATE '2024-01-01', CAST((doc_id DIV 2) % 50 AS INT)) END").alias("published"),
        F.array(F.element_at(named, F.col("label") + 1)).alias("systems"),
    )
