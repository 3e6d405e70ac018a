"""Archives read by member, and names in texts against a regular expression."""

import random
import re
import zipfile

from pyspark.sql import functions as F

from lamina.functions import text
from lamina.sources import archives, flatfile


def test_members_beyond_a_batch_and_cells_of_any_kind(spark, tmp_path):
    head = '"TSB/Document ID","Make","Model","Model Year","Concise Summary"\n'
    big = head + "".join(f'{i},Make,"M {i}",2020,"two\nlines ""{i}"""\n' for i in range(archives.BATCH * 2 + 5))
    with zipfile.ZipFile(tmp_path / "RECEIVED_2015-2019.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", big)
        z.writestr("b.csv", head.encode() + b"7,Make,M,2020,bad \xff byte,more\n" + b"short,row\n")
        z.writestr("empty.csv", "")
    with zipfile.ZipFile(tmp_path / "RECEIVED_2020-2024.zip", "w") as z:
        z.writestr("c.csv", "8,Make,M,2021," + "x" * 300_000)
    (tmp_path / "RECEIVED_notes.txt").write_bytes(b"no archive")
    folder = f"file://{tmp_path}"
    rows = archives.archived_rows(spark, folder)
    assert rows.rdd.getNumPartitions() == 4
    got = {(r.raw_id, r.raw_model, r.source_window): r.summary for r in rows.collect()}
    assert len(got) == archives.BATCH * 2 + 7
    assert got[("20004", "M 20004", "2015-2019")] == 'two\nlines "20004"' and got[("7", "M", "2015-2019")] == "bad � byte" and len(got[("8", "M", "2020-2024")]) == 300_000
    same = flatfile.zipped_rows(spark, folder).filter("source_window = '2015-2019'")
    assert same.exceptAll(rows).count() == 0 and same.count() == archives.BATCH * 2 + 6


def test_written_archives_come_back(spark, tmp_path):
    rows = spark.range(1200).selectExpr("CAST(id AS STRING) AS raw_id", "'Make' AS raw_make", "concat('M', char(10), id) AS raw_model", "'2020' AS raw_years", "'\"q\"' AS summary", "if(id % 3 = 0, '2015-2019', '2020-2024') AS source_window")
    archives.write_archives(rows, f"file://{tmp_path}/in", per_member=300)
    back = archives.archived_rows(spark, f"file://{tmp_path}/in")
    assert back.exceptAll(rows).count() == 0 and back.count() == 1200
    assert back.rdd.getNumPartitions() == 2 + 3


def test_names_equal_a_regular_expression(spark):
    rng = random.Random(8)
    signs = ["F", "15", "150", "F150", " ", " ", ".", "(", "A", "ß", "/"]
    rows = []
    for i in range(300):
        names = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 4))).strip() for _ in range(5)]
        rows.append((i, "".join(rng.choice(signs) for _ in range(rng.randint(0, 30))), [n for n in names if n]))
    rows += [(900, "", ["A"]), (901, "A", []), (902, "F 150", ["F 15", "F 150", "150", "F 150"])]
    docs = spark.createDataFrame(rows, "id long, t string, names array<string>")
    got = {r.id: r.found for r in docs.select("id", text.names_in(F.col("t"), F.col("names")).alias("found")).collect()}
    for i, t, names in rows:
        assert sorted(got[i]) == sorted({n for n in names if re.search(rf"(?<![A-Z0-9]){re.escape(n)}(?![A-Z0-9])", t)}), (t, names)


def test_recall_without_years_or_models(spark):
    docs = spark.sql("SELECT array(named_struct('year', '2015', 'model', 'F-150'), named_struct('year', 'x', 'model', 'f  150')) AS p, '2014-2016 F-150s, F 150' AS t UNION ALL SELECT CAST(array() AS ARRAY<STRUCT<year: STRING, model: STRING>>), '2015'")
    assert [tuple(r.r) for r in docs.select(text.applicability_recall(F.col("p"), F.col("t")).alias("r")).collect()] == [(1.0, 1.0, 1.0), (None, None, None)]


def test_recall_is_dealt_by_rows_and_not_by_files(spark, tmp_path):
    """A file of half a megabyte with 50,000 rows was one task."""
    from lamina.plans import archived

    parts = spark.range(50_000).selectExpr("id AS p_partkey", "concat('part ', id % 90) AS p_name", "CAST(id % 50 AS INT) AS p_size", "'Brand#12' AS p_brand")
    parts.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    shares = archived.c28_applicability_recall(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 3 and sum(r["count"] for r in shares) == 50_000
