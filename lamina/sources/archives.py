"""ZIP archives of CSV files as a source: a partition for each member, streamed from the file.

Planning reads the archives' tables of contents only. A task opens one archive, seeks to its member
and parses it as it is unpacked, some thousand rows at a time, so neither an archive nor a member is
ever held whole. Bad UTF-8 is replaced and quoted line ends are kept. Archives are opened through
``pyarrow.fs``, so a path may be of any file system that it knows.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lamina.sources.flatfile import HEADING

COLUMNS = ("raw_id", "raw_make", "raw_model", "raw_years", "summary", "source_window")
#: Rows of a batch, and how an archive is named.
BATCH, PREFIX, SUFFIX = 10_000, "RECEIVED_", ".zip"


def opened(uri: str):
    """A file of any file system, to read and seek."""
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def listed(folder: str) -> list[str]:
    """The archives of a folder, sorted."""
    system, path = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(f"{folder.rstrip('/')}/{f.base_name}" for f in found if f.base_name.startswith(PREFIX) and f.base_name.endswith(SUFFIX))


class Member(InputPartition):
    def __init__(self, archive: str, name: str):
        super().__init__((archive, name))
        self.archive, self.name = archive, name


class MemberReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Member]:
        out = []
        for archive in listed(self.folder):
            with opened(archive) as file, zipfile.ZipFile(file) as found:
                out += [Member(archive, name) for name in found.namelist() if not name.endswith("/")]
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)  # a cell of any length
        window = partition.archive.rsplit(PREFIX, 1)[-1][: -len(SUFFIX)]
        schema = pa.schema([(c, pa.string()) for c in COLUMNS])
        with opened(partition.archive) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as member:
            rows: list[list[str]] = []
            for cells in csv.reader(io.TextIOWrapper(member, encoding="utf-8", errors="replace", newline="")):
                if len(cells) >= 5 and cells[0].strip() != HEADING:
                    rows.append([*cells[:5], window])
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class ArchiveSource(DataSource):
    """``spark.read.format("zipped_csv").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> str:
        return ", ".join(f"{c} string" for c in COLUMNS)

    def reader(self, schema) -> MemberReader:
        return MemberReader(self.options["path"])


def archived_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all archives of a folder, as ``flatfile.zipped_rows`` gives them, for archives and members of any size."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("zipped_csv").load(folder)


def write_archives(rows: DataFrame, folder: str, per_member: int = 50_000) -> None:
    """One archive a window, with members of so many rows. An archive is one file, so one task writes it, as its rows stream by."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)

    def write(batches):
        system, path = fs.FileSystem.from_uri(folder)
        window, archive, lines, member, out = None, None, None, 0, None

        def close_member():
            if lines:
                lines.flush()
                lines.close()

        for batch in batches:
            for row in batch.to_pylist():
                if row["source_window"] != window:
                    close_member()
                    if archive:
                        archive.close()
                        out.close()
                    window, member, lines, n = row["source_window"], 0, None, 0
                    out = system.open_output_stream(f"{path}/{PREFIX}{window}{SUFFIX}")
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if lines is None or n == per_member:
                    close_member()
                    lines = io.TextIOWrapper(archive.open(f"part-{member}.csv", "w", force_zip64=True), encoding="utf-8", newline="")
                    writer = csv.writer(lines)
                    writer.writerow([HEADING, "Make", "Model", "Model Year", "Concise Summary"])
                    member, n = member + 1, 0
                writer.writerow([row[c] for c in COLUMNS[:5]])
                n += 1
        close_member()
        if archive:
            archive.close()
            out.close()
        yield from ()

    rows.select(*COLUMNS).repartition("source_window").sortWithinPartitions("source_window").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
