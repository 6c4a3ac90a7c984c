"""A corpus as a stream: every scan lists the folder tree in tasks, state keeps what was seen, new files are read.

The source has offsets of its own: an offset is the time up to which a scan looks. A batch takes files that last changed
before its end, so a batch that is run again finds the same files, whatever has arrived since. The listing goes level by level
through shuffles, like a batch scan's, and the driver holds no names; the paths seen so far are the state of a
deduplication, spread over the executors and kept in the query's checkpoint. Dot-files, underscore-files, and files and folders that cannot
be read arrive as in a batch scan. A file that changes arrives again, with its new size and time of change.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sheafspark.sources.corpus import children, content_reader, open_uri, prefix, said

ARRIVING = "bundle_id string, path string, size bigint, uri string, is_folder boolean, changed bigint, list_error string, until bigint"
_BATCH_ROWS = 50_000


class ScanSource(DataSource):
    """``spark.readStream.format("corpus_scans")``: one row per scan that is due, the time up to which it looks (``until``)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_scans"

    def schema(self) -> str:
        return "until bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ScanReader()


class ScanReader(DataSourceStreamReader):
    """Offsets are milliseconds: each batch is one scan up to its end."""

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": int(time.time() * 1000)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(end["until"])] if end["until"] > start["until"] else []

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield (partition.value,)

    def commit(self, end: dict) -> None:
        pass


def _expand(uri: str, by_child: bool, deep: bool):
    """Replaces folder rows by what is in them, one level or all; other rows pass."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_uri(uri)
        before = prefix(uri)
        names = [column.split()[0] for column in ARRIVING.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        def inside(bundle: str, folder: str, until: int) -> Iterator[tuple]:
            pending = [folder]
            while pending:
                folder = pending.pop()
                place = f"{top.rstrip('/')}/{folder}" if folder else top
                try:
                    for name, path, size, changed, error in children(files, place):
                        inner = f"{folder}/{name}" if folder else name
                        named = name if by_child and not folder else bundle
                        if size is None and deep:
                            pending.append(inner)
                        else:
                            yield named, inner, size, before + path, size is None, changed, error, until
                except OSError as failure:
                    yield bundle, folder, 0, before + place, False, None, said(failure), until

        rows = []
        for incoming in batches:
            for row in zip(*[incoming.column(name).to_pylist() for name in names]):
                bundle, folder, is_folder, until = row[0], row[1], row[4], row[7]
                for found in inside(bundle, folder, until) if is_folder else (row,):
                    rows.append(found)
                    if len(rows) >= _BATCH_ROWS:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return expand


def arriving_paths(spark: SparkSession, folder: str, bundles: str = "self", levels: int = 2, shards: int | None = None) -> DataFrame:
    """A stream of listing rows (bundle_id, path, size, uri, changed, list_error), each version of a file once.

    ``levels`` folders deep the listing is dealt out anew before it goes on, below that a task lists whole trees. ``bundles`` as in ``list_corpus``.
    """
    spark.dataSource.register(ScanSource)
    files, root = open_uri(folder)
    for _ in children(files, root):  # a missing top folder is a mistake of the caller
        break
    by_child = bundles == "children"
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = spark.readStream.format("corpus_scans").load().select(
        F.lit(os.path.basename(root.rstrip("/"))).alias("bundle_id"), F.lit("").alias("path"), F.lit(None).cast("bigint").alias("size"),
        F.lit("").alias("uri"), F.lit(True).alias("is_folder"), F.lit(None).cast("bigint").alias("changed"),
        F.lit(None).cast("string").alias("list_error"), "until",
    )
    for _ in range(levels):
        found = found.mapInArrow(_expand(folder, by_child, False), ARRIVING).repartition(shards, "path")
    found = found.mapInArrow(_expand(folder, by_child, True), ARRIVING)
    due = found.where("changed IS NULL OR changed < until")
    if by_child:
        # Files beside the bundles belong to none; paths start below the bundle's folder.
        due = due.where(F.col("path").contains("/") | F.col("list_error").isNotNull())
        due = due.withColumn("path", F.substring("path", F.length("bundle_id") + 2, F.length("path")))
    return due.drop("is_folder", "until").dropDuplicates(["bundle_id", "path", "size", "changed", "list_error"])


def watch_corpus(
    spark: SparkSession, folder: str, bundles: str = "self", utf8: bool = False, levels: int = 2, shards: int | None = None
) -> DataFrame:
    """A ``files`` stream of what arrives anywhere below ``folder``; a file that cannot be read has its error."""
    read, schema = content_reader(utf8)
    return arriving_paths(spark, folder, bundles, levels, shards).mapInArrow(read, schema)
