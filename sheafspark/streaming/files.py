"""Files that keep arriving: the per-file operators on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafspark.options import BundleOptions
from sheafspark.plans.pack import entries_of

def _bare(folder: str) -> str:
    """The path of a folder without scheme and outer slashes."""
    if "://" in folder:
        folder = folder.split("://", 1)[1]
    elif folder.startswith("file:"):
        folder = folder.removeprefix("file:")
    return folder.strip("/")


_BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def watch_files(spark: SparkSession, folder: str, bundle_id: str, max_files: int = 1000) -> DataFrame:
    """A ``files`` stream of what lands in ``folder``; paths are relative to it.

    Files that vanish before they are read are passed over. Spark's file stream
    does not see names that begin with a dot or an underscore; a batch run
    (``read_corpus``) does.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .schema(_BINARY_FILE)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .option("ignoreMissingFiles", "true")
        .load(folder)
    )
    # Spark reports whole URIs. The root is their start, wherever its name occurs again below.
    path, root = F.regexp_replace("path", r"^[a-z][a-z0-9+.-]*:/*", "/"), f"/{_bare(folder)}/"
    relative = F.substring(path, F.lit(len(root) + 1), F.length("path"))
    return arriving.select(
        F.lit(bundle_id).alias("bundle_id"),
        relative.alias("path"),
        F.col("length").alias("size"),
        "content",
        F.lit(None).cast("string").alias("read_error"),
    )


def write_entries(files: DataFrame, target: str, checkpoint: str, options: BundleOptions = BundleOptions()) -> StreamingQuery:
    """Append the entries of arriving files to a table; stops when all input is taken."""
    return (
        entries_of(files, options)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def running_totals(files: DataFrame, options: BundleOptions = BundleOptions()) -> DataFrame:
    """Files, bytes and lines so far per bundle and disposition (update or complete mode)."""
    return (
        entries_of(files, options)
        .groupBy("bundle_id", "disposition")
        .agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"), F.sum("lines").alias("n_lines"))
    )
