"""Write documents: one folder per bundle whose files, by the number in their names, are the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.session import stage
from sheafspark.sources.bundles import written_files

# Hadoop's names of the deflate levels.
ZLIB_LEVELS = {
    1: "BEST_SPEED",
    2: "TWO",
    3: "THREE",
    4: "FOUR",
    5: "FIVE",
    6: "SIX",
    7: "SEVEN",
    8: "EIGHT",
    9: "BEST_COMPRESSION",
}

ORDER = ("bundle_id", "section", "sort_key")


def write_bundles(
    rows: DataFrame,
    target: str,
    gzip_level: int | None = None,
    staged: bool = False,
    partitions: int | None = None,
    mode: str = "error",
) -> None:
    """Write document rows below ``target``, plain or as gzip.

    Rows are split by range, so a huge bundle spreads over many tasks and
    files; gzip files put one after the other are again one gzip stream.
    Finding the ranges reads the rows twice, so they are staged first unless
    ``staged`` says they already come from a cheap table. ``partitions`` should
    give tasks that sort in memory (about total bytes / 256 MB); by default
    it is the session's number of shuffle partitions, small ones merged. A
    bundle needs a name: null and empty ids would end in the same folder.
    ``sources.bundles.document_order`` lists the files of a document in order.
    """
    bundle = F.col("bundle_id").cast("string")
    unnamed = F.raise_error(F.lit("a bundle without a name cannot be written"))
    # Before the sort, so that the writer finds its partition column already in order.
    named = F.when(bundle.isNull() | (bundle == ""), unnamed).otherwise(bundle)
    rows = (rows if staged else stage(rows)).withColumn("bundle_id", named)
    ranges = rows.repartitionByRange(partitions, *ORDER) if partitions else rows.repartitionByRange(*ORDER)
    ordered = ranges.sortWithinPartitions(*ORDER)
    writer = ordered.select("bundle_id", F.col("line").alias("value")).write.mode(mode).partitionBy("bundle_id")
    if gzip_level is not None:
        writer = writer.option("compression", "gzip").option("zlib.compress.level", ZLIB_LEVELS[gzip_level])
    writer.text(target)


def effective_name(name: Column, gzip: Column) -> Column:
    """Output name of a bundle; compressed output ends in .gz."""
    extension = F.lower(F.regexp_extract(name, r"[^/]\.([^./]*)$", 1))
    return F.when(gzip & (extension != "gz"), F.concat(name, F.lit(".gz"))).otherwise(name)


def sink_names(plan: DataFrame, name: str = "output_file", gzip: str = "gzip") -> DataFrame:
    return plan.withColumn("effective_file", effective_name(F.col(name), F.col(gzip)))


def written_bytes(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, output_bytes) of the written documents."""
    return written_files(spark, target).groupBy("bundle_id").agg(F.sum("length").alias("output_bytes"))


def write_summary(bundles: DataFrame, target: str) -> None:
    bundles.write.mode("overwrite").parquet(target)
