"""Line-level tables over decoded text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions import text as L


def explode_lines(decoded: DataFrame) -> DataFrame:
    """(bundle_id, path, line_no, line), one row per logical line."""
    return decoded.where("text IS NOT NULL").select(
        "bundle_id", "path", F.posexplode(L.split_lines(F.col("text"))).alias("_pos", "line")
    ).select("bundle_id", "path", (F.col("_pos") + 1).alias("line_no"), "line")


def line_stats(entries: DataFrame, *by: str) -> DataFrame:
    """Files, bytes and lines of text entries per group of columns.

    Medians and ninth deciles are exact: the smallest value that at least this share of the files does not exceed. Files are
    counted by value first, combined before the shuffle; the running counts then see each different value of a group
    once, in order. Group by ``classify.file_extension`` for a table by kind of file.
    """
    measures = F.array(
        F.struct(F.lit("lines").alias("measure"), F.col("lines").cast("bigint").alias("value")),
        F.struct(F.lit("size").alias("measure"), F.col("size").alias("value")),
    )
    counted = (
        entries.where("disposition = 'text'")
        .select(*by, F.inline(measures))
        .groupBy(*by, "measure", "value")
        .agg(F.count("*").alias("n"))
    )
    group = Window.partitionBy(*by, "measure")
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)
    ranked = counted.withColumns({"_upto": F.sum(known).over(upto), "_all": F.sum(known).over(group)})

    def of(measure: str, value: Column) -> Column:
        return F.when(F.col("measure") == measure, value)

    def at(measure: str, tenths: int) -> Column:
        # In whole numbers: a share like 0.9 is not exact as a double.
        return F.min(F.when(10 * F.col("_upto") >= tenths * F.col("_all"), of(measure, F.col("value"))))

    total = F.col("value") * F.col("n")
    return ranked.groupBy(*by).agg(
        F.sum(of("lines", F.col("n"))).alias("n_files"),
        F.sum(of("size", total)).alias("n_bytes"),
        F.sum(of("lines", total)).alias("n_lines"),
        F.max(of("lines", F.col("value"))).cast("int").alias("max_lines"),
        F.max(of("size", F.col("value"))).alias("max_bytes"),
        (F.sum(of("lines", total)) / F.sum(of("lines", known))).alias("avg_lines"),
        at("lines", 5).cast("int").alias("median_lines"),
        at("lines", 9).cast("int").alias("p90_lines"),
        at("size", 5).alias("median_bytes"),
        at("size", 9).alias("p90_bytes"),
    )
