"""Run metrics, disposition roll-ups, largest files, compression profile."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bundle_metrics(
    sizes: DataFrame, tokens: DataFrame | None = None, outputs: DataFrame | None = None
) -> DataFrame:
    """One row per bundle: kept files, document bytes, written bytes, tokens.

    ``sizes`` comes from the document rows, ``outputs`` from the written files;
    without ``outputs`` nothing was compressed and both byte counts are equal.
    All inputs hold one row per bundle, so the joins are small.
    """
    result = sizes.select("bundle_id", "n_files", "xml_bytes")
    if outputs is not None:
        result = result.join(outputs, "bundle_id")
    else:
        result = result.withColumn("output_bytes", F.col("xml_bytes"))
    return result.join(tokens, "bundle_id") if tokens is not None else result


def disposition_cube(entries: DataFrame) -> DataFrame:
    """Files, bytes and lines over bundle and disposition in all combinations."""
    return entries.cube("bundle_id", "disposition").agg(
        F.grouping_id().alias("level"),
        F.count("*").alias("n_files"),
        F.sum("size").alias("n_bytes"),
        F.sum("lines").cast("bigint").alias("n_lines"),
    )


def largest(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n rows with the largest ``by``; ties are settled by the path."""
    ties = [c for c in ("bundle_id", "path") if c in df.columns]
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def gzip_size(level: int):
    """Arrow UDF text -> bytes of one gzip member at ``level``."""

    @F.arrow_udf(T.LongType())
    def size(texts: pa.Array) -> pa.Array:
        sizes = []
        for text in texts.to_pylist():
            if text is None:
                sizes.append(None)
                continue
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            sizes.append(len(packer.compress(text.encode())) + len(packer.flush()))
        return pa.array(sizes, pa.int64())

    return size


def compression_profile(rows: DataFrame, levels: Sequence[int] = (1, 6, 9)) -> DataFrame:
    """(bundle_id, level, plain_bytes, gzip_bytes); members are cut per document row."""
    line = F.concat(F.col("line"), F.lit("\n"))
    sized = rows.select(
        "bundle_id",
        F.octet_length(line).alias("plain"),
        *[gzip_size(level)(line).alias(f"z{level}") for level in levels],
    )
    sums = sized.groupBy("bundle_id").agg(
        F.sum("plain").cast("bigint").alias("plain_bytes"), *[F.sum(f"z{level}").alias(f"z{level}") for level in levels]
    )
    pairs = F.array(
        *[F.struct(F.lit(level).alias("level"), F.col(f"z{level}").alias("gzip_bytes")) for level in levels]
    )
    return sums.select("bundle_id", "plain_bytes", F.inline(pairs))
