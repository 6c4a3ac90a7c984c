"""Any table of (bundle, path, text or bytes) as a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def from_table(df: DataFrame, bundle: Column, path: Column, content: Column) -> DataFrame:
    """The ``files`` form of a table; text content is taken as UTF-8 bytes."""
    picked = df.select(bundle.cast("string").alias("bundle_id"), path.alias("path"), content.alias("content"))
    if isinstance(picked.schema["content"].dataType, T.StringType):
        picked = picked.withColumn("content", F.encode("content", "UTF-8"))
    return picked.selectExpr(
        "bundle_id",
        "path",
        "CAST(octet_length(content) AS bigint) AS size",
        "content",
        "CAST(NULL AS string) AS read_error",
    )
