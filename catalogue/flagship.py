"""The flagship query: path filter, classification, decoding and measures in one narrow pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.sql import with_
from sheafspark.plans.pack import entries_of


def bundle_overview(spark, sf):
    entries = entries_of(C.docs(spark, sf))
    is_text = F.col("disposition") == "text"
    return entries.groupBy("bundle_id").agg(
        F.count("*").alias("n_files"),
        F.sum("size").alias("n_bytes"),
        F.sum("lines").alias("n_lines"),
        F.count_if(is_text).alias("text_files"),
        F.count_if(~is_text).alias("other_files"),
    )


QUERIES = {"bundle_overview": bundle_overview}

SQL = {
    "bundle_overview": with_(C.DOCS)
    + f"""SELECT bundle_id, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes,
  CAST(sum({Q.lines('text')}) AS BIGINT) AS n_lines, count(*) AS text_files, CAST(0 AS BIGINT) AS other_files
FROM docs WHERE NOT {C.DEFAULT_EXCLUDED} GROUP BY bundle_id"""
}
