"""Exact length histogram: one row per encoded length, with suffix sums for any context limit.

Null and empty texts have length 0. Every row of the table counts, repeated
rows as often as they occur; an empty table gives an empty histogram.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.llm.buffers import slices, text_of
from sheafspark.llm.storage import stage
from sheafspark.llm.tokens import encoder

#: Lengths per block; suffix sums run inside blocks and over blocks.
BLOCK = 1024


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per text: n_tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", 8 * 1024 * 1024):
                _, offsets = encoder(tokenizer).encode(text_of(rows.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets))], ["n_tokens"])

    return docs.select("text").mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, n_docs) with suffix sums, from one row per document.

    Columns: docs_at_least and tokens_at_least over documents of this length or more, truncated_total, the tokens left if
    every document is cut to this length, total_docs, total_tokens, and
    share_at_most, the share of documents of at most this length. The counts are
    combined before the shuffle; the sums run over blocks of lengths, so no task holds all lengths.
    """
    counts = stage(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(everything).alias("total_docs"),
        F.sum("tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.col("docs_later") + F.sum("n_docs").over(inside)).alias("docs_at_least"),
        (F.col("tokens_later") + F.sum(tokens).over(inside)).alias("tokens_at_least"),
        "total_docs",
        "total_tokens",
    )
    return summed.select(
        "*",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("total_docs")).alias("share_at_most"),
    )


def truncated_totals(histogram: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(limit, docs_cut, tokens_kept) for each context limit, from the suffix sums of the first length above it.

    One aggregate over the histogram answers all limits; an empty histogram gives zeros.
    """
    above = F.col("n_tokens") > F.col("limit")
    wanted = histogram.withColumn("limit", F.explode(F.array([F.lit(int(x)).cast("long") for x in limits])))
    first = F.min(F.when(above, F.struct("n_tokens", "docs_at_least", "tokens_at_least")))
    answers = wanted.groupBy("limit").agg(first.alias("a"), F.max("total_tokens").alias("total"))
    asked = histogram.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "limit long")
    zero = F.lit(0).cast("long")
    cut = F.coalesce(F.col("a.docs_at_least"), zero)
    kept = F.coalesce(F.col("total"), zero) - F.coalesce(F.col("a.tokens_at_least"), zero) + F.col("limit") * cut
    return asked.join(answers, "limit", "left").select("limit", cut.alias("docs_cut"), kept.alias("tokens_kept"))


def length_quantiles(histogram: DataFrame, shares: Sequence[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least this share of documents does not exceed."""
    wanted = histogram.withColumn("share", F.explode(F.array([F.lit(float(x)) for x in shares])))
    return wanted.where("share_at_most >= share").groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
