"""Make the functions without a built-in counterpart available to SQL."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

from sheafspark.functions.charset import transcode
from sheafspark.functions.tokens import Vocabulary, token_counter
from sheafspark.operators.metrics import gzip_size
from sheafspark.sources.corpus import CorpusSource


def register(spark: SparkSession, vocabularies: Mapping[str, Vocabulary] | None = None) -> None:
    """Registers transcode(content, mode), gzip_size_1 to gzip_size_9(text),
    n_tokens_<name>(text) per vocabulary, and the 'corpus' data source.
    """
    spark.udf.register("transcode", transcode)
    for level in range(1, 10):
        spark.udf.register(f"gzip_size_{level}", gzip_size(level))
    for name, vocabulary in (vocabularies or {}).items():
        spark.udf.register(f"n_tokens_{name}", token_counter(vocabulary))
    spark.dataSource.register(CorpusSource)
