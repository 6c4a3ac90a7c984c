"""The whole run: from a ``files`` table to documents, metrics and diagnostics."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions.tokens import Vocabulary
from sheafspark.operators.classify import classify
from sheafspark.operators.decode import decode_files
from sheafspark.operators.document import document_rows, document_sizes, with_lengths
from sheafspark.operators.entries import build_entries, diagnostics
from sheafspark.operators.metrics import bundle_metrics
from sheafspark.operators.select import exclude_paths, require_safe_paths
from sheafspark.operators.tokens import bundle_tokens, display_name, vocabulary_for
from sheafspark.options import BundleOptions
from sheafspark.session import stage
from sheafspark.sinks.bundles import write_bundles, written_bytes


def entries_of(files: DataFrame, options: BundleOptions = BundleOptions()) -> DataFrame:
    """Filter, classify, decode and measure; narrow, so it also runs on streams."""
    return _kept_entries(exclude_paths(files, options.extend_exclude, options.exclude), options)


def _kept_entries(kept: DataFrame, options: BundleOptions) -> DataFrame:
    decoded = decode_files(classify(kept, options.utf8), options.utf8)
    return build_entries(decoded, options.line_numbers)


@dataclass(frozen=True)
class Packed:
    entries: DataFrame
    rows: DataFrame
    metrics: DataFrame
    diagnostics: DataFrame


def pack(
    files: DataFrame,
    target: str,
    options: BundleOptions = BundleOptions(),
    vocabularies: Mapping[str, Vocabulary] | None = None,
    quiet: bool = False,
) -> Packed:
    """Write one document per bundle below ``target`` and return the result tables.

    Bad names stop the run before anything is written, and so does a model
    without its vocabulary among ``vocabularies`` (vocabulary name -> file);
    without any, tokens are not counted. Raw content is read
    and decoded once, into a staged table of entries, and rendered once, into
    one of document rows with their lengths; the documents, metrics
    and diagnostics read those tables, each only the columns it needs.
    """
    vocabulary = vocabulary_for(options.model, vocabularies) if vocabularies is not None else None
    safe = require_safe_paths(exclude_paths(files, options.extend_exclude, options.exclude), options.on_bad_path)
    entries = stage(_kept_entries(safe, options))
    measured = stage(with_lengths(document_rows(entries, line_numbers=options.line_numbers)))
    rows = measured.drop("row_bytes")
    write_bundles(rows, target, options.gzip_level if options.gzip else None, staged=True)
    tokens = bundle_tokens(rows, vocabulary) if vocabulary else None
    outputs = written_bytes(files.sparkSession, target) if options.gzip else None
    metrics = bundle_metrics(document_sizes(measured), tokens, outputs)
    if vocabulary:
        metrics = metrics.withColumn("model", F.lit(display_name(options.model)))
    return Packed(entries, rows, metrics, diagnostics(entries, quiet))
