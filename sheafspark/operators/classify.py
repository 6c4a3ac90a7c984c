"""Text or binary: the classification cascade and its profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import bytes as B
from sheafspark.session import attach


def classify(files: DataFrame, utf8: bool = False) -> DataFrame:
    """Adds bom, suspect, binary_reason, binary_detail, iso2022jp_candidate.

    Text has a null ``binary_reason``. ``utf8`` says whether UTF-16 and legacy
    content will be transcoded later; without it UTF-16 counts as binary.
    ``suspect`` is false where no character needs a closer look. Rows with a
    ``read_error`` have null content and are left unclassified. Content that a
    probe read has cut (``truncated``) must be binary here as well; otherwise
    the reader ran with another ``utf8``, and the query fails rather than pass
    the cut content on.
    """
    content = F.col("content")
    reason = f"""
        CASE WHEN content IS NULL THEN NULL
             WHEN startswith(bom, 'UTF-16') THEN {"NULL" if utf8 else "'Utf16ConversionDisabled'"}
             WHEN _magic IS NOT NULL AND NOT contains(substring(content, 1, {B.PROBE_BYTES}), X'00')
               THEN 'RecognizedMagic'
             WHEN contains(content, X'00') THEN 'NullByte'
             WHEN _density > {B.CONTROL_DENSITY} THEN 'ControlDensity' END"""
    if "truncated" in files.columns:
        cut = "raise_error(concat('only the start of ', path, ' was read, for other options than these'))"
        reason = f"CASE WHEN truncated AND ({reason}) IS NULL THEN CAST({cut} AS string) ELSE {reason} END"
    detail = """
        CASE binary_reason WHEN 'RecognizedMagic' THEN _magic
                           WHEN 'Utf16ConversionDisabled' THEN bom END"""
    jis_escapes = " OR ".join(f"contains(content, X'{e}')" for e in B.JIS_ESCAPES)
    candidate = f"coalesce(bom IS NULL AND binary_reason IS NULL AND ({jis_escapes}), false)"
    marked = files.withColumns({"bom": B.bom(content), "_head": B.head(content)})
    marked = marked.withColumns({"_magic": B.magic_mime("_head"), "suspect": B.is_suspect(content)})
    marked = marked.withColumn("_magic", B.refined_mime("_magic", "content"))
    marked = marked.withColumn("_density", B.control_density(B.payload(content), F.col("suspect")))
    reasoned = attach(marked, binary_reason=F.expr(reason))
    return reasoned.withColumns(
        {"binary_detail": F.expr(detail), "iso2022jp_candidate": F.expr(candidate)}
    ).drop("_head", "_magic", "_density")


def file_extension(path: str = "path") -> Column:
    """Lower-case extension of a path column, '' without one."""
    return F.lower(F.regexp_extract(F.col(path), r"[^/]\.([^./]+)$", 1))


def classification_profile(classified: DataFrame) -> DataFrame:
    """Files and bytes by reason, detail and extension."""
    return classified.groupBy(
        F.coalesce("binary_reason", F.lit("text")).alias("reason"),
        F.coalesce("binary_detail", F.lit("")).alias("detail"),
        file_extension().alias("extension"),
    ).agg(F.count("*").alias("n_files"), F.sum("size").alias("n_bytes"))


def classification_rollup(classified: DataFrame) -> DataFrame:
    """Files and bytes per bundle and reason, with sub-totals and a total."""
    keyed = classified.select("bundle_id", F.coalesce("binary_reason", F.lit("text")).alias("reason"), "size")
    return keyed.rollup("bundle_id", "reason").agg(
        F.grouping_id().alias("level"), F.count("*").alias("n_files"), F.sum("size").alias("n_bytes")
    )
