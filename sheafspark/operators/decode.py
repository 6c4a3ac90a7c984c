"""Bytes to text: UTF-8, byte-order marks, UTF-16 and legacy charsets, with a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheafspark.functions import bytes as B
from sheafspark.functions.charset import transcode
from sheafspark.session import attach


def decode_files(classified: DataFrame, utf8: bool = False) -> DataFrame:
    """Adds text, source_encoding, had_replacements, utf8_had_replacements, decode_class.

    decode_class is 'valid', 'lossy', 'transcoded', 'binary' or 'error'.
    Without ``utf8`` everything is a built-in expression. With it the rows that
    need a charset codec, and only those, hand their bytes to an Arrow UDF.
    Transcoded text that looks like binary data ends as 'binary' with the
    reason ImplausibleDecodedData. A malformed file without a byte-order mark
    is lossy without a flag.
    """
    valid = "CASE WHEN binary_reason IS NULL THEN is_valid_utf8(CAST(content AS string)) END"
    df = classified.withColumn("_valid", F.expr(valid))
    if utf8:
        df = _transcoded(df)
        transcoded, implausible, out = "_transcoded", "_implausible", "_out"
    else:
        df = df.withColumn("_out", F.lit(None).cast("struct<text:string,encoding:string,had_replacements:boolean>"))
        transcoded, implausible, out = "false", "false", "_out"
    columns = {
        "text": f"""
            CASE WHEN content IS NULL OR binary_reason IS NOT NULL OR {implausible} THEN NULL
                 WHEN {transcoded} THEN {out}.text
                 WHEN _valid THEN CAST(content AS string)
                 ELSE make_valid_utf8(CAST(content AS string)) END""",
        "decode_class": f"""
            CASE WHEN content IS NULL THEN 'error'
                 WHEN binary_reason IS NOT NULL OR {implausible} THEN 'binary'
                 WHEN {transcoded} THEN 'transcoded' WHEN _valid THEN 'valid' ELSE 'lossy' END""",
        "source_encoding": f"CASE WHEN {transcoded} THEN {out}.encoding END",
        "had_replacements": f"coalesce({transcoded} AND {out}.had_replacements, false)",
        "utf8_had_replacements": f"coalesce({str(utf8).lower()} AND NOT _valid AND bom = 'UTF-8', false)",
        "binary_reason": f"CASE WHEN {implausible} THEN 'ImplausibleDecodedData' ELSE binary_reason END",
    }
    decoded = attach(df, **{name: F.expr(text) for name, text in columns.items()})
    return decoded.drop("_valid", "_mode", "_out", "_implausible", "_transcoded")


def _transcoded(df: DataFrame) -> DataFrame:
    """Adds the outcome of the charset codecs; null for rows that need none."""
    mode = """
        CASE WHEN content IS NULL OR binary_reason IS NOT NULL THEN NULL
             WHEN startswith(bom, 'UTF-16') THEN bom
             WHEN bom IS NULL AND NOT _valid THEN if(iso2022jp_candidate, 'jis+legacy', 'legacy')
             WHEN iso2022jp_candidate THEN 'jis' END"""
    df = df.withColumn("_mode", F.expr(mode))
    df = df.withColumn("_out", transcode(F.expr("if(_mode IS NOT NULL, content, NULL)"), F.col("_mode")))
    df = df.withColumn("_implausible", F.coalesce(B.is_implausible(F.col("_out.text")), F.lit(False)))
    return df.withColumn("_transcoded", F.expr("_out IS NOT NULL AND NOT _implausible"))


def conversion_report(decoded: DataFrame) -> DataFrame:
    """One row per transcoded file: where it came from and whether it lost anything."""
    return decoded.where("source_encoding IS NOT NULL").select(
        "bundle_id", "path", "size", "source_encoding", "had_replacements"
    )


def decode_metrics(decoded: DataFrame) -> DataFrame:
    """Per bundle: valid files by decoded bytes, transcoded files by source bytes."""
    return decoded.groupBy("bundle_id").agg(*_counters())


def observe_decoding(decoded: DataFrame, observation: Observation) -> DataFrame:
    """``decoded`` itself; the counters of the whole run appear in ``observation``."""
    return decoded.observe(observation, *_counters())


def _counters() -> list[Column]:
    valid, transcoded = F.col("decode_class") == "valid", F.col("decode_class") == "transcoded"
    zero = F.lit(0)
    return [
        F.count_if(valid).alias("valid_files"),
        F.coalesce(F.sum(F.when(valid, F.octet_length("text"))), zero).alias("valid_bytes"),
        F.count_if(transcoded).alias("transcoded_files"),
        F.coalesce(F.sum(F.when(transcoded, F.octet_length("content"))), zero).alias("transcoded_bytes"),
    ]
