"""Entries: what becomes of each file, its size and lines, and its XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import text as L
from sheafspark.functions import xml as X
from sheafspark.session import attach

# Diagnostics placed in the entry of a file without text.
BINARY_COMMENT = "This file is a binary file and not included"
OMITTED_COMMENT = "Text content omitted: XML 1.0 cannot represent character "
READ_ERROR_COMMENT = "Failed to read file: "


def build_entries(decoded: DataFrame, line_numbers: bool = False) -> DataFrame:
    """disposition, size, lines, diagnostic and body of each file.

    disposition is 'read_error', 'binary', 'xml_omitted' or 'text'. ``body``
    is the text as it will be packed; lines are counted on it.
    """
    disposition = """
        CASE WHEN read_error IS NOT NULL THEN 'read_error'
             WHEN binary_reason IS NOT NULL THEN 'binary'
             WHEN _bad IS NOT NULL THEN 'xml_omitted'
             ELSE 'text' END"""
    diagnostic = f"""
        CASE disposition WHEN 'read_error' THEN concat('{READ_ERROR_COMMENT}', read_error)
                         WHEN 'binary' THEN '{BINARY_COMMENT}'
                         WHEN 'xml_omitted' THEN concat('{OMITTED_COMMENT}', _bad.code_point) END"""
    # Text that the byte scan passed as clean needs no second scan, unless transcoded.
    checked = F.expr("coalesce(suspect, true) OR decode_class = 'transcoded'")
    judged = attach(
        decoded.withColumn("_bad", F.when(checked, X.first_invalid_char(F.col("text")))),
        disposition=F.expr(disposition),
    )
    text = L.number_lines(F.col("text")) if line_numbers else F.col("text")
    return (
        judged.withColumns(
            {
                "diagnostic": F.expr(diagnostic),
                "body": F.when(F.col("disposition") == "text", text),
                "size": F.expr("if(disposition = 'read_error', 0L, size)"),
                "code_point": F.col("_bad.code_point"),
                "byte_index": F.col("_bad.byte_index"),
            }
        )
        .withColumn("lines", F.coalesce(L.count_lines(F.col("body")), F.lit(0)))
        .drop("_bad", "content", "text")
    )


def _attr(name: str, value: Column) -> list[Column]:
    return [F.lit(f' {name}="'), value, F.lit('"')]


def entry_xml() -> Column:
    """The ``<file>`` element of an entry: text in CDATA, or a comment."""
    inner = F.when(F.col("diagnostic").isNull(), X.cdata(F.col("body"))).otherwise(X.comment(F.col("diagnostic")))
    return F.concat(
        F.lit("<file"),
        *_attr("path", X.escape_attr(F.col("path"))),
        *_attr("size", F.col("size").cast("string")),
        *_attr("lines", F.col("lines").cast("string")),
        F.lit(">"),
        inner,
        F.lit("</file>"),
    )


def render_entries(entries: DataFrame) -> DataFrame:
    return entries.withColumn("entry_xml", entry_xml())


# Fixed values: (condition, level, code, message), the message as a printf format and its arguments.
_LOST = "with replacement characters; information was lost"
DIAGNOSTICS = (
    ("source_encoding IS NOT NULL", "info", "converted", "Converted '%s' from %s to UTF-8", "path, source_encoding"),
    (
        "source_encoding IS NOT NULL AND had_replacements", "warning", "lossy_conversion",
        f"'%s' decoded as %s {_LOST}", "path, source_encoding",
    ),
    (
        "utf8_had_replacements", "warning", "malformed_utf8",
        f"'%s' contained malformed UTF-8 and was decoded {_LOST}", "path",
    ),
    (
        "disposition = 'xml_omitted'", "warning", "xml_omitted",
        "'%s' content was omitted because XML 1.0 cannot represent character %s", "path, code_point",
    ),
    ("disposition = 'read_error'", "error", "read_error", "Error reading file '%s': %s", "path, read_error"),
)


def diagnostics(entries: DataFrame, quiet: bool = False) -> DataFrame:
    """(bundle_id, path, level, code, message) for all that was converted, lost or left out.

    ``quiet`` keeps errors only.
    """
    rows = [
        F.when(
            F.expr(condition),
            F.struct(
                F.lit(level).alias("level"),
                F.lit(code).alias("code"),
                F.format_string(message, *arguments.split(", ")).alias("message"),
            ),
        )
        for condition, level, code, message, arguments in DIAGNOSTICS
        if level == "error" or not quiet
    ]
    return entries.select("bundle_id", "path", F.inline(F.filter(F.array(*rows), lambda r: r.isNotNull())))
