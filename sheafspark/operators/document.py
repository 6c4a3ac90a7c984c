"""The packed document as ordered rows: header, structure, files, footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import xml as X
from sheafspark.operators.entries import entry_xml
from sheafspark.operators.tree import structure_rows

HEADER, STRUCTURE, ENTRIES, FOOTER = 0, 1, 2, 3

# Own wording of the document's explanation of itself, by element.
SUMMARY_TEXTS = {
    "purpose": (
        "One document holding the readable content of a collection of files,\n"
        "laid out so that a program or a language model can take it in at once."
    ),
    "file_format": (
        "1. This summary.\n"
        "2. repository_structure: the folders and files, nested by name.\n"
        "3. repository_files: one element per file with its path, its size in bytes,\n"
        "   its number of lines, and its text in CDATA. Binary files and text that\n"
        "   XML 1.0 cannot hold carry a comment instead."
    ),
    "instructions": (
        "- Look at the files themselves, their text, layout and purpose.\n"
        "- Leave the markup of this document out of the discussion.\n"
        "- Take the language of a file from the extension of its path."
    ),
    "usage_guidelines": (
        "- Read only: make changes in the original files.\n"
        "- Tell files apart by their full path.\n"
        "- The content may be confidential; treat it like its source."
    ),
    "notes": (
        "- Paths ruled out by ignore files or by the exclusion options are missing.\n"
        "- The structure section lists every kept file, also those without text."
    ),
    "additional_info": "Written by sheafspark.",
}
LINE_NUMBER_NOTE = (
    "\n- Every line starts with its number, padded to equal width, and two spaces.\n"
    "  The numbers are for reference and are not part of the file."
)
STRUCTURE_END = "  </repository_structure>"
STRUCTURE_SUMMARY = "The folders and files of the collection."
FILES_SUMMARY = "The files with their full paths and, where it can be shown, their text."


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def header_text(line_numbers: bool = False) -> str:
    lines = ['<?xml version="1.0" encoding="utf-8"?>', "<repository>", "  <file_summary>"]
    for name, text in SUMMARY_TEXTS.items():
        if name == "instructions" and line_numbers:
            text += LINE_NUMBER_NOTE
        lines.append(f"    <{name}>{_escape(text)}</{name}>")
    return "\n".join([*lines, "  </file_summary>"])


def frame_rows(line_numbers: bool = False) -> list[tuple[int, str, str]]:
    """(section, sort_key, line) of the rows every document has."""
    return [
        (HEADER, "", header_text(line_numbers)),
        (STRUCTURE, "", f"  <repository_structure>\n    <summary>{_escape(STRUCTURE_SUMMARY)}</summary>"),
        (STRUCTURE, "3", STRUCTURE_END),
        (ENTRIES, "", f"  <repository_files>\n    <summary>{_escape(FILES_SUMMARY)}</summary>"),
        (ENTRIES, "3", "  </repository_files>"),
        (FOOTER, "", "</repository>"),
    ]


def metadata_rows(metadata: DataFrame) -> DataFrame:
    """(bundle_id, section, sort_key, line) of a table (bundle_id, name, value): what users say about their bundles.

    They follow the summary, one row per value, by name and value. Names and values are escaped; what XML cannot
    hold becomes U+FFFD. Null values are empty.
    """

    def attribute(value: Column) -> Column:
        return X.escape_attr(F.regexp_replace(F.coalesce(value, F.lit("")), X.INVALID_ATTRIBUTE_CLASS, "\ufffd"))

    frame = F.array(
        F.struct(F.lit("1").alias("sort_key"), F.lit("  <metadata>").alias("line")),
        F.struct(F.lit("3").alias("sort_key"), F.lit("  </metadata>").alias("line")),
    )
    framed = metadata.select("bundle_id").distinct().select("bundle_id", F.inline(frame))
    name, value = attribute(F.col("name")), attribute(F.col("value"))
    body = metadata.select(
        "bundle_id",
        F.concat(F.lit("2"), F.coalesce("name", F.lit("")), F.lit("\x01"), F.coalesce("value", F.lit(""))).alias("sort_key"),
        F.concat(F.lit('    <entry name="'), name, F.lit('" value="'), value, F.lit('" />')).alias("line"),
    )
    return framed.unionByName(body).select("bundle_id", F.lit(HEADER).alias("section"), "sort_key", "line")


def document_rows(
    entries: DataFrame, files: DataFrame | None = None, line_numbers: bool = False, metadata: DataFrame | None = None
) -> DataFrame:
    """(bundle_id, section, sort_key, line); in that order the lines are the document.

    The structure section and the frame take their paths from ``files``, whose
    content is then not read. Leave it out only if ``entries`` is a staged
    table, or its texts would be decoded again for their paths. No row holds
    more than one file. ``metadata`` (bundle_id, name, value) adds what users say about their bundles.
    """
    paths = (files if files is not None else entries).select("bundle_id", "path")
    frame = F.array(
        *[
            F.struct(F.lit(s).alias("section"), F.lit(k).alias("sort_key"), F.lit(v).alias("line"))
            for s, k, v in frame_rows(line_numbers)
        ]
    )
    framed = paths.select("bundle_id").distinct().select("bundle_id", F.inline(frame))
    structure = structure_rows(paths).select("bundle_id", F.lit(STRUCTURE).alias("section"), "sort_key", "line")
    body = entries.select(
        "bundle_id",
        F.lit(ENTRIES).alias("section"),
        F.concat(F.lit("1"), F.col("path")).alias("sort_key"),
        F.concat(F.lit("    "), entry_xml()).alias("line"),
    )
    rows = framed.unionByName(structure).unionByName(body)
    if metadata is None:
        return rows
    known = metadata.join(paths.select("bundle_id").distinct(), "bundle_id", "left_semi")
    return rows.unionByName(metadata_rows(known))


def document_chunk(newline: str = "next") -> Column:
    """The row's share of the document text; the shares joined are the text.

    Every row ends in ``>``, so the newline after it is always on a border of
    pre-tokens, either before it ('next') or after it ('previous').
    """
    if newline == "previous":
        return F.concat(F.col("line"), F.lit("\n"))
    first = (F.col("section") == HEADER) & (F.col("sort_key") == "")
    last = F.col("section") == FOOTER
    return F.concat(
        F.when(first, F.lit("")).otherwise(F.lit("\n")),
        F.col("line"),
        F.when(last, F.lit("\n")).otherwise(F.lit("")),
    )


def with_lengths(rows: DataFrame) -> DataFrame:
    """Document rows with ``row_bytes``, the row's share of the document in bytes; staged so, sizes need no text."""
    return rows.withColumn("row_bytes", F.octet_length("line") + 1)


def document_sizes(rows: DataFrame) -> DataFrame:
    """Files, rows and bytes of each document, in one pass over its rows."""
    row_bytes = F.col("row_bytes") if "row_bytes" in rows.columns else F.octet_length("line") + 1
    is_file = (F.col("section") == ENTRIES) & F.startswith(F.col("sort_key"), F.lit("1"))
    return rows.groupBy("bundle_id").agg(
        F.count_if(is_file).alias("n_files"),
        F.count("*").alias("n_rows"),
        F.sum(row_bytes).cast("bigint").alias("xml_bytes"),
    )
