"""Documents as Markdown or plain text, and Markdown read back.

A file is a heading with its path as a JSON string, a line of facts, and its text in a fence of back-ticks that is one longer than
the longest run of back-ticks in the text; so nothing in a text can close its fence, and reading back needs no escapes.
A row holds one whole file, as in XML documents, and the rows are ordered and written by the same sink.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.operators.classify import file_extension
from sheafspark.operators.document import ENTRIES, HEADER, STRUCTURE
from sheafspark.sources.bundles import written_files
from sheafspark.sources.corpus import BATCH_BYTES, open_uri

FILES = "bundle_id string, path string, size bigint, lines int, text string, comment string"


def quoted_path(path: Column) -> Column:
    """A JSON string on one line."""
    return F.get(F.regexp_extract_all(F.to_json(F.struct(path.alias("p"))), F.lit(r'(?s)\A\{"p":(.*)\}\z'), 1), F.lit(0))


def fence_of(text: Column) -> Column:
    """Back-ticks, three at least, and one more than any run of them in the text."""
    runs = F.regexp_extract_all(text, F.lit("(`+)"), 1)
    longest = F.aggregate(runs, F.lit(0), lambda a, r: F.greatest(a, F.length(r)))
    return F.repeat(F.lit("`"), F.greatest(longest + 1, F.lit(3)))


def markdown_rows(entries: DataFrame) -> DataFrame:
    """(bundle_id, section, sort_key, line) of Markdown documents: a title, a list of the files, the files."""
    path = F.col("path")
    title = entries.select("bundle_id").distinct().select(
        "bundle_id", F.lit(HEADER).alias("section"), F.lit("").alias("sort_key"),
        F.concat(F.lit("# "), F.regexp_replace("bundle_id", r"\s+", " "), F.lit("\n")).alias("line"),
    )
    listed = entries.select(
        "bundle_id", F.lit(STRUCTURE).alias("section"), F.concat(F.lit("1"), path).alias("sort_key"), F.concat(F.lit("- "), quoted_path(path)).alias("line")
    )
    fence = F.element_at(F.transform(F.array("body"), fence_of), 1)
    language = F.regexp_extract(file_extension(), r"\A[a-z0-9]+\z", 0)
    text = F.element_at(
        F.transform(F.array(fence), lambda f: F.concat(f, language, F.lit("\n"), F.col("body"), F.lit("\n"), f, F.lit("\n"))), 1
    )
    comment = F.concat(F.lit("> "), F.regexp_replace("diagnostic", r"\s+", " "), F.lit("\n"))
    facts = F.concat(F.lit("\n## "), quoted_path(path), F.lit("\n\n"), F.col("size"), F.lit(" bytes, "), F.col("lines"), F.lit(" lines\n\n"))
    bodies = entries.select(
        "bundle_id", F.lit(ENTRIES).alias("section"), F.concat(F.lit("1"), path).alias("sort_key"),
        F.concat(facts, F.when(F.col("body").isNotNull(), text).otherwise(comment)).alias("line"),
    )
    return title.unionByName(listed).unionByName(bodies)


def text_rows(entries: DataFrame) -> DataFrame:
    """(bundle_id, section, sort_key, line) of plain text documents: each file below a ruled line with its path."""
    path = F.col("path")
    return entries.select(
        "bundle_id", F.lit(ENTRIES).alias("section"), F.concat(F.lit("1"), path).alias("sort_key"),
        F.concat(F.lit("===== "), quoted_path(path), F.lit(" =====\n"), F.coalesce("body", F.concat(F.lit("("), "diagnostic", F.lit(")")))).alias("line"),
    )


_HEADING = re.compile(r'## (".*")\n')
_FACTS = re.compile(r"(\d+) bytes, (\d+) lines\n")
_FENCE = re.compile(r"(`{3,})[a-z0-9]*\n")


def parse_markdown(lines: Iterator[str]) -> Iterator[tuple]:
    """(path, size, lines, text, comment) of the files among the lines of a document or a part of one."""
    path = facts = None
    for line in lines:
        if heading := _HEADING.fullmatch(line):
            path, facts = json.loads(heading[1]), None
        elif path is None:
            continue
        elif facts is None:
            if found := _FACTS.fullmatch(line):
                facts = int(found[1]), int(found[2])
        elif fence := _FENCE.fullmatch(line):
            end, inside = fence[1] + "\n", []
            for line in lines:
                if line == end:
                    break
                inside.append(line)
            yield path, *facts, "".join(inside)[:-1], None
            path = None
        elif line.startswith("> "):
            yield path, *facts, None, line[2:-1]
            path = None


def read_markdown(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, path, size, lines, text, comment) of written Markdown documents; tasks stream whole files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in FILES.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, held = [], 0
        for incoming in batches:
            for bundle, uri in zip(incoming["bundle_id"].to_pylist(), incoming["file"].to_pylist()):
                files, path = open_uri(uri)
                with files.open_input_stream(path) as stream:
                    for entry in parse_markdown(io.TextIOWrapper(stream, encoding="utf-8", newline="\n")):
                        rows.append((bundle, *entry))
                        held += len(entry[3] or "")
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return written_files(spark, target).select("bundle_id", "file").mapInArrow(read, FILES)
