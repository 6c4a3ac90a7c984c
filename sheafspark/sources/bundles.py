"""Read written documents back: their entries and the structure section.

A document may lie in many files, but no row of it crosses from one file into
the next. So files are read as streams, one by one. The nesting of the
structure section does depend on earlier files; each file is reduced to the folders it closes and opens, and these
summaries are composed.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from xml.sax.saxutils import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafspark.operators.document import STRUCTURE_END
from sheafspark.session import stage
from sheafspark.sources.corpus import BATCH_BYTES, open_uri

ENTRIES = "bundle_id string, path string, size bigint, lines int, text string, comment string"

_START = re.compile(r'    <file path="([^"]*)" size="(\d+)" lines="(\d+)">(.*)', re.DOTALL)
_NODE = re.compile(r' {4,}<(file path|folder name)="([^"]*)"(?: /)?>\n?\Z')
_CLOSE = re.compile(r" {4,}</folder>\n?\Z")
_ENTITIES = {"&quot;": '"', "&apos;": "'", "&#xA;": "\n", "&#xD;": "\r"}


def bundle_of(file: Column) -> Column:
    """The bundle a written file belongs to, from its folder's name."""
    folder = F.regexp_extract(file, r"/bundle_id=([^/]+)/", 1)
    # Folder names escape with %XX only; a plus sign stands for itself.
    return F.url_decode(F.replace(folder, F.lit("+"), F.lit("%2B")))


def part_number(name: Column) -> Column:
    """The number of a part file: beyond 99,999 the order of names is no longer that of numbers."""
    return F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint")


def document_order(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, ordinal, file, length): the files of each written document in their order."""
    order = Window.partitionBy("bundle_id").orderBy(part_number(F.regexp_extract("file", r"[^/]*\z", 0)), "file")
    return written_files(spark, target).withColumn("ordinal", F.row_number().over(order))


def written_files(spark: SparkSession, target: str | list[str]) -> DataFrame:
    """(bundle_id, file, length) of the written files below one or several folders; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(target)
    return files.select(bundle_of(F.col("path")).alias("bundle_id"), F.col("path").alias("file"), "length")


def parse_entries(lines: Iterator[str]) -> Iterator[tuple]:
    """(path, size, lines, text, comment) of the entries among the lines of a file.

    Text cannot hold ``]]>`` unbroken, so only a real end tag follows one;
    newlines come out as an XML parser gives them.
    """
    attributes, inner, end = (), [], ""
    for line in lines:
        if not inner:
            start = _START.match(line)
            if not start:
                continue
            path, size, count, line = start.groups()
            attributes = (unescape(path, _ENTITIES), int(size), int(count))
            end = "--></file>\n" if line.startswith("<!--") else "]]></file>\n"
        inner.append(line)
        if line.endswith(end):
            content = "".join(inner)[: -len(end)]
            if end.startswith("-"):
                yield *attributes, None, content[len("<!--") :]
            else:
                text = content[len("<![CDATA[") :].replace("]]]]><![CDATA[>", "]]>")
                yield *attributes, text.replace("\r\n", "\n").replace("\r", "\n"), None
            inner = []


def read_bundles(spark: SparkSession, target: str | list[str]) -> DataFrame:
    """(bundle_id, path, size, lines, text, comment) of the entries of written documents.

    One of text and comment is null. Tasks take whole files, packed by size.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bundle_id", "path", "size", "lines", "text", "comment"]
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, held = [], 0
        for incoming in batches:
            for bundle, uri in zip(incoming["bundle_id"].to_pylist(), incoming["file"].to_pylist()):
                files, path = open_uri(uri)
                with files.open_input_stream(path) as stream:
                    for entry in parse_entries(io.TextIOWrapper(stream, encoding="utf-8", newline="\n")):
                        rows.append((bundle, *entry))
                        held += len(entry[3] or "")
                        if held >= BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    return written_files(spark, target).select("bundle_id", "file").mapInArrow(read, ENTRIES)


def structure_steps(lines: Iterator[str]) -> Iterator[tuple]:
    """What the lines of a file say about the structure section, whatever was open before them.

    Per file listed (levels closed that were opened earlier, names of the folders opened here and of the file, None), and in the
    end (levels closed, names still open, whether the section ends here).
    """
    closed, opened, ended = 0, [], False
    for line in lines:
        if node := _NODE.match(line):
            name = unescape(node[2], _ENTITIES)
            if node[1] == "file path":
                yield closed, [*opened, name], None
            else:
                opened.append(name)
        elif _CLOSE.match(line):
            if opened:
                opened.pop()
            else:
                closed += 1
        elif line.rstrip("\n") == STRUCTURE_END:
            # Texts may repeat the end tag or look like nodes, but only after the real one.
            ended = True
            break
    yield closed, opened, ended


def read_structure(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, path) of the files the structure section lists, from its nesting.

    The files of a document are streamed once, in tasks of their own. Each comes down to how many folders it closes that others
    opened and which it leaves open; these summaries, one row per file, are composed in order and give the folders that are open where
    a file begins. Depth costs nothing but the length of a list.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bundle_id", "number", "closed", "names", "ended"]
        types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.bool_()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows = []
        for incoming in batches:
            for bundle, uri, number in zip(*[incoming[c].to_pylist() for c in ("bundle_id", "file", "number")]):
                files, path = open_uri(uri)
                with files.open_input_stream(path) as stream:
                    for step in structure_steps(io.TextIOWrapper(stream, encoding="utf-8", newline="\n")):
                        rows.append((bundle, number, *step))
                        if len(rows) >= 20_000:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, stack, ended = None, [], False
        for incoming in batches:
            rows = []
            for this, number, closed, opened, ends in zip(*[c.to_pylist() for c in incoming.columns]):
                if this != bundle:
                    bundle, stack, ended = this, [], False
                if not ended:
                    rows.append((this, number, stack))
                    stack = stack[: len(stack) - closed] + opened
                    ended = ends
            columns = list(zip(*rows)) or [(), (), ()]
            types = [pa.string(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bundle_id", "number", "before"])

    name = F.regexp_extract("file", r"[^/]*\z", 0)
    parts = written_files(spark, target).select("bundle_id", "file", part_number(name).alias("number"))
    steps = stage(parts.mapInArrow(scan, "bundle_id string, number bigint, closed int, names array<string>, ended boolean"))
    ends = steps.where("ended IS NOT NULL").repartition("bundle_id").sortWithinPartitions("bundle_id", "number")
    begins = ends.mapInArrow(compose, "bundle_id string, number bigint, before array<string>")
    listed = steps.where("ended IS NULL").join(begins, ["bundle_id", "number"])
    above = F.slice("before", F.lit(1), F.size("before") - F.col("closed"))
    return listed.select("bundle_id", F.array_join(F.concat(above, "names"), "/").alias("path"))
