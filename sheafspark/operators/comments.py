"""Source texts without their comments and doc strings.

A family of languages has a lexer that works line by line: all it must know of earlier lines is one of few states (in a
block comment, in a string of several lines). So a stretch of lines acts as a map from the state before it to the state after it, and such maps
compose in any grouping. Files of one cell are stripped in one pass (``strip_comments``). Line tables may be cut anywhere, also inside a
file (``strip_lines``): each partition reduces the file it begins or ends in to its map, the maps of earlier
partitions give the state a partition starts in, and a second pass strips.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions.batches import slices
from sheafspark.operators.classify import file_extension
from sheafspark.session import stage

CODE = 0


@dataclass(frozen=True)
class Span:
    """Something that may go on over lines: how it opens, how it ends, whether it is dropped, whether only at a line's start.

    ``escapes``: a backslash takes the next character with it.
    """

    opens: str
    ends: str
    dropped: bool
    leading: bool = False
    escapes: bool = False


@dataclass(frozen=True)
class Family:
    """Spans over lines (state i + 1 is inside span i), line comments, and quotes of strings that end with their line.

    Where several spans open alike, the first whose ``leading`` fits is taken.
    """

    spans: tuple[Span, ...]
    line_comments: tuple[str, ...]
    quotes: str = ""
    word_start: bool = False  # a line comment begins only at the start or after white space


_TRIPLES = tuple(Span(q * 3, q * 3, dropped, dropped, True) for dropped in (True, False) for q in "\"'")

# Families by their comment and string marks, and file extensions.
FAMILIES = {
    "c": Family((Span("/*", "*/", True), Span("`", "`", False, escapes=True)), ("//",), "\"'"),
    "hash": Family((), ("#",), "\"'", word_start=True),
    "python": Family(_TRIPLES, ("#",), "\"'"),
    "sql": Family((Span("/*", "*/", True),), ("--",), "\"'"),
    "markup": Family((Span("<!--", "-->", True),), ()),
}
EXTENSIONS = {
    "c": ("c", "cc", "cpp", "cs", "go", "h", "hpp", "java", "js", "jsx", "kt", "rs", "scala", "swift", "ts", "tsx"),
    "hash": ("bash", "conf", "r", "rb", "sh", "toml", "yaml", "yml"),
    "python": ("py", "pyi"),
    "sql": ("sql",),
    "markup": ("htm", "html", "svg", "xml"),
}


@lru_cache(maxsize=None)
def _token(name: str) -> re.Pattern:
    """What matters in code: a span's opening, a line comment, or a whole string. A quote without its partner is no string."""
    family = FAMILIES[name]
    marks = sorted({s.opens for s in family.spans} | set(family.line_comments), key=len, reverse=True)
    strings = [rf"{q}(?:\\.|[^{q}\\])*{q}" for q in family.quotes]
    return re.compile("|".join([*map(re.escape, marks), *strings]), re.DOTALL)


@lru_cache(maxsize=None)
def _end(ends: str, escapes: bool) -> re.Pattern:
    return re.compile(rf"(?:\\.|(?!{re.escape(ends)})[^\\]|\\\Z)*?{re.escape(ends)}" if escapes else rf".*?{re.escape(ends)}", re.DOTALL)


def strip_line(name: str, state: int, line: str) -> tuple[int, str, bool]:
    """(state after, what is left, whether something was dropped) of a line without its end."""
    family, token = FAMILIES[name], _token(name)
    at, kept, dropped = 0, [], False
    while True:
        if state != CODE:
            span = family.spans[state - 1]
            match = _end(span.ends, span.escapes).match(line, at)
            stop = match.end() if match else len(line)
            if span.dropped:
                dropped = True
            else:
                kept.append(line[at:stop])
            if not match:
                return state, "".join(kept), dropped
            at, state = stop, CODE
        match = token.search(line, at)
        while match and match.group() in family.line_comments and family.word_start and not _at_word(line, match.start()):
            match = token.search(line, match.end())
        if not match:
            kept.append(line[at:])
            return CODE, "".join(kept), dropped
        found = match.group()
        if found in family.line_comments:
            kept.append(line[at : match.start()])
            return CODE, "".join(kept), True
        opened = [i for i, s in enumerate(family.spans, 1) if s.opens == found]
        if not opened:
            kept.append(line[at : match.end()])
            at = match.end()
            continue
        leading = not line[: match.start()].strip()
        state = next(i for i in opened if family.spans[i - 1].leading <= leading)
        kept.append(line[at : match.start()])
        if not family.spans[state - 1].dropped:
            kept.append(found)
        at = match.end()


def _at_word(line: str, place: int) -> bool:
    return place == 0 or line[place - 1].isspace()


def _shown(left: str, dropped: bool) -> str | None:
    """What a line becomes: trailing white space before a comment goes, and so does a line that held nothing else."""
    if not dropped:
        return left
    return left.rstrip() or None


def strip_text(name: str, text: str) -> str:
    """A text without comments; its line ends become LF."""
    lines = re.sub(r"\r\n?", "\n", text).split("\n")
    out, state = [], CODE
    for line in lines:
        state, left, dropped = strip_line(name, state, line)
        shown = _shown(left, dropped)
        if shown is not None:
            out.append(shown)
    return "\n".join(out)


def family_of(path: str = "path") -> Column:
    """Family of a path's extension, null for others."""
    extension, found = file_extension(path), F.lit(None).cast("string")
    for name, extensions in EXTENSIONS.items():
        found = F.when(extension.isin(*extensions), name).otherwise(found)
    return found


def strip_comments(texts: DataFrame) -> DataFrame:
    """Rows (bundle_id, path, text) with ``stripped``: the text without comments; texts of other files as they are."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in slices(batch.column("text")):
                rows = batch.slice(start, len(texts))
                start += len(texts)
                pairs = zip(texts.to_pylist(), rows.column("family").to_pylist())
                done = [text if text is None or name is None else strip_text(name, text) for text, name in pairs]
                kept = [rows.column(c) for c in ("bundle_id", "path", "text")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(done, pa.string())], ["bundle_id", "path", "text", "stripped"])

    rows = texts.select("bundle_id", "path", "text", family_of().alias("family"))
    return rows.mapInArrow(strip, "bundle_id string, path string, text string, stripped string")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def strip_lines(lines: DataFrame) -> DataFrame:
    """A line table (bundle_id, path, line_no, line) without comments; lines that held nothing else are gone.

    Lines are split by range over files and line numbers, so a file of any length is the work of several tasks.
    """
    keys = ["bundle_id", "path", "line_no"]
    known = lines.select("bundle_id", "path", F.col("line_no").cast("long").alias("line_no"), "line", family_of().alias("family"))
    placed = stage(known.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(file, part, states):
            return {"bundle_id": file[0], "path": file[1], "part": part, "states": states}

        # Only the first and the last file of a task may go on elsewhere, but their maps cost no more than those of all.
        found, file, states = [], None, []
        for bundle, path, line, name, part in _runs(batches):
            if file != (bundle, path, part):
                if file:
                    found.append(made(file, file[2], states))
                file, states = (bundle, path, part), list(range(len(FAMILIES[name].spans) + 1)) if name else [CODE]
            if name:
                after = {s: strip_line(name, s, line)[0] for s in set(states)}
                states = [after[s] for s in states]
        if file:
            found.append(made(file, file[2], states))
        schema = pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("part", pa.int32()), ("states", pa.list_(pa.int32()))])
        yield pa.RecordBatch.from_pylist(found, schema)

    maps = placed.select("bundle_id", "path", "line", "family", "_part").mapInArrow(
        reduce, "bundle_id string, path string, part int, states array<int>"
    )
    before = Window.partitionBy("bundle_id", "path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    state = F.aggregate(F.collect_list("states").over(before), F.lit(CODE), lambda s, m: m[s])
    starts = maps.select("bundle_id", "path", F.col("part").alias("_part"), state.alias("state")).where("state <> 0")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, state = None, CODE
        names, types = [*keys, "line"], [pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            rows = []
            for bundle, path, number, line, name, first, part in _runs([batch]):
                if file != (bundle, path, part):
                    file, state = (bundle, path, part), first or CODE
                shown = line
                if name:
                    state, left, dropped = strip_line(name, state, line)
                    shown = _shown(left, dropped)
                if shown is not None:
                    rows.append((bundle, path, number, shown))
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    # One row per file that begins a task inside a comment or string; broadcast only where that is small.
    joined = placed.join(starts, ["bundle_id", "path", "_part"], "left").select(*keys, "line", "family", "state", "_part")
    sorted_again = joined.repartition("_part").sortWithinPartitions("_part", *keys)
    return sorted_again.mapInArrow(strip, "bundle_id string, path string, line_no bigint, line string")
