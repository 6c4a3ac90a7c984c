"""Line expressions over decoded text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with the value computed once rather than at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR become LF; text without CR is passed on untouched."""
    cr = F.lit("\r")
    fixed = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), cr, F.lit("\n"))
    return F.when(F.contains(text, cr), fixed).otherwise(text)


def count_lines(text: Column) -> Column:
    """Lines ended by a newline plus an unended last one; '' has none."""
    lines = normalize_newlines(text)
    breaks = F.octet_length(lines) - F.octet_length(F.replace(lines, F.lit("\n"), F.lit("")))
    open_end = (F.octet_length(lines) > 0) & ~F.endswith(lines, F.lit("\n"))
    return (breaks + open_end.cast("int")).cast("int")


def split_lines(text: Column) -> Column:
    """Array of logical lines, without the empty piece after a final newline."""
    pieces = F.split(normalize_newlines(text), "\n")
    return _let(pieces, lambda p: F.slice(p, F.lit(1), F.size(p) - (F.element_at(p, -1) == "").cast("int")))


def number_lines(text: Column) -> Column:
    """Each line behind its right-aligned number and two spaces; ends in LF."""
    lines = split_lines(text)

    def number(s: Column) -> Column:
        numbered = F.transform(
            s["lines"],
            lambda line, i: F.concat(F.lpad((i + 1).cast("string"), s["width"], F.lit(" ")), F.lit("  "), line),
        )
        return F.concat(F.array_join(numbered, "\n"), F.lit("\n"))

    with_width = _let(
        lines, lambda a: F.struct(a.alias("lines"), F.length(F.size(a).cast("string")).alias("width"))
    )
    return F.when(text == "", text).otherwise(_let(with_width, number))
