"""XML 1.0 safety tests and escaping as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What XML 1.0 cannot hold, of the characters a string can hold.
INVALID_CLASS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
# A tab is legal XML but does not survive in an attribute.
INVALID_ATTRIBUTE_CLASS = r"[\x00-\x09\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"


def code_point(char: Column) -> Column:
    """``U+000B`` form of a character of the basic plane."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(char)), 4, "0"))


def _first(text: Column, char_class: str) -> Column:
    char = F.regexp_extract(text, char_class, 0)
    found = F.struct(
        code_point(char).alias("code_point"),
        F.octet_length(F.call_function("substring_index", text, char, F.lit(1))).alias("byte_index"),
    )
    return F.when(text.rlike(char_class), found)


def first_invalid_char(text: Column) -> Column:
    """struct(code_point, byte_index) of the first illegal character, or null."""
    return _first(text, INVALID_CLASS)


def first_invalid_attribute_char(text: Column) -> Column:
    """As ``first_invalid_char``, for attribute values: a tab counts too."""
    return _first(text, INVALID_ATTRIBUTE_CLASS)


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape_attr(value: Column) -> Column:
    return _replace_all(
        value,
        [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"),
         ("\n", "&#xA;"), ("\r", "&#xD;")],
    )


def escape_text(value: Column) -> Column:
    return _replace_all(value, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")])


def cdata(text: Column) -> Column:
    """CDATA section; an inner ``]]>`` is cut over two adjacent sections."""
    inner = F.replace(text, F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    return F.concat(F.lit("<![CDATA["), inner, F.lit("]]>"))


def comment_text(diagnostic: Column) -> Column:
    """Text that may stand in a comment: illegal characters named, ``--`` broken."""
    bad = F.lit(INVALID_CLASS)
    labelled = F.array_join(
        F.transform(
            F.split(diagnostic, ""),
            lambda c: F.when(
                F.rlike(c, bad), F.concat(F.lit("[unrepresentable "), code_point(c), F.lit("]"))
            ).otherwise(c),
        ),
        "",
    )
    legal = F.when(diagnostic.rlike(INVALID_CLASS), labelled).otherwise(diagnostic)
    return F.concat(F.lit(" "), F.replace(legal, F.lit("--"), F.lit("- ")), F.lit(" "))


def comment(diagnostic: Column) -> Column:
    return F.concat(F.lit("<!--"), comment_text(diagnostic), F.lit("-->"))
