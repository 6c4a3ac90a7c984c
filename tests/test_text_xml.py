"""Line and XML expressions, on fixed cases and against plain Python on random text."""

import re
from xml.etree import ElementTree

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafspark.functions import bytes as B
from sheafspark.functions import text as L
from sheafspark.functions import xml as X
from sheafspark.operators.lines import line_stats


def column(spark, values, *exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in sorted(df.select("i", *exprs).collect(), key=lambda r: r.i)]


LINE_CASES = [
    ("so it\r\nmixes\rall\nkinds", 4, "1  so it\n2  mixes\n3  all\n4  kinds\n"),
    ("\r\r\n\r", 3, "1  \n2  \n3  \n"),
    ("ends with CR LF\r\n", 1, "1  ends with CR LF\n"),
    ("", 0, ""),
    ("no end", 1, "1  no end\n"),
    ("\n", 1, "1  \n"),
    ("a\n\n", 2, "1  a\n2  \n"),
    ("\n\nx", 3, "1  \n2  \n3  x\n"),
    ("x\n" * 10, 10, "".join(f"{n:2}  x\n" for n in range(1, 11))),
]


def test_lines(spark):
    v = F.col("v")
    got = column(spark, [c[0] for c in LINE_CASES], L.count_lines(v), L.number_lines(v), L.count_lines(L.number_lines(v)))
    assert got == [(n, numbered, n) for _, n, numbered in LINE_CASES]


def python_lines(text):
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


texts = st.lists(
    st.text(alphabet=st.sampled_from("ab\r\n\t]><-&\"'é😀\x01\x0b￾"), max_size=30), min_size=40, max_size=40
)


@settings(max_examples=4, deadline=None)
@given(texts)
def test_lines_like_python(spark, values):
    v = F.col("v")
    got = column(spark, values, L.count_lines(v), L.split_lines(v), L.number_lines(v))
    for text, (count, lines, numbered) in zip(values, got):
        expected = python_lines(text)
        width = len(str(len(expected)))
        assert (count, lines) == (len(expected), expected)
        assert numbered == "".join(f"{i:>{width}}  {line}\n" for i, line in enumerate(expected, 1))


INVALID = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def test_invalid_character_limits(spark):
    bad = ["\x00", "\x01", "\x08", "\x0b", "\x0c", "\x0e", "\x1f", "￾", "￿"]
    good = ["\t", "\n", "\r", " ", "퟿", "", "�", "\U00010000", "\U0010ffff"]
    first = X.first_invalid_char(F.col("v"))
    got = column(spark, ["before" + c for c in bad + good], first["code_point"], first["byte_index"])
    assert got == [(f"U+{ord(c):04X}", 6) for c in bad] + [(None, None)] * len(good)


@settings(max_examples=4, deadline=None)
@given(texts)
def test_xml_like_python(spark, values):
    v = F.col("v")
    first = X.first_invalid_char(v)
    got = column(spark, values, first["code_point"], first["byte_index"], X.cdata(v), X.escape_attr(v), X.comment(v))
    for text, (point, index, cdata, attr, comment) in zip(values, got):
        found = INVALID.search(text)
        expected = (f"U+{ord(found[0]):04X}", len(text[: found.start()].encode())) if found else (None, None)
        assert (point, index) == expected
        clean = INVALID.sub(lambda m: f"[unrepresentable U+{ord(m[0]):04X}]", text)
        assert comment == f"<!-- {clean.replace('--', '- ')} -->"
        if found:
            continue
        parsed = ElementTree.fromstring(f"<a>{cdata}</a>").text or ""
        assert parsed == text.replace("\r\n", "\n").replace("\r", "\n")
        if "\t" not in text:
            assert ElementTree.fromstring(f'<a v="{attr}"/>').attrib["v"] == text
        assert ElementTree.fromstring(f"<a>{comment}</a>") is not None


def test_comment_golden(spark):
    v = 'Failed to read file: bad -- <tag> & "quote" trailing-\x0b'
    assert column(spark, [v], X.comment_text(F.col("v"))) == [
        (' Failed to read file: bad -  <tag> & "quote" trailing-[unrepresentable U+000B] ',)
    ]


@settings(max_examples=4, deadline=None)
@given(st.lists(st.binary(max_size=40), min_size=40, max_size=40))
def test_density_like_python(spark, values):
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, v binary")
    rows = sorted(df.select("i", B.control_density(F.col("v")).alias("d")).collect(), key=lambda r: r.i)
    control = set(range(1, 9)) | {11, 12} | set(range(14, 32)) | {127}
    for content, row in zip(values, rows):
        assert row.d == (sum(b in control for b in content) / len(content) if content else 0.0)


def test_line_stats_are_exact(spark):
    """More different values than an approximate percentile keeps; null sizes are counted as files only."""
    n = 60_001
    files = spark.range(n).selectExpr(
        "'text' AS disposition", "IF(id % 2 = 0, 'a', NULL) AS kind", "CAST(id * 7919 % 60001 AS int) AS lines", "IF(id = 0, NULL, id * 104729 % 60001) AS size"
    )
    rows = {r.kind: r for r in line_stats(files, "kind").collect()}
    for kind, first in (("a", 0), (None, 1)):
        lines = sorted(i * 7919 % 60001 for i in range(first, n, 2))
        sizes = sorted(i * 104729 % 60001 for i in range(first, n, 2) if i)
        r = rows[kind]
        assert (r.n_files, r.n_lines, r.max_lines, r.n_bytes, r.max_bytes) == (len(lines), sum(lines), lines[-1], sum(sizes), sizes[-1])
        assert (r.median_lines, r.p90_lines) == (lines[-(-len(lines) // 2) - 1], lines[-(-9 * len(lines) // 10) - 1])
        assert (r.median_bytes, r.p90_bytes) == (sizes[-(-len(sizes) // 2) - 1], sizes[-(-9 * len(sizes) // 10) - 1])
        assert abs(r.avg_lines - sum(lines) / len(lines)) < 1e-9
