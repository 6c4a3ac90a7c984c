"""Queries on lines, entries, XML safety and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.sql import with_
from sheafspark.functions import text as L
from sheafspark.functions import xml as X
from sheafspark.operators.classify import classify, file_extension
from sheafspark.operators.decode import decode_files
from sheafspark.operators.entries import OMITTED_COMMENT, build_entries, diagnostics, render_entries
from sheafspark.operators.lines import explode_lines, line_stats
from sheafspark.operators.metrics import disposition_cube, largest


def entries(files, utf8=False, line_numbers=False):
    return build_entries(decode_files(classify(files, utf8), utf8), line_numbers)


def line_counts(spark, sf):
    return entries(C.byte_files(spark, sf)).select("bundle_id", "path", "size", "lines")


def numbered_text(spark, sf):
    decoded = decode_files(classify(C.byte_files(spark, sf), True), True).where("text IS NOT NULL")
    numbered = L.number_lines(F.col("text"))
    return decoded.select(
        "path", F.md5(numbered).alias("numbered_md5"), L.count_lines(numbered).alias("numbered_lines"),
        L.count_lines(F.col("text")).alias("raw_lines"),
    )


def normalized_text(spark, sf):
    decoded = decode_files(classify(C.byte_files(spark, sf))).where("text IS NOT NULL")
    return decoded.select("path", F.md5(L.normalize_newlines(F.col("text"))).alias("text_md5"))


def line_table_stats(spark, sf):
    """Longest line, blank lines and characters of every file, from the line table."""
    lines = explode_lines(decode_files(classify(C.byte_files(spark, sf))))
    return lines.groupBy("bundle_id", "path").agg(
        F.count("*").alias("n_lines"),
        F.max("line_no").alias("last_line"),
        F.max(F.length("line")).cast("bigint").alias("longest"),
        F.count_if(F.col("line") == "").alias("blank"),
        F.sum(F.length("line")).cast("bigint").alias("n_chars"),
    )


def page_line_stats(spark, sf):
    return line_stats(entries(C.pages(spark, sf)), "bundle_id")


def doc_line_stats(spark, sf):
    with_ext = entries(C.docs(spark, sf)).withColumn("extension", file_extension())
    return line_stats(with_ext, "extension")


def xml_invalid_chars(spark, sf):
    decoded = decode_files(classify(C.byte_files(spark, sf), True), True)
    bad = X.first_invalid_char(F.col("text"))
    return decoded.select("path", bad["code_point"].alias("code_point"), bad["byte_index"].alias("byte_index"))


def omitted_entries(spark, sf):
    return (
        entries(C.byte_files(spark, sf))
        .where("disposition = 'xml_omitted'")
        .select("bundle_id", "path", "size", "lines", "diagnostic")
    )


def attr_escape(spark, sf):
    """Every page's URL and markup as attribute and as element text."""
    value = F.concat(F.lit("a'\r\n"), F.col("url"), F.col("html"))
    return C.table(spark, sf, "pages", "page_id").select(
        "page_id", F.md5(X.escape_attr(value)).alias("attr_md5"), F.md5(X.escape_text(value)).alias("text_md5")
    )


def cdata_entries(spark, sf):
    return render_entries(entries(C.pages(spark, sf))).select("bundle_id", "path", F.md5("entry_xml").alias("xml_md5"))


def rendered_entries(spark, sf):
    rendered = render_entries(entries(C.byte_files(spark, sf), True, True))
    return rendered.select("bundle_id", "path", "disposition", F.md5("entry_xml").alias("xml_md5"))


def placeholder_entries(spark, sf):
    rendered = render_entries(entries(C.byte_files(spark, sf)))
    return rendered.where("diagnostic IS NOT NULL").select("bundle_id", "path", "entry_xml")


def _failing(spark, sf):
    """docs where every third file could not be read."""
    files = C.docs(spark, sf)
    fails = F.pmod(F.length("path"), F.lit(3)) == 0
    error = F.concat(F.lit("bad -- <tag> & \"quote\" "), F.col("path"), F.lit(" trailing-\x0b"))
    return files.withColumn("read_error", F.when(fails, error)).withColumn("content", F.when(~fails, F.col("content")))


def read_error_entries(spark, sf):
    rendered = render_entries(entries(_failing(spark, sf)))
    return rendered.select("bundle_id", "path", "disposition", "size", F.md5("entry_xml").alias("xml_md5"))


def comment_sanitise(spark, sf):
    diagnostic = F.concat(F.lit("a -- b --- c \x01\x0b\x1f "), F.col("text"), F.lit("-"))
    docs = C.table(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", F.md5(X.comment(diagnostic)).alias("comment_md5"))


def all_diagnostics(spark, sf):
    return diagnostics(entries(C.byte_files(spark, sf), True))


def quiet_diagnostics(spark, sf):
    return diagnostics(entries(_failing(spark, sf)), quiet=True)


def disposition(spark, sf):
    return disposition_cube(entries(C.byte_files(spark, sf), True))


def largest_files(spark, sf):
    return largest(entries(C.docs(spark, sf)).select("bundle_id", "path", "size", "lines"), "size", 25)


def longest_files(spark, sf):
    return largest(entries(C.pages(spark, sf)).select("bundle_id", "path", "size", "lines"), "lines", 25)


QUERIES = {
    "line_counts": line_counts,
    "numbered_text": numbered_text,
    "normalized_text": normalized_text,
    "line_table_stats": line_table_stats,
    "page_line_stats": page_line_stats,
    "line_stats": doc_line_stats,
    "xml_invalid_chars": xml_invalid_chars,
    "omitted_entries": omitted_entries,
    "attr_escape": attr_escape,
    "cdata_entries": cdata_entries,
    "rendered_entries": rendered_entries,
    "placeholder_entries": placeholder_entries,
    "read_error_entries": read_error_entries,
    "comment_sanitise": comment_sanitise,
    "diagnostics": all_diagnostics,
    "quiet_diagnostics": quiet_diagnostics,
    "disposition_cube": disposition,
    "largest_files": largest_files,
    "longest_files": longest_files,
}

_BYTES = with_(C.BYTES)
_BINARY = "This file is a binary file and not included"


def _comment(text: str) -> str:
    return f"'<!-- ' || replace({text}, '--', '- ') || ' -->'"


def _bytes_entry(mode: str, text: str) -> str:
    binary = Q.entry("path", "size", "'0'", f"'<!-- {_BINARY} -->'")
    omitted = Q.entry("path", "size", "'0'", f"'<!-- {OMITTED_COMMENT}U+000B -->'")
    return (
        f"CASE disposition_{mode} WHEN 'binary' THEN {binary} WHEN 'xml_omitted' THEN {omitted} "
        f"ELSE {Q.text_entry('path', 'size', text)} END"
    )


def _stats(by: str, source: str, name: str) -> str:
    return f"""SELECT {by} AS {name}, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes,
  CAST(sum(lines) AS BIGINT) AS n_lines, max(lines) AS max_lines, max(size) AS max_bytes, avg(lines) AS avg_lines,
  quantile_disc(lines, 0.5) AS median_lines, quantile_disc(lines, 0.9) AS p90_lines,
  quantile_disc(size, 0.5) AS median_bytes, quantile_disc(size, 0.9) AS p90_bytes
FROM (SELECT *, {Q.lines('text')} AS lines FROM {source}) GROUP BY 1"""


_READ_ERRORS = """
failing AS (
  SELECT *, CASE WHEN length(path) % 3 = 0
    THEN 'bad -- <tag> & "quote" ' || path || ' trailing-' || chr(11) END AS read_error FROM docs)
"""

SQL = {
    "line_counts": _BYTES
    + f"""SELECT bundle_id, path, size,
  CASE WHEN disposition_off = 'text' THEN {Q.lines('text_off')} ELSE 0 END AS lines FROM byte_files""",
    "numbered_text": _BYTES
    + f"""SELECT path, md5({Q.numbered('text_on')}) AS numbered_md5, {Q.lines('text_on')} AS numbered_lines,
  {Q.lines('text_on')} AS raw_lines FROM byte_files WHERE text_on IS NOT NULL""",
    "normalized_text": _BYTES
    + f"SELECT path, md5({Q.newlines('text_off')}) AS text_md5 FROM byte_files WHERE text_off IS NOT NULL",
    "line_table_stats": _BYTES
    + f"""SELECT bundle_id, path, count(*) AS n_lines, CAST(max(line_no) AS INTEGER) AS last_line,
  max(length(line)) AS longest, count(*) FILTER (line = '') AS blank, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM (SELECT bundle_id, path, unnest(range(1, k + 1)) AS line_no, unnest(parts[1:k]) AS line
      FROM (SELECT bundle_id, path, string_split({Q.newlines('text_off')}, chr(10)) AS parts,
              {Q.lines('text_off')} AS k FROM byte_files WHERE text_off IS NOT NULL))
GROUP BY bundle_id, path""",
    "page_line_stats": with_(C.PAGES) + _stats("bundle_id", "pages_corpus", "bundle_id"),
    "line_stats": with_(C.DOCS) + _stats(r"lower(regexp_extract(path, '[^/]\.([^./]+)$', 1))", "docs", "extension"),
    "xml_invalid_chars": _BYTES
    + """SELECT path, CASE WHEN k = 10 THEN 'U+000B' END AS code_point,
  CAST(CASE WHEN k = 10 THEN 32 END AS INTEGER) AS byte_index FROM byte_files""",
    "omitted_entries": _BYTES
    + f"""SELECT bundle_id, path, size, 0 AS lines, '{OMITTED_COMMENT}U+000B' AS diagnostic
FROM byte_files WHERE k = 10""",
    "attr_escape": f"""
SELECT page_id, md5({Q.attr('v')}) AS attr_md5,
  md5(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS text_md5
FROM (SELECT page_id, 'a''' || chr(13) || chr(10) || url || html AS v FROM pages)""",
    "cdata_entries": with_(C.PAGES)
    + f"SELECT bundle_id, path, md5({Q.text_entry('path', 'size', 'text')}) AS xml_md5 FROM pages_corpus",
    "rendered_entries": _BYTES
    + f"""SELECT bundle_id, path, disposition_on AS disposition, md5({_bytes_entry('on', 'numbered')}) AS xml_md5
FROM (SELECT *, {Q.numbered('text_on')} AS numbered FROM byte_files)""",
    "placeholder_entries": _BYTES
    + f"""SELECT bundle_id, path, {_bytes_entry('off', 'text_off')} AS entry_xml
FROM byte_files WHERE disposition_off <> 'text'""",
    "read_error_entries": with_(C.DOCS, _READ_ERRORS)
    + f"""SELECT bundle_id, path, CASE WHEN read_error IS NULL THEN 'text' ELSE 'read_error' END AS disposition,
  CASE WHEN read_error IS NULL THEN size ELSE 0 END AS size,
  md5(CASE WHEN read_error IS NULL THEN {Q.text_entry('path', 'size', 'text')}
    ELSE {Q.entry('path', "'0'", "'0'", _comment("'Failed to read file: ' || replace(read_error, chr(11), '[unrepresentable U+000B]')"))}
    END) AS xml_md5 FROM failing""",
    "comment_sanitise": """
SELECT doc_id, md5('<!-- ' || replace('a -- b --- c [unrepresentable U+0001][unrepresentable U+000B]'
  || '[unrepresentable U+001F] ' || text || '-', '--', '- ') || ' -->') AS comment_md5 FROM documents""",
    "diagnostics": _BYTES
    + """SELECT bundle_id, path, 'info' AS level, 'converted' AS code,
  'Converted ''' || path || ''' from ' || encoding_on || ' to UTF-8' AS message
FROM byte_files WHERE encoding_on IS NOT NULL
UNION ALL
SELECT bundle_id, path, 'warning', 'xml_omitted',
  '''' || path || ''' content was omitted because XML 1.0 cannot represent character U+000B'
FROM byte_files WHERE k = 10""",
    "quiet_diagnostics": with_(C.DOCS, _READ_ERRORS)
    + """SELECT bundle_id, path, 'error' AS level, 'read_error' AS code,
  'Error reading file ''' || path || ''': ' || read_error AS message FROM failing WHERE read_error IS NOT NULL""",
    "disposition_cube": _BYTES
    + f"""SELECT bundle_id, disposition, CAST(grouping(bundle_id, disposition) AS BIGINT) AS level, count(*) AS n_files,
  CAST(sum(size) AS BIGINT) AS n_bytes, CAST(sum(lines) AS BIGINT) AS n_lines
FROM (SELECT bundle_id, disposition_on AS disposition, size,
        CASE WHEN disposition_on = 'text' THEN {Q.lines('text_on')} ELSE 0 END AS lines FROM byte_files)
GROUP BY CUBE (bundle_id, disposition)""",
    "largest_files": with_(C.DOCS)
    + f"""SELECT bundle_id, path, size, {Q.lines('text')} AS lines FROM docs
ORDER BY size DESC, bundle_id, path LIMIT 25""",
    "longest_files": with_(C.PAGES)
    + f"""SELECT bundle_id, path, size, {Q.lines('text')} AS lines FROM pages_corpus
ORDER BY lines DESC, bundle_id, path LIMIT 25""",
}
