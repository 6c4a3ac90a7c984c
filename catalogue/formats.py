"""Queries on other forms of documents, included categories, dot-files and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.documents import HEADER
from catalogue.entries import entries
from catalogue.sql import with_
from sheafspark.operators import document, markdown, select
from sheafspark.session import shared_dir
from sheafspark.sinks import bundles as sink

# Texts with fences of several lengths, at line ends and inside lines.
_FENCED = "CASE doc_id % 4 WHEN 0 THEN '```' || chr(10) || text || chr(10) || '```' WHEN 1 THEN text || repeat('`', CAST(doc_id % 9 AS int)) WHEN 2 THEN '> a' || chr(10) || '## \"no\"' || chr(10) || text ELSE text END"


def _fenced(spark, sf):
    docs = C.table(spark, sf, "documents", "doc_id").selectExpr("source", f"{C._DOC_PATH} AS path", f"{_FENCED} AS text")
    return C.from_table(docs, F.col("source"), F.col("path"), F.col("text"))


def markdown_rows(spark, sf):
    rows = markdown.markdown_rows(entries(_fenced(spark, sf)))
    return rows.select("bundle_id", "section", "sort_key", F.md5("line").alias("line_md5"))


def markdown_roundtrip(spark, sf):
    """Written as Markdown and read back: texts come out as they were."""
    target = shared_dir(spark)
    sink.write_bundles(markdown.markdown_rows(entries(_fenced(spark, sf))), target)
    back = markdown.read_markdown(spark, target)
    return back.select("bundle_id", "path", "size", "lines", F.md5("text").alias("text_md5"))


def text_documents(spark, sf):
    rows = markdown.text_rows(entries(C.byte_files(spark, sf)))
    return document.document_sizes(rows)


def included_categories(spark, sf):
    return select.exclude_paths(C.doc_paths(spark, sf).select("bundle_id", "path"), include=("licences", "github"))


def without_dot_files(spark, sf):
    files = C.doc_paths(spark, sf).select("bundle_id", F.regexp_replace("path", "^([^/]+)/1/", "$1/.x/").alias("path"))
    return select.exclude_paths(files, dot_files=False)


def metadata_documents(spark, sf):
    """Documents with what their owners say about them, two values a bundle."""
    files = C.docs(spark, sf)
    say = C.table(spark, sf, "documents").where("doc_id < 20 OR doc_id % 50 = 7").selectExpr(
        "source AS bundle_id", "CASE WHEN doc_id % 2 = 0 THEN 'about' ELSE 'note <' || doc_id || '>' END AS name", "substring(text, 1, 40) AS value"
    )
    rows = document.document_rows(entries(files), files, metadata=say)
    return rows.where("section = 0").select("bundle_id", "sort_key", F.md5("line").alias("line_md5"))


QUERIES = {
    "markdown_rows": markdown_rows,
    "markdown_roundtrip": markdown_roundtrip,
    "text_documents": text_documents,
    "included_categories": included_categories,
    "without_dot_files": without_dot_files,
    "metadata_documents": metadata_documents,
}


# ---- SQL

_DOCS = f"fenced AS (SELECT bundle_id, path, {_FENCED} AS text FROM docs)"
_RUN = "coalesce(list_max(list_transform(regexp_extract_all(text, '`+'), lambda r: length(r))), 0)"
_BODY = f"""
'## "' || path || '"' || chr(10) || chr(10) || octet_length(encode(text)) || ' bytes, ' || {Q.lines('text')} || ' lines' || chr(10) || chr(10)
  || repeat('`', greatest(3, {_RUN} + 1)) || lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) || chr(10) || text || chr(10)
  || repeat('`', greatest(3, {_RUN} + 1)) || chr(10)"""
_ESCAPED = Q.attr("value")

SQL = {
    "markdown_rows": with_(C.DOCS, _DOCS)
    + f"""SELECT bundle_id, 0 AS section, '' AS sort_key, md5('# ' || bundle_id || chr(10)) AS line_md5 FROM (SELECT DISTINCT bundle_id FROM docs)
UNION ALL SELECT bundle_id, 1, '1' || path, md5('- "' || path || '"') FROM docs
UNION ALL SELECT bundle_id, 2, '1' || path, md5(chr(10) || {_BODY}) FROM fenced""",
    "markdown_roundtrip": with_(C.DOCS, _DOCS)
    + f"""SELECT bundle_id, path, CAST(octet_length(encode(text)) AS BIGINT) AS size, {Q.lines('text')} AS lines, md5(text) AS text_md5 FROM fenced""",
    "text_documents": with_(C.BYTES)
    + """SELECT bundle_id, count(*) AS n_files, count(*) AS n_rows, CAST(sum(octet_length(encode('===== "' || path || '" =====' || chr(10) ||
  CASE disposition_off WHEN 'binary' THEN '(This file is a binary file and not included)'
    WHEN 'xml_omitted' THEN '(Text content omitted: XML 1.0 cannot represent character U+000B)' ELSE text_off END)) + 1) AS BIGINT) AS xml_bytes
FROM byte_files GROUP BY bundle_id""",
    "included_categories": with_(C.DOCS)
    + r"""SELECT bundle_id, path FROM docs
WHERE NOT regexp_matches(path, '(?i)(\.gitignore|renovate\.json|requirement.*\.txt|\.lock$|\.vscode)')
  AND NOT regexp_matches(replace(lower(path), '.github', ''), '\.git')""",
    "without_dot_files": with_(C.DOCS)
    + f"""SELECT bundle_id, path FROM (SELECT bundle_id, regexp_replace(path, '^([^/]+)/1/', '\\1/.x/') AS path FROM docs)
WHERE NOT {C.DEFAULT_EXCLUDED} AND NOT regexp_matches(path, '(^|/)\\.')""",
    "metadata_documents": with_(
        """said AS (SELECT source AS bundle_id, CASE WHEN doc_id % 2 = 0 THEN 'about' ELSE 'note <' || doc_id || '>' END AS name, substring(text, 1, 40) AS value
  FROM documents WHERE doc_id < 20 OR doc_id % 50 = 7)"""
    )
    + f"""SELECT bundle_id, '' AS sort_key, md5({Q.quoted(HEADER)}) AS line_md5 FROM (SELECT DISTINCT source AS bundle_id FROM documents)
UNION ALL SELECT bundle_id, '1', md5('  <metadata>') FROM (SELECT DISTINCT bundle_id FROM said)
UNION ALL SELECT bundle_id, '3', md5('  </metadata>') FROM (SELECT DISTINCT bundle_id FROM said)
UNION ALL SELECT bundle_id, '2' || name || chr(1) || value, md5('    <entry name="' || {Q.attr('name')} || '" value="' || {_ESCAPED} || '" />') FROM said""",
}
