"""Queries on what stands inside texts: secrets, and comments of source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.sql import with_
from sheafspark.operators import comments, secrets


def _texts(spark, sf):
    return C.docs(spark, sf).select("bundle_id", "path", F.col("content").cast("string").alias("text"))


# ---- secrets


def secret_scan(spark, sf):
    """Known forms of secrets in all documents."""
    found = secrets.secret_scan(_texts(spark, sf)).where(F.col("kind") != secrets.ENTROPY)
    return found.drop("entropy")


def entropy_scan(spark, sf):
    """Runs of characters that look random, whatever their form."""
    return secrets.secret_scan(_texts(spark, sf), forms=()).drop("kind")


def secret_summary(spark, sf):
    return secrets.secret_summary(secrets.secret_scan(_texts(spark, sf)))


# ---- comments: documents as source files, line i in one of six forms per family; x is the line's letters

_LANGUAGES = ("rs", "py", "yml", "html", "sql", "txt")

# (extension, i % 6) -> the line in the file, and what is left of it (null: nothing). Not named: a plain line.
_FORMS = {
    ("rs", 0): ("'let a = \"// no\"; // ' || x", "'let a = \"// no\";'"),
    ("rs", 1): ("'/* ' || x || ' */ f();'", "' f();'"),
    ("rs", 2): ("'g(); /* ' || x", "'g();'"),
    ("rs", 3): ("x", "NULL"),
    ("rs", 4): ("x || ' */ h();'", "' h();'"),
    ("rs", 5): ("'u(\"http://a/*\"); `' || x || ' // ` '", "'u(\"http://a/*\"); `' || x || ' // ` '"),
    ("py", 0): ("'a = \"# no\"  # ' || x", "'a = \"# no\"'"),
    ("py", 1): ("'b = \"\"\"# ' || x || '\"\"\"'", "'b = \"\"\"# ' || x || '\"\"\"'"),
    ("py", 2): ("'    \"\"\"' || x", "NULL"),
    ("py", 3): ("x || ' # '", "NULL"),
    ("py", 4): ("x || '\"\"\"'", "NULL"),
    ("py", 5): ("'c = 1'", "'c = 1'"),
    ("yml", 0): ("'a: \"# no\" # ' || x", "'a: \"# no\"'"),
    ("yml", 1): ("'b#c: ' || x", "'b#c: ' || x"),
    ("yml", 2): ("'  # ' || x", "NULL"),
    ("html", 0): ("'<p><!-- ' || x || ' --></p>'", "'<p></p>'"),
    ("html", 2): ("'<b/><!-- ' || x", "'<b/>'"),
    ("html", 3): ("x", "NULL"),
    ("html", 4): ("x || '--><i/>'", "'<i/>'"),
    ("sql", 0): ("'SELECT ''-- no'' -- ' || x", "'SELECT ''-- no'''"),
    ("sql", 1): ("'/* ' || x || ' */'", "NULL"),
    ("sql", 5): ("'-- ' || x", "NULL"),
}


def _case(side: int, index: str) -> str:
    cases = " ".join(f"WHEN ext = '{ext}' AND {index} % 6 = {i} THEN {forms[side]}" for (ext, i), forms in _FORMS.items())
    return f"CASE {cases} ELSE x END"


def _sources(spark, sf):
    docs = C.table(spark, sf, "documents", "doc_id").selectExpr(
        "source AS bundle_id",
        "doc_id",
        f"element_at(array({', '.join(repr(e) for e in _LANGUAGES)}), CAST(doc_id % 6 + 1 AS int)) AS ext",
        "transform(split(text, '\\n'), x -> regexp_replace(x, '[^a-z ]', '')) AS lines",
    )
    made = f"transform(lines, (x, i) -> {_case(0, 'i')})"
    # Quotes inside the templates are doubled, which Spark reads as two strings side by side.
    made = made.replace("''-- no''", "\\'-- no\\'")
    return docs.selectExpr("bundle_id", "concat('f', doc_id, '.', ext) AS path", f"{made} AS lines")


def comment_removal(spark, sf):
    """Source files without comments, one pass per file."""
    texts = _sources(spark, sf).select("bundle_id", "path", F.array_join("lines", "\n").alias("text"))
    done = comments.strip_comments(texts)
    return done.select("bundle_id", "path", F.length("stripped").cast("bigint").alias("n_chars"), F.md5("stripped").alias("stripped_md5"))


def comment_lines(spark, sf):
    """The same on a table of lines that is cut anywhere, also inside files."""
    lines = _sources(spark, sf).select("bundle_id", "path", F.posexplode("lines").alias("line_no", "line"))
    return comments.strip_lines(lines.withColumn("line_no", F.col("line_no") + 1))


QUERIES = {
    "secret_scan": secret_scan,
    "entropy_scan": entropy_scan,
    "secret_summary": secret_summary,
    "comment_removal": comment_removal,
    "comment_lines": comment_lines,
}


# ---- SQL

_LINES = f"""
doc_lines AS (
  SELECT bundle_id, path, i AS line_no, list_extract(ls, i) AS line
  FROM (SELECT bundle_id, path, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT bundle_id, path, string_split({Q.newlines('text')}, {Q.LF}) AS ls FROM docs)))
"""


def _places(kind: str, pattern: str) -> str:
    """Matches of a pattern with their columns: what stands before a match is made of the pieces between matches and the matches."""
    p = Q.quoted(pattern)
    return f"""
SELECT bundle_id, path, line_no, m, kind,
  CAST(1 + list_sum(list_transform(pieces[1:j], lambda s: length(s))) + coalesce(list_sum(list_transform(found[1:j - 1], lambda s: length(s))), 0) AS INTEGER) AS start_col
FROM (SELECT bundle_id, path, line_no, '{kind}' AS kind, pieces, found, unnest(range(1, len(found) + 1)) AS j, unnest(found) AS m
      FROM (SELECT *, regexp_extract_all(line, {p}) AS found, string_split_regex(line, {p}) AS pieces FROM doc_lines WHERE regexp_matches(line, {p})))"""


_KNOWN = " UNION ALL ".join(_places(f.kind, f.pattern) for f in secrets.FORMS)
_RUNS = _places("run", "[A-Za-z0-9+/=_-]{20,}")

# Entropy of all windows of 20 characters of the runs, from character counts.
_ENTROPY = f"""
runs AS ({_RUNS}),
windows AS (
  SELECT *, substr(m, CAST(w AS BIGINT), 20) AS win FROM (
    SELECT *, unnest(range(1, length(m) - 18)) AS w FROM runs WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))),
letters AS (
  SELECT bundle_id, path, line_no, start_col, m, w, c, count(*) AS n
  FROM (SELECT *, unnest(string_split(win, '')) AS c FROM windows) GROUP BY ALL),
entropies AS (
  SELECT bundle_id, path, line_no, start_col, m, w, sum(-n / 20 * log2(n / 20)) AS h FROM letters GROUP BY ALL),
random_runs AS (
  SELECT bundle_id, path, line_no, start_col, m, round(max(h), 4) AS entropy FROM entropies GROUP BY ALL HAVING max(h) >= 3)
"""

_SOURCES = f"""
sources AS (
  SELECT source AS bundle_id, ([{', '.join(Q.quoted(e) for e in _LANGUAGES)}])[doc_id % 6 + 1] AS ext, doc_id,
    list_transform(string_split(text, {Q.LF}), lambda x: regexp_replace(x, '[^a-z ]', '', 'g')) AS lines FROM documents),
left_over AS (
  SELECT bundle_id, 'f' || doc_id || '.' || ext AS path, line_no, {_case(1, '(line_no - 1)')} AS line
  FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS x FROM sources))
"""

SQL = {
    "secret_scan": with_(C.DOCS, _LINES)
    + f"""SELECT bundle_id, path, line_no, start_col, CAST(start_col + length(m) - 1 AS INTEGER) AS end_col, kind, sha256(m) AS secret_sha256
FROM ({_KNOWN})""",
    "entropy_scan": with_(C.DOCS, _LINES, _ENTROPY)
    + """SELECT bundle_id, path, line_no, start_col, CAST(start_col + length(m) - 1 AS INTEGER) AS end_col, entropy, sha256(m) AS secret_sha256
FROM random_runs""",
    "secret_summary": with_(C.DOCS, _LINES, _ENTROPY)
    + f"""SELECT bundle_id, kind, count(*) AS n_findings, count(DISTINCT path) AS n_files, count(DISTINCT m) AS n_secrets FROM (
  SELECT bundle_id, path, kind, m FROM ({_KNOWN})
  UNION ALL SELECT bundle_id, path, 'high_entropy', m FROM random_runs r WHERE NOT EXISTS (
    SELECT 1 FROM ({_KNOWN}) k WHERE k.bundle_id = r.bundle_id AND k.path = r.path AND k.line_no = r.line_no
      AND k.start_col < r.start_col + length(r.m) AND k.start_col + length(k.m) > r.start_col)) GROUP BY bundle_id, kind""",
    "comment_removal": with_(_SOURCES)
    + """SELECT bundle_id, path, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars, md5(coalesce(t, '')) AS stripped_md5
FROM (SELECT bundle_id, path, string_agg(line, chr(10) ORDER BY line_no) AS t FROM left_over GROUP BY bundle_id, path)""",
    "comment_lines": with_(_SOURCES) + "SELECT bundle_id, path, line_no, line FROM left_over WHERE line IS NOT NULL",
}
