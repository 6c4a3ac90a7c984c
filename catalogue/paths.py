"""Queries on paths: scan adapter, exclusions, ignore rules, unsafe names, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue.sql import quoted, with_
from sheafspark.operators import ignore, select

EXTEND = ["DOC_1", "src/", "[x]+"]
REPLACE = [".LOCK", "fr/", ".github/w"]


def corpus_files(spark, sf):
    return C.doc_paths(spark, sf).select("bundle_id", "path", "size")


def chat_files(spark, sf):
    return C.chats(spark, sf).select("bundle_id", "path", "size")


def default_excluded(spark, sf):
    return select.exclude_paths(C.doc_paths(spark, sf).select("bundle_id", "path"))


def extended_excluded(spark, sf):
    return select.exclude_paths(C.doc_paths(spark, sf).select("bundle_id", "path"), extend=EXTEND)


def replaced_excluded(spark, sf):
    return select.exclude_paths(C.doc_paths(spark, sf).select("bundle_id", "path"), extend=EXTEND, replace=REPLACE)


def exclusion_audit(spark, sf):
    return select.exclusion_audit(C.doc_paths(spark, sf).select("path", "size"), extend=EXTEND)


_AUDIT_SQL = [
    (r"\.gitignore", r"(?i)\.gitignore"), (r"renovate\.json", r"(?i)renovate\.json"),
    (r"requirement.*\.txt", r"(?i)requirement.*\.txt"), (r"\.lock$", r"(?i)\.lock$"),
    (r"licen[cs]e(\..*)?", r"(?i)licen[cs]e(\..*)?"), (r"\.github", r"(?i)\.github"),
    (r"\.git", r"(?i)\.git"), (r"\.vscode", r"(?i)\.vscode"),
    ("DOC_1", "(?i)doc_1"), ("src/", "(?i)src/"), ("[x]+", r"(?i)\[x\]\+"),
]


def normalized_paths(spark, sf):
    files = C.doc_paths(spark, sf).select("bundle_id", "path")
    windows = F.concat(F.lit(".\\"), F.replace("path", F.lit("/"), F.lit("\\\\")))
    return select.normalize_paths(files.withColumn("raw", windows).withColumn("path", F.col("raw")))


RULES = {
    "": (
        "gitignore",
        "# build output\n*.lock\n!doc_1*.lock\n/en/1/\nLICENSE_?[0-9]*.md\nsrc/\n!/fr/2/src/\nfr/**/w*.yml  \n\n",
    ),
    "en": ("gitignore", "requirements-*[13579].txt\n!requirements-*1.txt\n"),
}


def rule_files(files):
    """Rule files of every bundle, two bundles with rules of their own, and a global one."""
    shared = files.sparkSession.range(1).select(
        F.lit(ignore.ALL_BUNDLES).alias("bundle_id"), F.lit("").alias("rule_dir"),
        F.lit("global").alias("source"), F.lit("doc_*7.txt\n").alias("text"),
    )
    return bundle_rule_files(files).unionByName(shared)


def bundle_rule_files(files):
    rows = F.array(
        *[
            F.struct(F.lit(d).alias("rule_dir"), F.lit(s).alias("source"), F.lit(t).alias("text"))
            for d, (s, t) in RULES.items()
        ]
    )
    bundles = files.select("bundle_id").distinct()
    common = bundles.select("bundle_id", F.inline(rows))
    own = bundles.where("bundle_id IN ('src3', 'src5')").select(
        "bundle_id",
        F.lit("").alias("rule_dir"),
        F.when(F.col("bundle_id") == "src3", "ignore").otherwise("exclude").alias("source"),
        F.when(F.col("bundle_id") == "src3", "!*.lock\r\n").otherwise("!doc_*7.txt").alias("text"),
    )
    return common.unionByName(own)


def ignore_rule_filter(spark, sf):
    files = C.doc_paths(spark, sf).select("bundle_id", "path")
    return ignore.apply_ignore_rules(files, ignore.parse_ignore_rules(rule_files(files)))


def bundle_ignore_filter(spark, sf):
    """The same without rules that hold for all bundles."""
    files = C.doc_paths(spark, sf).select("bundle_id", "path")
    return ignore.apply_ignore_rules(files, ignore.parse_ignore_rules(bundle_rule_files(files)))


_IGNORED = r"""
(regexp_matches(path, '\.lock$') AND NOT regexp_matches(path, '/doc_1[^/]*\.lock$') AND bundle_id <> 'src3')
OR starts_with(path, 'en/1/')
OR regexp_matches(path, '/LICENSE_.[0-9][^/]*\.md$')
OR (contains(path, '/src/') AND NOT starts_with(path, 'fr/2/src/'))
OR regexp_matches(path, '^fr/(.*/)?w[^/]*\.yml$')
OR (starts_with(path, 'en/') AND regexp_matches(path, '/requirements-[^/]*[13579]\.txt$')
    AND NOT regexp_matches(path, '/requirements-[^/]*1\.txt$'))
"""
_GLOBAL = r" OR (regexp_matches(path, '/doc_[^/]*7\.txt$') AND bundle_id <> 'src5')"


def _unsafe(spark, sf):
    """docs with a tab in a folder, or a vertical tab in a name, of two bundles."""
    files = C.doc_paths(spark, sf).select("bundle_id", "path")
    b = F.col("bundle_id")
    path = F.when(b == "src1", F.replace("path", F.lit("en/"), F.lit("e\tn/"))).when(
        b == "src2", F.replace("path", F.lit("doc_"), F.lit("doc\x0b_"))
    ).otherwise(F.col("path"))
    return files.withColumn("path", path)


_UNSAFE = """
unsafe AS (
  SELECT bundle_id, CASE bundle_id WHEN 'src1' THEN replace(path, 'en/', 'e' || chr(9) || 'n/')
    WHEN 'src2' THEN replace(path, 'doc_', 'doc' || chr(11) || '_') ELSE path END AS path
  FROM docs)
"""


def path_violations(spark, sf):
    return select.path_violations(_unsafe(spark, sf))


def quarantined(spark, sf):
    return select.require_safe_paths(_unsafe(spark, sf), "quarantine")


def repo_refs(spark, sf):
    page = F.col("page_id").cast("string")
    k = F.col("page_id") % 8
    ref = (
        F.when(k == 0, F.concat(F.lit("owner-1/repo_"), page))
        .when(k == 1, F.concat(F.lit("owner/repo."), page))
        .when(k == 2, F.concat(F.lit("git@host:a/b"), page))
        .when(k == 3, F.concat(F.lit("not a repository "), page))
        .when(k == 4, F.concat(F.lit("ssh://git@host/a/b"), page))
        .when(k == 5, F.concat(F.lit("https:///?q="), page))
        .otherwise(F.col("url"))
    )
    pages = C.table(spark, sf, "pages").select("page_id", ref.alias("ref"))
    return select.normalize_repo_refs(pages)


QUERIES = {
    "corpus_files": corpus_files,
    "chat_files": chat_files,
    "default_excluded": default_excluded,
    "extended_excluded": extended_excluded,
    "replaced_excluded": replaced_excluded,
    "exclusion_audit": exclusion_audit,
    "normalized_paths": normalized_paths,
    "ignore_rule_filter": ignore_rule_filter,
    "bundle_ignore_filter": bundle_ignore_filter,
    "path_violations": path_violations,
    "quarantined_bundles": quarantined,
    "repo_refs": repo_refs,
}

SQL = {
    "corpus_files": with_(C.DOCS) + "SELECT bundle_id, path, size FROM docs",
    "chat_files": with_(C.CONVERSATIONS) + "SELECT bundle_id, path, size FROM chats",
    "default_excluded": with_(C.DOCS) + f"SELECT bundle_id, path FROM docs WHERE NOT {C.DEFAULT_EXCLUDED}",
    "extended_excluded": with_(C.DOCS)
    + f"""SELECT bundle_id, path FROM docs WHERE NOT {C.DEFAULT_EXCLUDED}
AND NOT contains(lower(path), 'doc_1') AND NOT contains(lower(path), 'src/') AND NOT contains(lower(path), '[x]+')""",
    "replaced_excluded": with_(C.DOCS)
    + """SELECT bundle_id, path FROM docs WHERE NOT contains(lower(path), '.lock')
AND NOT contains(lower(path), 'fr/') AND NOT contains(lower(path), '.github/w')""",
    "exclusion_audit": with_(C.DOCS)
    + "\nUNION ALL ".join(
        f"SELECT {quoted(p)} AS pattern, count(*) AS n_files, CAST(coalesce(sum(size), 0) AS BIGINT) AS n_bytes "
        f"FROM docs WHERE regexp_matches(path, {quoted(r)})"
        for p, r in _AUDIT_SQL
    ),
    "normalized_paths": with_(C.DOCS)
    + r"SELECT bundle_id, path, '.\' || replace(path, '/', '\\') AS raw FROM docs",
    "ignore_rule_filter": with_(C.DOCS) + f"SELECT bundle_id, path FROM docs WHERE NOT ({_IGNORED}{_GLOBAL})",
    "bundle_ignore_filter": with_(C.DOCS) + f"SELECT bundle_id, path FROM docs WHERE NOT ({_IGNORED})",
    "path_violations": with_(C.DOCS, _UNSAFE)
    + """
, bad AS (
  SELECT bundle_id, 'repository file path' AS role, path AS node_path, path AS value FROM unsafe
  UNION ALL
  SELECT bundle_id, 'repository structure file path', path, regexp_extract(path, '[^/]*$') FROM unsafe
  UNION ALL
  SELECT DISTINCT bundle_id, 'repository structure folder name', string_split(path, '/')[1],
    string_split(path, '/')[1] FROM unsafe)
SELECT bundle_id, role, node_path, value,
  CASE WHEN contains(value, chr(9)) THEN 'U+0009' ELSE 'U+000B' END AS code_point,
  CAST(strpos(value, CASE WHEN contains(value, chr(9)) THEN chr(9) ELSE chr(11) END) - 1 AS INTEGER) AS byte_index,
  CASE WHEN contains(value, chr(9)) THEN 'cannot round-trip through XML attributes'
       ELSE 'cannot be represented in XML 1.0' END AS reason
FROM bad WHERE contains(value, chr(9)) OR contains(value, chr(11))""",
    "quarantined_bundles": with_(C.DOCS, _UNSAFE)
    + """SELECT bundle_id, path FROM unsafe WHERE bundle_id NOT IN (
  SELECT bundle_id FROM unsafe WHERE contains(path, chr(9)) OR contains(path, chr(11)))""",
    "repo_refs": r"""
WITH refs AS (SELECT page_id, CASE page_id % 8
    WHEN 0 THEN 'owner-1/repo_' || page_id WHEN 1 THEN 'owner/repo.' || page_id
    WHEN 2 THEN 'git@host:a/b' || page_id WHEN 3 THEN 'not a repository ' || page_id
    WHEN 4 THEN 'ssh://git@host/a/b' || page_id WHEN 5 THEN 'https:///?q=' || page_id
    ELSE url END AS ref FROM pages)
SELECT page_id, ref,
  CASE WHEN page_id % 8 IN (4, 6, 7) THEN 'url' WHEN page_id % 8 = 0 THEN 'shorthand' ELSE 'invalid' END AS kind,
  CASE WHEN page_id % 8 IN (4, 6, 7) THEN ref
       WHEN page_id % 8 = 0 THEN 'https://github.com/' || ref || '.git' END AS clone_url
FROM refs""",
}
