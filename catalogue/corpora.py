"""The test tables as corpora, in Spark and, with the same rules, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafspark.sources.tables import from_table


def table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table, with keys also dealt out by them: the test tables are single row groups."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(*keys) if keys else df


# ---- docs: one bundle per source; the path mixes languages, folders and excluded names

_DOC_PATH = """
concat(lang, '/', cast(doc_id div 10 % 5 as string), '/',
  CASE doc_id % 11 WHEN 0 THEN concat('doc_', doc_id, '.lock')
                   WHEN 1 THEN concat('requirements-', doc_id, '.txt')
                   WHEN 2 THEN concat('.github/w', doc_id, '.yml')
                   WHEN 3 THEN concat('LICENSE_', doc_id, '.md')
                   WHEN 4 THEN concat('src/doc_', doc_id, '.rs')
                   ELSE concat('doc_', doc_id, '.txt') END)
"""

DOCS = """
docs AS (
  SELECT source AS bundle_id, doc_id, text, octet_length(encode(text)) AS size,
    lang || '/' || (doc_id // 10 % 5) || '/' ||
    CASE doc_id % 11 WHEN 0 THEN 'doc_' || doc_id || '.lock'
                     WHEN 1 THEN 'requirements-' || doc_id || '.txt'
                     WHEN 2 THEN '.github/w' || doc_id || '.yml'
                     WHEN 3 THEN 'LICENSE_' || doc_id || '.md'
                     WHEN 4 THEN 'src/doc_' || doc_id || '.rs'
                     ELSE 'doc_' || doc_id || '.txt' END AS path
  FROM documents)
"""

# The default exclusions in SQL.
DEFAULT_EXCLUDED = r"""
regexp_matches(path, '(?i)(\.gitignore|renovate\.json|requirement.*\.txt|\.lock$|licen[cs]e(\..*)?|\.github|\.git|\.vscode)')
"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents", "doc_id")
    return from_table(df, F.col("source"), F.expr(_DOC_PATH), F.col("text"))


def doc_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs without spreading, for queries that only look at paths and sizes."""
    df = table(spark, sf_dir, "documents")
    return from_table(df, F.col("source"), F.expr(_DOC_PATH), F.col("text"))


# ---- pages: one bundle per host; the path is the URL's

PAGES = r"""
pages_corpus AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS bundle_id, page_id, html AS text,
    octet_length(encode(html)) AS size,
    ltrim(trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') || '/p' || page_id || '.html', '/') AS path
  FROM pages)
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages", "page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    tail = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    path = F.concat(F.trim(tail, F.lit("/")), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html"))
    return from_table(df, host, F.ltrim(path, F.lit("/")), F.col("html"))


# ---- conversations: one bundle per conversation

CONVERSATIONS = """
chats AS (
  SELECT CAST(conv_id AS VARCHAR) AS bundle_id, text, octet_length(encode(text)) AS size,
    'turn_' || lpad(CAST(turn AS VARCHAR), 6, '0') || '_' || role || '.txt' AS path
  FROM conversations)
"""


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations", "conv_id", "turn")
    path = F.concat(
        F.lit("turn_"), F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("_"), F.col("role"), F.lit(".txt")
    )
    return from_table(df, F.col("conv_id"), path, F.col("text"))


# ---- bytes: every document once, wrapped by doc_id % 14 into one of 14 byte forms

# Windows-1252 characters of the bytes 80 to 9F.
_CP1252_HIGH = (
    8364, 129, 8218, 402, 8222, 8230, 8224, 8225, 710, 8240, 352, 8249, 338, 141, 381, 143,
    144, 8216, 8217, 8220, 8221, 8226, 8211, 8212, 732, 8482, 353, 8250, 339, 157, 382, 376,
)

# text_off / text_on: the decoded text without and with charset conversion.
# Form 12 with conversion is UTF-8 read as windows-1252, byte by byte.
BYTES = f"""
byte_rows AS (
  SELECT source AS bundle_id, 'f' || doc_id || '.txt' AS path, doc_id % 14 AS k, text AS src,
    octet_length(encode(text)) AS n,
    CASE doc_id % 14
      WHEN 1 THEN chr(65279) || text
      WHEN 8 THEN replace(text, chr(10), chr(13) || chr(10))
      WHEN 9 THEN replace(text, chr(10), chr(13))
      WHEN 10 THEN 'a sufficiently long text prefix ' || chr(11) || text
      WHEN 11 THEN text || ']]>end]]>'
      WHEN 13 THEN ''
      WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL WHEN 7 THEN NULL
      ELSE text END AS plain
  FROM documents),
misread AS (
  SELECT path AS misread_path,
    string_agg(chr(CASE WHEN b BETWEEN 128 AND 159 THEN list_extract({list(_CP1252_HIGH)}, b - 127) ELSE b END),
               '' ORDER BY i) || 'ÿ' AS misread_text
  FROM (SELECT path, i, CAST('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2) AS INTEGER) AS b
        FROM (SELECT path, hex(encode(src)) AS h, unnest(range(1, n + 1)) AS i FROM byte_rows WHERE k = 12))
  GROUP BY path),
byte_files AS (
  SELECT byte_rows.*,
    CASE k WHEN 1 THEN n + 3
           WHEN 2 THEN 2 + 2 * length(src) WHEN 3 THEN 2 + 2 * length(src)
           WHEN 4 THEN n + 2 WHEN 5 THEN n + 8 WHEN 6 THEN 8193 + n WHEN 7 THEN 2 * n
           WHEN 12 THEN n + 1
           ELSE octet_length(encode(plain)) END AS size,
    CASE k WHEN 4 THEN 'NullByte' WHEN 5 THEN 'RecognizedMagic' WHEN 6 THEN 'NullByte'
           WHEN 7 THEN 'ControlDensity' WHEN 2 THEN 'Utf16ConversionDisabled'
           WHEN 3 THEN 'Utf16ConversionDisabled' END AS reason_off,
    CASE k WHEN 5 THEN 'image/png' WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' END AS detail_off,
    CASE k WHEN 4 THEN 'NullByte' WHEN 5 THEN 'RecognizedMagic' WHEN 6 THEN 'NullByte'
           WHEN 7 THEN 'ControlDensity' END AS reason_on,
    CASE WHEN k = 5 THEN 'image/png' END AS detail_on,
    CASE WHEN k IN (2, 3) THEN NULL WHEN k = 12 THEN plain || chr(65533) ELSE plain END AS text_off,
    CASE WHEN k = 12 THEN misread_text ELSE plain END AS text_on,
    CASE k WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' WHEN 12 THEN 'windows-1252' END AS encoding_on,
    CASE WHEN k IN (2, 3, 4, 5, 6, 7) THEN 'binary' WHEN k = 10 THEN 'xml_omitted' ELSE 'text' END AS disposition_off,
    CASE WHEN k IN (4, 5, 6, 7) THEN 'binary' WHEN k = 10 THEN 'xml_omitted' ELSE 'text' END AS disposition_on
  FROM byte_rows LEFT JOIN misread ON path = misread_path)
"""


_BYTE_CONTENT = r"""
CASE doc_id % 14
  WHEN 1 THEN concat(X'EFBBBF', encode(text, 'UTF-8'))
  WHEN 2 THEN concat(X'FFFE', encode(text, 'UTF-16LE'))
  WHEN 3 THEN concat(X'FEFF', encode(text, 'UTF-16BE'))
  WHEN 4 THEN concat(X'4100', encode(text, 'UTF-8'))
  WHEN 5 THEN concat(X'89504E470D0A1A0A', encode(text, 'UTF-8'))
  WHEN 6 THEN concat(encode(repeat('x', 8192), 'UTF-8'), X'00', encode(text, 'UTF-8'))
  WHEN 7 THEN encode(concat(repeat(char(1), octet_length(text)), text), 'UTF-8')
  WHEN 8 THEN encode(replace(text, char(10), concat(char(13), char(10))), 'UTF-8')
  WHEN 9 THEN encode(replace(text, char(10), char(13)), 'UTF-8')
  WHEN 10 THEN encode(concat('a sufficiently long text prefix ', char(11), text), 'UTF-8')
  WHEN 11 THEN encode(concat(text, ']]>end]]>'), 'UTF-8')
  WHEN 12 THEN concat(encode(text, 'UTF-8'), X'FF')
  WHEN 13 THEN X''
  ELSE encode(text, 'UTF-8') END
"""


def byte_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 14 byte forms, so that all branches are taken."""
    df = table(spark, sf_dir, "documents", "doc_id")
    return from_table(df, F.col("source"), F.expr("concat('f', doc_id, '.txt')"), F.expr(_BYTE_CONTENT))
