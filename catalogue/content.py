"""Queries on content: classification, decoding, conversion reports."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue.sql import quoted, with_
from sheafspark.functions import bytes as B
from sheafspark.operators.classify import classification_profile, classification_rollup, classify
from sheafspark.operators.decode import conversion_report, decode_files, decode_metrics, observe_decoding
from sheafspark.sources.tables import from_table



def _decoded(spark, sf, utf8):
    return decode_files(classify(C.byte_files(spark, sf), utf8), utf8)


def bom_profile(spark, sf):
    return C.byte_files(spark, sf).select("bundle_id", "path", "size", B.bom(F.col("content")).alias("bom"))


def nul_flags(spark, sf):
    return C.byte_files(spark, sf).select(
        "path", B.has_nul(B.probe(F.col("content"))).alias("nul_in_probe"), B.has_nul(F.col("content")).alias("nul_anywhere")
    )


def magic_types(spark, sf):
    heads = C.byte_files(spark, sf).select("path", B.head(F.col("content")).alias("head"))
    return heads.select("path", B.magic_mime("head").alias("mime"))


def control_density(spark, sf):
    return C.byte_files(spark, sf).select("path", B.control_density(B.payload(F.col("content"))).alias("density"))


def _escaped(spark, sf):
    """Every document behind an escape sequence: two kanji shifts, three others, none."""
    docs = C.table(spark, sf, "documents", "doc_id")
    k = F.col("doc_id") % 6
    mark = (
        F.when(k == 0, "\x1b$B").when(k == 1, "\x1b$@").when(k == 2, "\x1b(B").when(k == 3, "\x1b[31m")
        .when(k == 4, "\x1b$(").otherwise("")
    )
    return from_table(docs, F.col("source"), F.col("doc_id").cast("string"), F.concat(mark, F.col("text")))


def iso2022jp_candidates(spark, sf):
    return _escaped(spark, sf).select("path", B.iso2022jp_candidate(F.col("content")).alias("candidate"))


def escaped_decode(spark, sf):
    """Broken JIS is not taken for JIS: every text comes back as it was."""
    decoded = decode_files(classify(_escaped(spark, sf), True), True)
    return decoded.select("path", "decode_class", "source_encoding", F.md5("text").alias("text_md5"))


def binary_cascade_off(spark, sf):
    return classify(C.byte_files(spark, sf), False).select("bundle_id", "path", "binary_reason", "binary_detail")


def binary_cascade_on(spark, sf):
    return classify(C.byte_files(spark, sf), True).select("bundle_id", "path", "binary_reason", "binary_detail")


def profile(spark, sf):
    return classification_profile(classify(C.byte_files(spark, sf), False))


def rollup(spark, sf):
    return classification_rollup(classify(C.byte_files(spark, sf), True))


def _texts(decoded):
    return decoded.select(
        "bundle_id", "path", "decode_class", "source_encoding", "had_replacements", "utf8_had_replacements",
        "binary_reason", F.md5("text").alias("text_md5"), F.octet_length("text").cast("bigint").alias("text_bytes"),
    )


def decode_off(spark, sf):
    return _texts(_decoded(spark, sf, False))


def decode_on(spark, sf):
    return _texts(_decoded(spark, sf, True))


def _wrap_utf16(spark, sf):
    """Every document as UTF-16: a third dense with controls, a third cut within a unit, a third clean."""
    docs = C.table(spark, sf, "documents", "doc_id")
    k = F.col("doc_id") % 3
    dense = F.concat(F.repeat(F.lit("\x85"), F.length("text")), F.col("text"))
    body = F.encode(F.when(k == 0, dense).otherwise(F.col("text")), "UTF-16LE")
    cut = F.when(k == 1, F.lit(bytearray(b"A"))).otherwise(F.lit(bytearray(b"")))
    return from_table(docs, F.col("source"), F.col("doc_id").cast("string"), F.concat(F.lit(bytearray(b"\xff\xfe")), body, cut))


def utf16_decode(spark, sf):
    decoded = decode_files(classify(_wrap_utf16(spark, sf), True), True)
    return decoded.select(
        "path", "decode_class", "binary_reason", "source_encoding", "had_replacements", F.md5("text").alias("text_md5")
    )


def implausible_text(spark, sf):
    decoded = decode_files(classify(_wrap_utf16(spark, sf), True), True)
    return decoded.where("binary_reason = 'ImplausibleDecodedData'").select("bundle_id", "path", "size")


def _bad_bom(spark, sf):
    """Every document behind a UTF-8 mark and, in every second one, a stray byte."""
    docs = C.table(spark, sf, "documents", "doc_id")
    stray = F.when(F.col("doc_id") % 2 == 0, F.lit(bytearray(b"\xff "))).otherwise(F.lit(bytearray(b"")))
    content = F.concat(F.lit(bytearray(b"\xef\xbb\xbf")), stray, F.encode("text", "UTF-8"))
    return from_table(docs, F.col("source"), F.col("doc_id").cast("string"), content)


# One sentence per charset as (label, Python codec, sentence).
SENTENCES = (
    ("Shift_JIS", "cp932", "古い日記には天気のことがたくさん書いてあり、どの行も大切です。"),
    ("EUC-JP", "euc_jp", "古い日記には天気のことがたくさん書いてあり、どの行も大切です。"),
    ("ISO-2022-JP", "iso2022_jp", "古い日記には天気のことがたくさん書いてあり、どの行も大切です。"),
    ("GBK", "gbk", "这本旧日记里写着许多年的天气，每一行对水手来说都很重要。"),
    ("Big5", "big5", "這本舊日記裡寫著許多年的天氣，每一行對水手來說都很重要。"),
    ("EUC-KR", "cp949", "오래된 일기에는 여러 해의 날씨가 적혀 있고 모든 줄이 중요하다."),
    ("windows-1250", "cp1250", "Stary dziennik przechowuje zapiski o pogodzie, a każda linijka była ważna dla żeglarzy."),
    ("windows-1251", "cp1251", "Старый журнал хранит записи о погоде за много лет, и каждая строка важна."),
    ("KOI8-U", "koi8_u", "Старый журнал хранит записи о погоде за много лет, и каждая строка важна."),
    ("windows-1252", "cp1252", "El viejo diario guarda notas del año pasado; ¿qué línea importa más?"),
    ("windows-1253", "cp1253", "Το παλιό ημερολόγιο κρατά σημειώσεις για τον καιρό και κάθε γραμμή έχει σημασία."),
    ("windows-1255", "cp1255", "היומן הישן שומר רשימות על מזג האוויר לאורך שנים רבות וכל שורה חשובה."),
    ("windows-1256", "cp1256", "يحفظ الدفتر القديم ملاحظات عن الطقس لسنوات طويلة وكل سطر مهم."),
    ("windows-874", "cp874", "สมุดบันทึกเก่าเก็บเรื่องสภาพอากาศไว้หลายปี และทุกบรรทัดมีความสำคัญ"),
)


def legacy_charsets(spark, sf):
    """Every document behind a sentence in one of the legacy charsets; what is not ASCII, and so not in all of them, becomes a mark."""
    docs = C.table(spark, sf, "documents", "doc_id")
    encoded = F.array(*[F.lit(sentence.encode(codec)) for _, codec, sentence in SENTENCES])
    start = F.element_at(encoded, (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))
    plain = F.encode(F.regexp_replace("text", r"[^\x00-\x7f]", "_"), "UTF-8")
    files = from_table(docs, F.col("source"), F.col("doc_id").cast("string"), F.concat(start, plain))
    decoded = decode_files(classify(files, True), True)
    return decoded.select("path", "decode_class", "source_encoding", "had_replacements", F.md5("text").alias("text_md5"))


# Starts of binary files as (media type, hex).
_LOCAL, _FIELDS = "504B0304", "00" * 26
STARTS = (
    ("image/png", "89504E470D0A1A0A"),
    ("image/jpeg", "FFD8FFE0"),
    ("image/gif", "474946383961"),
    ("image/webp", "524946460000000057454250"),
    ("image/tiff", "49492A00"),
    ("image/vnd.microsoft.icon", "00000100"),
    ("application/pdf", "255044462D"),
    ("application/gzip", "1F8B08"),
    ("application/x-bzip2", "425A6839"),
    ("application/x-xz", "FD377A585A00"),
    ("application/zstd", "28B52FFD"),
    ("application/x-7z-compressed", "377ABCAF271C"),
    ("application/vnd.rar", "526172211A0700"),
    ("application/x-tar", "20" * 257 + "7573746172"),
    ("application/x-executable", "7F454C46"),
    ("application/x-mach-binary", "FEEDFACF"),
    ("application/java", "CAFEBABE"),
    ("application/wasm", "0061736D"),
    ("application/vnd.sqlite3", "53514C697465"),
    ("audio/mpeg", "494433"),
    ("audio/ogg", "4F676753"),
    ("audio/x-flac", "664C6143"),
    ("audio/x-wav", "524946460000000057415645"),
    ("video/mp4", "000000186674797069736F6D"),
    ("application/font-woff2", "774F463200010000"),
    ("application/rtf", "7B5C727466"),
    ("application/zip", _LOCAL + _FIELDS + "612E747874"),
    ("application/java-archive", _LOCAL + _FIELDS + "4D4554412D494E462F"),
    (
        "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
        _LOCAL + _FIELDS + "5B436F6E74656E745F54797065735D2E786D6C" + _LOCAL + _FIELDS + "776F72642F",
    ),
    (
        "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
        _LOCAL + _FIELDS + "5B436F6E74656E745F54797065735D2E786D6C" + "AA" * 600 + _LOCAL + _FIELDS + "786C2F",
    ),
    (
        "application/vnd.openxmlformats-officedocument.presentationml.presentation",
        _LOCAL + _FIELDS + "5B436F6E74656E745F54797065735D2E786D6C" + _LOCAL + _FIELDS + "7070742F",
    ),
    (
        "application/vnd.oasis.opendocument.text",
        _LOCAL + _FIELDS + "6D696D65747970656170706C69636174696F6E2F766E642E6F617369732E6F70656E646F63756D656E742E74657874" + _LOCAL,
    ),
)


def binary_starts(spark, sf):
    """Every document behind the start of some kind of binary file; the type must be told by it."""
    docs = C.table(spark, sf, "documents", "doc_id")
    starts = F.array(*[F.lit(bytes.fromhex(start)) for _, start in STARTS])
    start = F.element_at(starts, (F.col("doc_id") % len(STARTS) + 1).cast("int"))
    files = from_table(docs, F.col("source"), F.col("doc_id").cast("string"), F.concat(start, F.encode("text", "UTF-8")))
    heads = files.withColumn("head", B.head(F.col("content"))).withColumn("mime", B.magic_mime("head"))
    return heads.select("path", B.refined_mime("mime", "content").alias("mime"))


def malformed_bom_on(spark, sf):
    return _texts(decode_files(classify(_bad_bom(spark, sf), True), True))


def malformed_bom_off(spark, sf):
    return _texts(decode_files(classify(_bad_bom(spark, sf), False), False))


def conversions(spark, sf):
    return conversion_report(_decoded(spark, sf, True))


def metrics_on(spark, sf):
    return decode_metrics(_decoded(spark, sf, True))


def metrics_off(spark, sf):
    return decode_metrics(_decoded(spark, sf, False))


def observed_decoding(spark, sf):
    """The counters of a whole run, taken along while its texts are written."""
    seen = Observation("decoding")
    observe_decoding(_decoded(spark, sf, True), seen).write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "valid_files bigint, valid_bytes bigint, transcoded_files bigint, transcoded_bytes bigint")


QUERIES = {
    "bom_profile": bom_profile,
    "nul_flags": nul_flags,
    "magic_types": magic_types,
    "control_density": control_density,
    "iso2022jp_candidates": iso2022jp_candidates,
    "iso2022jp_fallback": escaped_decode,
    "binary_cascade_off": binary_cascade_off,
    "binary_cascade_on": binary_cascade_on,
    "classification_profile": profile,
    "classification_rollup": rollup,
    "lossy_decode": decode_off,
    "utf8_decode": decode_on,
    "utf16_decode": utf16_decode,
    "implausible_text": implausible_text,
    "legacy_charsets": legacy_charsets,
    "binary_starts": binary_starts,
    "malformed_bom_on": malformed_bom_on,
    "malformed_bom_off": malformed_bom_off,
    "conversion_report": conversions,
    "decode_metrics": metrics_on,
    "decode_metrics_off": metrics_off,
    "observed_decoding": observed_decoding,
}

_BYTES = with_(C.BYTES)


def _texts_sql(mode: str) -> str:
    if mode == "off":
        decode_class = "CASE WHEN reason_off IS NOT NULL THEN 'binary' WHEN k = 12 THEN 'lossy' ELSE 'valid' END"
        encoding = "CAST(NULL AS VARCHAR)"
    else:
        decode_class = (
            "CASE WHEN reason_on IS NOT NULL THEN 'binary' WHEN encoding_on IS NOT NULL THEN 'transcoded' ELSE 'valid' END"
        )
        encoding = "encoding_on"
    return _BYTES + f"""SELECT bundle_id, path, {decode_class} AS decode_class, {encoding} AS source_encoding,
  false AS had_replacements, false AS utf8_had_replacements, reason_{mode} AS binary_reason,
  md5(text_{mode}) AS text_md5, octet_length(encode(text_{mode})) AS text_bytes FROM byte_files"""


def _pick(values: list[str]) -> str:
    """The value at doc_id modulo their number."""
    return f"list_extract([{', '.join(quoted(v) for v in values)}], CAST(doc_id % {len(values)} + 1 AS BIGINT))"


def _bad_bom_sql(utf8: bool) -> str:
    return f"""
SELECT source AS bundle_id, CAST(doc_id AS VARCHAR) AS path,
  CASE WHEN doc_id % 2 = 0 THEN 'lossy' ELSE 'valid' END AS decode_class,
  CAST(NULL AS VARCHAR) AS source_encoding, false AS had_replacements,
  {'doc_id % 2 = 0' if utf8 else 'false'} AS utf8_had_replacements, CAST(NULL AS VARCHAR) AS binary_reason,
  md5(t) AS text_md5, octet_length(encode(t)) AS text_bytes
FROM (SELECT *, chr(65279) || CASE WHEN doc_id % 2 = 0 THEN chr(65533) || ' ' ELSE '' END || text AS t FROM documents)"""


SQL = {
    "bom_profile": _BYTES
    + """SELECT bundle_id, path, size,
  CASE k WHEN 1 THEN 'UTF-8' WHEN 2 THEN 'UTF-16LE' WHEN 3 THEN 'UTF-16BE' END AS bom FROM byte_files""",
    "nul_flags": _BYTES
    + """SELECT path,
  CASE WHEN k = 4 THEN true WHEN k IN (2, 3) THEN length(src) > 0 ELSE false END AS nul_in_probe,
  CASE WHEN k IN (4, 6) THEN true WHEN k IN (2, 3) THEN length(src) > 0 ELSE false END AS nul_anywhere
FROM byte_files""",
    "magic_types": _BYTES + "SELECT path, CASE WHEN k = 5 THEN 'image/png' END AS mime FROM byte_files",
    "control_density": _BYTES
    + """SELECT path,
  CASE WHEN k = 7 THEN CASE WHEN n = 0 THEN 0.0 ELSE 0.5 END
       WHEN k = 5 THEN 1 / CAST(n + 8 AS DOUBLE)
       WHEN k = 10 THEN 1 / CAST(n + 33 AS DOUBLE)
       ELSE 0.0 END AS density FROM byte_files""",
    "iso2022jp_candidates": "SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 6 IN (0, 1) AS candidate FROM documents",
    "iso2022jp_fallback": """
SELECT CAST(doc_id AS VARCHAR) AS path, 'valid' AS decode_class, CAST(NULL AS VARCHAR) AS source_encoding,
  md5(CASE doc_id % 6 WHEN 0 THEN chr(27) || '$B' WHEN 1 THEN chr(27) || '$@' WHEN 2 THEN chr(27) || '(B'
      WHEN 3 THEN chr(27) || '[31m' WHEN 4 THEN chr(27) || '$(' ELSE '' END || text) AS text_md5
FROM documents""",
    "binary_cascade_off": _BYTES
    + "SELECT bundle_id, path, reason_off AS binary_reason, detail_off AS binary_detail FROM byte_files",
    "binary_cascade_on": _BYTES
    + "SELECT bundle_id, path, reason_on AS binary_reason, detail_on AS binary_detail FROM byte_files",
    "classification_profile": _BYTES
    + """SELECT coalesce(reason_off, 'text') AS reason, coalesce(detail_off, '') AS detail, 'txt' AS extension,
  count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes FROM byte_files GROUP BY ALL""",
    "classification_rollup": _BYTES
    + """SELECT bundle_id, reason, CAST(grouping(bundle_id, reason) AS BIGINT) AS level,
  count(*) AS n_files, CAST(sum(size) AS BIGINT) AS n_bytes
FROM (SELECT bundle_id, coalesce(reason_on, 'text') AS reason, size FROM byte_files)
GROUP BY ROLLUP (bundle_id, reason)""",
    "lossy_decode": _texts_sql("off"),
    "utf8_decode": _texts_sql("on"),
    "utf16_decode": """
SELECT CAST(doc_id AS VARCHAR) AS path,
  CASE WHEN doc_id % 3 = 0 THEN 'binary' ELSE 'transcoded' END AS decode_class,
  CASE WHEN doc_id % 3 = 0 THEN 'ImplausibleDecodedData' END AS binary_reason,
  CASE WHEN doc_id % 3 <> 0 THEN 'UTF-16LE' END AS source_encoding,
  doc_id % 3 = 1 AS had_replacements,
  CASE WHEN doc_id % 3 <> 0 THEN md5(text || CASE WHEN doc_id % 3 = 1 THEN chr(65533) ELSE '' END) END AS text_md5
FROM documents""",
    "implausible_text": """
SELECT source AS bundle_id, CAST(doc_id AS VARCHAR) AS path, 2 + 4 * length(text) AS size
FROM documents WHERE doc_id % 3 = 0""",
    "legacy_charsets": f"""
SELECT CAST(doc_id AS VARCHAR) AS path, 'transcoded' AS decode_class,
  {_pick([label for label, _, _ in SENTENCES])} AS source_encoding, false AS had_replacements,
  md5({_pick([sentence for _, _, sentence in SENTENCES])} || regexp_replace(text, '[^\\x00-\\x7f]', '_', 'g')) AS text_md5
FROM documents""",
    "binary_starts": f"SELECT CAST(doc_id AS VARCHAR) AS path, {_pick([mime for mime, _ in STARTS])} AS mime FROM documents",
    "malformed_bom_on": _bad_bom_sql(True),
    "malformed_bom_off": _bad_bom_sql(False),
    "conversion_report": _BYTES
    + """SELECT bundle_id, path, size, encoding_on AS source_encoding, false AS had_replacements
FROM byte_files WHERE encoding_on IS NOT NULL""",
    "decode_metrics": _BYTES
    + """SELECT bundle_id,
  count(*) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)) AS valid_files,
  CAST(coalesce(sum(size) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)), 0) AS BIGINT) AS valid_bytes,
  count(*) FILTER (k IN (2, 3, 12)) AS transcoded_files,
  CAST(coalesce(sum(size) FILTER (k IN (2, 3, 12)), 0) AS BIGINT) AS transcoded_bytes
FROM byte_files GROUP BY bundle_id""",
    "observed_decoding": _BYTES
    + """SELECT count(*) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)) AS valid_files,
  CAST(coalesce(sum(size) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)), 0) AS BIGINT) AS valid_bytes,
  count(*) FILTER (k IN (2, 3, 12)) AS transcoded_files,
  CAST(coalesce(sum(size) FILTER (k IN (2, 3, 12)), 0) AS BIGINT) AS transcoded_bytes FROM byte_files""",
    "decode_metrics_off": _BYTES
    + """SELECT bundle_id,
  count(*) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)) AS valid_files,
  CAST(coalesce(sum(size) FILTER (k NOT IN (2, 3, 4, 5, 6, 7, 12)), 0) AS BIGINT) AS valid_bytes,
  CAST(0 AS BIGINT) AS transcoded_files, CAST(0 AS BIGINT) AS transcoded_bytes
FROM byte_files GROUP BY bundle_id""",
}
