"""Queries on files that arrive, files of any size, and snapshots that are compared."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from catalogue import corpora as C
from catalogue import sql as Q
from catalogue.entries import entries
from catalogue.sql import with_
from sheafspark.operators import diff
from sheafspark.operators.classify import classify
from sheafspark.session import shared_dir
from sheafspark.sources.chunks import measure_files
from sheafspark.sources.corpus import list_corpus, open_uri, read_contents, read_corpus
from sheafspark.streaming.corpus import watch_corpus
from sheafspark.streaming.documents import MARKER, read_finished, write_finished


def plant(files, folder):
    """Write rows (path, content) of a table as files below a folder, in tasks."""

    def write(batches):
        store, top = open_uri(folder)
        made = set()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            for path, content in zip(paths, batch.column("content")):
                place, content = f"{top}/{path}", content.as_py()
                inside = place.rpartition("/")[0]
                if inside not in made:
                    store.create_dir(inside, recursive=True)
                    made.add(inside)
                with store.open_output_stream(place, compression=None) as stream:
                    stream.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    files.select("path", "content").mapInArrow(write, "path string").write.format("noop").mode("overwrite").save()


# ---- streams

# Dot-files, underscore-files and folders that begin so, beside ordinary names.
_ARRIVING = """concat(bundle_id, '/', CASE CAST(substring(md5(path), 1, 1) AS string)
  WHEN '0' THEN concat('.env/', path) WHEN '1' THEN concat('_x/', path) WHEN '2' THEN concat('a/b/c/d/', path) ELSE path END)"""


def streamed_files(spark, sf):
    """Documents as files of a folder tree that arrive in two waves, the stream stopped in between."""
    folder, target, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    files = C.docs(spark, sf).withColumn("path", F.expr(_ARRIVING))
    second = F.crc32("content") % 2 == 1
    for wave in (~second, second):
        plant(files.where(wave), folder)
        arriving = watch_corpus(spark, folder, "children")
        seen = arriving.select("bundle_id", "path", "size", F.md5("content").alias("content_md5"), "read_error")
        query = seen.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)


def streamed_documents(spark, sf):
    """Bundles whose files arrive in two waves; some finish with the first, the others with the third; documents read back."""
    folder, target, checkpoint = shared_dir(spark), shared_dir(spark), shared_dir(spark)
    files = C.docs(spark, sf).withColumn("early", F.crc32("bundle_id") % 3 == 0)
    placed = files.withColumn("path", F.concat_ws("/", "bundle_id", "path"))
    markers = files.select(F.concat_ws("/", "bundle_id", F.lit(MARKER)).alias("path"), "early", F.lit(b"").alias("content")).distinct()
    first = F.col("early") | (F.crc32("content") % 2 == 0)
    waves = (placed.where(first), markers.where("early")), (placed.where(~first),), (markers.where("NOT early"),)
    for wave in waves:
        for part in wave:
            plant(part, folder)
        write_finished(watch_corpus(spark, folder, "children"), target, checkpoint).awaitTermination()
    back = read_finished(spark, target)
    return back.select("bundle_id", "path", "size", "lines", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


# ---- files of any size


def chunked_scan(spark, sf):
    """The byte corpus as files, measured in chunks of 97 bytes; a chunk of 64 MB is the default."""
    folder = shared_dir(spark)
    files = C.byte_files(spark, sf)
    plant(files.withColumn("path", F.concat_ws("/", "bundle_id", "path")), folder)
    found = measure_files(list_corpus(spark, folder, "children"), True, 97)
    text = F.col("binary_reason").isNull() & F.col("lines").isNotNull()
    return found.select("bundle_id", "path", "size", F.when(text, F.col("lines")).alias("lines"), "binary_reason", "binary_detail")


def probe_scan(spark, sf):
    """The byte corpus as files, binaries read no further than their start: what was read, and what it was taken for."""
    folder = shared_dir(spark)
    plant(C.byte_files(spark, sf).withColumn("path", F.concat_ws("/", "bundle_id", "path")), folder)
    read = read_corpus(spark, folder, "children", replace=[], ignore_files=False, probe_only=True)
    return classify(read).select(
        "bundle_id", "path", "size", F.octet_length("content").cast("bigint").alias("read_bytes"), "truncated", "binary_reason", "binary_detail"
    )


def scan_errors(spark, sf):
    """Files that are gone when they are to be read, beside those that are there."""
    folder = shared_dir(spark)
    plant(C.docs(spark, sf).withColumn("path", F.concat_ws("/", "bundle_id", "path")), folder)
    gone = F.substring(F.md5("path"), 1, 1).isin("0", "1", "2")
    listing = list_corpus(spark, folder, "children").withColumn("uri", F.when(gone, F.concat("uri", F.lit(".gone"))).otherwise(F.col("uri")))
    made = entries(read_contents(listing))
    return made.select("bundle_id", "path", "disposition", "size", "lines", "diagnostic")


# ---- snapshots

_BEFORE = "doc_id % 19 <> 0"
_AFTER = """
SELECT bundle_id, doc_id,
  CASE WHEN doc_id % 13 = 1 THEN 'moved/' || path WHEN doc_id % 13 = 2 THEN path || '.new' ELSE path END AS path,
  CASE WHEN doc_id % 7 = 3 THEN 'changed ' || text WHEN doc_id % 29 = 5 THEN '' ELSE text END AS text
FROM {docs} WHERE doc_id % 17 <> 4
"""


def _snapshots(spark, sf):
    docs = C.table(spark, sf, "documents", "doc_id").selectExpr("source AS bundle_id", "doc_id", f"{C._DOC_PATH} AS path", "text")
    files = [docs.where(_BEFORE), spark.sql(_AFTER.format(docs="{docs}"), docs=docs)]
    return [diff.fingerprints(f.select("bundle_id", "path", F.encode("text", "UTF-8").alias("content"))) for f in files]


def snapshot_diff(spark, sf):
    """Two snapshots of the documents: some gone, some new, some changed, some in another folder or under another name."""
    return diff.diff_snapshots(*_snapshots(spark, sf))


def snapshot_summary(spark, sf):
    return diff.diff_summary(snapshot_diff(spark, sf))


QUERIES = {
    "streamed_files": streamed_files,
    "streamed_documents": streamed_documents,
    "chunked_scan": chunked_scan,
    "probe_scan": probe_scan,
    "scan_errors": scan_errors,
    "snapshot_diff": snapshot_diff,
    "snapshot_summary": snapshot_summary,
}


# ---- SQL


def _pairs(name: str, keys: str, old: str, new: str) -> str:
    """CTEs: pairs of the n-th rows of each key, and what is left of both sides."""
    by = keys.split(", ")
    same = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in by)
    side = "SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY path, hash) AS n FROM {source}"
    return f"""
{name}_a AS ({side.format(keys=keys, source=old)}),
{name}_b AS ({side.format(keys=keys, source=new)}),
{name} AS (SELECT b.bundle_id AS bundle_id, b.path AS path, a.path AS old_path, a.hash AS old_hash, b.hash AS new_hash
  FROM {name}_a a JOIN {name}_b b ON {same} AND a.n = b.n),
{name}_old AS (SELECT bundle_id, path, hash, name FROM {name}_a a WHERE NOT EXISTS (SELECT 1 FROM {name}_b b WHERE {same} AND a.n = b.n)),
{name}_new AS (SELECT bundle_id, path, hash, name FROM {name}_b b WHERE NOT EXISTS (SELECT 1 FROM {name}_a a WHERE {same} AND a.n = b.n))"""


_SIDE = f"SELECT bundle_id, path, sha256(text) AS hash, {Q.name('path')} AS name FROM"
_DIFF = (
    with_(
        C.DOCS,
        f"before AS ({_SIDE} docs WHERE {_BEFORE})",
        f"after AS ({_SIDE} ({_AFTER.format(docs='docs')}))",
        "gone AS (SELECT * FROM before EXCEPT ALL SELECT * FROM after)",
        "come AS (SELECT * FROM after EXCEPT ALL SELECT * FROM before)",
        _pairs("changed", "bundle_id, path", "gone", "come"),
        _pairs("moved", "bundle_id, hash, name", "changed_old", "changed_new"),
        _pairs("renamed", "bundle_id, hash", "moved_old", "moved_new"),
    )
    + """
SELECT bundle_id, 'changed' AS status, path, CAST(NULL AS VARCHAR) AS old_path, old_hash, new_hash FROM changed
UNION ALL SELECT bundle_id, 'moved', path, old_path, old_hash, new_hash FROM moved
UNION ALL SELECT bundle_id, 'moved', path, old_path, old_hash, new_hash FROM renamed
UNION ALL SELECT bundle_id, 'removed', path, NULL, hash, NULL FROM renamed_old
UNION ALL SELECT bundle_id, 'added', path, NULL, NULL, hash FROM renamed_new"""
)

SQL = {
    "streamed_files": with_(C.DOCS)
    + """SELECT bundle_id, CASE substr(md5(path), 1, 1) WHEN '0' THEN '.env/' || path WHEN '1' THEN '_x/' || path
    WHEN '2' THEN 'a/b/c/d/' || path ELSE path END AS path, CAST(size AS BIGINT) AS size, md5(text) AS content_md5,
  CAST(NULL AS VARCHAR) AS read_error FROM docs""",
    "streamed_documents": with_(C.DOCS)
    + f"""SELECT bundle_id, path, CAST(size AS BIGINT) AS size, {Q.lines('text')} AS lines, md5({Q.newlines('text')}) AS text_md5
FROM docs WHERE NOT {C.DEFAULT_EXCLUDED}""",
    "chunked_scan": with_(C.BYTES)
    + f"""SELECT bundle_id, path, CAST(size AS BIGINT) AS size, reason_on AS binary_reason, detail_on AS binary_detail,
  CASE WHEN reason_on IS NULL AND k NOT IN (2, 3) THEN CAST({Q.lines("CASE WHEN k = 12 THEN src ELSE plain END")} AS BIGINT) END AS lines
FROM byte_files""",
    "probe_scan": with_(C.BYTES)
    + """SELECT bundle_id, path, CAST(size AS BIGINT) AS size, CAST(CASE WHEN k IN (2, 3, 4, 5) THEN least(size, 8192) ELSE size END AS BIGINT) AS read_bytes,
  k IN (2, 3, 4, 5) AND size > 8192 AS truncated, reason_off AS binary_reason, detail_off AS binary_detail FROM byte_files""",
    "scan_errors": with_(C.DOCS)
    + f"""SELECT bundle_id, path, CASE WHEN gone THEN 'read_error' ELSE 'text' END AS disposition,
  CAST(CASE WHEN gone THEN 0 ELSE size END AS BIGINT) AS size, CASE WHEN gone THEN 0 ELSE {Q.lines('text')} END AS lines,
  CASE WHEN gone THEN 'Failed to read file: No such file or directory' END AS diagnostic
FROM (SELECT *, substr(md5(path), 1, 1) IN ('0', '1', '2') AS gone FROM docs)""",
    "snapshot_diff": _DIFF,
    "snapshot_summary": f"""SELECT bundle_id, count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
  count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'moved') AS moved FROM ({_DIFF}) GROUP BY bundle_id""",
}
