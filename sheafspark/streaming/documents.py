"""Documents of finished bundles, written while files keep arriving.

A bundle is finished when a marker file arrives at its top. Until then its files wait in a table, dealt into folders by a hash of
the bundle, so that a batch reads only the folders that its finished bundles lie in; markers have a folder of their own. Contents are
written where they arrive, once as waiting files, and never move before they are rendered: joins see paths alone. Each batch writes into folders named by its
id and replaces what an earlier try of the same batch left there; the last thing it writes is its entry in the commit log. Readers
go by the log alone, so every document appears once, whatever was interrupted and run again. Files that come after their bundle's marker
are kept apart (``late_files``) and change no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sheafspark.operators.document import document_rows
from sheafspark.operators.select import exclude_paths, require_safe_paths
from sheafspark.options import BundleOptions
from sheafspark.plans.pack import entries_of
from sheafspark.schemas import FILES
from sheafspark.session import stage
from sheafspark.sinks.bundles import write_bundles
from sheafspark.sources.bundles import read_bundles
from sheafspark.sources.corpus import children, open_uri

MARKER = ".complete"
BUCKETS = 256
MARKERS = -1  # the folder of the markers, beside the buckets
_WAITING = FILES + ", batch bigint, bucket int"
_LOG = "bundle_id string, batch bigint"


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table that batches write into; nothing before the first one."""
    files, path = open_uri(folder)
    try:
        there = any(True for _ in children(files, path))
    except OSError:
        there = False
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def commit_log(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, batch) of the documents that are written."""
    return _table(spark, f"{target}/log", _LOG)


def write_batch(
    files: DataFrame, batch: int, target: str, options: BundleOptions = BundleOptions(), marker: str = MARKER, spark: SparkSession | None = None
) -> None:
    """Take the files of one batch in and write the documents of the bundles whose marker is among them.

    ``files`` is read once. What follows runs in the session ``spark``: that of a stream's batches plans without looking at sizes.
    """
    spark = spark or files.sparkSession
    bucket = F.pmod(F.xxhash64("bundle_id"), F.lit(BUCKETS)).cast("int")
    named = files.where("path IS NOT NULL").withColumn("bucket", F.when(F.col("path") == marker, MARKERS).otherwise(bucket))
    arrived = f"{target}/waiting/batch={batch}"
    named.sortWithinPartitions("bucket", "bundle_id").write.mode("overwrite").partitionBy("bucket").parquet(arrived)
    # Bundles of later batches cannot be in the log; those of this one are there if it is run again.
    done = commit_log(spark, target).where(F.col("batch") < batch).select("bundle_id")
    marked = _table(spark, f"{arrived}/bucket={MARKERS}", "bundle_id string").distinct().join(done, "bundle_id", "left_anti")
    finished = stage(marked.select("bundle_id", bucket.alias("bucket")))
    buckets = [r.bucket for r in finished.select("bucket").distinct().collect()]
    if not buckets:
        return
    waiting = _table(spark, f"{target}/waiting", _WAITING).where(F.col("bucket").isin(buckets) & (F.col("batch") <= batch))
    bundles = finished.select("bundle_id")
    paths = stage(waiting.select("bundle_id", "path", "batch").join(bundles, "bundle_id", "left_semi"))
    # Of a file that changed while its bundle was open the last version counts.
    versions = paths.groupBy("bundle_id", "path").agg(F.min("batch").alias("first"), F.max("batch").alias("last"))
    changed = stage(versions.where("first < last").select("bundle_id", "path", "last"))

    def latest(rows: DataFrame) -> DataFrame:
        same = (rows["bundle_id"] == changed["bundle_id"]) & (rows["path"] == changed["path"])
        return rows.join(changed, same & (rows["batch"] < changed["last"]), "left_anti")

    safe = require_safe_paths(latest(paths), options.on_bad_path)
    if options.on_bad_path == "quarantine":
        bundles = stage(safe.select("bundle_id").distinct())
    ready = latest(waiting.join(bundles, "bundle_id", "left_semi")).select([c.split()[0] for c in FILES.split(", ")])
    listed = exclude_paths(safe, options.extend_exclude, options.exclude)
    rows = stage(document_rows(entries_of(ready, options), listed, options.line_numbers))
    level = options.gzip_level if options.gzip else None
    write_bundles(rows, f"{target}/documents/batch={batch}", level, staged=True, mode="overwrite")
    finished.select("bundle_id").coalesce(1).write.mode("overwrite").parquet(f"{target}/log/batch={batch}")


def write_finished(
    files: DataFrame, target: str, checkpoint: str, options: BundleOptions = BundleOptions(), marker: str = MARKER
) -> StreamingQuery:
    """Write documents of bundles as they are finished; stops when all input is taken."""
    spark = files.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, target, options, marker, spark)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_finished(spark: SparkSession, target: str) -> DataFrame:
    """Entries of all committed documents, as ``read_bundles`` gives them."""
    batches = [r.batch for r in commit_log(spark, target).select("batch").distinct().collect()]
    if not batches:
        raise FileNotFoundError(f"no document is finished below {target}")
    return read_bundles(spark, [f"{target}/documents/batch={batch}" for batch in sorted(batches)])


def late_files(spark: SparkSession, target: str) -> DataFrame:
    """(bundle_id, path, size, batch) of files that came after their bundle's document was written."""
    arrived = _table(spark, f"{target}/waiting", _WAITING).where(F.col("bucket") != MARKERS)
    waiting = arrived.select("bundle_id", "path", "size", F.col("batch").alias("came"))
    log = commit_log(spark, target)
    return waiting.join(log, "bundle_id").where("came > batch").select("bundle_id", "path", "size", F.col("came").alias("batch"))
