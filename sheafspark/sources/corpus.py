"""File trees as corpora: a distributed listing, path filters, then balanced reading.

Folders are listed level by level: the folders of one level are rows, listing
them in tasks gives files and the folders of the next level. The driver holds
no names. Paths are filtered before any content is read, and reading is spread
by bytes, so neither a huge folder nor many small files end in one task.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sheafspark.functions.bytes import BOMS, PROBE_BYTES, SIGNATURES
from sheafspark.operators import ignore, select
from sheafspark.schemas import FILES, LISTING
from sheafspark.session import stage

# A reader task hands over a batch when it holds this many bytes.
BATCH_BYTES = 4 * 1024 * 1024
# What a cell of a table can hold, with room for what the operators add to it.
CELL_BYTES = 1_900_000_000
TOO_LARGE = "File is too large for one row"
# What a reading task gets on average, at most.
TASK_BYTES, TASK_FILES = 128 * 1024 * 1024, 20_000

_SIGNATURES = tuple(tuple((offset, bytes.fromhex(h)) for offset, h in parts) for _, parts in SIGNATURES)
_BOMS = {name: bytes.fromhex(h) for name, h in BOMS}


@lru_cache(maxsize=None)
def _file_system(scheme: str, authority: str):
    """(file system, path of its root), one per worker."""
    from pyarrow import fs  # starts threads, so not before a worker needs it

    if scheme == "file":
        return fs.LocalFileSystem(), ""
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")


def open_uri(uri: str):
    """(file system, path) of a URI or a local path; names are taken as they are, not %-decoded."""
    if not re.match(r"[a-z][a-z0-9+.-]+:/", uri):
        return _file_system("file", "")[0], os.path.abspath(uri)
    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return _file_system("file", "")[0], re.sub(r"^/+", "/", rest)
    authority, _, path = rest.removeprefix("//").partition("/")
    files, base = _file_system(scheme, authority)
    return files, f"{base.rstrip('/')}/{path}"


def children(files, path: str) -> Iterator[tuple[str, str, int | None, int | None, str | None]]:
    """(name, path, size, milliseconds of the last change, error) in a folder, size None for folders; no symbolic links."""
    from pyarrow import fs

    if files.type_name != "local":
        for info in files.get_file_info(fs.FileSelector(path)):
            changed = info.mtime_ns // 1_000_000 if info.mtime_ns else None
            yield info.base_name, info.path, info.size if info.type == fs.FileType.File else None, changed, None
        return
    with os.scandir(path) as inside:
        for entry in inside:
            if entry.is_symlink():
                continue
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, entry.path, None, None, None
                elif entry.is_file(follow_symlinks=False):
                    found = entry.stat(follow_symlinks=False)
                    # The change of the inode: a file moved in keeps its own older date of modification.
                    yield entry.name, entry.path, found.st_size, found.st_ctime_ns // 1_000_000, None
            except OSError as failure:
                yield entry.name, entry.path, 0, None, said(failure)


def said(failure: OSError) -> str:
    return os.strerror(failure.errno) if failure.errno else str(failure)


def prefix(uri: str) -> str:
    """What turns a path of the URI's file system back into a URI, authority included."""
    if not re.match(r"[a-z][a-z0-9+.-]+://", uri) or uri.startswith("file:"):
        return ""
    scheme, _, rest = uri.partition("://")
    authority = rest.partition("/")[0]
    # Object stores have the bucket as the first part of each path, other stores begin at the root.
    in_path = _file_system(scheme, authority)[1].strip("/")
    return f"{scheme}://" if in_path else f"{scheme}://{authority}"


def _list_level(folders: DataFrame, uri: str, by_child: bool, strict: bool) -> DataFrame:
    """Everything directly in the given folders."""

    def list_folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = open_uri(uri)
        before = prefix(uri)
        names = ["bundle_id", "path", "size", "uri", "is_folder", "list_error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows = []
        for incoming in batches:
            for bundle, folder in zip(incoming["bundle_id"].to_pylist(), incoming["path"].to_pylist()):
                place = f"{top.rstrip('/')}/{folder}" if folder else top
                try:
                    for name, path, size, _, error in children(files, place):
                        inner = f"{folder}/{name}" if folder else name
                        # With bundles by child, the first level gives the bundles their names.
                        named = name if by_child and not folder else bundle
                        if error and strict:
                            raise RuntimeError(f"{path}: {error}")
                        rows.append((named, inner, size, before + path, size is None, error))
                        if len(rows) >= 50_000:
                            yield batch(rows)
                            rows = []
                except OSError as failure:
                    rows.append((bundle, folder, 0, before + place, False, said(failure)))
        if rows:
            yield batch(rows)

    return folders.select("bundle_id", "path").mapInArrow(list_folders, f"{LISTING}, is_folder boolean, list_error string")


def list_corpus(
    spark: SparkSession, path: str, bundles: str = "self", shards: int | None = None, on_stat_error: str = "fail"
) -> DataFrame:
    """(bundle_id, path, size, uri, list_error) of all regular files, dot-files included.

    ``bundles`` is 'self' (the folder is one bundle) or 'children' (each
    sub-folder is one). A folder that cannot be listed or has vanished gives one
    row with its error and does not stop the others; the top folder must be
    there. A file whose size
    cannot be asked for stops the listing (``on_stat_error='fail'``) or is a row with its error ('keep').
    """
    files, root = open_uri(path)
    for _ in children(files, root):  # a missing top folder is a mistake of the caller
        break
    by_child = bundles == "children"
    level = spark.createDataFrame([(os.path.basename(root.rstrip("/")), "")], "bundle_id string, path string")
    found = None
    while True:
        listed = stage(_list_level(level, path, by_child, on_stat_error == "fail"))
        entries = listed.where("NOT is_folder")
        if by_child:
            # Files beside the bundles belong to none; paths start below the bundle's folder.
            inner = F.col("path").contains("/") | F.col("list_error").isNotNull()
            below = F.substring("path", F.length("bundle_id") + 2, F.length("path"))
            entries = entries.where(inner).withColumn("path", below)
        found = entries if found is None else found.unionByName(entries)
        folders = listed.where("is_folder")
        count = folders.count()
        if not count:
            break
        wanted = shards or 4 * spark.sparkContext.defaultParallelism
        level = folders.select("bundle_id", "path").repartition(max(1, min(count, wanted)))
    return found.select("bundle_id", "path", "size", "uri", "list_error")


class CorpusSource(DataSource):
    """``spark.read.format("corpus").load(folder)``: one folder as one bundle, for SQL and small trees.

    One task per folder directly below; ``list_corpus`` splits deeper and keeps errors as rows.
    """

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return CorpusReader(self.options["path"])


class CorpusReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> Sequence[InputPartition]:
        files, top = open_uri(self.uri)
        inner = [path for _, path, size, *_ in children(files, top) if size is None]
        return [InputPartition(None), *map(InputPartition, inner)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        files, top = open_uri(self.uri)
        before, base = prefix(self.uri), top.rstrip("/")
        pending = [partition.value or top]
        while pending:
            for _, path, size, *_ in children(files, pending.pop()):
                if size is not None:
                    yield os.path.basename(base), path[len(base) + 1 :], size, before + path
                elif partition.value:
                    pending.append(path)


def _known_binary(start: bytes, utf8: bool) -> bool:
    """Whether the first bytes already decide that a file is binary."""
    if start.startswith((_BOMS["UTF-16LE"], _BOMS["UTF-16BE"])):
        return not utf8
    body = start.removeprefix(_BOMS["UTF-8"])
    if b"\0" in body:
        return True
    return any(all(body[o : o + len(s)] == s for o, s in parts) for parts in _SIGNATURES)


def read_bytes(stream, utf8: bool, probe_only: bool) -> bytes:
    """Whole content, or only the probe of a file that is binary beyond doubt.

    The probe alone leads the classification to the same reason.
    """
    start = stream.read(PROBE_BYTES)
    if probe_only and _known_binary(start, utf8):
        return start
    return start + stream.read()


def content_reader(utf8: bool = False, probe_only: bool = False):
    """(function for ``mapInArrow``, schema) that turns listing rows (with ``list_error``) into rows of ``files``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bundle_id", "path", "size", "content", "read_error"] + ["truncated"] * probe_only
        types = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()] + [pa.bool_()] * probe_only
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for incoming in batches:
            for row in incoming.to_pylist():
                content, error, cut = None, row["list_error"], False
                if error is None and (row["size"] or 0) >= CELL_BYTES:
                    error = TOO_LARGE
                try:
                    if error is None:
                        files, path = open_uri(row["uri"])
                        with files.open_input_stream(path, compression=None) as stream:
                            content = read_bytes(stream, utf8, probe_only)
                            cut = probe_only and len(content) == PROBE_BYTES and bool(stream.read(1))
                except OSError as failure:
                    error = said(failure)
                rows.append((row["bundle_id"], row["path"], row["size"], content, error) + (cut,) * probe_only)
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    return read, FILES + ", truncated boolean" if probe_only else FILES


def reading_tasks(listing: DataFrame) -> int:
    """Tasks for reading the files of a listing: thin rows say nothing about the bytes behind them, so they are summed."""
    total = listing.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    cores = listing.sparkSession.sparkContext.defaultParallelism
    return max(min(cores, total["n"]), -(-(total["bytes"] or 0) // TASK_BYTES), -(-total["n"] // TASK_FILES), 1)


def read_contents(listing: DataFrame, utf8: bool = False, probe_only: bool = False) -> DataFrame:
    """The ``files`` table of a listing; an unreadable file keeps a row with its error.

    The listing is read twice, first for the number of tasks. With
    ``probe_only`` only the start of a file is read where that decides that it
    is binary; such rows are marked in a column ``truncated``, and ``classify``
    refuses them if it comes to another result. A file that no cell can hold is a row with an
    error as well; ``sources.chunks`` measures files of any size.
    """
    failed = F.col("list_error") if "list_error" in listing.columns else F.lit(None).cast("string")
    thin = listing.select("bundle_id", "path", "size", "uri", failed.alias("list_error"))
    read, schema = content_reader(utf8, probe_only)
    return thin.repartition(reading_tasks(thin), "bundle_id", "path").mapInArrow(read, schema)


def rule_files(listing: DataFrame) -> DataFrame:
    """Ignore files of a listing as (bundle_id, rule_dir, source, text)."""
    path = F.col("path")
    source = (
        F.when(path.rlike(r"(?:\A|/)\.gitignore\z"), "gitignore")
        .when(path.rlike(r"(?:\A|/)\.ignore\z"), "ignore")
        .when(path == ".git/info/exclude", "exclude")
    )
    found = listing.where(source.isNotNull())
    folder = F.when(F.col("source") == "exclude", F.lit("")).otherwise(
        F.regexp_replace(path, r"/?[^/]*\z", "")
    )
    return (
        read_contents(found, probe_only=False)
        .where("content IS NOT NULL")
        .withColumn("source", source)
        .select("bundle_id", folder.alias("rule_dir"), "source", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    )


def read_corpus(
    spark: SparkSession,
    path: str,
    bundles: str = "self",
    extend: Sequence[str] | None = None,
    replace: Sequence[str] | None = None,
    utf8: bool = False,
    ignore_files: bool = True,
    probe_only: bool = False,
    on_stat_error: str = "fail",
) -> DataFrame:
    """List, drop ignored and excluded paths, then read what is left.

    Several steps look at the listing; the levels of the folder trees are staged
    tables. Folders that could not be listed stay as rows with their error.
    """
    listing = list_corpus(spark, path, bundles, on_stat_error=on_stat_error)
    kept = select.exclude_paths(listing, extend, replace)
    if ignore_files:
        kept = stage(ignore.apply_ignore_rules(kept, ignore.parse_ignore_rules(rule_files(listing))))
    return read_contents(kept, utf8, probe_only)
