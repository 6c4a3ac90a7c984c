"""Scanning folder trees, reading with a probe, read errors, and streams of files."""

import gzip
import io
import os

import pytest
from pyspark.sql import functions as F

from sheafspark.functions.bytes import PROBE_BYTES
from sheafspark.options import BundleOptions
from sheafspark.plans.pack import entries_of
from sheafspark.session import shared_dir
from sheafspark.sources.corpus import _list_level, list_corpus, read_bytes, read_contents, read_corpus
from sheafspark.streaming.files import running_totals, watch_files, write_entries

PNG = b"\x89PNG\r\n\x1a\n"


def plant(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content.encode() if isinstance(content, str) else content)
    return str(root)


def test_listing_keeps_dot_files_and_passes_links_over(spark, tmp_path):
    files = {"a.txt": "1", ".env": "22", "_x/.y/z": "333", "d/e/f/g/h": "4"}
    root = plant(tmp_path, files)
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    os.symlink(tmp_path / "d", tmp_path / "linked")
    for shards in (1, 3, 50):
        rows = list_corpus(spark, root, shards=shards).collect()
        assert {(r.path, r.size) for r in rows} == {(p, len(c)) for p, c in files.items()} and len(rows) == 4
    assert {r.bundle_id for r in rows} == {tmp_path.name}


def test_children_are_bundles_and_ignore_files_rule(spark, tmp_path):
    root = plant(
        tmp_path,
        {
            "one/.gitignore": "*.tmp\nout/\n", "one/a.txt": "a", "one/b.tmp": "b", "one/out/c.txt": "c",
            "one/sub/.gitignore": "!b.tmp\n", "one/sub/b.tmp": "kept", "one/.git/info/exclude": "secret*\n",
            "one/secret.txt": "s", "one/.ignore": "a?.txt\n", "one/ab.txt": "x",
            "two/a.txt": "a", "two/b.tmp": "b", "two/Cargo.lock": "l", "stray.txt": "no bundle",
        },
    )
    rows = {(r.bundle_id, r.path): bytes(r.content) for r in read_corpus(spark, root, "children").collect()}
    assert set(rows) == {("one", "a.txt"), ("one", "sub/b.tmp"), ("one", ".ignore"), ("two", "a.txt"), ("two", "b.tmp")}
    assert rows["one", "sub/b.tmp"] == b"kept"
    replaced = read_corpus(spark, root, "children", replace=["a.txt"], ignore_files=False)
    assert {(r.bundle_id, r.path) for r in replaced.collect()} >= {("one", ".gitignore"), ("two", "Cargo.lock"), ("one", "b.tmp")}


class Counting(io.BytesIO):
    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        self.taken += len(data)
        return data


def test_early_binaries_are_read_no_further_than_the_probe():
    long = b"x" * (PROBE_BYTES * 4)
    cases = [
        (PNG + long, True, PROBE_BYTES), (b"a\0" + long, True, PROBE_BYTES), (b"\xef\xbb\xbf" + PNG + long, True, PROBE_BYTES),
        (b"\xef\xbb\xbfa\0" + long, True, PROBE_BYTES), (b"\xff\xfe" + long, False, PROBE_BYTES), (b"\xfe\xff" + long, False, PROBE_BYTES),
        (b"\xff\xfe" + long, True, None), (long + b"\0", True, None), (b"text" + long, False, None),
    ]
    for content, utf8, taken in cases:
        stream = Counting(content)
        got = read_bytes(stream, utf8, True)
        assert stream.taken == (taken or len(content)) and got == content[: stream.taken]
        assert read_bytes(io.BytesIO(content), utf8, False) == content


def test_probe_reading_gives_the_same_entries(spark, tmp_path):
    root = plant(tmp_path, {"p.png": PNG + b"x" * 20000, "t": "text", "n": b"x" * 9000 + b"\0", "u": b"\xff\xfe" + b"a\0" * 9000})
    rows = []
    for probe_only in (True, False):
        entries = entries_of(read_corpus(spark, root, probe_only=probe_only))
        rows.append(sorted(tuple(r) for r in entries.select("path", "size", "disposition", "binary_reason", "lines").collect()))
    assert rows[0] == rows[1]
    assert [r[3] for r in rows[0]] == ["NullByte", "RecognizedMagic", None, "Utf16ConversionDisabled"]


def test_whole_files_by_default_and_cut_ones_never_pass(spark, tmp_path):
    wide = b"\xff\xfe" + "".join(f"row {i:05d} of a wide file\n" for i in range(5000)).encode("utf-16-le")
    root = plant(tmp_path, {"wide.txt": wide})
    row = entries_of(read_corpus(spark, root), BundleOptions(utf8=True)).first()
    assert (row.disposition, row.lines, row["size"]) == ("text", 5000, len(wide))
    cut = read_corpus(spark, root, probe_only=True)
    assert cut.first().truncated and entries_of(cut).first().binary_reason == "Utf16ConversionDisabled"
    with pytest.raises(Exception, match="only the start of wide.txt"):
        entries_of(cut, BundleOptions(utf8=True)).collect()


def test_many_small_files_are_read_by_all_cores(spark, tmp_path):
    root = plant(tmp_path, {f"d/{i}.txt": "x" for i in range(300)})
    files = read_corpus(spark, root, ignore_files=False)
    assert files.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and files.count() == 300


def test_folders_that_cannot_be_listed_do_not_stop_the_scan(spark, tmp_path):
    root = plant(tmp_path, {"a/x.txt": "x", "b/y.txt": "y"})
    (tmp_path / "b" / "locked").mkdir()
    listed = _list_level(spark.createDataFrame([("s", "a"), ("s", "gone"), ("s", "b")], "bundle_id string, path string"), root, False, True)
    rows = {r.path: r for r in listed.collect()}
    assert rows["a/x.txt"]["size"] == 1 and rows["b/locked"].is_folder
    assert rows["gone"].list_error == "No such file or directory" and not rows["gone"].is_folder
    broken = read_contents(listed.where("NOT is_folder"))
    assert {(r.path, r.read_error) for r in broken.collect()} == {("a/x.txt", None), ("b/y.txt", None), ("gone", "No such file or directory")}
    with pytest.raises(FileNotFoundError):
        list_corpus(spark, root + "/nowhere")


def test_stream_paths_begin_below_the_root(spark, tmp_path):
    root = plant(tmp_path / "data", {"x/data/y.txt": "1", "y.txt": "2"})
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    write_entries(watch_files(spark, root, "inbox"), target, checkpoint).awaitTermination()
    assert {r.path for r in spark.read.parquet(target).collect()} == {"x/data/y.txt", "y.txt"}


def test_compressed_files_are_read_as_they_are(spark, tmp_path):
    packed = gzip.compress(b"text")
    root = plant(tmp_path, {"a.gz": packed, "100%25 +.txt": "odd name"})
    rows = {r.path: r for r in read_corpus(spark, root).collect()}
    assert bytes(rows["a.gz"].content) == packed and rows["a.gz"]["size"] == len(packed)
    assert bytes(rows["100%25 +.txt"].content) == b"odd name"


def test_unreadable_file_becomes_an_entry(spark, tmp_path):
    root = plant(tmp_path, {"here.txt": "1", "gone.txt": "22"})
    listing = list_corpus(spark, root).withColumn(
        "uri", F.when(F.col("path") == "gone.txt", F.concat("uri", F.lit(".missing"))).otherwise(F.col("uri"))
    )
    rows = {r.path: r for r in entries_of(read_contents(listing)).collect()}
    assert rows["here.txt"].disposition == "text" and rows["here.txt"].body == "1"
    gone = rows["gone.txt"]
    assert (gone.disposition, gone["size"], gone.lines) == ("read_error", 0, 0)
    assert gone.diagnostic == "Failed to read file: No such file or directory"


def test_arriving_files(spark, tmp_path):
    root = plant(tmp_path, {"a.txt": "1\n2\n", "sub/b.txt": "x", "c.lock": "no"})
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    write_entries(watch_files(spark, root, "inbox"), target, checkpoint).awaitTermination()
    assert {(r.bundle_id, r.path, r.lines) for r in spark.read.parquet(target).collect()} == {("inbox", "a.txt", 2), ("inbox", "sub/b.txt", 1)}
    plant(tmp_path, {"later.bin": b"\0"})
    write_entries(watch_files(spark, root, "inbox"), target, checkpoint, BundleOptions()).awaitTermination()
    got = {r.path: r.disposition for r in spark.read.parquet(target).collect()}
    assert got == {"a.txt": "text", "sub/b.txt": "text", "later.bin": "binary"}


def test_running_totals(spark, tmp_path):
    root = plant(tmp_path, {"a.txt": "1\n2\n", "b.bin": b"\0"})
    totals = running_totals(watch_files(spark, root, "inbox"))
    query = totals.writeStream.format("memory").queryName("totals").outputMode("complete").start()
    query.processAllAvailable()
    plant(tmp_path, {"c.txt": "3"})
    query.processAllAvailable()
    query.stop()
    assert {(r.disposition, r.n_files, r.n_bytes, r.n_lines) for r in spark.table("totals").collect()} == {
        ("text", 2, 5, 3), ("binary", 1, 1, 0),
    }
