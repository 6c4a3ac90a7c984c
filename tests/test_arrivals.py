"""Corpus streams, documents of finished bundles, files of any size, and snapshot differences."""

import os
import random
import time
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafspark.operators.classify import classify
from sheafspark.operators.diff import diff_snapshots, diff_summary, numbered
from sheafspark.plans.pack import entries_of
from sheafspark.session import shared_dir
from sheafspark.sources import corpus
from sheafspark.sources import chunks
from sheafspark.sources.chunks import measure, measure_files
from sheafspark.sources.corpus import content_reader, list_corpus, read_contents, read_corpus
from sheafspark.streaming.corpus import ScanReader, arriving_paths, watch_corpus
from sheafspark.streaming.documents import MARKER, commit_log, late_files, read_finished, write_batch, write_finished


def plant(root, files):
    for path, content in files.items():
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content if isinstance(content, bytes) else content.encode())
    time.sleep(0.02)  # a scan takes what changed before it began
    return str(root)


def drain(stream, target, checkpoint):
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()


def test_everything_arrives_once_and_as_in_batch(spark, tmp_path):
    files = {".env": "K=1", "_x": "2", "_d/.h/z": "3", "a/b/c/d/e/f": "4", "plain.txt": "5", "a/empty": ""}
    root = plant(tmp_path / "in", files)
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    for levels in (2, 2):  # nothing new the second time
        drain(watch_corpus(spark, root, levels=levels), target, checkpoint)
        rows = spark.read.parquet(target).collect()
        assert Counter((r.path, bytes(r.content).decode()) for r in rows) == Counter(files.items())
    batch = read_corpus(spark, root, replace=[], ignore_files=False).collect()
    assert sorted(map(repr, batch)) == sorted(map(repr, rows))
    plant(tmp_path / "in", {"_x": "changed", "late/new": "6"})
    drain(watch_corpus(spark, root), target, checkpoint)
    got = Counter((r.path, bytes(r.content).decode()) for r in spark.read.parquet(target).collect())
    assert got == Counter([*files.items(), ("_x", "changed"), ("late/new", "6")])


def test_vanished_and_unreadable_files_have_errors(spark, tmp_path):
    root = plant(tmp_path / "in", {"here": "1", "gone": "2", "folder": "3"})
    os.mkdir(tmp_path / "in" / "inner")
    listed = arriving_paths(spark, root)
    # What happens between listing and reading: one file goes, another is replaced by something unreadable.
    other = F.when(F.col("path") == "gone", F.concat("uri", F.lit(".missing"))).when(F.col("path") == "folder", F.lit(f"{root}/inner"))
    read, schema = content_reader()
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    drain(listed.withColumn("uri", F.coalesce(other, "uri")).mapInArrow(read, schema), target, checkpoint)
    rows = {r.path: r for r in spark.read.parquet(target).collect()}
    assert rows["here"].read_error is None and bytes(rows["here"].content) == b"1"
    assert rows["gone"].read_error == "No such file or directory" and rows["gone"].content is None
    assert rows["folder"].read_error and rows["folder"].content is None
    errors = {r.path: r.disposition for r in entries_of(spark.read.parquet(target)).collect()}
    assert errors == {"here": "text", "gone": "read_error", "folder": "read_error"}
    with pytest.raises(FileNotFoundError):
        arriving_paths(spark, root + "/nowhere")


def test_a_scan_looks_up_to_its_end():
    reader = ScanReader()
    end = reader.latestOffset()
    (partition,) = reader.partitions(reader.initialOffset(), end)
    assert list(reader.read(partition)) == [(end["until"],)]
    assert not reader.partitions(end, end)


def test_bundles_are_children_in_streams_too(spark, tmp_path):
    root = plant(tmp_path / "in", {"one/a": "1", "one/.x/b": "2", "two/a": "3", "stray": "4"})
    target, checkpoint = shared_dir(spark), shared_dir(spark)
    drain(watch_corpus(spark, root, "children"), target, checkpoint)
    assert {(r.bundle_id, r.path) for r in spark.read.parquet(target).collect()} == {("one", "a"), ("one", ".x/b"), ("two", "a")}


def test_finished_bundles_are_written_once(spark, tmp_path):
    target, checkpoint = shared_dir(spark), shared_dir(spark)

    def run():
        write_finished(watch_corpus(spark, root, "children"), target, checkpoint).awaitTermination()

    root = plant(tmp_path / "in", {"one/a.txt": "1\n", "one/b.txt": "old", "two/a.txt": "2"})
    run()
    assert commit_log(spark, target).count() == 0
    plant(tmp_path / "in", {"one/b.txt": "new", f"one/{MARKER}": ""})
    run()
    assert {(r.bundle_id, r.path, r.text) for r in read_finished(spark, target).collect()} == {("one", "a.txt", "1\n"), ("one", "b.txt", "new")}
    plant(tmp_path / "in", {"one/c.txt": "late", f"two/{MARKER}": ""})
    run()
    run()
    got = read_finished(spark, target).collect()
    assert Counter((r.bundle_id, r.path, r.text) for r in got) == Counter([("one", "a.txt", "1\n"), ("one", "b.txt", "new"), ("two", "a.txt", "2")])
    assert [(r.bundle_id, r.path) for r in late_files(spark, target).collect()] == [("one", "c.txt")]


def test_a_batch_run_again_replaces_itself(spark, make_files):
    target = shared_dir(spark)
    first = make_files({"a": "1", "b": "2"}, "x")
    write_batch(first, 0, target)
    second = make_files({"c": "3", MARKER: ""}, "x").unionByName(make_files({"a": "9"}, "y"))
    for _ in range(3):
        write_batch(second, 1, target)
    # A try that broke off before its entry in the log is not seen.
    write_batch(make_files({"z": "0", MARKER: ""}, "z"), 2, target)
    import shutil

    shutil.rmtree(f"{target}/log/batch=2")
    assert Counter((r.bundle_id, r.path) for r in read_finished(spark, target).collect()) == Counter([("x", "a"), ("x", "b"), ("x", "c")])
    write_batch(make_files({"z": "0", MARKER: ""}, "z"), 2, target)
    assert {r.bundle_id for r in read_finished(spark, target).collect()} == {"x", "z"}


def test_contents_are_written_once_before_they_are_rendered(spark, tmp_path, monkeypatch):
    """Staged tables hold paths or document rows, no contents, and are planned by sizes as outside of a stream."""
    from sheafspark.streaming import documents

    staged = []

    def stage(df):
        staged.append((set(df.columns), df.sparkSession.conf.get("spark.sql.adaptive.enabled")))
        return kept(df)

    kept = documents.stage
    monkeypatch.setattr(documents, "stage", stage)
    root = plant(tmp_path / "in", {"one/a.txt": "1\n", "one/sub/b.txt": "2", "one/c.lock": "3", f"one/{MARKER}": "", "two/d": "4"})
    target = shared_dir(spark)
    write_finished(watch_corpus(spark, root, "children"), target, shared_dir(spark)).awaitTermination()
    assert {(r.bundle_id, r.path, r.text) for r in read_finished(spark, target).collect()} == {("one", "a.txt", "1\n"), ("one", "sub/b.txt", "2")}
    assert staged and not any(columns & {"content", "body"} for columns, _ in staged)
    assert {adaptive for _, adaptive in staged} == {spark.conf.get("spark.sql.adaptive.enabled")}
    assert late_files(spark, target).count() == 0


def test_bad_names_keep_a_finished_bundle_out(spark, make_files):
    from sheafspark.options import BundleOptions

    both = make_files({"a\tb": "1", "c": "2", MARKER: ""}, "bad").unionByName(make_files({"d": "old", "e": "4"}, "good"))
    with pytest.raises(ValueError, match="U\\+0009"):
        write_batch(both, 0, shared_dir(spark))
    target, options = shared_dir(spark), BundleOptions(on_bad_path="quarantine")
    write_batch(both, 0, target, options)
    write_batch(make_files({"d": "new", MARKER: ""}, "good"), 1, target, options)
    got = Counter((r.bundle_id, r.path, r.text) for r in read_finished(spark, target).collect())
    assert got == Counter([("good", "d", "new"), ("good", "e", "4")])


# ---- files of any size


def plain_measure(data):
    text = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    try:
        data.decode()
        valid = True
    except UnicodeDecodeError:
        valid = False
    return len(data), text.count(b"\n") + (text[-1:] not in (b"", b"\n")), valid


@pytest.mark.parametrize("chunk", [1, 2, 3, 5, 16, 1000])
def test_chunks_add_up_to_the_whole(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    pieces = [b"a", "é".encode(), "日本".encode(), "😀".encode(), b"\r\n", b"\r", b"\n", b"\x1b$B", b"\x01", b"\x80", b"\xff", b"\xe3\x81", b"\xef\xbb\xbf"]
    files = {f"f{i}": b"".join(rng.choices(pieces, k=rng.randrange(30))) for i in range(60)}
    files |= {"empty": b"", "nul": b"text " * 9 + b"\0", "bom": b"\xef\xbb\xbfabc\x01\x02", "png": b"\x89PNG\r\n\x1a\nabc", "wide": b"\xff\xfea\0b\0"}
    root = plant(tmp_path / "in", files)
    listing = list_corpus(spark, root)
    for utf8 in (False, True):
        whole = {r.path: r for r in classify(read_contents(listing), utf8).collect()}
        rows = measure_files(listing, utf8, chunk).collect()
        assert len(rows) == len(files)
        for r in rows:
            size, lines, valid = plain_measure(files[r.path])
            assert (r["size"], r.valid_utf8) == (size, valid), r.path
            assert r.lines == (None if r.path == "wide" or (r.bom or "").startswith("UTF-16") else lines), r.path
            w = whole[r.path]
            assert (r.binary_reason, r.binary_detail, r.bom, r.iso2022jp_candidate) == (w.binary_reason, w.binary_detail, w.bom, w.iso2022jp_candidate), r.path


def test_contents_are_handed_over_in_small_batches(tmp_path):
    root = plant(tmp_path / "in", {f"f{i}": "x" * 2_500_000 for i in range(4)})
    rows = [{"bundle_id": "b", "path": f"f{i}", "size": 2_500_000, "uri": f"{root}/f{i}", "list_error": None} for i in range(4)]
    listing = pa.Table.from_pylist(rows).cast(pa.schema([("bundle_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("uri", pa.string()), ("list_error", pa.string())]))
    read, _ = content_reader()
    assert [b.column("path").to_pylist() for b in read(iter(listing.to_batches()))] == [["f0", "f1"], ["f2", "f3"]]


def test_small_chunks_share_rows_and_reads(spark, tmp_path, monkeypatch):
    """One open file for neighbouring chunks; spans and reads end anywhere and change nothing."""
    text = "a line é 日本 \U0001f600\r\nnext\rlast\n\x1b$B" * 300
    root = plant(tmp_path / "in", {"f": text, "empty": ""})
    listing = list_corpus(spark, root)
    assert chunks.span_rows(listing, 97).count() == 2
    size, lines, valid = plain_measure(text.encode())
    for span, read in ((chunks.SPAN_BYTES, chunks.READ_BYTES), (1000, 300), (97, 97), (64, 10)):
        with monkeypatch.context() as m:
            m.setattr(chunks, "SPAN_BYTES", span)
            assert chunks.span_rows(listing.where("path = 'f'"), 97).count() == -(-size // (max(1, span // 97) * 97))
            with open(f"{root}/f", "rb") as stream:
                m.setattr(chunks, "READ_BYTES", read)
                found = chunks._measure_span(stream, 0, size, size, 97)
                assert (found["n_bytes"], found["n_lines"] + found["open_end"], found["valid_utf8"], found["jis"]) == (size, lines, valid, True)
            (row,) = [r for r in measure_files(listing, True, 97).collect() if r.path == "f"]
            assert (row["size"], row.lines, row.valid_utf8) == (size, lines, valid)


def test_a_file_above_two_gibibytes(spark, tmp_path):
    big = tmp_path / "in" / "big.txt"
    plant(tmp_path / "in", {"big.txt": "first line\n", "small.txt": "x\n"})
    size = (1 << 31) + 12_345
    with open(big, "r+b") as stream:  # a hole: no blocks on disk
        stream.truncate(size)
        stream.seek(size - 6)
        stream.write(b"\nlast\r")
    listing = list_corpus(spark, str(tmp_path / "in"))
    rows = {r.path: r for r in measure_files(listing).collect()}
    assert (rows["big.txt"]["size"], rows["big.txt"].lines, rows["big.txt"].binary_reason) == (size, 3, "NullByte")
    read = {r.path: r for r in read_contents(listing).collect()}
    assert read["big.txt"].read_error == corpus.TOO_LARGE and bytes(read["small.txt"].content) == b"x\n"


def test_unreadable_chunks_and_errors_of_the_listing(spark, tmp_path):
    root = plant(tmp_path / "in", {"a": "1\n2", "b": "1"})
    listing = list_corpus(spark, root).withColumn("uri", F.when(F.col("path") == "b", F.lit(f"{root}/none")).otherwise(F.col("uri")))
    failed = spark.createDataFrame([(tmp_path.name, "locked", 0, root, "Permission denied")], "bundle_id string, path string, size long, uri string, list_error string")
    rows = {r.path: r for r in measure_files(listing.unionByName(failed), chunk_bytes=2).collect()}
    assert (rows["a"]["size"], rows["a"].lines, rows["a"].read_error) == (3, 2, None)
    assert rows["b"].read_error == "No such file or directory" and rows["b"]["size"] is None
    assert rows["locked"].read_error == "Permission denied"
    assert measure(b"", b"") == (0, 0, 0, False, True)


# ---- snapshots


def plain_diff(old, new):
    gone, come = list((Counter(old) - Counter(new)).elements()), list((Counter(new) - Counter(old)).elements())
    out = []

    def pair(key, status):
        sides = []
        for rows in (gone, come):
            groups = defaultdict(list)
            for row in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
                groups[key(row)].append(row)
            sides.append(groups)
        for k in set(sides[0]) & set(sides[1]):
            for a, b in zip(sides[0][k], sides[1][k]):
                gone.remove(a)
                come.remove(b)
                out.append((b[0], status, b[1], a[1] if status == "moved" else None, a[2], b[2]))

    pair(lambda r: r[:2], "changed")
    pair(lambda r: (r[0], r[2], r[1].rpartition("/")[2]), "moved")
    pair(lambda r: (r[0], r[2]), "moved")
    out += [(b, "removed", p, None, h, None) for b, p, h in gone] + [(b, "added", p, None, None, h) for b, p, h in come]
    return Counter(out)


def test_differences_are_those_of_brute_force(spark):
    rng = random.Random(7)
    schema = "bundle_id string, path string, hash string"

    def snapshot(n):
        folders, names, hashes = ["", "a/", "b/c/"], [f"f{i}" for i in range(25)], ["h0"] * 6 + [f"h{i}" for i in range(9)] + [None]
        return [(rng.choice(["x", "y"]), rng.choice(folders) + rng.choice(names), rng.choice(hashes)) for _ in range(n)]

    for n in (0, 30, 250):
        old, new = snapshot(n), snapshot(n + n // 5)
        a, b = (spark.createDataFrame(rows, schema).repartition(3) for rows in (old, new))
        diff = diff_snapshots(a, b)
        want = plain_diff(old, new)
        assert Counter(tuple(r) for r in diff.collect()) == want
        summary = {r.bundle_id: r.moved for r in diff_summary(diff).collect()}
        moves = Counter()
        for row, k in want.items():
            moves[row[0]] += k * (row[1] == "moved")
        assert summary == dict(moves)
    assert diff_snapshots(b, b).count() == 0


def test_places_are_numbered_over_partitions(spark):
    rows = spark.range(5000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 50 AS string) END AS k", "CAST(id AS string) AS path")
    found = numbered(rows, ["k"], ["path"]).collect()
    places = defaultdict(list)
    for r in found:
        places[r.k].append((r.n, r.path))
    for k, pairs in places.items():
        assert [p for _, p in sorted(pairs)] == sorted(p for _, p in pairs) and sorted(n for n, _ in pairs) == list(range(1, len(pairs) + 1))
