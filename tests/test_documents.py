"""Entries, structure and whole documents, re-read by an independent XML parser."""

import glob
import gzip
import os
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from catalogue import documents as catalogue
from sheafspark.operators import document, metrics, tree
from sheafspark.operators.entries import diagnostics, render_entries
from sheafspark.options import BundleOptions
from sheafspark.plans.pack import entries_of, pack
from sheafspark.session import shared_dir, stage
from sheafspark.sinks.bundles import ZLIB_LEVELS, sink_names, write_bundles, write_summary, written_bytes
from sheafspark.sources.bundles import document_order, read_bundles, read_structure

CONTENTS = {
    "plain.txt": "alpha\nbeta\n",
    "dir/empty.txt": "",
    "dir/cdata.txt": "x]]>y]]]>z]]>",
    "dir/ends.txt": "]]]]>]]>",
    "dir/markup.xml": "<a b='c'>&amp;</a>\n</file>\n<file path=\"x\" size=\"1\" lines=\"1\"/>",
    "dir/sub/mixed.txt": "a\r\nb\rc\n",
    "dir/sub/words.txt": "日本語 Русский العربية 😀\n",
    "dir/sub/deep/png.bin": b"\x89PNG\r\n\x1a\n\0",
    "bad.txt": "before\x0bafter",
    "del.txt": "one \x7f of many bytes here",
    "file<&\"'.txt": "odd name",
    "line\nfeed.txt": "lf",
    "carriage\rreturn.txt": "cr",
    "dir-a/x": "sorts around dir/",
    "dir.txt": "also",
}
RUN = BundleOptions(exclude=())


def read_files(folder, opener=open):
    names = sorted(n for n in glob.glob(os.path.join(folder, "part-*")))
    return b"".join(opener(n, "rb").read() for n in names)


def plain(text):
    return text.replace("\r\n", "\n").replace("\r", "\n")


def walk(element, above=()):
    for child in element:
        if child.tag == "file":
            yield "/".join((*above, child.attrib["path"]))
        elif child.tag == "folder":
            yield from walk(child, (*above, child.attrib["name"]))


def test_document_survives_a_real_parser(spark, make_files):
    target = shared_dir(spark)
    packed = pack(make_files(CONTENTS), target, RUN)
    data = read_files(f"{target}/bundle_id=b")
    assert data.startswith(b'<?xml version="1.0" encoding="utf-8"?>\n<repository>\n') and data.endswith(b"</repository>\n")
    root = ElementTree.fromstring(data)
    assert [e.tag for e in root] == ["file_summary", "repository_structure", "repository_files"]
    assert set(walk(root[1])) == set(CONTENTS)
    found = {e.attrib["path"]: e for e in root[2] if e.tag == "file"}
    assert set(found) == set(CONTENTS)
    for path, content in CONTENTS.items():
        size = len(content.encode() if isinstance(content, str) else content)
        assert int(found[path].attrib["size"]) == size
        if path in ("bad.txt", "dir/sub/deep/png.bin"):
            assert found[path].attrib["lines"] == "0" and not (found[path].text or "").strip()
        else:
            assert (found[path].text or "") == plain(content)
    row = packed.metrics.first()
    assert (row.n_files, row.xml_bytes, row.output_bytes) == (len(CONTENTS), len(data), len(data))
    codes = {(r.path, r.code) for r in packed.diagnostics.collect()}
    assert codes == {("bad.txt", "xml_omitted")}


def test_structure_lists_files_before_folders(spark, make_files):
    files = make_files({p: "" for p in ("kiln/ash/ember/coal", "kiln/ash/soot", "brick", "kiln/zinc", "wall")})
    rows = tree.structure_rows(files).orderBy("sort_key").collect()
    assert [r.line.strip() for r in rows] == [
        '<file path="brick" />', '<file path="wall" />', '<folder name="kiln">', '<file path="zinc" />',
        '<folder name="ash">', '<file path="soot" />', '<folder name="ember">', '<file path="coal" />',
        "</folder>", "</folder>", "</folder>",
    ]
    assert rows[5].line == '        <file path="soot" />'


def test_tree_tables(spark, make_files):
    files = make_files({"oak": "a", "moss/fern.c": "bb", "moss/bog/reed.c": "c", "moss/bog/peat/turf.c": "d"})
    nodes = tree.tree_nodes(files)
    got = {(r.parent_path, r.name, r.kind, r.depth) for r in nodes.collect()}
    assert got == {
        ("", "oak", "file", 0), ("", "moss", "folder", 0), ("moss", "fern.c", "file", 1), ("moss", "bog", "folder", 1),
        ("moss/bog", "reed.c", "file", 2), ("moss/bog", "peat", "folder", 2), ("moss/bog/peat", "turf.c", "file", 3),
    }
    sizes = {r.node_path: (r.n_files, r["size"]) for r in tree.directory_rollup(files, "size").collect()}
    assert sizes == {"": (4, 5), "moss": (3, 4), "moss/bog": (2, 2), "moss/bog/peat": (1, 1)}
    assert {(r.parent_path, r.n_files, r.n_folders) for r in tree.folder_sizes(nodes).collect()} == {
        ("", 1, 1), ("moss", 1, 1), ("moss/bog", 1, 1), ("moss/bog/peat", 1, 0),
    }
    assert {(r.kind, r.name) for r in tree.children(nodes).where("parent_path = 'moss'").collect()} == {
        ("file", "fern.c"), ("folder", "bog"),
    }
    ranked = tree.largest_folders(tree.directory_rollup(files, "size"), "size", 1).collect()
    top = max(size for node, (_, size) in sizes.items() if node)
    assert {(r.node_path, r.size_rank) for r in ranked} == {(n, 1) for n, (_, size) in sizes.items() if n and size == top}
    assert [tuple(r) for r in tree.depth_profile(nodes).orderBy("depth").select("n_files", "n_folders", "max_children").collect()] == [
        (1, 1, 2), (1, 1, 2), (1, 1, 2), (1, 0, 1),
    ]


@pytest.mark.parametrize("level", [1, 3, 9])
def test_gzip_holds_the_same_bytes(spark, make_files, level):
    text = {f"d/{i}.txt": f"line {i}\n" * 200 for i in range(50)}
    plain_dir, gzip_dir = shared_dir(spark), shared_dir(spark)
    plain_run = pack(make_files(text), plain_dir, RUN)
    gzip_run = pack(make_files(text), gzip_dir, BundleOptions(exclude=(), gzip=True, gzip_level=level))
    assert read_files(f"{gzip_dir}/bundle_id=b", gzip.open) == read_files(f"{plain_dir}/bundle_id=b")
    row = gzip_run.metrics.first()
    assert row.xml_bytes == plain_run.metrics.first().xml_bytes
    assert row.output_bytes == len(read_files(f"{gzip_dir}/bundle_id=b")) < row.xml_bytes


def test_levels_have_hadoop_names():
    assert sorted(ZLIB_LEVELS) == list(range(1, 10)) and BundleOptions(gzip_level=17).gzip_level == 6


def test_many_tasks_give_the_same_document(spark, make_files):
    text = {f"d{i % 7}/f{i:03}.txt": f"{i}\n" * (i % 5) for i in range(200)}
    entries = entries_of(make_files(text, "one bundle/+%"), RUN)
    rows = document.document_rows(entries)
    results = []
    for tasks in (1, 8):
        target = shared_dir(spark)
        staged = stage(rows.repartition(tasks))
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", tasks == 1)
        write_bundles(staged, target, staged=True)
        (folder,) = glob.glob(f"{target}/bundle_id=*")
        results.append(read_files(folder))
        assert len(glob.glob(f"{folder}/part-*")) == tasks
        assert [tuple(r) for r in written_bytes(spark, target).collect()] == [("one bundle/+%", len(results[-1]))]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    assert results[0] == results[1]
    ElementTree.fromstring(results[0])


def test_read_back_takes_entries_only(spark, make_files):
    target = shared_dir(spark)
    text = {k: v for k, v in CONTENTS.items() if k not in ("bad.txt", "dir/sub/deep/png.bin")}
    write_bundles(document.document_rows(entries_of(make_files(text, "007"), RUN)), target)
    back = {r.path: (r.bundle_id, r.text) for r in read_bundles(spark, target).collect()}
    assert back == {p: ("007", plain(t)) for p, t in text.items()}


@pytest.mark.parametrize("split_bytes", [None, 700])
def test_structure_and_comments_are_read_over_splits(spark, make_files, split_bytes):
    paths = [f"d{i % 3}/e{i % 5}/f{i}.txt" for i in range(60)] + ["top.txt", "d1/side.txt", "d&1/<q>.txt", "d1\nx/y"]
    paths.append("/".join(f"n{i}" for i in range(40)) + "/deep.txt")
    contents = {p: "text\n" for p in paths}
    contents["tricky.txt"] = (
        '  </repository_structure>\n    <file path="no" />\n    <folder name="no">\n'
        '    <file path="no" size="0" lines="0"><!-- no --></file>\n]]>\n'
        '    <file path="no" size="0" lines="0"><!-- no --></file>\n<![CDATA[\n'
    )
    contents["d0/a.txt"] = "one\rtwo\r"
    contents["d0/b.bin"] = b"\0"
    contents["zz/<b>.bin"] = b"\0\0"
    target = shared_dir(spark)
    rows = document.document_rows(entries_of(make_files(contents), RUN))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", split_bytes is None)
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        write_bundles(rows, target)
        assert sorted(r.path for r in read_structure(spark, target).collect()) == sorted(contents)
        back = read_bundles(spark, target).collect()
        texts = {r.path: r.text for r in back}
        got = {(r.path, r["size"], r.comment) for r in back if r.comment is not None}
        assert texts == {p: plain(t) if isinstance(t, str) else None for p, t in contents.items()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)
    note = " This file is a binary file and not included "
    assert got == {("d0/b.bin", 1, note), ("zz/<b>.bin", 2, note)}


def test_entry_forms(spark, make_files):
    files = make_files({"a.bin": b"\0", "t.txt": "x\ny", "omit": "\x0b" + "a" * 9})
    failed = files.where("path = 't.txt'").withColumn("path", F.lit("gone")).withColumn("content", F.lit(None).cast("binary"))
    failed = failed.withColumn("read_error", F.lit("No such file -- really"))
    entries = entries_of(files.unionByName(failed), RUN)
    xml = {r.path: r.entry_xml for r in render_entries(entries).collect()}
    assert xml == {
        "a.bin": '<file path="a.bin" size="1" lines="0"><!-- This file is a binary file and not included --></file>',
        "t.txt": '<file path="t.txt" size="3" lines="2"><![CDATA[x\ny]]></file>',
        "omit": '<file path="omit" size="10" lines="0">'
        "<!-- Text content omitted: XML 1.0 cannot represent character U+000B --></file>",
        "gone": '<file path="gone" size="0" lines="0"><!-- Failed to read file: No such file -  really --></file>',
    }
    all_rows = {(r.path, r.level, r.code) for r in diagnostics(entries).collect()}
    assert all_rows == {("omit", "warning", "xml_omitted"), ("gone", "error", "read_error")}
    assert [r.code for r in diagnostics(entries, quiet=True).collect()] == ["read_error"]


def test_conversion_diagnostics(make_files):
    files = make_files({"u": b"\xff\xfeH\0i", "m": b"\xef\xbb\xbf\xff", "w": b"\x93Hi\x94"})
    rows = diagnostics(entries_of(files, BundleOptions(utf8=True))).collect()
    assert {(r.path, r.code, r.level) for r in rows} == {
        ("u", "converted", "info"), ("u", "lossy_conversion", "warning"), ("m", "malformed_utf8", "warning"),
        ("w", "converted", "info"),
    }
    messages = {r.message for r in rows}
    assert "Converted 'w' from windows-1252 to UTF-8" in messages
    assert "'u' decoded as UTF-16LE with replacement characters; information was lost" in messages
    assert "'m' contained malformed UTF-8 and was decoded with replacement characters; information was lost" in messages


def test_bad_name_writes_nothing(spark, make_files):
    target = shared_dir(spark)
    with pytest.raises(ValueError, match=r"U\+000B"):
        pack(make_files({"missing\x0bfile": "x"}), target, RUN)
    assert not os.path.exists(target)


def test_line_numbers_reach_the_document(spark, make_files):
    target = shared_dir(spark)
    pack(make_files({"a.txt": "x\ny"}), target, BundleOptions(line_numbers=True))
    data = read_files(f"{target}/bundle_id=b").decode()
    assert "<![CDATA[1  x\n2  y\n]]>" in data and "Every line starts with its number" in data


def test_sink_names(spark):
    names = [("packed.xml", True, "packed.xml.gz"), ("bundle.XML.GZ", True, "bundle.XML.GZ"), ("a.xml", False, "a.xml"),
             ("dir.gz/a", True, "dir.gz/a.gz"), (".gz", True, ".gz.gz"), ("a.", True, "a..gz")]
    df = spark.createDataFrame([n[:2] for n in names], "output_file string, gzip boolean")
    got = {r.output_file: r.effective_file for r in sink_names(df).collect()}
    assert got == {n: e for n, _, e in names}


def test_summary_and_largest(spark, make_files):
    entries = entries_of(make_files({"a": "1", "b": "22", "c": "22"}), RUN)
    assert [r.path for r in metrics.largest(entries, "size", 2).collect()] == ["b", "c"]
    target = shared_dir(spark)
    write_summary(metrics.bundle_metrics(document.document_sizes(document.document_rows(entries))), target)
    assert spark.read.parquet(target).first().n_files == 3


def test_compression_profile(spark, make_files):
    rows = document.document_rows(entries_of(make_files({"a": "x" * 5000}), RUN))
    got = {r.level: (r.plain_bytes, r.gzip_bytes) for r in metrics.compression_profile(rows, (1, 9)).collect()}
    assert got[1][0] == got[9][0] == document.document_sizes(rows).first().xml_bytes
    assert got[9][1] <= got[1][1] < got[1][0]


def test_parts_in_the_order_of_their_numbers(spark, tmp_path):
    folder = tmp_path / "bundle_id=b"
    folder.mkdir()
    head = '    <folder name="a">\n        <file path="f" />\n'
    rest = f'        <file path="g" />\n    </folder>\n{document.STRUCTURE_END}\n'
    (folder / "part-99999-x.c000.txt").write_text(head)
    (folder / "part-100000-x.c000.txt").write_text(rest)
    order = document_order(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.file.rsplit("part-")[-1][:6] for r in order] == ["99999-", "100000"]
    assert {r.path for r in read_structure(spark, str(tmp_path)).collect()} == {"a/f", "a/g"}


def test_bundles_need_names(spark, make_files):
    rows = document.document_rows(entries_of(make_files({"a": "x"}, bundle="")))
    with pytest.raises(Exception, match="without a name"):
        write_bundles(rows, shared_dir(spark))


def test_streams_of_a_table_in_parts(spark, tmp_path):
    """A table is one file or a folder of files; both arrive whole."""
    rows = [(c, t, "user", f"text {c}\n{t}") for c in range(4) for t in range(3)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table.repartition(3).write.parquet(f"{tmp_path}/parts/conversations.parquet")
    table.toPandas().to_parquet(tmp_path / "conversations.parquet")
    for sf in (f"{tmp_path}/parts", f"{tmp_path}"):
        assert catalogue.streamed_entries(spark, sf).count() == 12
        totals = catalogue.streamed_totals(spark, sf).collect()
        assert sorted((r.bundle_id, r.n_files, r.n_lines) for r in totals) == [(str(c), 3, 6) for c in range(4)]
