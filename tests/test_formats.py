"""Markdown and text documents, included categories, dot-files and metadata."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sheafspark.functions import paths as P
from sheafspark.operators import document, markdown, select
from sheafspark.plans.pack import entries_of
from sheafspark.session import shared_dir
from sheafspark.sinks.bundles import write_bundles


def test_markdown_comes_back_as_it_was(spark, make_files):
    rng = random.Random(8)
    pieces = ["`", "```", "````", "\n", "\r\n", "# ", '## "x"\n', "> quote\n", "3 bytes, 1 lines\n", "text", "é", " ", "- a"]
    files = {f"d{i % 3}/f{i}.py": "".join(rng.choices(pieces, k=rng.randrange(25))) for i in range(80)}
    files |= {'odd "name"\n`x`.txt': "a", "empty": "", "bin.dat": b"\0\1", "ticks.md": "`" * 300, "long.txt": "line `\n" * 50_000}
    target = shared_dir(spark)
    write_bundles(markdown.markdown_rows(entries_of(make_files(files))), target)
    back = {r.path: r for r in markdown.read_markdown(spark, target).collect()}
    assert set(back) == set(files)
    for path, content in files.items():
        r = back[path]
        if isinstance(content, bytes):
            assert r.text is None and r.comment == "This file is a binary file and not included"
        else:
            assert (r.text, r["size"], r.comment) == (content, len(content.encode()), None), path
    fences = spark.createDataFrame([("",), ("a``b",), ("```",), ("`" * 9,)], "t string").select(markdown.fence_of(F.col("t"))).collect()
    assert [len(r[0]) for r in fences] == [3, 3, 4, 10]
    assert markdown.markdown_rows(entries_of(make_files({}))).count() == 0


def test_text_documents_hold_every_file(spark, make_files):
    rows = markdown.text_rows(entries_of(make_files({"a.txt": "one\n", "b.bin": b"\0"}))).orderBy("sort_key").collect()
    assert [r.line for r in rows] == ['===== "a.txt" =====\none\n', '===== "b.bin" =====\n(This file is a binary file and not included)']


PATHS = ["LICENSE.md", ".gitignore", "a/.gitattributes", ".github/w.yml", "x.lock", "requirements.txt", "renovate.json", ".vscode/s", ".git/config", "src/a.rs", ".env", "a/.b/c"]


@pytest.mark.parametrize(
    ("include", "kept"),
    [
        ((), {"src/a.rs", ".env", "a/.b/c"}),
        (("licences",), {"LICENSE.md", "src/a.rs", ".env", "a/.b/c"}),
        (("gitignore", "lockfiles"), {".gitignore", "x.lock", "src/a.rs", ".env", "a/.b/c"}),
        (("github", "gitignore", "tools"), {".github/w.yml", ".gitignore", "renovate.json", ".vscode/s", "src/a.rs", ".env", "a/.b/c"}),
        (("requirements", "git"), {"requirements.txt", ".git/config", "a/.gitattributes", "src/a.rs", ".env", "a/.b/c"}),
        (tuple(P.CATEGORIES), set(PATHS)),
    ],
)
def test_categories_of_the_defaults_can_be_kept(spark, include, kept):
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    assert {r.path for r in select.exclude_paths(files, include=include).collect()} == kept
    shown = {r.path for r in select.exclude_paths(files, include=include, dot_files=False).collect()}
    named = [P.java_regex(p) for name in include for p in P.CATEGORIES[name]]
    spared = {r.path for r in files.where(P.matches(F.col("path"), "|".join(named))).collect()} if named else set()
    assert shown == {p for p in kept if not any(part.startswith(".") for part in p.split("/")) or p in spared}


def test_unknown_categories_are_refused():
    with pytest.raises(ValueError, match="no such category: nothing"):
        P.exclusion_regexes(include=("nothing",))
    assert set(P.DEFAULT_EXCLUDE_PATTERNS) == {p for patterns in P.CATEGORIES.values() for p in patterns}


def test_metadata_stands_in_its_document(spark, make_files):
    files = make_files({"a.txt": "x"}, "one").unionByName(make_files({"b.txt": "y"}, "two"))
    say = [("one", "name", "A & <B>"), ("one", "about", "two\nlines"), ("one", "odd", "t\tab\x0b"), ("one", None, None), ("none", "name", "no document")]
    rows = document.document_rows(entries_of(files), files, metadata=spark.createDataFrame(say, "bundle_id string, name string, value string"))
    texts = {}
    for r in sorted(rows.collect(), key=lambda r: (r.bundle_id, r.section, r.sort_key)):
        texts.setdefault(r.bundle_id, []).append(r.line)
    assert set(texts) == {"one", "two"}
    root = ET.fromstring("\n".join(texts["one"]).encode())
    found = [(e.get("name"), e.get("value")) for e in root.find("metadata")]
    assert found == [("", ""), ("about", "two\nlines"), ("name", "A & <B>"), ("odd", "t�ab�")]
    assert ET.fromstring("\n".join(texts["two"]).encode()).find("metadata") is None
