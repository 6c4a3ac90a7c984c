import pytest
from pyspark.sql import functions as F

from sheafspark.functions import paths as P
from sheafspark.operators import ignore, select

DROPPED = [
    "sub/.git/HEAD", "x/.gitignore", "Renovate.JSON", "py/requirements-all.txt", "yarn.lock", "third/LICENSE-Apache", "our.licence.pdf",
    "docs/liCENses", "LICENCES/a", ".github/labels.yml", "b/.vscode/launch", "a.lock",
    "site/team.github.io/index", ".gitattributes", "tools/license_scan.py", "a/Requirements-dev.TXT", "licenſe",
]
KEPT = ["notes.txt", "b.lock.txt", "x.lock\n", "requirements.md", "src/main.rs"]


def kept(spark, paths, **kw):
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in select.exclude_paths(df, **kw).collect()}


def test_default_exclusions(spark):
    assert kept(spark, DROPPED + KEPT) == set(KEPT)


def test_replacing_patterns_are_literal_and_switch_defaults_off(spark):
    paths = ["LIB/[MADE].PY", "lib/m.py", ".gitignore", "c++.txt", ".git/config"]
    got = kept(spark, paths, extend=["c++.txt"], replace=["lib/[made].py"])
    assert got == {"lib/m.py", ".gitignore", "c++.txt", ".git/config"}
    assert kept(spark, ["plain.txt", "scratch.part", "Cargo.lock"], replace=["scratch.part"]) == {"plain.txt", "Cargo.lock"}


def test_extending_patterns_add_to_defaults(spark):
    paths = ["c++.txt", "ccc.txt", ".gitignore"]
    assert kept(spark, paths, extend=["c++.txt"]) == {"ccc.txt"}
    assert kept(spark, ["plain.txt", "scratch.part", "Cargo.lock"], extend=["scratch.part"]) == {"plain.txt"}


def test_empty_lists_and_patterns(spark):
    assert kept(spark, DROPPED, replace=[]) == set(DROPPED)
    assert kept(spark, KEPT, extend=[""]) == set()


def test_exclusion_audit_counts_each_pattern_alone(spark):
    df = spark.createDataFrame([("a.lock", 3), (".github/x.lock", 4), ("b", 5)], "path string, size bigint")
    got = {r.pattern: (r.n_files, r.n_bytes) for r in select.exclusion_audit(df, extend=["b"]).collect()}
    assert got[r"\.lock$"] == (2, 7)
    assert got[r"\.github"] == (1, 4) and got[r"\.git"] == (1, 4)
    assert got["b"] == (2, 9)
    assert got[r"\.vscode"] == (0, 0)
    assert select.exclusion_audit(df, replace=[]).count() == 0


@pytest.mark.parametrize(
    "raw, expected",
    [("src\\a\\b.rs", "src/a/b.rs"), ("./a//b/", "a/b"), ("a", "a"), ("/a/./b", "a/b")],
)
def test_normalize_path(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "path string")
    assert select.normalize_paths(df).first().path == expected


def test_path_pieces(spark):
    df = spark.createDataFrame([("a/b/c.txt",), ("c",)], "path string")
    p = F.col("path")
    rows = df.select(P.base_name(p), P.parent_path(p), P.path_depth(p), P.ancestors(p), P.folders_above(p)).collect()
    assert tuple(rows[0]) == ("c.txt", "a/b", 2, ["", "a", "a/b"], ["a", "a/b"])
    assert tuple(rows[1]) == ("c", "", 0, [""], [])


REFS = {
    "owner/repo": ("shorthand", "https://github.com/owner/repo.git"),
    "ówner/re-po_1": ("shorthand", "https://github.com/ówner/re-po_1.git"),
    "https://example.com/a/b.git": ("url", "https://example.com/a/b.git"),
    "ssh://git@host/a": ("url", "ssh://git@host/a"),
    "mailto:x": ("url", "mailto:x"),
    "http://[::1]:80/x": ("url", "http://[::1]:80/x"),
    "not a repository": ("invalid", None),
    "owner/repo.name": ("invalid", None),
    "owner/repo\n": ("invalid", None),
    "git@host:a/b": ("invalid", None),
    "http://": ("invalid", None),
    "https://a b/c": ("invalid", None),
    "": ("invalid", None),
}


def test_repository_references(spark):
    df = spark.createDataFrame([(r,) for r in REFS], "ref string")
    got = {r.ref: (r.kind, r.clone_url) for r in select.normalize_repo_refs(df).collect()}
    assert got == REFS


def test_path_violations(spark):
    rows = [("x", "missing\x0bfile"), ("y", "a\tb/c\n.txt"), ("y", "a\tb/d"), ("z", "fine/'<&\">.txt"), ("z", "é\x01")]
    df = spark.createDataFrame(rows, "bundle_id string, path string")
    got = {(r.bundle_id, r.role, r.value, r.code_point, r.byte_index) for r in select.path_violations(df).collect()}
    assert got == {
        ("x", select.FILE_PATH, "missing\x0bfile", "U+000B", 7),
        ("x", select.FILE_NAME, "missing\x0bfile", "U+000B", 7),
        ("y", select.FILE_PATH, "a\tb/c\n.txt", "U+0009", 1),
        ("y", select.FILE_PATH, "a\tb/d", "U+0009", 1),
        ("y", select.FOLDER_NAME, "a\tb", "U+0009", 1),
        ("z", select.FILE_PATH, "é\x01", "U+0001", 2),
        ("z", select.FILE_NAME, "é\x01", "U+0001", 2),
    }


def test_unsafe_paths_fail_or_quarantine(spark):
    df = spark.createDataFrame([("x", "a\tb"), ("x", "c"), ("y", "d")], "bundle_id string, path string")
    with pytest.raises(ValueError, match=r"U\+0009 at byte index 1"):
        select.require_safe_paths(df)
    assert [tuple(r) for r in select.require_safe_paths(df, "quarantine").collect()] == [("y", "d")]
    assert select.require_safe_paths(df.where("bundle_id = 'y'")).count() == 1


# (rule files by folder and source, ignored paths, kept paths)
IGNORE_CASES = [
    ({("", "gitignore"): "*.log\n!keep.log\n"}, ["a.log", "d/b.log"], ["keep.log", "d/keep.log", "a.txt"]),
    ({("", "gitignore"): "/top\n"}, ["top"], ["d/top"]),
    ({("", "gitignore"): "build/\n"}, ["build/x", "d/build/y/z"], ["build2", "d/build.txt"]),
    ({("", "gitignore"): "build/\n!build/keep.txt\n"}, ["build/keep.txt"], []),
    ({("", "gitignore"): "build/*\n!build/keep.txt\n"}, ["build/a"], ["build/keep.txt"]),
    ({("", "gitignore"): "a/**/z\n"}, ["a/z", "a/b/z", "a/b/c/z"], ["z", "b/a/z"]),
    ({("", "gitignore"): "**/foo/bar\n"}, ["foo/bar", "x/foo/bar"], ["foo/x/bar"]),
    ({("", "gitignore"): "abc/**\n"}, ["abc/x", "abc/y/z"], ["abcd/x"]),
    ({("", "gitignore"): "f?o[0-9][!a].t\n"}, ["foo1b.t", "x/fxo9-.t"], ["foo1a.t", "f/o1b.t", "fooxb.t"]),
    ({("", "gitignore"): "# note\n\n\\#real\n\\!bang\ntrail  \nkeep\\ \n"}, ["#real", "!bang", "trail", "keep "], ["note", "keep"]),
    ({("", "gitignore"): "*.x\n", ("sub", "gitignore"): "!*.x\n"}, ["a.x"], ["sub/a.x"]),
    ({("sub", "gitignore"): "/only\n"}, ["sub/only"], ["only", "sub/d/only"]),
    ({("", "gitignore"): "!a.x\n", ("", "exclude"): "*.x\n"}, ["b.x"], ["a.x"]),
    ({("", "gitignore"): "*.x\n", ("", "ignore"): "!*.x\n"}, [], ["b.x"]),
    ({("sub", "gitignore"): "!a.x\n", ("", "ignore"): "a.x\n"}, ["sub/a.x"], []),
    ({("", "gitignore"): "*.x\r\na.b\r\n"}, ["q.x", "a.b"], ["aXb"]),
    ({("sub", "gitignore"): "*\n"}, ["sub/a", "sub/d/b"], ["suba", "d/sub.x"]),
    ({("sub", "gitignore"): "/*\n!/d\n"}, ["sub/a", "sub/e/b"], ["sub/d/b", "a"]),
    ({("", "gitignore"): "b?\n*/\n!keep/\n"}, ["bx", "d/a", "keep/b1"], ["b", "keep/b", "a"]),
    ({("a.b", "gitignore"): "x.y\n", ("", "exclude"): "x?y\n!xzy\n"}, ["a.b/x.y", "q/x-y", "x.y"], ["a.b/xzy", "axb/xzy"]),
    ({}, [], ["a", "d/b"]),
    ({("", "gitignore"): "doc/*.txt\n"}, ["doc/n.txt"], ["doc/s/n.txt", "x/doc/n.txt"]),
]


@pytest.mark.parametrize("case", range(len(IGNORE_CASES)))
def test_ignore_rules(spark, case):
    rules, ignored, kept_paths = IGNORE_CASES[case]
    rule_files = spark.createDataFrame(
        [("b", folder, source, text) for (folder, source), text in rules.items()],
        "bundle_id string, rule_dir string, source string, text string",
    )
    files = spark.createDataFrame(
        [(b, p) for p in ignored + kept_paths for b in ("b", "other")], "bundle_id string, path string"
    )
    got = {(r.bundle_id, r.path) for r in ignore.apply_ignore_rules(files, ignore.parse_ignore_rules(rule_files)).collect()}
    assert got == {("b", p) for p in kept_paths} | {("other", p) for p in ignored + kept_paths}
