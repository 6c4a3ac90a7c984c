"""Ignore files (gitignore syntax) as one rule set per folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import paths as P
from sheafspark.functions import text as L

# Which source of rules wins over which, highest last.
SOURCE_RANK = {"global": 1, "exclude": 2, "gitignore": 3, "ignore": 4}

# Rules with this bundle hold for every bundle.
ALL_BUNDLES = "*"

# Ends what a rule set is matched against.
_END = "\x01"

# The pieces of a glob: any-depth forms first, then escape, class, stars, one character.
_TOKENS = (
    r"(?s)\A\*\*/(?:\*\*/)*|/\*\*(?:/\*\*)*/|/\*\*\z|\\.|\[[!^]?\]?(?:\\.|[^\]\\])*\]|\*+|."
)


def _token_regex(token: Column) -> Column:
    quoted = F.regexp_replace(token, r"([^\p{L}\p{N}])", r"\\$1")
    in_class = F.regexp_replace(token, r"^\[!", "[^")
    in_class = F.regexp_replace(in_class, r"(?<!^)\[", r"\\[")
    return (
        F.when(token.rlike(r"\A\*\*/"), F.lit(r"(?:.*/)?"))
        .when(token.rlike(r"\A/\*\*.*/\z"), F.lit(r"/(?:.*/)?"))
        .when(token == "/**", F.lit(r"/.+"))
        .when(token.rlike(r"\A\*+\z"), F.lit(r"[^/]*"))
        .when(token == "?", F.lit(r"[^/]"))
        .when(F.startswith(token, F.lit("\\")), F.regexp_replace(F.substring(token, 2, 2), r"([^\p{L}\p{N}])", r"\\$1"))
        .when((F.length(token) > 1) & F.startswith(token, F.lit("[")), F.concat(F.lit("(?!/)"), in_class))
        .otherwise(quoted)
    )


def glob_regex(glob: Column) -> Column:
    """Java regex (to be used with ``(?s)``) of a gitignore glob without its ``!`` and outer slashes."""
    tokens = F.regexp_extract_all(glob, F.lit(f"({_TOKENS})"), 1)
    return F.array_join(F.transform(tokens, _token_regex), "")


def parse_ignore_rules(rule_files: DataFrame) -> DataFrame:
    """One row per rule of (bundle_id, rule_dir, source, text) rule files.

    A rule with an inner slash is matched against the path below its folder,
    one without against the name alone.
    """
    rank = F.create_map(*[F.lit(x) for pair in SOURCE_RANK.items() for x in pair])
    lines = rule_files.select(
        "bundle_id",
        "rule_dir",
        F.element_at(rank, F.col("source")).alias("source_rank"),
        F.posexplode(L.split_lines(F.col("text"))).alias("line_no", "raw"),
    )
    # Trailing blanks go unless escaped.
    line = F.regexp_replace(F.col("raw"), r"(?<!\\)[ \t]+\z", "")
    negated = F.startswith(F.col("line"), F.lit("!"))
    pattern = F.when(negated, F.col("line").substr(F.lit(2), F.length("line"))).otherwise(F.col("line"))
    body = F.regexp_replace(F.col("pattern"), r"/\z", "")
    glob = F.regexp_replace(F.col("body"), r"\A/", "")
    return (
        lines.withColumn("line", line)
        .where((F.col("line") != "") & ~F.startswith(F.col("line"), F.lit("#")))
        .withColumn("negated", negated)
        .withColumn("pattern", pattern)
        .withColumn("dir_only", F.endswith(F.col("pattern"), F.lit("/")))
        .withColumn("body", body)
        .withColumn("anchored", F.contains(F.col("body"), F.lit("/")))
        .withColumn("glob", glob)
        .where("glob <> ''")
        .select(
            "bundle_id", "rule_dir", "source_rank",
            F.when(F.col("rule_dir") == "", 0).otherwise(P.path_depth(F.col("rule_dir")) + 1).alias("depth"),
            (F.col("line_no") + 1).alias("line_no"),
            glob_regex(F.col("glob")).alias("regex"),
            "anchored", "negated", "dir_only",
        )
    )


def _subject(path: Column, is_dir: bool) -> Column:
    """What the alternatives of a rule set are matched against: name, NUL, path, end mark."""
    end = F.lit("/" if is_dir else "")
    return F.concat(P.base_name(path), end, F.lit("\0"), path, end, F.lit(_END))


def _alternative() -> Column:
    """A rule as one alternative over ``_subject``; it takes the end mark along if the rule ignores.

    A rule without an inner slash starts with the name, so most names fail it at their first character.
    """
    at_root = F.col("rule_dir") == ""
    folder = F.concat(F.regexp_replace("rule_dir", r"([^\p{L}\p{N}])", r"\\$1"), F.lit("/"))
    folder = F.when(at_root, F.lit("")).otherwise(F.concat(folder, F.lit(rf"(?!{_END})")))
    tail = F.when(F.col("dir_only"), F.lit("/")).otherwise(F.lit("/?"))
    # A star takes an empty rest, but not the rest after the slash that ends a folder.
    glob = F.concat(F.lit("(?:"), F.col("regex"), F.lit(")(?<!/)"), tail)
    by_name = F.concat(glob, F.lit(r"\x00"), folder, F.lit(".*"))
    by_path = F.concat(F.lit(r"[^\x00]*+\x00"), folder, glob)
    verdict = F.when(F.col("negated"), F.lit(rf"(?={_END}\z)")).otherwise(F.lit(rf"{_END}\z"))
    return F.concat(F.when(F.col("anchored"), by_path).otherwise(by_name), verdict)


def _is_ignored(path: Column, is_dir: bool, rule_set: Column) -> Column:
    """Whether the first alternative that fits, the last rule that matches, ignores the path.

    ``regexp_extract`` keeps the pattern of the row before, so rows in order of
    their rule set compile it once.
    """
    return F.endswith(F.call_function("regexp_extract", _subject(path, is_dir), rule_set, F.lit(0)), F.lit(_END))


def folder_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(bundle_id, folder, rule_set, lost) of each folder with files that any rule can reach ('' is the root).

    ``rule_set`` is one regex of all rules that hold in the folder, strongest
    first; ``lost`` says that the folder or one above it is ignored. The rules
    of one folder are folded to one row before they are joined, those for all
    bundles are one value, and a folder has at most as many rule folders as it is deep.
    """
    order = (
        F.col("source_rank").cast("bigint") * F.lit(1 << 50)
        + F.col("depth").cast("bigint") * F.lit(1 << 33)
        + F.col("line_no").cast("bigint")
    )
    ranked = rules.select("bundle_id", "rule_dir", F.struct(order.alias("order"), _alternative().alias("regex")).alias("rule"))
    folded = ranked.groupBy("bundle_id", "rule_dir").agg(F.collect_list("rule").alias("folded"))
    shared = folded.where(F.col("bundle_id") == ALL_BUNDLES).agg(F.flatten(F.collect_list("folded"))).scalar()

    folder = F.col("folder")
    places = files.select("bundle_id", P.parent_path(F.col("path")).alias("folder")).distinct()
    chain = F.when(folder == "", F.array(F.lit(""))).otherwise(F.array_append(P.ancestors(folder), folder))
    reached = places.select("bundle_id", "folder", F.explode(chain).alias("rule_dir"))
    held = (
        reached.join(folded, ["bundle_id", "rule_dir"], "left")
        .groupBy("bundle_id", "folder")
        .agg(F.flatten(F.collect_list("folded")).alias("own"))
        .withColumn("rules", F.sort_array(F.concat("own", shared), asc=False))
        .where(F.size("rules") > 0)
    )
    alternatives = F.array_join(F.transform("rules", lambda rule: rule["regex"]), "|")
    held = held.select("bundle_id", "folder", F.concat(F.lit(r"(?s)\A(?:"), alternatives, F.lit(")")).alias("rule_set"))
    above = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.array_append(P.folders_above(folder), folder))
    lost = F.exists(above, lambda node: _is_ignored(node, True, F.col("rule_set")))
    return held.withColumn("lost", lost)


def apply_ignore_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Drop files that are ignored or lie under an ignored folder.

    Each file is looked up once, by its folder. The join is a sorted one, so
    the files of a folder, and of folders with the same rules, follow each other
    and a rule set is compiled once for them; a hot folder is split by AQE. Where the files
    carry ``content``, only their paths take part and the content is filtered
    by the paths that go; on a listing nothing but the listing is moved.
    """
    judged = folder_rules(files, rules).select(F.col("bundle_id").alias("_bundle"), "folder", "rule_set", "lost")
    goes = (
        (F.col("bundle_id") == F.col("_bundle"))
        & (P.parent_path(F.col("path")) == F.col("folder"))
        & (F.col("lost") | _is_ignored(F.col("path"), False, F.col("rule_set")))
    )
    if "content" not in files.columns:
        return files.join(judged.hint("merge"), goes, "left_anti")
    ignored = files.select("bundle_id", "path").join(judged.hint("merge"), goes, "left_semi")
    return files.join(ignored, ["bundle_id", "path"], "left_anti")
