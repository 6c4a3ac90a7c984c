"""Path-level operators: exclusions, their audit, unsafe names, repository references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import paths as P
from sheafspark.functions import xml as X
from sheafspark.session import stage


def normalize_paths(files: DataFrame) -> DataFrame:
    return files.withColumn("path", P.normalize_path(F.col("path")))


def exclude_paths(
    files: DataFrame,
    extend: Sequence[str] | None = None,
    replace: Sequence[str] | None = None,
    include: Sequence[str] = (),
    dot_files: bool = True,
) -> DataFrame:
    """Drop excluded paths. ``replace`` switches the defaults and ``extend`` off.

    ``include`` keeps categories of the defaults in; without ``dot_files`` names that begin with a dot go too, but for included ones.
    """
    kept = ~P.is_excluded(F.col("path"), extend, replace, include)
    if not dot_files:
        spared = [P.matches(F.col("path"), regex) for name in include for pattern in P.CATEGORIES[name] for regex in [P.java_regex(pattern)]]
        hidden = P.is_dot_file(F.col("path"))
        for rule in spared:
            hidden = hidden & ~rule
        kept = kept & ~hidden
    return files.where(kept)


def exclusion_audit(
    files: DataFrame, extend: Sequence[str] | None = None, replace: Sequence[str] | None = None
) -> DataFrame:
    """(pattern, n_files, n_bytes) removed by each pattern on its own.

    All patterns are counted in one aggregation, so no row is multiplied.
    """
    rules = P.exclusion_regexes(extend, replace)
    if not rules:
        empty = "pattern string, n_files bigint, n_bytes bigint"
        return files.sparkSession.createDataFrame([], empty)
    counts = []
    for i, (_, regex) in enumerate(rules):
        hit = P.matches(F.col("path"), regex)
        counts.append(F.count_if(hit).alias(f"n{i}"))
        counts.append(F.coalesce(F.sum(F.when(hit, F.col("size"))), F.lit(0)).alias(f"b{i}"))
    rows = [
        F.struct(
            F.lit(pattern).alias("pattern"),
            F.col(f"n{i}").alias("n_files"),
            F.col(f"b{i}").alias("n_bytes"),
        )
        for i, (pattern, _) in enumerate(rules)
    ]
    return files.agg(*counts).select(F.inline(F.array(*rows)))


#: Bundle names that are sent to all tasks, at most.
BROADCAST_BUNDLES = 100_000

# Roles of a name in a bundle, and what is wrong with a bad one.
FILE_PATH = "repository file path"
FILE_NAME = "repository structure file path"
FOLDER_NAME = "repository structure folder name"
TAB_REASON = "cannot round-trip through XML attributes"
INVALID_REASON = "cannot be represented in XML 1.0"


def path_violations(files: DataFrame) -> DataFrame:
    """Names an XML attribute cannot carry back: a tab or an illegal character.

    One row per bad file path, file name and folder. The cheap test on the
    whole path comes first; only paths that fail it are taken apart.
    """
    path = F.col("path")
    bad = files.select("bundle_id", "path").where(path.rlike(X.INVALID_ATTRIBUTE_CLASS))
    folders = F.transform(
        P.folders_above(path),
        lambda folder: F.struct(
            F.lit(FOLDER_NAME).alias("role"), folder.alias("node_path"), P.base_name(folder).alias("value")
        ),
    )
    names = F.concat(
        F.array(
            F.struct(F.lit(FILE_PATH).alias("role"), path.alias("node_path"), path.alias("value")),
            F.struct(F.lit(FILE_NAME).alias("role"), path.alias("node_path"), P.base_name(path).alias("value")),
        ),
        folders,
    )
    found = (
        bad.select("bundle_id", F.inline(names))
        .withColumn("bad", X.first_invalid_attribute_char(F.col("value")))
        .where("bad IS NOT NULL")
        .select("bundle_id", "role", "node_path", "value", "bad.code_point", "bad.byte_index")
    )
    reason = F.when(F.col("code_point") == "U+0009", TAB_REASON).otherwise(INVALID_REASON)
    return found.dropDuplicates(["bundle_id", "role", "node_path"]).withColumn("reason", reason)


def require_safe_paths(files: DataFrame, mode: str = "fail") -> DataFrame:
    """Stop on a bad name (``fail``) or drop the bundles that hold one (``quarantine``).

    Bad bundles are found on the path columns. They are few, and their names go to the files, so no content moves; only a
    corpus with more than ``BROADCAST_BUNDLES`` of them is joined by shuffling.
    """
    violations = path_violations(files)
    if mode == "quarantine":
        bad = stage(violations.select("bundle_id").distinct())
        few = bad.limit(BROADCAST_BUNDLES + 1).count() <= BROADCAST_BUNDLES
        return files.join(F.broadcast(bad) if few else bad, "bundle_id", "left_anti")
    first = violations.limit(1).collect()
    if first:
        v = first[0]
        raise ValueError(
            f"{v.role} {v.value!r} of bundle {v.bundle_id!r} contains {v.code_point} "
            f"at byte index {v.byte_index}, which {v.reason}"
        )
    return files


def normalize_repo_refs(refs: DataFrame, ref: str = "ref") -> DataFrame:
    """Adds ``kind`` and ``clone_url``: URLs as they are, owner/name on github.com."""
    text = F.col(ref)
    url = F.when(F.col("kind") == "url", text).when(
        F.col("kind") == "shorthand", F.concat(F.lit("https://github.com/"), text, F.lit(".git"))
    )
    return refs.withColumn("kind", P.reference_kind(text)).withColumn("clone_url", url)
