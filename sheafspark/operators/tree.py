"""The folder hierarchy as rows, its roll-ups, and the structure section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions import paths as P
from sheafspark.functions import xml as X

# Separator of sort keys: below every character a checked path can hold.
KEY_END = "\x01"


def folders(files: DataFrame) -> DataFrame:
    """(bundle_id, node_path) of every folder below the root.

    Folders repeat in each file below them; the distinct is combined on the
    map side, so a big folder sends one row per task.
    """
    above = P.folders_above(F.col("path"))
    return files.select("bundle_id", F.explode(above).alias("node_path")).distinct()


def tree_nodes(files: DataFrame) -> DataFrame:
    """(bundle_id, node_path, parent_path, name, depth, kind), the root left implicit."""
    nodes = (
        files.select("bundle_id", F.col("path").alias("node_path"), F.lit("file").alias("kind"))
        .unionByName(folders(files).withColumn("kind", F.lit("folder")))
    )
    node = F.col("node_path")
    return nodes.select(
        "bundle_id",
        "node_path",
        P.parent_path(node).alias("parent_path"),
        P.base_name(node).alias("name"),
        P.path_depth(node).alias("depth"),
        "kind",
    )


def children(tree: DataFrame) -> DataFrame:
    """Direct children as (bundle_id, parent_path, kind, name) rows, never one array."""
    return tree.select("bundle_id", "parent_path", "kind", "name")


def folder_sizes(tree: DataFrame) -> DataFrame:
    """Number of direct files and sub-folders per folder ('' is the root)."""
    return tree.groupBy("bundle_id", "parent_path").agg(
        F.count_if(F.col("kind") == "file").alias("n_files"),
        F.count_if(F.col("kind") == "folder").alias("n_folders"),
    )


def directory_rollup(entries: DataFrame, *measures: str) -> DataFrame:
    """Files and sums of the measures per folder including all below it.

    Entries are first summed per folder, so the fan-out to ancestors works on
    one row per folder and a hot folder is combined on the map side.
    """
    sums = [F.sum(m).cast("bigint").alias(m) for m in measures]
    direct = entries.groupBy("bundle_id", P.parent_path(F.col("path")).alias("folder")).agg(
        F.count("*").alias("n_files"), *sums
    )
    chain = F.when(F.col("folder") == "", F.array(F.lit(""))).otherwise(
        F.array_append(P.ancestors(F.col("folder")), F.col("folder"))
    )
    columns = ["n_files", *measures]
    return (
        direct.select("bundle_id", F.explode(chain).alias("node_path"), *columns)
        .groupBy("bundle_id", "node_path")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )


def largest_folders(rollup: DataFrame, measure: str, n: int = 10) -> DataFrame:
    """The ``n`` folders of each bundle with the largest measure, ranked; ties share a rank and all stay.

    ``rollup`` comes from ``directory_rollup``. Spark limits a filtered rank before the
    shuffle as well, so a task sends few rows per bundle however many folders there are.
    """
    size = Window.partitionBy("bundle_id").orderBy(F.col(measure).desc())
    ranked = rollup.where("node_path <> ''").withColumn("size_rank", F.rank().over(size))
    return ranked.where(F.col("size_rank") <= n)


def depth_profile(tree: DataFrame) -> DataFrame:
    """Files, folders and the widest folder per bundle and depth."""
    wide = tree.groupBy("bundle_id", "depth", "parent_path").agg(
        F.count_if(F.col("kind") == "file").alias("files"),
        F.count_if(F.col("kind") == "folder").alias("folders"),
    )
    return wide.groupBy("bundle_id", "depth").agg(
        F.sum("files").alias("n_files"),
        F.sum("folders").alias("n_folders"),
        F.max(F.col("files") + F.col("folders")).alias("max_children"),
    )


def _folder_key(folder: Column) -> Column:
    """Sort key of a folder; '' for the root. A prefix of the keys of its content."""
    nested = F.replace(folder, F.lit("/"), F.lit(KEY_END + "1"))
    return F.when(folder == "", F.lit("")).otherwise(F.concat(F.lit("1"), nested, F.lit(KEY_END)))


def structure_rows(files: DataFrame) -> DataFrame:
    """(bundle_id, sort_key, line) of the nested listing, indented for its place.

    In key order a folder's files come first, then its sub-folders, then its
    end tag. The keys alone put open and close tags in place: no window, no
    recursion, and any range split of a bundle stays correct.
    """
    path, node = F.col("path"), F.col("node_path")

    def indent(p: Column) -> Column:
        return F.repeat(F.lit("  "), P.path_depth(p) + 2)

    file_rows = files.select(
        "bundle_id",
        F.concat(_folder_key(P.parent_path(path)), F.lit("0"), P.base_name(path)).alias("sort_key"),
        F.concat(
            indent(path), F.lit('<file path="'), X.escape_attr(P.base_name(path)), F.lit('" />')
        ).alias("line"),
    )
    opened = F.concat(indent(node), F.lit('<folder name="'), X.escape_attr(P.base_name(node)), F.lit('">'))
    closed = F.concat(indent(node), F.lit("</folder>"))
    ends = F.array(
        F.struct(_folder_key(node).alias("sort_key"), opened.alias("line")),
        F.struct(F.concat(_folder_key(node), F.lit("2")).alias("sort_key"), closed.alias("line")),
    )
    return file_rows.unionByName(folders(files).select("bundle_id", F.inline(ends)))
