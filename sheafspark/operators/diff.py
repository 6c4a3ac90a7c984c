"""Difference of two snapshots: what was added, removed, changed and moved in each bundle.

Snapshots are multisets of (bundle_id, path, content hash). What both hold goes first, by counts alone. The rest is
paired one to one, three times: rows of the same path are changes, then equal contents under the same name in
another folder and equal contents under any name are moves. Pairing needs the n-th row of each side, also where one content
makes up most of a corpus (empty files, licences); so rows are numbered by range partitions and their counts, never by
sorting one group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.functions.paths import base_name
from sheafspark.session import stage


def _none(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def fingerprints(files: DataFrame) -> DataFrame:
    """(bundle_id, path, hash) of a ``files`` table; a file without content has a null hash."""
    return files.select("bundle_id", "path", F.sha2("content", 256).alias("hash"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """Adds the place (from 1) of each row among those of its keys, in the given order.

    Rows are split by range, so a key of very many rows lies in several partitions. Places inside a partition come from a window
    over one partition's share of a key; what the earlier partitions hold is added from their counts, one row per key and partition.
    """
    split = rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id())
    split = stage(split)
    inside = Window.partitionBy("_part", *keys).orderBy(*order)
    counts = split.groupBy("_part", *keys).agg(F.count("*").alias("_count"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("_part", *keys, F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    placed = split.withColumn("_here", F.row_number().over(inside)).alias("a")
    same = [F.col("a._part") == F.col("b._part"), *[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    joined = placed.join(earlier.alias("b"), same)
    return joined.select(*[f"a.{c}" for c in rows.columns], (F.col("_here") + F.col("_before")).alias(name))


def _pair(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, rest of old, rest of new): the n-th old row of each key goes with the n-th new one."""
    order = [c for c in ("path", "hash") if c not in keys]
    a, b = numbered(old, keys, order).alias("a"), numbered(new, keys, order).alias("b")
    same = [*[F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], F.col("a.n") == F.col("b.n")]
    sides = [
        F.struct(*[F.col(f"{side}.{c}") for c in ("bundle_id", "path", "hash", "name", "n")]).alias(side) for side in "ab"
    ]
    both = stage(a.join(b, same, "full").select(*sides))
    here, there = F.col("a.n").isNotNull(), F.col("b.n").isNotNull()
    columns = ("bundle_id", "path", "hash", "name")
    return (
        both.where(here & there),
        both.where(here & ~there).select(*[f"a.{c}" for c in columns]),
        both.where(~here & there).select(*[f"b.{c}" for c in columns]),
    )


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bundle_id, status, path, old_path, old_hash, new_hash) of two tables (bundle_id, path, hash).

    status is added, removed, changed (same path, other content) or moved (same content, other path; ``old_path`` is where it
    was). A path or file that occurs several times counts as often. Among equal candidates pairs follow the order of paths.
    """
    sides = before.select("bundle_id", "path", "hash", F.lit(1).alias("old"), F.lit(0).alias("new")).unionByName(
        after.select("bundle_id", "path", "hash", F.lit(0).alias("old"), F.lit(1).alias("new"))
    )
    surplus = sides.groupBy("bundle_id", "path", "hash").agg(F.sum("old").alias("old"), F.sum("new").alias("new")).where("old <> new")
    named = stage(surplus.withColumn("name", base_name(F.col("path"))).withColumn("d", F.expr("new - old")))

    def units(rows: DataFrame) -> DataFrame:
        # A row that is surplus many times over becomes as many rows, in whatever tasks it lies.
        return rows.select("bundle_id", "path", "hash", "name", F.explode(F.sequence(F.lit(1), F.abs("d").cast("int")))).drop("col")

    changed, old, new = _pair(units(named.where("d < 0")), units(named.where("d > 0")), ["bundle_id", "path"])
    moved, old, new = _pair(old, new, ["bundle_id", "hash", "name"])
    renamed, old, new = _pair(old, new, ["bundle_id", "hash"])
    changes = changed.select(
        "b.bundle_id", F.lit("changed").alias("status"), "b.path", _none("old_path"), F.col("a.hash").alias("old_hash"), F.col("b.hash").alias("new_hash")
    )
    moves = moved.unionByName(renamed).select(
        "b.bundle_id", F.lit("moved").alias("status"), "b.path", F.col("a.path").alias("old_path"), F.col("a.hash").alias("old_hash"), F.col("b.hash").alias("new_hash")
    )
    removed = old.select(
        "bundle_id", F.lit("removed").alias("status"), "path", _none("old_path"), F.col("hash").alias("old_hash"), _none("new_hash")
    )
    added = new.select("bundle_id", F.lit("added").alias("status"), "path", _none("old_path"), _none("old_hash"), F.col("hash").alias("new_hash"))
    return changes.unionByName(moves).unionByName(removed).unionByName(added)


def diff_summary(diff: DataFrame) -> DataFrame:
    """(bundle_id, added, removed, changed, moved)."""
    return diff.groupBy("bundle_id").agg(
        *[F.count_if(F.col("status") == status).alias(status) for status in ("added", "removed", "changed", "moved")]
    )
