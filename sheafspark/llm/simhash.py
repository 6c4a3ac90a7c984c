"""Near-duplicates: SimHash fingerprints linked by covering locality-sensitive hashing.

Every bit of the fingerprint gets a non-zero code of radius + 1 bits; each non-zero
code word v gives a mask, the bits whose code has odd overlap with v. The codes
of at most ``radius`` differing bits cannot span the whole code space, so some
mask leaves all of them out: every pair within the radius shares the key
(mask, fingerprint & mask) of some mask, and none is missed.

A bucket of more than ``BUCKET`` fingerprints is covered again over the bits that
its mask leaves free. At the last level so few bits are free that a bucket is small
by construction; nothing is capped and a group never meets whole in one task.

Null and empty texts and texts without words have fingerprint zero and are linked
like any other. Null document ids are ignored when a group is named; a group of nulls has no name. Repeated rows
share a fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.buffers import SPACED, Text, find_words, slices, text_of
from sheafspark.llm.storage import free_name, schema_with, stage

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Fingerprints of one bucket that are compared with each other directly.
BUCKET = 64
LEVELS = 3
_CHUNK = 1 << 16


def covering_masks(free: int, radius: int = RADIUS) -> list[int]:
    """Masks over the set bits of ``free``: any ``radius`` of these bits are outside some mask."""
    codes = (1 << (radius + 1)) - 1
    places = [i for i in range(BITS) if free >> i & 1]
    return [
        sum(1 << place for k, place in enumerate(places) if ((k % codes + 1) & v).bit_count() & 1)
        for v in range(1, codes + 1)
    ]


def fingerprints(text: Text, shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each row as uint64: bit set if set in more than half of the hashes of its shingles."""
    from xxhash import xxh64_intdigest

    text = text.lowered()
    words = find_words(text, SPACED)
    sizes, per_row = words.end - words.start + 1, words.per_row
    # All words of all rows, each followed by one space.
    spaced = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.full(int(spaced[-1]), 0x20, np.uint8)
    inside = np.ones(len(flat), bool)
    inside[spaced[1:] - 1] = False
    flat[inside] = text.data[SPACED[text.data]]
    raw = flat.tobytes()
    width = np.minimum(per_row, shingle)
    counts = np.where(per_row > 0, per_row - width + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate([[0], np.cumsum(counts)])
    begin = words.first[row] + np.arange(first[-1]) - first[row]
    starts, ends = spaced[begin], spaced[begin + width[row]] - 1
    hashes = np.fromiter(
        (xxh64_intdigest(raw[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)
    )
    ones = np.zeros((len(counts), BITS), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = row[at : at + _CHUNK]
        borders = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        ones[rows[borders]] += np.add.reduceat(bits, borders, axis=0, dtype=np.int32)
    set_bits = 2 * ones > counts[:, None]
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def with_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """All columns of ``df`` and the fingerprint of its ``text`` as a long (its bits)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                found = fingerprints(text_of(rows.column("text"))).view(np.int64)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], [*rows.schema.names, name])

    return df.mapInArrow(add, schema_with(df, (name, "long")))


def spanning_links(values: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that join all values which chains of at most ``radius`` bits join."""
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    waiting = np.ones(len(values), bool)
    for root in range(len(values)):
        if not waiting[root]:
            continue
        waiting[root] = False
        open_nodes = [root]
        while open_nodes:
            node = open_nodes.pop()
            found = np.flatnonzero(near[node] & waiting)
            waiting[found] = False
            open_nodes += found.tolist()
            for other in found.tolist():
                yield int(values[node]), int(values[other])


def _bucket_links(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("fps")
            offsets = lists.offsets.to_numpy()
            values = lists.values.to_numpy().view(np.uint64)
            sizes = np.diff(offsets)
            two = offsets[:-1][sizes == 2]
            a, b = values[two], values[two + 1]
            near = np.bitwise_count(a ^ b) <= radius
            pairs = [np.stack([a[near], b[near]], axis=1)]
            for at, size in zip(offsets[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found = list(spanning_links(values[at : at + size], radius))
                if found:
                    pairs.append(np.array(found, np.uint64))
            links = np.concatenate(pairs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0].copy()), pa.array(links[:, 1].copy())], ["a", "b"])

    return link


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that join what is within ``radius`` bits.

    Direct links of a bucket are reduced to a spanning forest, so the rows made
    are at most those of the buckets, whatever the size of a group.
    """
    masks = [(m, ((1 << BITS) - 1) & ~m) for m in covering_masks((1 << BITS) - 1, radius)]
    rows = prints.select("fp", F.explode(_masks([m for m, _ in masks])).alias("mask"))
    found = None
    for level in range(LEVELS):
        rows = rows.select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        large = None
        if level < LEVELS - 1:
            large = stage(rows.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > BUCKET).drop("n"))
            if large.isEmpty():
                large = None
        small = rows if large is None else rows.join(large, ["mask", "key"], "left_anti")
        buckets = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        links = buckets.select("fps").mapInArrow(_bucket_links(radius), "a long, b long")
        found = links if found is None else found.unionByName(links)
        if large is None:
            break
        finer = [(m, [m | s for s in covering_masks(free, radius)]) for m, free in masks]
        table = F.create_map(*[x for m, subs in finer for x in (F.lit(_signed(m)), _masks(subs))])
        rows = rows.join(large, ["mask", "key"], "left_semi").select("fp", F.explode(table[F.col("mask")]).alias("mask"))
        masks = [(s, ((1 << BITS) - 1) & ~s) for _, subs in finer for s in subs]
    return found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _masks(masks: list[int]):
    return F.array(*[F.lit(_signed(m)).cast("long") for m in dict.fromkeys(masks)])


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of a link (u, v): root is the smallest node it is connected with.

    Alternating large-star and small-star steps: every node's links are moved to its
    smallest neighbour, until all components are stars. A step is one aggregate and one join on nodes, which Spark can
    split where a node has very many links; each round is written to the shared folder.
    """
    links = stage(links)
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 32))).first()
        if now == seen:
            break
        seen = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


#: Components of more classes than this are dealt into so many tasks by their fingerprints.
LARGE, SALTS = 1024, 64


def _with_root_value(rooted: DataFrame, value, name: str, as_name: str) -> DataFrame:
    """``rooted`` with an aggregate over each root.

    The aggregate combines before its shuffle. To come back to the rows it is joined by root; the few large components are
    joined by root and a salt of the fingerprint instead, so a giant one is never one task.
    """
    totals = stage(rooted.groupBy("root").agg(value(F.col(name)).alias("of_root"), F.count("*").alias("n_classes")))
    large = totals.where(F.col("n_classes") > LARGE).select("root", F.col("of_root").alias("of_large"), F.lit(True).alias("is_large"))
    large = large.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    small = totals.where(F.col("n_classes") <= LARGE).select("root", F.col("of_root").alias("of_small"), F.lit(-1).cast("long").alias("salt"))
    salted = rooted.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS))).join(large, ["root", "salt"], "left")
    salted = salted.withColumn("salt", F.when(F.col("is_large"), F.col("salt")).otherwise(F.lit(-1).cast("long")))
    both = salted.join(small, ["root", "salt"], "left")
    found = F.when(F.col("is_large"), F.col("of_large")).otherwise(F.col("of_small"))
    return both.withColumn(as_name, found).drop("salt", "is_large", "of_large", "of_small")


def fingerprint_groups(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of rows (doc_id, fp).

    root is the smallest fingerprint (as a long) of those connected with ``fp``, component_id the
    smallest document id of their rows.
    """
    classes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("id")))
    roots = components(near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left")
    rooted = stage(rooted.select("fp", F.coalesce("root", "fp").alias("root"), "id"))
    return _with_root_value(rooted, F.min, "id", "component_id").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, fingerprint (hex), component_id."""
    prints = stage(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    groups = fingerprint_groups(prints, radius)
    return prints.join(groups, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that remain when one document of each group of near-duplicates stays.

    Groups are those of ``near_duplicates``: fingerprints of 3-word shingles within 2 bits, linked through others. No pair within
    that radius is lost; it is not a bound on the similarity of texts, and copies with a few changed words can lie further apart.
    It is the one with the smallest id, a row without id only in a group that has none; among equal ids the text with the
    smallest hash; of repeated rows one. All columns are kept as they are. What is decided about a row is found again
    by its id and a hash of its text, so no copy of the texts is written.
    """
    names = {n: free_name(docs, n) for n in ("kept_id", "kept_key", "copies", "whole_row")}
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    prints = stage(with_fingerprint(keyed, "fp").select("doc_id", "key", "fp"))
    groups = fingerprint_groups(prints.select("doc_id", "fp"), radius).select("fp", "root")
    rows = stage(prints.groupBy("fp", "doc_id", "key").agg(F.count("*").alias("n")).join(groups, "fp"))
    ranked = rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    firsts = _with_root_value(ranked, F.min, "rank", "first")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    marks = stage(
        firsts.select(F.col("doc_id").alias(names["kept_id"]), F.col("key").alias(names["kept_key"]), F.col("n").alias(names["copies"]), kept.alias("kept"))
    )
    same = F.col("doc_id").eqNullSafe(F.col(names["kept_id"])) & (F.xxhash64("text") == F.col(names["kept_key"]))
    rest = docs.join(marks.where("NOT kept").drop("kept", names["copies"]), same, "left_anti")
    several = marks.where("kept").where(F.col(names["copies"]) > 1).drop("kept", names["copies"])
    if several.isEmpty():
        return rest
    # Of rows with equal id and text, but perhaps other columns that differ, the least by a hash of all columns stays; equal ones are one.
    repeated = rest.join(several, same, "left_semi").withColumn(names["whole_row"], F.xxhash64(*docs.columns))
    least = repeated.groupBy("doc_id", F.xxhash64("text").alias(names["kept_key"])).agg(F.min(names["whole_row"]).alias(names["whole_row"]))
    least = least.withColumnRenamed("doc_id", names["kept_id"]).withColumnRenamed(names["whole_row"], names["copies"])
    is_least = same & (F.col(names["whole_row"]) == F.col(names["copies"]))
    once = repeated.join(least, is_least, "left_semi").drop(names["whole_row"]).dropDuplicates(["doc_id", "text"])
    return rest.join(several, same, "left_anti").unionByName(once)
