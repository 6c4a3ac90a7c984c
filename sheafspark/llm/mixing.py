"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents of a source are dealt to blocks by hash; the blocks of a source are permuted and laid on a line of two turns, of
which the mix takes the part that holds the source's target words. The number of
whole blocks taken is the source's exact quota. A binary tree divides the quotas among output
shards: each node draws how many of its blocks of each source go left, from the
multivariate hypergeometric distribution, so every shard is a fair sample of the
mix while all quotas stay exact. Shards take disjoint ranges of the permuted
blocks and shuffle their documents locally.

Everything is DataFrame functions. Blocks hold about ``BLOCK_DOCS`` documents at every size of a source; running sums over the
blocks of a source go by chunks of ``CHUNK`` blocks and then inside a chunk. Other windows run over the documents of one block, over sources (one
row each) and over shards; no window holds a source's documents. With many sources the tree first divides groups of
sources and then, given what each shard has of a group, the sources inside every group; so no row holds all sources.

Null texts have no words; documents without words weigh nothing and are taken when their
block is. Null sources form one source, the last. Documents with null ids and repeated
rows are documents of their own; equal rows of a cut block are told apart by nothing, so which of them is taken does not
matter. An empty table gives an empty mix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafspark.llm.storage import stage

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
#: Documents of a block, about; blocks of a chunk; sources in a row of the tree, about.
BLOCK_DOCS, CHUNK, GROUP = 256, 4096, 256
#: Words of an output shard.
SHARD_WORDS = 10_000_000
SEED = 17
#: The tree's nodes are spread over tasks below this depth.
SPREAD_DEPTH = 6
# A prime above any number of blocks: multiplying by it permutes the blocks of a source.
_PRIME = 2_147_483_647


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null, through one mark per word."""
    marks = F.regexp_replace(text, r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, r"[\x20\x09-\x0D]+", "")), F.lit(0)).cast("long")


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, source, size, order, more...) of every document; order is a hash that no other column follows."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("order"),
        *[F.col(c) for c in more],
    )


def targets(sized: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n_docs, source_size, weight, target): one row per source.

    Filling to a level: a target is the smaller of ``most`` times the source's size
    and weight times a level. With sources in the order in which they reach
    their limit, sums over that order give the level without iteration.
    """
    groups = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    limit = F.col("source_size") * float(most)
    rows = groups.withColumn("weight", weight).withColumn("limit", limit)
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # If exactly the sources before this one are at their limit, this is the level of the others.
    level = (
        F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    free = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    rows = rows.withColumn("level", F.first(free, ignorenulls=True).over(everything))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return rows.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def blocks_of(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the number of their block, and the source's row."""
    n = F.ceil(F.col("n_docs") / BLOCK_DOCS).cast("long")
    named = sources.select(F.col("source").alias("_source"), "source_size", "target", n.alias("n_blocks"))
    joined = sized.join(F.broadcast(named) if _is_small(named) else named, F.col("source").eqNullSafe(F.col("_source")))
    return joined.drop("_source").withColumn("block", F.pmod(F.col("order"), F.col("n_blocks")))


def _is_small(table: DataFrame, rows: int = 100_000) -> bool:
    """Whether a narrow table has few enough rows to be broadcast."""
    return table.limit(rows + 1).count() <= rows


def block_plan(blocked: DataFrame) -> DataFrame:
    """One row per block: its place in the source's permutation, copies taken whole, and words taken of a cut block.

    The line of a source is its permuted blocks; whole turns are taken first, then
    blocks while they fit; the next block is cut.
    """
    totals = blocked.groupBy("source", "block", "n_blocks", "source_size", "target").agg(F.sum("size").alias("words"))
    offset = F.pmod(F.xxhash64(F.lit(SEED), "source"), F.col("n_blocks"))
    place = F.pmod(F.col("block") * (F.lit(_PRIME) % F.col("n_blocks")) + offset, F.col("n_blocks"))
    rows = _running(totals.withColumn("place", place))
    wanted = F.round(F.col("target")).cast("long")
    turns = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("long")
    rest = wanted - turns * F.col("source_size") - F.col("before")
    whole = turns + F.when((rest >= F.col("words")) & (rest > 0), 1).otherwise(0)
    cut = F.when((rest > 0) & (rest < F.col("words")), rest).otherwise(0)
    return rows.select(
        "source", "block", "n_blocks", "place", "words", whole.cast("long").alias("whole"), cut.cast("long").alias("cut"), "rank", "n_present"
    )


def _running(rows: DataFrame) -> DataFrame:
    """Adds, along the places of each source: words before a block, its rank (from 0), and the number of the source's blocks."""
    chunked = stage(rows.withColumn("chunk", F.expr(f"place div {CHUNK}")))
    chunks = chunked.groupBy("source", "chunk").agg(F.sum("words").alias("words"), F.count("*").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select(
        F.col("source").alias("_source"), F.col("chunk").alias("_chunk"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("_words"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_n"),
        F.sum("n").over(Window.partitionBy("source")).alias("n_present"),
    )
    inside = Window.partitionBy("source", "chunk").orderBy("place")
    here = chunked.withColumns(
        {
            "before": F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "rank": F.row_number().over(inside) - 1,
        }
    )
    both = here.join(chunks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("chunk") == F.col("_chunk")))
    both = both.withColumns({"before": F.col("before") + F.col("_words"), "rank": F.col("rank") + F.col("_n")})
    return both.drop("chunk", "_source", "_chunk", "_words", "_n")


def cut_picks(blocked: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, block, number): the documents of cut blocks that are taken once more, by their place in the order of their hash.

    Documents are gone through in that order, and each is taken that fits what is left; so what is left in the end is less
    than any document left out. Then the smallest of those is taken too and taken ones that fit what is too much, the largest
    first, are given back, if that brings the sum nearer. So the gap is about the smallest document, not half of the largest. Documents
    without words are taken up to the first that did not fit although it is no larger than the whole cut. A list holds the sizes of one block.
    """
    cuts = plan.where("cut > 0").select(F.col("source").alias("_source"), F.col("block").alias("_block"), "cut")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    rows = blocked.join(F.broadcast(cuts) if _is_small(cuts) else cuts, same)
    listed = rows.groupBy("source", "block", "cut").agg(F.sort_array(F.collect_list(F.struct("order", "doc_id", "size"))).alias("docs"))
    begin = F.struct(
        F.col("cut").alias("left"), F.lit(0).cast("long").alias("at"), F.lit(True).alias("open"),
        F.expr("cast(array() as array<bigint>)").alias("picked"),
    )

    def step(a: Column, d: Column) -> Column:
        fits = F.when(d["size"] == 0, a["open"]).otherwise(d["size"] <= a["left"])
        return F.struct(
            F.when(fits, a["left"] - d["size"]).otherwise(a["left"]).alias("left"),
            (a["at"] + 1).alias("at"),
            (a["open"] & (fits | (d["size"] > F.col("cut")))).alias("open"),
            F.when(fits, F.concat(a["picked"], F.array(a["at"] + 1))).otherwise(a["picked"]).alias("picked"),
        )

    filled = listed.withColumn("filled", F.explode(F.array(F.aggregate("docs", begin, step))))
    left, picked = F.col("filled.left"), F.col("filled.picked")
    numbered = F.transform("docs", lambda d, k: F.struct(d["size"].alias("size"), (k + 1).cast("long").alias("number")))
    worded = F.filter(numbered, lambda d: d["size"] > 0)
    nearer = filled.select(
        "source", "block", left.alias("left"), picked.alias("picked"),
        F.explode(F.array(F.array_min(F.filter(worded, lambda d: ~F.array_contains(picked, d["number"]))))).alias("more"),
        F.sort_array(F.filter(worded, lambda d: F.array_contains(picked, d["number"])), asc=False).alias("given"),
    )
    none = F.expr("cast(array() as array<bigint>)")
    over = F.struct((F.col("more.size") - F.col("left")).alias("over"), none.alias("back"))

    def give_back(a: Column, d: Column) -> Column:
        fits = d["size"] <= a["over"]
        return F.struct(
            F.when(fits, a["over"] - d["size"]).otherwise(a["over"]).alias("over"),
            F.when(fits, F.concat(a["back"], F.array(d["number"]))).otherwise(a["back"]).alias("back"),
        )

    filled = nearer.withColumn("turned", F.explode(F.array(F.aggregate("given", over, give_back))))
    other = F.concat(F.array_except("picked", "turned.back"), F.array(F.col("more.number")))
    every = F.when(F.col("turned.over") < F.col("left"), other).otherwise(F.col("picked"))
    return filled.select("source", "block", F.explode(every).alias("number"))


def cut_copies(rows: DataFrame, picks: DataFrame) -> DataFrame:
    """Whether each document of the cut blocks is taken once more (column ``extra``, 0 or 1)."""
    number = F.row_number().over(Window.partitionBy("source", "block").orderBy("order", "doc_id", "size")).cast("long")
    taken = picks.select(F.col("source").alias("_of"), F.col("block").alias("_in"), F.col("number").alias("_number"))
    same = F.col("source").eqNullSafe(F.col("_of")) & (F.col("block") == F.col("_in")) & (F.col("_place") == F.col("_number"))
    found = rows.withColumn("_place", number).join(F.broadcast(taken) if _is_small(taken) else taken, same, "left")
    return found.withColumn("extra", F.col("_number").isNotNull().cast("long")).drop("_place", "_of", "_in", "_number")


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series from 16 on (error below 1e-11), exact products below."""
    x = F.greatest(n, F.lit(16.0))
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x)
    table = F.array(*[F.lit(math.log(math.factorial(k))) for k in range(17)])
    return F.when(n < 16, F.element_at(table, (n + 1).cast("int"))).otherwise(series)


def _log_choose(n: Column, k: Column) -> Column:
    return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)


def hypergeometric(total: Column, good: Column, drawn: Column, chance: Column) -> Column:
    """A hypergeometric count by inversion: ``good`` of ``total`` blocks, ``drawn`` of them taken.

    Twelve standard deviations around the mean are summed; ``chance`` is uniform on [0, 1).
    """
    t, g, d = total.cast("double"), good.cast("double"), drawn.cast("double")
    mean = d * g / F.greatest(t, F.lit(1.0))
    spread = F.sqrt(mean * (1 - g / F.greatest(t, F.lit(1.0)))) + 1
    least, most = F.greatest(F.lit(0.0), d - (t - g)), F.least(g, d)
    low = F.greatest(least, F.floor(mean - 12 * spread).cast("double"))
    high = F.least(most, F.ceil(mean + 12 * spread).cast("double"))
    mass = F.transform(
        F.sequence(low.cast("long"), high.cast("long")),
        lambda k: F.struct(
            k.alias("k"),
            F.exp(
                _log_choose(g, k.cast("double")) + _log_choose(t - g, d - k.cast("double")) - _log_choose(t, d)
            ).alias("p"),
        ),
    )
    start = F.struct(F.lit(0.0).alias("sum"), low.cast("long").alias("k"))
    # The chosen count is the last one whose preceding sum does not exceed the chance.
    return F.aggregate(
        mass,
        start,
        lambda a, m: F.struct(
            (a["sum"] + m["p"]).alias("sum"), F.when(a["sum"] <= chance, m["k"]).otherwise(a["k"]).alias("k")
        ),
        lambda a: a["k"],
    )


def _drawing(seed: int, depth: int):
    """One step along a node's sources: how many blocks of this source go left."""

    def draw(state: Column, q: Column) -> Column:
        key = F.xxhash64(F.lit(seed), F.lit(depth), F.col("shard"), q["source"])
        chance = F.pmod(key, F.lit(1 << 40)) / float(1 << 40)
        k = hypergeometric(state["total"], q["quota"], state["wanted"], chance)
        k = F.when((q["quota"] == 0) | (state["wanted"] == 0), F.lit(0).cast("long")).otherwise(k)
        return F.struct(
            (state["total"] - q["quota"]).alias("total"),
            (state["wanted"] - k).alias("wanted"),
            F.concat(state["left"], F.array(k)).alias("left"),
        )

    return draw


def _sum_quotas(quotas: Column) -> Column:
    return F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q["quota"])


def _divide(nodes: DataFrame, n_shards: int, seed: int, wanted) -> DataFrame:
    """(shard, quotas, more...) of the leaves below nodes (shard, shards, quotas, more...).

    A node's row holds its quotas as an array. Its left child gets ``wanted`` blocks, the
    number of each source drawn one source after the other, each from what the earlier ones left: the multivariate
    hypergeometric distribution. The right child gets the rest, so the sums stay exact. What is zero goes at each level.
    """
    more = [c for c in nodes.columns if c not in ("shard", "shards", "quotas")]
    for depth in range(max(0, (n_shards - 1).bit_length())):
        half = F.ceil(F.col("shards") / 2).cast("long")
        begin = F.struct(
            _sum_quotas(F.col("quotas")).alias("total"), wanted(half).alias("wanted"), F.expr("cast(array() as array<bigint>)").alias("left")
        )
        left = F.aggregate("quotas", begin, _drawing(seed, depth), lambda s: s["left"])
        drawn = nodes.select(
            "shard", "shards", "quotas", half.alias("half"), *more,
            F.explode(F.array(F.when(F.col("shards") > 1, left).otherwise(F.transform("quotas", lambda q: q["quota"])))).alias("left"),
        )
        quota_left = F.zip_with("quotas", "left", lambda q, k: F.struct(q["source"].alias("source"), k.alias("quota")))
        quota_right = F.zip_with("quotas", "left", lambda q, k: F.struct(q["source"].alias("source"), (q["quota"] - k).alias("quota")))
        one = F.when(F.col("shards") > 1, F.col("half")).otherwise(F.col("shards"))

        def some(quotas: Column) -> Column:
            return F.filter(quotas, lambda q: q["quota"] > 0)

        children = F.array(
            F.struct(F.col("shard").alias("shard"), one.alias("shards"), some(quota_left).alias("quotas")),
            F.struct((F.col("shard") + one).alias("shard"), (F.col("shards") - one).alias("shards"), some(quota_right).alias("quotas")),
        )
        nodes = drawn.select(*more, F.inline(children)).where("shards > 0 AND size(quotas) > 0")
        if depth == SPREAD_DEPTH:
            nodes = nodes.repartition("shard")
    return nodes.select("shard", "quotas", *more)


def splitting_tree(quotas: DataFrame, n_shards: int, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """(shard, source, quota): ``quotas`` (source, quota) divided among shards.

    Up to ``group`` sources are one row of the tree. More are dealt into groups by hash: a first tree divides the groups' sums, and
    then each group has a tree of its own whose nodes take what the first one gave their shards, which is the same distribution.
    """
    pair = F.struct(F.col("source"), F.col("quota").cast("long").alias("quota"))
    some = quotas.where("quota > 0")
    shard, shards = F.lit(0).cast("long").alias("shard"), F.lit(n_shards).cast("long").alias("shards")
    n_groups = -(-some.count() // group)

    def fair(half: Column) -> Column:
        return F.round(_sum_quotas(F.col("quotas")) * half / F.col("shards")).cast("long")

    if n_groups <= 1:
        root = some.agg(F.array_sort(F.collect_list(pair)).alias("quotas")).select(shard, shards, "quotas")
        return _divide(root.where("size(quotas) > 0"), n_shards, seed, fair).select("shard", F.inline("quotas"))
    # The tree over groups is itself one over sums, so its rows are bounded in the same way.
    grouped = some.withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(n_groups)))
    sums = grouped.groupBy(F.col("group").cast("string").alias("source")).agg(F.sum("quota").cast("long").alias("quota"))
    given = stage(splitting_tree(stage(sums), n_shards, seed + 1, group))
    shares = given.groupBy(F.col("source").cast("long").alias("group")).agg(
        F.collect_list(F.struct("shard", "quota")).alias("given")
    )
    roots = grouped.groupBy("group").agg(F.array_sort(F.collect_list(pair)).alias("quotas")).join(shares, "group")
    roots = roots.select(shard, shards, "quotas", "group", "given").repartition("group")

    def as_given(half: Column) -> Column:
        inside = F.filter("given", lambda g: (g["shard"] >= F.col("shard")) & (g["shard"] < F.col("shard") + half))
        return _sum_quotas(inside)

    return _divide(roots, n_shards, seed, as_given).select("shard", F.inline("quotas"))


def draws(plan: DataFrame, n_shards: int) -> DataFrame:
    """(source, block, turn, shard): every draw of a block and the shard it goes to.

    The draws of a source are numbered turn by turn along its permuted blocks;
    each shard takes the next range of its quota.
    """
    turns = F.col("whole") + (F.col("cut") > 0).cast("long")
    taken = plan.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(int(MOST) + 1)))).where(F.col("turn") <= turns)
    # All blocks take part in whole turns, and the first ones along the line in the last.
    number = (F.col("turn") - 1) * F.col("n_present") + F.col("rank")
    numbered = stage(taken.select("source", "block", "turn", number.alias("number")))
    quotas = numbered.groupBy("source").agg(F.count("*").alias("quota"))
    shares = splitting_tree(quotas, n_shards)
    line = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    ranges = shares.withColumn("begin", F.coalesce(F.sum("quota").over(line), F.lit(0)))
    ranges = ranges.select(
        F.col("source").alias("_source"), "shard", F.explode(F.sequence("begin", F.expr("begin + quota - 1"))).alias("_number")
    )
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("number") == F.col("_number"))
    return numbered.join(ranges, same).select("source", "block", "turn", "shard")


def mix(docs: DataFrame, *more: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Every document with its place in the mix.

    Columns: doc_id, size, source_size, target, taken, copies, shards (the shard of each
    copy), source and the columns named in ``more``.
    """
    sized = sizes(docs, *more)
    # What the plan needs of a document is a few numbers; the texts are counted once.
    narrow = stage(sizes(docs))
    sources = stage(targets(narrow))
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    blocked = blocks_of(narrow, sources)
    plan = stage(block_plan(blocked))
    shards = draws(plan, max(1, math.ceil(total / shard_words)))
    by_block = shards.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"]).alias("shards")
    )
    both = plan.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "whole", "cut").join(
        by_block.withColumnsRenamed({"_source": "s", "_block": "b"}),
        F.col("_source").eqNullSafe(F.col("s")) & (F.col("_block") == F.col("b")),
        "left",
    )
    table = stage(both.select("_source", "_block", "whole", "cut", "shards"))
    rows = blocks_of(sized if more else narrow, sources).join(
        F.broadcast(table) if _is_small(table) else table,
        F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")),
    )
    uncut = rows.where("cut = 0").withColumn("extra", F.lit(0).cast("long"))
    picks = stage(cut_picks(blocked, plan))
    every = uncut.unionByName(cut_copies(rows.where("cut > 0"), picks))
    copies = F.col("whole") + F.col("extra")
    return every.select(
        "doc_id", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
        copies.alias("copies"),
        F.coalesce(F.slice("shards", F.lit(1), copies.cast("int")), F.expr("cast(array() as array<bigint>)")).alias("shards"),
        *more,
    )


def mixed_rows(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, in locally shuffled shards."""
    held = docs.select(
        F.struct(*[F.col(c) for c in docs.columns]).alias("row"), "doc_id", "source", "text"
    )
    placed = mix(held, "row", shard_words=shard_words)
    each = placed.select("row", "doc_id", F.posexplode("shards").alias("turn", "shard"))
    shuffled = each.withColumn("order", F.xxhash64(F.lit(SEED + 1), "shard", "turn", "doc_id", F.hash("row")))
    n = F.col("shard")
    return shuffled.repartition(n, F.pmod("order", F.lit(64))).sortWithinPartitions("shard", "order").select("row.*")
