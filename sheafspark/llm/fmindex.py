"""Benchmark decontamination with an FM-index per training shard.

Texts are word sequences. A shard is some documents of one task; its index
holds the Burrows-Wheeler transform of their words as a wavelet tree (one bit
vector per level, with rank directories) and every eighth suffix position. Windows of
the test items are searched backwards, all at once, through ranks; the
occurrences are located by walking to the nearest sampled position and merged to
removal spans per document.

Words that occur in no test item cannot be part of an occurrence, nor can a run of
other words that is shorter than the shortest window: they only separate
runs and are left out of the index. Test items are taken in blocks of at
most about ``BLOCK_WORDS`` words, so what a task holds of them is bounded.

Null texts and texts without words have no windows and are never hit. An item whose id is
null counts as one item with an empty id. Repeated rows are judged one by one; an empty
table of documents gives no rows and an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.buffers import ALNUM, find_words, hash_words, slices, text_of
from sheafspark.llm.storage import free_name, stage

WINDOW = 13
#: Words of test items per block.
BLOCK_WORDS = 4_000_000
#: A shard is closed when it holds this many indexed words, or documents.
SHARD_WORDS, SHARD_DOCS = 1_000_000, 20_000
SAMPLE = 8

INDEX = (
    "shard string, doc_id array<long>, text_key array<long>, n_words array<long>, "
    "n long, levels int, bits binary, ranks binary, zeros array<long>, starts binary, "
    "vocabulary binary, marked binary, marked_ranks binary, samples binary, run_start binary, run_doc binary, run_word binary"
)
HITS = (
    "shard string, row int, doc_id long, text_key long, n_words long, "
    "spans array<struct<begin:long,end:long>>, items array<string>"
)


class Bits:
    """A bit vector with a rank directory: ones before each 64-bit word."""

    def __init__(self, words: np.ndarray, before: np.ndarray):
        self.words, self.before = words, before

    @classmethod
    def of(cls, flags: np.ndarray) -> Bits:
        padded = np.zeros((len(flags) // 64 + 1) * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        padded[: len(packed)] = packed
        words = padded.view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int32)
        return cls(words, np.cumsum(ones, dtype=np.int32) - ones)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Ranks and values of a sequence of small integers, one bit vector per level."""

    def __init__(self, levels: list[Bits], zeros: list[int]):
        self.levels, self.zeros = levels, zeros

    @classmethod
    def of(cls, values: np.ndarray, n_levels: int) -> WaveletTree:
        levels, zeros = [], []
        for level in reversed(range(n_levels)):
            flags = (values >> level) & 1 == 1
            levels.append(Bits.of(flags))
            zeros.append(int(len(flags) - flags.sum()))
            values = np.concatenate([values[~flags], values[flags]])
        return cls(levels, zeros)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        low, high = np.zeros_like(at), at
        for depth, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = (symbol >> (len(self.levels) - 1 - depth)) & 1 == 1
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return high - low

    def value_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position and how often it occurs before."""
        low, high, symbol = np.zeros_like(at), at, np.zeros_like(at)
        for bits, zeros in zip(self.levels, self.zeros):
            one = bits.get(high) == 1
            a, b = bits.rank(low), bits.rank(high)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
            symbol = symbol * 2 + one
        return symbol, high - low


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in order; the zeros count as different, in order of place."""
    n = len(symbols)
    ends = symbols == 0
    rank = np.where(ends, np.cumsum(ends) - 1, symbols + int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_rank[1:] != sorted_rank[:-1])]) if n else 0
        rank = new
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        rank = rank * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        width *= 2


@dataclass
class ShardIndex:
    """The index of one shard: counts of smaller symbols, wavelet tree, sampled positions."""

    n: int
    starts: np.ndarray
    tree: WaveletTree
    marked: Bits
    samples: np.ndarray

    @classmethod
    def of(cls, symbols: np.ndarray, n_symbols: int, run_start: np.ndarray) -> ShardIndex:
        order = suffix_order(symbols)
        before = symbols[order - 1]  # position 0 follows the last, which is a separator
        levels = max(1, int(n_symbols).bit_length())
        starts = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1))])
        sampled = np.arange(len(symbols)) % SAMPLE == 0
        sampled[run_start] = True
        marks = sampled[order]
        return cls(len(symbols), starts, WaveletTree.of(before, levels), Bits.of(marks), order[marks].astype(np.int64))

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that begin with each phrase (symbols, aligned right in a matrix)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in reversed(range(phrases.shape[1])):
            alive = alive[(lengths[alive] >= phrases.shape[1] - column) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = phrases[alive, column]
            low[alive] = self.starts[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.starts[symbol] + self.tree.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to the nearest sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(self.marked.get(rows) == 0)
        while len(walking):
            symbol, rank = self.tree.value_and_rank(rows[walking])
            rows[walking] = self.starts[symbol] + rank
            steps[walking] += 1
            walking = walking[self.marked.get(rows[walking]) == 0]
        return self.samples[self.marked.rank(rows)] + steps


@dataclass
class Phrases:
    """A block of test items: their sorted distinct word hashes, and all windows as numbers of those."""

    vocabulary: np.ndarray
    windows: np.ndarray  # aligned right, 0 in front
    lengths: np.ndarray
    item: np.ndarray
    names: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, np.ndarray]], size: int = WINDOW) -> Phrases:
        vocabulary = np.unique(np.concatenate([h for _, h in items] or [np.zeros(0, np.uint64)]))
        names = sorted({name for name, _ in items})
        number = {name: k for k, name in enumerate(names)}
        rows, lengths, owner = [], [], []
        for name, hashes in items:
            symbols = np.searchsorted(vocabulary, hashes) + 1
            width = min(size, len(symbols))
            if not width:
                continue
            found = np.lib.stride_tricks.sliding_window_view(symbols, width)
            rows.append(np.pad(found, ((0, 0), (size - width, 0))))
            lengths.append(np.full(len(found), width))
            owner.append(np.full(len(found), number[name]))
        if not rows:
            empty = np.zeros(0, np.int64)
            return cls(vocabulary, np.zeros((0, size), np.int64), empty, empty, names)
        return cls(vocabulary, np.concatenate(rows), np.concatenate(lengths), np.concatenate(owner), names)


def word_hashes(table: DataFrame, id_column: str) -> DataFrame:
    """(id string, words array of hashes) of a table of short texts."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text"):
                text = text_of(rows.column("text")).lowered()
                words = find_words(text, ALNUM)
                hashes = hash_words(text, words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.ListArray.from_arrays(pa.array(words.first, pa.int32()), pa.array(hashes))],
                    ["id", "words"],
                )

    named = F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id")
    return table.select(named, "text").mapInArrow(read, "id string, words array<long>")


def phrase_blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Phrases]:
    """The test items, block by block; each block fits one task's memory.

    Items are dealt to blocks by a hash of their id. The number of blocks follows from
    the words of all items, so a block holds about ``block_words`` words at most.
    """
    items = stage(word_hashes(benchmark, "item_id"))
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    n_blocks = -(-total // block_words)
    for block in range(n_blocks):
        mine = items.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block)
        found = [(r["id"], np.array(r["words"], np.int64).view(np.uint64)) for r in mine.toLocalIterator()]
        yield Phrases.of(found)


class _Shard:
    """Collects documents until the shard is large enough."""

    def __init__(self, name: str, most_words: int):
        self.most_words = most_words
        self.name, self.docs, self.keys, self.counts = name, [], [], []
        self.symbols, self.run_start, self.run_doc, self.run_word = [], [], [], []
        self.size, self.n_docs = 0, 0

    def add(self, rows: pa.RecordBatch, vocabulary: np.ndarray, shortest: int) -> None:
        text = text_of(rows.column("text")).lowered()
        words = find_words(text, ALNUM)
        hashes = hash_words(text, words)
        place = np.searchsorted(vocabulary, hashes)
        place[place == len(vocabulary)] = 0
        known = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        # Runs of known words inside a document.
        opens, closes = known.copy(), known.copy()
        borders = words.first[1:-1][(words.first[1:-1] > 0) & (words.first[1:-1] < len(known))]
        opens[1:] &= ~known[:-1]
        opens[borders] = known[borders]
        closes[:-1] &= ~known[1:]
        closes[borders - 1] = known[borders - 1]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = end - start >= shortest
        start, end = start[long], end[long]
        sizes = end - start + 1  # each run is followed by a separator
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(start - offsets[:-1], sizes) + np.arange(offsets[-1])
        symbols = place[np.minimum(source, len(place) - 1)] + 1 if len(source) else np.zeros(0, np.int64)
        symbols[offsets[1:] - 1] = 0
        doc = np.searchsorted(words.first, start, side="right") - 1
        self.symbols.append(symbols)
        self.run_start.append(offsets[:-1] + self.size)
        self.run_doc.append(doc + self.n_docs)
        self.run_word.append(start - words.first[doc])
        self.docs += rows.column("doc_id").to_pylist()
        self.keys.append(rows.column("text_key").to_numpy())
        self.counts.append(words.per_row)
        self.size += int(offsets[-1])
        self.n_docs += rows.num_rows

    @property
    def full(self) -> bool:
        return self.size >= self.most_words or self.n_docs >= SHARD_DOCS

    def close(self) -> pa.RecordBatch:
        symbols = np.concatenate([*self.symbols, np.zeros(0, np.int64)]).astype(np.int64)
        run_start = np.concatenate([*self.run_start, np.zeros(0, np.int64)])
        # Only words that occur here need a number, which keeps the tree low.
        used = np.unique(symbols)
        used = used[used > 0]
        symbols = np.where(symbols > 0, np.searchsorted(used, symbols) + 1, 0)
        index = ShardIndex.of(symbols, len(used), run_start)
        row = {
            "shard": self.name,
            "doc_id": self.docs,
            "text_key": np.concatenate(self.keys).tolist(),
            "n_words": np.concatenate(self.counts).tolist(),
            "n": index.n,
            "levels": len(index.tree.levels),
            "bits": b"".join(b.words.tobytes() for b in index.tree.levels),
            "ranks": b"".join(b.before.tobytes() for b in index.tree.levels),
            "zeros": index.tree.zeros,
            "starts": index.starts.astype(np.int64).tobytes(),
            "vocabulary": used.astype(np.int64).tobytes(),
            "marked": index.marked.words.tobytes(),
            "marked_ranks": index.marked.before.tobytes(),
            "samples": index.samples.tobytes(),
            "run_start": run_start.astype(np.int64).tobytes(),
            "run_doc": np.concatenate([*self.run_doc, np.zeros(0, np.int64)]).astype(np.int64).tobytes(),
            "run_word": np.concatenate([*self.run_word, np.zeros(0, np.int64)]).astype(np.int64).tobytes(),
        }
        types = {"doc_id": pa.list_(pa.int64()), "text_key": pa.list_(pa.int64()), "n_words": pa.list_(pa.int64()), "zeros": pa.list_(pa.int64()), "n": pa.int64(), "levels": pa.int32(), "shard": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([v], types.get(k, pa.binary())) for k, v in row.items()], list(row))


def build_index(docs: DataFrame, phrases: Phrases, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per shard: the index of its documents (doc_id, text) for words of ``phrases``."""
    shared = docs.sparkSession.sparkContext.broadcast((phrases.vocabulary, int(phrases.lengths.min(initial=WINDOW))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, shortest = shared.value
        part, count = TaskContext.get().partitionId(), 0
        shard = _Shard(f"{part}-{count}", shard_words)
        for batch in batches:
            for rows in slices(batch, "text"):
                shard.add(rows, vocabulary, shortest)
                if shard.full:
                    yield shard.close()
                    count += 1
                    shard = _Shard(f"{part}-{count}", shard_words)
        if shard.n_docs:
            yield shard.close()

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(build, INDEX)


def search_shard(index: ShardIndex, used: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(window number, text position) of every occurrence of every window in a shard."""
    local = np.zeros(len(phrases.vocabulary) + 1, np.int64)
    local[used] = np.arange(1, len(used) + 1)
    windows = local[phrases.windows]
    # Windows with a word that the shard lacks cannot occur.
    possible = np.flatnonzero((windows > 0).sum(axis=1) == phrases.lengths)
    low, high = index.search(windows[possible], phrases.lengths[possible])
    counts = high - low
    rows = np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return np.repeat(possible, counts), index.locate(rows)


def merge_spans(doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping or touching spans of each document, in order."""
    order = np.lexsort((begin, doc))
    doc, begin, end = doc[order], begin[order], end[order]
    if not len(doc):
        return doc, begin, end
    shift = int(end.max()) + 2  # documents one after the other on one line
    reach = np.maximum.accumulate(doc * shift + end)
    new = np.concatenate([[True], doc[1:] * shift + begin[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return doc[new], begin[new], reach[last] - doc[new] * shift


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Per document of each shard: merged removal spans (in words) and the items that occur."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _search_row(batch.slice(at, 1).to_pylist()[0], shared.value)

    return index.mapInArrow(find, HITS)


def _search_row(row: dict, phrases: Phrases) -> pa.RecordBatch:
    def longs(name: str) -> np.ndarray:
        return np.frombuffer(row[name], np.int64)

    per_level = row["n"] // 64 + 1
    bits = np.frombuffer(row["bits"], np.uint64).reshape(-1, per_level)
    ranks = np.frombuffer(row["ranks"], np.int32).reshape(-1, per_level)
    tree = WaveletTree([Bits(b, r) for b, r in zip(bits, ranks)], row["zeros"])
    marked = Bits(np.frombuffer(row["marked"], np.uint64), np.frombuffer(row["marked_ranks"], np.int32))
    index = ShardIndex(row["n"], longs("starts"), tree, marked, longs("samples"))
    window, position = search_shard(index, longs("vocabulary"), phrases)
    run = np.searchsorted(longs("run_start"), position, side="right") - 1
    doc = longs("run_doc")[run]
    begin = longs("run_word")[run] + position - longs("run_start")[run]
    spans = merge_spans(doc, begin, begin + phrases.lengths[window])
    pairs = np.unique(np.stack([doc, phrases.item[window]], axis=1), axis=0)
    n = len(row["doc_id"])
    every = np.arange(n + 1)
    span_values = pa.StructArray.from_arrays([pa.array(spans[1]), pa.array(spans[2])], ["begin", "end"])
    names = pa.array([phrases.names[k] for k in pairs[:, 1].tolist()], pa.string())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([row["shard"]] * n, pa.string()),
            pa.array(np.arange(n, dtype=np.int32)),
            pa.array(row["doc_id"], pa.int64()),
            pa.array(row["text_key"], pa.int64()),
            pa.array(row["n_words"], pa.int64()),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(spans[0], every).astype(np.int32)), span_values),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], every).astype(np.int32)), names),
        ],
        ["shard", "row", "doc_id", "text_key", "n_words", "spans", "items"],
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS
) -> DataFrame:
    """Per document row: doc_id, text_key (xxhash64 of the text), n_words, spans, items, n_hit.

    The index of each block of items is written to the shared folder first. Spans of several blocks
    are merged per document; with one block there is nothing to merge and no shuffle.
    """
    found, blocks = None, 0
    for phrases in phrase_blocks(benchmark, block_words):
        hits = search(stage(build_index(docs, phrases, shard_words)), phrases)
        found = hits if found is None else found.unionByName(hits)
        blocks += 1
    if found is None:
        found = search(stage(build_index(docs, Phrases.of([]), shard_words)), Phrases.of([]))
    found = _join_blocks(found, blocks) if blocks > 1 else found.drop("shard", "row")
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return found.withColumn("n_hit", length)


def _join_blocks(hits: DataFrame, blocks: int) -> DataFrame:
    """Spans and items of the same document row, found in several blocks of items.

    Shards close elsewhere in each block, so a row has another place in each. Rows of one id and text have the same hits in
    a block, and come out of every block once each: they are merged by id and text, and given back as often as they are.
    """
    spans = F.array_sort(F.flatten(F.collect_set("spans")))
    none = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")

    def put(done, span):
        last = F.element_at(done, -1)
        joined = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], span["end"]).alias("end"))
        fits = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= span["begin"])
        return F.when(fits, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    whole = hits.groupBy("doc_id", "text_key", "n_words").agg(
        spans.alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("n")
    )
    merged = whole.withColumn("spans", F.aggregate("spans", none, put))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.expr(f"n div {blocks}")))
    return merged.withColumn("n", each).drop("n")


def report(found: DataFrame) -> DataFrame:
    """The result per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    names = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they are.

    Contaminated rows are few and are found again by id and a hash of the text; both may be null.
    """
    found = contamination(docs, benchmark).where(is_contaminated())
    bad_id, key = free_name(docs, "bad_id"), free_name(docs, "text_key")
    bad = stage(found.select(F.col("doc_id").alias(bad_id), F.col("text_key").alias(key)).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.xxhash64("text") == F.col(key))
    return docs.join(bad, same, "left_anti")
