"""Language identification: unigram piece models, marginalised over segmentations.

The pieces are those of a fixed public vocabulary file, byte pieces included, so every
word can be segmented. A language is a probability per piece, learnt by
expectation-maximisation over the words of a bounded sample of labelled documents. The score of a word is the
sum over all its segmentations, by the forward algorithm; many words go through it side by side. A document's score
is the sum over all its words.

Words are runs of a-z and non-ASCII characters of the lower-cased text, with the vocabulary's word mark in
front. A long run (a sentence of a script without spaces) is cut where no piece of the vocabulary reaches over the cut, which
leaves its sum a product of the parts' sums; what cannot be cut is summed with a window as wide as the longest piece, so there is no limit
to its length. Texts that are null or have no
letter are ``und`` with score 0, and so is everything if there is nothing to learn from.
The model has a row per piece seen in the sample and a column per language, however many there are.
Equal scores go to the language that sorts first. Repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.buffers import LETTERS, SLICE_BYTES, Text, Words, _Powers, find_words, hash_words, prefix_sums, slices, text_of
from sheafspark.llm.storage import free_name, schema_with, stage

#: Documents learnt from, per language.
SAMPLE_DOCS = 2_000
ROUNDS = 3
#: Bytes from which a run is looked through for cuts, and from which a part is summed alone. Neither changes a sum.
LONG, ALONE = 45, 512
#: Bytes of a word after which the forward sums get a new unit.
STRETCH = 16
_BLOCK = 8_192
#: Sums held at once while words go through the forward algorithm.
_SUMS = 1 << 21
#: Languages that are scored together, and up to which their rates are sent to all tasks.
_COLUMNS, BROADCAST_LANGUAGES = 256, 100_000
#: Words whose evidence counts in full in the score between 0 and 1.
EVIDENCE = 32
UNKNOWN = "und"
_MARK = "▁".encode()


class Pieces:
    """The pieces of a vocabulary file as byte strings, found by hash."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = {}
        for i in range(model.get_piece_size()):
            if model.is_byte(i):
                piece = bytes([int(model.id_to_piece(i)[3:5], 16)])
            elif model.is_control(i) or model.is_unknown(i):
                continue
            else:
                piece = model.id_to_piece(i).encode()
            # A word has its mark in front and nowhere else.
            if _MARK not in piece[1:]:
                found.setdefault(piece, len(found))
        self.count = len(found)
        flat = np.frombuffer(b"".join(found), np.uint8)
        ends = np.cumsum([len(p) for p in found])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = self.raw_hash(prefix_sums(flat), starts, ends)
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.longest = max(map(len, found))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.keys >> np.uint64(44)] = True

    @staticmethod
    def raw_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * _Powers.down[start]

    def lattice(self, flat: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(end, length, words, pieces) of all pieces in all words, by ascending end; sizes must descend."""
        sums = prefix_sums(flat)
        edges = []
        for end in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            active = int(np.searchsorted(-sizes, -end, side="right"))
            to = start[:active] + end
            for length in range(1, min(end, self.longest) + 1):
                word, piece = self.known(self.raw_hash(sums, to - length, to))
                if len(word):
                    edges.append((end, length, word, piece))
        return edges

    def known(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are pieces, those pieces)."""
        near = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        place = np.searchsorted(self.keys, hashes[near])
        place[place == len(self.keys)] = 0
        hit = self.keys[place] == hashes[near]
        return near[hit], self.order[place[hit]]

    def occurrences(self, flat: np.ndarray, last: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, pieces) of the pieces of ``least`` bytes or more in runs of bytes; ``last`` is the end of each byte's run."""
        sums, place = prefix_sums(flat), np.arange(len(flat))
        for length in range(least, self.longest + 1):
            fits = place[place + length <= last]
            which, piece = self.known(self.raw_hash(sums, fits, fits + length))
            yield length, fits[which], piece

    def cuts(self, flat: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether no piece reaches over the place before each byte."""
        over = np.zeros(len(flat) + 1, np.int64)
        for length, start, _ in self.occurrences(flat, np.repeat(begin + sizes, sizes), 2):
            np.add.at(over, start + 1, 1)
            np.add.at(over, start + length, -1)
        return np.cumsum(over)[:-1] == 0


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(edges, sizes: np.ndarray, probability: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the segmentations of each prefix, (words, bytes + 1, languages), and the unit of each stretch.

    The unit of a stretch of ``STRETCH`` prefixes is the last sum of the stretch before, in that one's own unit. So no sum
    underflows, however rare the pieces are. Stretches that a word does not reach have unit 1.
    """
    alpha = np.zeros((len(sizes), int(sizes[0]) + 1, probability.shape[1]))
    alpha[:, 0] = 1
    unit = np.ones((len(sizes), int(sizes[0]) // STRETCH + 1, probability.shape[1]))
    reached = 0
    for end, length, word, piece in edges:
        while reached < end // STRETCH:
            reached += 1
            there = int(np.searchsorted(-sizes, -reached * STRETCH, side="right"))
            unit[:there, reached] = alpha[:there, reached * STRETCH - 1]
        alpha[word, end] += _in_unit(alpha[word, end - length], unit, word, end - length, end) * probability[piece]
    return alpha, unit


def _in_unit(values: np.ndarray, unit: np.ndarray, word: np.ndarray, start: int, end: int) -> np.ndarray:
    """Values in the unit of the stretch of ``start``, in that of the stretch of ``end``."""
    for stretch in range(start // STRETCH + 1, end // STRETCH + 1):
        values = values / unit[word, stretch]
    return values


def expected_counts(edges, sizes: np.ndarray, weight: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``weight`` copies of each word, over all segmentations (one language)."""
    alpha, unit = (x[:, :, 0] for x in forward(edges, sizes, probability[:, None]))
    # Sums over the segmentations of what follows, as shares of the word's sum and against the same units.
    beta = np.zeros_like(alpha)
    every = np.arange(len(sizes))
    beta[every, sizes] = 1 / alpha[every, sizes]
    counts = np.zeros(len(probability))
    for end, length, word, piece in reversed(edges):
        onward = _in_unit(probability[piece] * beta[word, end], unit, word, end - length, end)
        counts += np.bincount(piece, weight[word] * alpha[word, end - length] * onward, len(counts))
        beta[word, end - length] += onward
    return counts


@dataclass
class Parts:
    """Words of some rows as parts that are scored one by one; ``bare`` parts go on a word and have no mark in front."""

    text: Text
    words: Words
    bare: np.ndarray
    n_words: np.ndarray


def words_of(column: pa.Array, model: Pieces) -> Parts:
    """The words of the lower-cased text; long ones cut where that changes nothing."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = text_of(pc.utf8_lower(column))
    words = find_words(text, LETTERS)
    long = np.flatnonzero(words.end - words.start > LONG)
    if not len(long):
        return Parts(text, words, np.zeros(len(words.start), bool), words.per_row)
    flat, begin, sizes = marked(text, words.start[long], words.end[long])
    cut = model.cuts(flat, begin, sizes)
    # The mark stays with the first byte of its word.
    for k in range(len(_MARK) + 1):
        cut[begin + k] = False
    place = np.flatnonzero(cut)
    of = np.searchsorted(begin, place, side="right") - 1
    more = words.start[long[of]] + place - begin[of] - len(_MARK)
    parts = np.ones(len(words.start), np.int64)
    np.add.at(parts, long[of], 1)
    first = np.concatenate([[0], np.cumsum(parts)])
    start = np.concatenate([words.start, more])
    bare = np.concatenate([np.zeros(len(words.start), bool), np.ones(len(more), bool)])
    order = np.argsort(start, kind="stable")
    start, bare = start[order], bare[order]
    end = np.append(start[1:], 0)
    end[first[1:] - 1] = words.end
    return Parts(text, Words(start, end, first[words.first]), bare, words.per_row)


def distinct_words(parts: Parts) -> tuple[np.ndarray, np.ndarray]:
    """(number of the distinct part of each part, first place of each distinct part)."""
    keys = hash_words(parts.text, parts.words) ^ np.where(parts.bare, np.uint64(0x9E3779B97F4A7C15), np.uint64(0))
    codes, values = pd.factorize(keys)
    first = np.zeros(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


def marked(text: Text, start: np.ndarray, end: np.ndarray, bare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of words with the word mark in front, but for bare ones."""
    lead = np.full(len(start), len(_MARK)) if bare is None else np.where(bare, 0, len(_MARK))
    body = end - start
    sizes = body + lead
    to = np.cumsum(sizes)
    begin = to - sizes
    flat = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    for k, byte in enumerate(_MARK):
        flat[begin[lead > 0] + k] = byte
    at = np.cumsum(body) - body
    every = np.arange(body.sum())
    flat[np.repeat(begin + lead - at, body) + every] = text.data[np.repeat(start - at, body) + every]
    return flat, begin, sizes


def blocks(sizes: np.ndarray, columns: int) -> Iterator[np.ndarray]:
    """Words of similar size together, in blocks of bounded memory; sizes descend."""
    order = np.argsort(-sizes, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(_BLOCK, _SUMS // ((int(sizes[order[at]]) + 1) * columns)))
        yield order[at : at + n]
        at += n


def score_alone(flat: np.ndarray, model: Pieces, probability: np.ndarray) -> np.ndarray:
    """Log-probability of one run of bytes: the forward sums of the last few places only, rescaled as they go."""
    found = [(start + length, np.full(len(start), length), piece) for length, start, piece in model.occurrences(flat, np.full(len(flat), len(flat)), 1)]
    ends, lengths, pieces_ = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(ends, kind="stable")
    lengths, pieces_ = lengths[order], pieces_[order]
    first = np.searchsorted(ends[order], np.arange(1, len(flat) + 2))
    width = model.longest + 1
    ring = np.zeros((width, probability.shape[1]))
    ring[0] = 1
    scale = np.zeros(probability.shape[1])
    for end in range(1, len(flat) + 1):
        a, b = first[end - 1], first[end]
        row = (ring[(end - lengths[a:b]) % width] * probability[pieces_[a:b]]).sum(axis=0)
        ring[end % width] = row
        if end % STRETCH == 0:
            ring /= row
            scale += np.log(row)
    return np.log(ring[len(flat) % width]) + scale


def score_words(text: Text, start: np.ndarray, end: np.ndarray, model: Pieces, probability: np.ndarray, bare: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of each word in each language."""
    bare = np.zeros(len(start), bool) if bare is None else bare
    scores = np.zeros((len(start), probability.shape[1]))
    sizes = end - start + np.where(bare, 0, len(_MARK))
    for k in np.flatnonzero(sizes > ALONE).tolist():
        flat, _, _ = marked(text, start[k : k + 1], end[k : k + 1], bare[k : k + 1])
        scores[k] = score_alone(flat, model, probability)
    short = np.flatnonzero(sizes <= ALONE)
    for block in blocks(sizes[short], probability.shape[1]):
        part = short[block]
        flat, begin, size = marked(text, start[part], end[part], bare[part])
        alpha, unit = forward(model.lattice(flat, begin, size), size, probability)
        scores[part] = np.log(alpha[np.arange(len(part)), size]) + np.log(unit).sum(axis=1)
    return scores


def is_held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from: crc32 of the id as text has remainder 2 by 4; not for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def sample_words(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(lang, word, n) of a sample of the documents of each language that are not held out; words have their marks.

    The sample is taken by a 64-bit hash of the id, at a rate that gives each language
    about ``sample_docs`` documents; smaller languages are taken whole. Rates are a table of languages, joined to the documents.
    """
    learnt = docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).where("lang IS NOT NULL AND text IS NOT NULL")
    learnt = learnt.select("doc_id", "lang", "text")
    counts = stage(learnt.groupBy("lang").agg(F.count("*").alias("n")))
    # Languages are few; only a dirty column has so many values that texts have to move to them.
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    share = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(2.0**63)
    chosen = learnt.join(counts, "lang").where((F.col("n") <= sample_docs) | (share < sample_docs / F.col("n"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(vocabulary)
        for batch in batches:
            for rows in slices(batch, "text"):
                parts = words_of(rows.column("text"), model)
                codes, first = distinct_words(parts)
                langs = rows.column("lang").dictionary_encode()
                lang = np.repeat(langs.indices.to_numpy(), parts.words.per_row).astype(np.int64)
                pair, n = np.unique(codes * len(langs.dictionary) + lang, return_counts=True)
                which = first[pair // len(langs.dictionary)]
                flat, begin, sizes = marked(parts.text, parts.words.start[which], parts.words.end[which], parts.bare[which])
                raw = flat.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.dictionary.take(pa.array(pair % len(langs.dictionary))).cast(pa.string()),
                        pa.array([raw[a : a + n] for a, n in zip(begin.tolist(), sizes.tolist())], pa.binary()),
                        pa.array(n),
                    ],
                    ["lang", "word", "n"],
                )

    words = chosen.mapInArrow(count, "lang string, word binary, n long")
    return words.groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages, and piece probabilities: a row per piece that was seen, and a last one for all others."""

    languages: list[str]
    row: np.ndarray
    table: np.ndarray

    @classmethod
    def even(cls, languages: list[str], pieces_: int) -> Model:
        return cls(languages, np.zeros(pieces_, np.int64), np.full((1, len(languages)), 1 / pieces_))

    @classmethod
    def of_counts(cls, languages: list[str], pieces_: int, piece: np.ndarray, lang: np.ndarray, n: np.ndarray) -> Model:
        """Shares of counts; a little of every piece is added, so that no word is impossible."""
        seen, place = np.unique(piece, return_inverse=True)
        row = np.full(pieces_, len(seen), np.int64)
        row[seen] = np.arange(len(seen))
        table = np.full((len(seen) + 1, len(languages)), 0.05)
        table[place, lang] += n
        total = table[:-1].sum(axis=0) + 0.05 * (pieces_ - len(seen))
        return cls(languages, row, table / total)

    def __getitem__(self, piece: np.ndarray) -> np.ndarray:
        return self.table[self.row[piece]]

    @property
    def shape(self) -> tuple[int, int]:
        return len(self.row), len(self.languages)

    def column(self, lang: int) -> np.ndarray:
        return self.table[self.row, lang]

    def columns(self, begin: int, end: int) -> Model:
        return Model(self.languages[begin:end], self.row, self.table[:, begin:end])


def learn(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """The model of all languages.

    Each round computes expected counts in tasks over the sample's words; only sums per language
    and piece come to the driver, which is the size of the model.
    """
    counted = stage(sample_words(docs, vocabulary, sample_docs))
    languages = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    count = pieces(vocabulary).count
    model = Model.even(languages, count)
    number = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        shared = counted.sparkSession.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tool, known = pieces(vocabulary), shared.value
            for batch in batches:
                text = text_of(batch.column("word").cast(pa.large_binary()))
                bare = np.ones(batch.num_rows, bool)
                lang = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
                weight = batch.column("n").to_numpy().astype(float)
                found = []
                for k in np.unique(lang).tolist():
                    mine = np.flatnonzero(lang == k)
                    sizes, column, sums = np.diff(text.offsets)[mine], known.column(k), np.zeros(tool.count)
                    for block in blocks(sizes, 1):
                        part = mine[block]
                        flat, begin, size = marked(text, text.offsets[part], text.offsets[part + 1], bare[part])
                        sums += expected_counts(tool.lattice(flat, begin, size), size, weight[part], column)
                    piece = np.flatnonzero(sums)
                    found.append((np.full(len(piece), k), piece, sums[piece]))
                if found:
                    langs, piece, n = (np.concatenate(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(langs.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(n)], ["lang", "piece", "n"])

        sums = counted.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
        model = Model.of_counts(languages, count, sums["piece"].to_numpy(np.int64), sums["lang"].to_numpy(np.int64), sums["n"].to_numpy(float))
        shared.unpersist()
    return model


def predict(df: DataFrame, model: Model, vocabulary: str, names: tuple[str, str]) -> DataFrame:
    """All columns of ``df`` (which has ``text``) with the predicted language and its score."""
    languages = model.languages
    shared = df.sparkSession.sparkContext.broadcast(model)
    letter = free_name(df, "has_letter")
    asked = df.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, known = pieces(vocabulary), shared.value
        # With many languages fewer rows and words are scored together.
        width = min(len(languages), _COLUMNS)
        step, limit = max(1, _SUMS // len(languages)), max(1 << 16, min(1, 32 / width) * SLICE_BYTES)
        for batch in batches:
            for rows in (r.slice(at, step) for r in slices(batch, "text", int(limit)) for at in range(0, r.num_rows, step)):
                parts = words_of(rows.column("text"), tool)
                words = parts.words
                codes, first = distinct_words(parts)
                each = np.empty((rows.num_rows, len(languages)))
                for at in range(0, len(languages), width):
                    some = known.columns(at, at + width)
                    scores = score_words(parts.text, words.start[first], words.end[first], tool, some, parts.bare[first])
                    for k in range(scores.shape[1]):
                        each[:, at + k] = _sums(scores[codes, k], words.first)
                best = each.argmax(axis=1)
                evidence = np.minimum(1, EVIDENCE / np.maximum(1, parts.n_words))
                odds = np.exp((each - each.max(axis=1, keepdims=True)) * evidence[:, None])
                sure = 1 / odds.sum(axis=1)
                told = rows.column(letter).to_numpy(zero_copy_only=False).astype(bool)
                lang = [languages[k] if t else UNKNOWN for k, t in zip(best.tolist(), told.tolist())]
                kept = [c for n, c in zip(rows.schema.names, rows.columns) if n != letter]
                kept_names = [n for n in rows.schema.names if n != letter]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(lang, pa.string()), pa.array(np.where(told, sure, 0.0))], [*kept_names, *names]
                )

    if not languages:
        return df.withColumns({names[0]: F.lit(UNKNOWN), names[1]: F.lit(0.0)})
    return asked.mapInArrow(classify, schema_with(df, (names[0], "string"), (names[1], "double")))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each row's values, from its own values alone."""
    sums = np.zeros(len(first) - 1)
    filled = np.flatnonzero(first[1:] > first[:-1])
    if len(filled):
        sums[filled] = np.add.reduceat(values, first[filled])
    return sums


def languages_of(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = learn(docs, vocabulary)
    rows = docs.select("doc_id", "text")
    found = predict(rows, model, vocabulary, ("lang_pred", "score"))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocabulary: str, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of at least ``least``, as they are."""
    model = learn(docs, vocabulary)
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = predict(docs, model, vocabulary, names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).drop(*names)
