"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader.

Features are n-grams of words and of word shapes (case, digits, trailing and inner
symbols, length, same as the word before), hashed to ``SLOTS`` weights and divided by the number of words. A bounded sample
of labelled rows is dealt to a fixed number of learners; each runs FTRL-proximal over its rows in
a fixed order, and their weights are averaged, for ``ROUNDS`` rounds. Scoring is one sparse dot
product per document, as sums of gathered weights.

Null and empty texts have no features: their score is that of the intercept. Without labelled rows of
both kinds every score is the share of good rows, or 0.5. Repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.buffers import SPACED, Text, Words, find_words, hash_words, mix, slices, text_of
from sheafspark.llm.langid import _sums, is_held_out

#: Labelled rows that are learnt from, at most about.
SAMPLE_ROWS = 16_000
LEARNERS, ROUNDS, EPOCHS = 8, 2, 2
SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
THRESHOLD = 0.7

# FTRL-proximal: learning rate, its smoothing, and the two regularisers.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-3

_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_LOWER = np.zeros(256, np.int64)
_LOWER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_SALTS = np.arange(1, 6, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shapes(text: Text, words: Words, hashes: np.ndarray) -> np.ndarray:
    """A number per word for how it looks, whatever its letters."""

    def count(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[text.data])])
        return sums[words.end] - sums[words.start]

    size = words.end - words.start
    upper, lower, digit = count(_UPPER), count(_LOWER), count(_DIGIT)
    other = size - upper - lower - digit
    last = text.data[words.end - 1].astype(np.int64)
    last = np.where(_UPPER[last] + _LOWER[last] + _DIGIT[last] > 0, 0, last)
    case = np.where(upper == 0, 0, np.where(lower == 0, 2, 1)) + 3 * (lower + upper == 0)
    again = np.zeros(len(size), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])
    parts = (case, np.minimum(digit, 2), np.minimum(other, 4), last, np.minimum(size, 24) // 6, again)
    shape = np.zeros(len(size), np.int64)
    for part in parts:
        shape = shape * 256 + part
    return shape.astype(np.uint64)


def features(text: Text) -> tuple[Words, list[np.ndarray]]:
    """Words, and per family of n-grams a slot for each word (n-grams end at the word)."""
    words = find_words(text, SPACED)
    hashes = hash_words(text.lowered(), words)
    shape = mix(shapes(text, words, hashes))
    first = np.zeros(len(hashes), bool)
    first[words.first[:-1][words.per_row > 0]] = True

    def before(values: np.ndarray) -> np.ndarray:
        moved = np.zeros_like(values)
        moved[1:] = values[:-1]
        moved[first] = 0
        return moved

    base = np.uint64(0x9E3779B97F4A7C15)
    previous = before(shape)
    grams = (hashes, hashes * base + before(hashes), shape, shape * base + previous, (shape * base + previous) * base + before(previous))
    shift = np.uint64(64 - SLOT_BITS)
    slots = [(mix(g + salt) >> shift).astype(np.int64) for g, salt in zip(grams, _SALTS)]
    return words, slots


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], start: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last is the intercept) after FTRL-proximal over (slots, values, label) in order."""
    n = np.zeros(SLOTS + 1)
    z = -start * (BETA / ALPHA + L2) - np.sign(start) * L1
    for _ in range(epochs):
        for slot, value, label in rows:
            zi, ni = z[slot], n[slot]
            rate = (BETA + np.sqrt(ni)) / ALPHA + L2
            w = np.where(np.abs(zi) > L1, (np.sign(zi) * L1 - zi) / rate, 0.0)
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - label) * value
            z[slot] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[slot] = ni + g * g
    rate = (BETA + np.sqrt(n)) / ALPHA + L2
    return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / rate, 0.0)


def _examples(frame: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Sparse rows of a learner's documents, in the order of their hash."""
    frame = frame.sort_values(["key", "text"], kind="stable")
    found = []
    for at in range(0, len(frame), 500):
        part = frame.iloc[at : at + 500]
        words, slots = features(text_of(pa.array(part["text"], pa.string())))
        for k, label in enumerate(part["label"].tolist()):
            a, b = int(words.first[k]), int(words.first[k + 1])
            slot, n = np.unique(np.concatenate([s[a:b] for s in slots]), return_counts=True)
            slot = np.append(slot, SLOTS)
            found.append((slot, np.append(n / max(1, b - a), 1.0), float(label)))
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, text, label, learner) of labelled documents that are not held out.

    Labels are thinned by a hash of the id before the join, so the side that is
    broadcast has about ``sample_rows`` rows at most, whatever the table holds.
    """
    usable = labels.where((F.crc32(F.col("doc_id").cast("string")) % 4 != 2) & F.col("quality").isin(0, 1))
    rate = min(1.0, sample_rows / max(1, usable.count()))
    key = F.xxhash64("doc_id")
    share = key.bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(2.0**63)
    chosen = usable.where(share < rate) if rate < 1 else usable
    chosen = chosen.select(F.col("doc_id").alias("_id"), F.col("quality").alias("label"))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    return texts.select(
        key.alias("key"), F.coalesce("text", F.lit("")).alias("text"), "label", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(LEARNERS)).alias("learner")
    )


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of all slots and the intercept. A fixed number of values, so it fits the driver and every task."""
    sample = labelled_sample(docs, labels, sample_rows)
    spark = docs.sparkSession
    weights = np.zeros(SLOTS + 1)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(weights)

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            found = train(_examples(frame), shared.value)
            slot = np.flatnonzero(found)
            return pd.DataFrame({"slot": slot, "w": found[slot]})

        models = sample.groupBy("learner").applyInPandas(fit, "slot long, w double")
        # Every learner's rows come from a fixed order, so the sums differ only in rounding; that is cut off.
        mean = models.groupBy("slot").agg(F.round(F.sum("w") / LEARNERS, 9).alias("w")).toPandas()
        weights = np.zeros(SLOTS + 1)
        weights[mean["slot"].to_numpy(np.int64)] = mean["w"]
        shared.unpersist()
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, score) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for rows in slices(batch, "text"):
                words, slots = features(text_of(rows.column("text")))
                total = sum(known[s] for s in slots)
                dot = _sums(total, words.first) / np.maximum(1, words.per_row) + known[SLOTS]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(dot, -35, 35))))], ["doc_id", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(apply, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels, sample_rows))
    return scored.select(
        "doc_id",
        is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
