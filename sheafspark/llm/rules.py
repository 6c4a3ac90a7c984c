"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger holds the measurements and one
bit per failed rule. A policy is a version name and a mask of rules; applying
it, comparing versions and asking what one rule costs are bitwise operations and
sums over the ledger, without another look at the texts.

Null and empty texts have no words and fail ``few_words``. Repeated rows get equal
rows; an empty table an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafspark.llm.buffers import SPACED, Words, find_words, hash_words, mix, row_sums, slices, text_of, window_hash

WINDOW = 8
# Texts measured at a time: words, hashes and windows take many times their bytes.
RUN_BYTES = 512 * 1024

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letter_words", "n_unspaced",
)

#: name -> failing condition over the measurements; the position is the bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "2 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "few_letters": "100 * n_letter_words < 60 * n_words",
    "spaced_word_length": "word_chars < 2 * n_words OR word_chars - n_unspaced > 20 * n_words",
}

# Blocks of scripts that write no spaces between words (Thai, Lao, Burmese, Khmer, kana, Han).
UNSPACED = (
    r"[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
    r"\x{20000}-\x{2FA1F}]"
)

#: version -> rules that count.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "word_length", "few_letters"),
    # Letters of scripts without spaces do not make a word too long.
    "v2": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "few_letters", "spaced_word_length"),
}
CURRENT = "v2"

_LINE = np.ones(256, bool)
_LINE[0x0A] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _counted(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags between consecutive offsets."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _seen_before(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Group number and size of equal hashes of one row, per hash: (sizes, whether an earlier one exists)."""
    codes, distinct = pd.factorize(mix(hashes ^ mix(row.astype(np.uint64) + np.uint64(1))))
    sizes = np.bincount(codes, minlength=len(distinct))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return sizes[codes], np.arange(len(codes)) > first[codes]


def measure_rows(column: pa.Array) -> dict[str, np.ndarray]:
    """All measurements of each text."""
    text = text_of(column)
    words = find_words(text, SPACED)
    n_words = words.per_row

    whole = find_words(text, _LINE)
    filled = np.searchsorted(words.start, whole.end) > np.searchsorted(words.start, whole.start)
    kept = np.concatenate([[0], np.cumsum(filled)])
    lines = Words(whole.start[filled], whole.end[filled], kept[whole.first])
    _, earlier = _seen_before(hash_words(text, lines), lines.row)

    row = words.row
    windows = window_hash(hash_words(text, words), WINDOW)
    inside = row[: len(windows)] == row[len(row) - len(windows) :] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    sizes, _ = _seen_before(windows[at], row[at])
    repeated = at[sizes > 1]
    steps = np.zeros(len(row) + 1, np.int64)
    np.add.at(steps, repeated, 1)
    np.add.at(steps, repeated + WINDOW, -1)
    covered = np.cumsum(steps[:-1]) > 0

    letters = np.concatenate([[0], np.cumsum(_LETTER[text.data], dtype=np.int64)])
    return {
        "n_words": n_words,
        "word_chars": _counted(SPACED[text.data] & ((text.data & 0xC0) != 0x80), text.offsets),
        "n_symbols": _counted(_SYMBOL[text.data], text.offsets),
        "n_dup_lines": row_sums(earlier, lines.first),
        "n_repeat_words": row_sums(covered, words.first),
        "n_lines": lines.per_row,
        "n_letter_words": row_sums(letters[words.end] > letters[words.start], words.first),
        "n_unspaced": pc.fill_null(pc.count_substring_regex(column, pattern=UNSPACED), 0).to_numpy(zero_copy_only=False),
    }


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failed): one row per document, one pass over the text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "text", RUN_BYTES):
                found = measure_rows(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), *[pa.array(found[m].astype(np.int64)) for m in MEASURES]],
                    ["doc_id", *MEASURES],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ", ".join([f"doc_id {kind}", *[f"{m} long" for m in MEASURES]])
    measured = docs.select("doc_id", "text").mapInArrow(measure, columns)
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def policy_mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(rule) for rule in rules)


def fails(policy: str) -> Column:
    """Whether a row of the ledger fails a policy."""
    return F.col("failed").bitwiseAND(F.lit(policy_mask(POLICIES[policy])).cast("long")) != 0


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: rows failing it, failing it alone (kept again without it), and kept under the policy.

    One aggregation over the ledger, combined before its shuffle.
    """
    mask = policy_mask(POLICIES[policy])
    of_policy = F.col("failed").bitwiseAND(F.lit(mask).cast("long"))
    names = list(RULES)
    sums = [F.sum((of_policy == 0).cast("long")).alias("kept")]
    for rule in POLICIES[policy]:
        bit = F.lit(1 << names.index(rule)).cast("long")
        sums.append(F.sum((of_policy.bitwiseAND(bit) != 0).cast("long")).alias(f"fail_{rule}"))
        sums.append(F.sum((of_policy == bit).cast("long")).alias(f"only_{rule}"))
    totals = rows.agg(*sums)
    each = [
        F.struct(F.lit(r).alias("rule"), F.col(f"fail_{r}").alias("n_failed"), F.col(f"only_{r}").alias("n_only"))
        for r in POLICIES[policy]
    ]
    zero = F.lit(0).cast("long")
    return totals.select(F.lit(policy).alias("policy"), "kept", F.inline(F.array(*each))).select(
        "policy", "rule", *[F.coalesce(c, zero).alias(c) for c in ("n_failed", "n_only", "kept")]
    )


def all_ablations(rows: DataFrame) -> DataFrame:
    """``ablations`` of every version."""
    found = None
    for policy in POLICIES:
        of_policy = ablations(rows, policy)
        found = of_policy if found is None else found.unionByName(of_policy)
    return found


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger with base_failed and kept under a policy."""
    return rows.withColumn("base_failed", fails("base")).withColumn("kept", ~fails("base") & ~fails(policy))
