"""Token counting as Arrow UDFs with one encoder per vocabulary and Python worker."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.functions.batches import slices

# One pattern in two spellings. No pre-token of it holds white space behind anything else.
CUTTABLE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s",
)
# The inside of a line: from the first to the last white space that follows a visible ASCII character.
_INSIDE = r"(?<=[!-~]) [^\r\n]*[!-~](?=[ \r\n])"


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file. ``kind`` is 'tiktoken', 'huggingface' or 'sentencepiece'.

    ``path`` must be readable on the executors: the same path everywhere, or
    the name of a file shipped with ``SparkContext.addFile``. ``newline`` says
    where the pre-tokenizer puts a newline that follows punctuation: with the
    white space after it ('next'), or with the punctuation ('previous'), as
    patterns do whose punctuation branch ends in ``[\r\n]*``. Documents are
    cut on that side for counting, so the counts of the pieces add up.
    """

    name: str
    kind: str
    path: str
    pattern: str = ""
    special_tokens: tuple[tuple[str, int], ...] = field(default=())
    newline: str = "next"

    def __post_init__(self) -> None:
        if self.newline not in ("next", "previous"):
            raise ValueError("newline must be 'next' or 'previous'")

    @property
    def cuttable(self) -> bool:
        """Whether a text may be cut wherever white space follows something else, so that the counts of the pieces add up."""
        spaced = any(re.search(r"\s", token) for token, _ in self.special_tokens)
        return self.kind == "tiktoken" and self.pattern in CUTTABLE and not spaced

    def local_path(self) -> str:
        if os.path.exists(self.path):
            return self.path
        shipped = SparkFiles.get(os.path.basename(self.path))
        if os.path.exists(shipped):
            return shipped
        raise FileNotFoundError(f"vocabulary {self.name}: no file {self.path}")


@lru_cache(maxsize=None)
def _counter(vocabulary: Vocabulary, special: str) -> Callable[[list[str]], list[int]]:
    """Function from texts to token counts; loaded once per worker."""
    path = vocabulary.local_path()
    if vocabulary.kind == "tiktoken":
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines if line.strip())}
        encoding = tiktoken.Encoding(
            vocabulary.name,
            pat_str=vocabulary.pattern,
            mergeable_ranks=ranks,
            special_tokens=dict(vocabulary.special_tokens),
        )
        if special == "all":
            allowed = encoding.special_tokens_set
            return lambda texts: [
                len(encoding.encode_to_numpy(t, allowed_special=allowed, disallowed_special=())) for t in texts
            ]
        return lambda texts: [len(encoding.encode_to_numpy(t, disallowed_special=())) for t in texts]
    if vocabulary.kind == "huggingface":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = special != "all"
        # Results without offsets, of one text at a time: those of a whole batch would be held together.
        return lambda texts: [len(e) for t in texts for e in tokenizer.encode_batch_fast([t], add_special_tokens=False)]
    if vocabulary.kind == "sentencepiece":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(processor.encode(t)) for t in texts]
    raise ValueError(f"unknown vocabulary kind {vocabulary.kind!r}")


def token_counter(vocabulary: Vocabulary, special: str = "all"):
    """Arrow UDF text -> number of tokens; null stays null.

    ``special='all'`` takes the strings of special tokens in a text as these
    tokens, ``'none'`` as ordinary text.
    """
    if special not in ("all", "none"):
        raise ValueError("special must be 'all' or 'none'")

    @F.arrow_udf(T.LongType())
    def n_tokens(texts: pa.Array) -> pa.Array:
        count = _counter(vocabulary, special)
        found = []
        for part in slices(texts):  # results take many times the bytes of the texts
            values = part.to_pylist()
            counts = iter(count([v for v in values if v is not None]))
            found += [None if v is None else next(counts) for v in values]
        return pa.array(found, pa.int64())

    return n_tokens


def line_ends(text: Column) -> Column:
    """The text without the insides of its lines, cut where a ``cuttable`` vocabulary allows it.

    What is put before or behind lines changes its count as much as that of the whole text. A text that holds ``]]>``, which CDATA
    changes inside of lines, stays whole.
    """
    return F.when(F.contains(text, F.lit("]]>")), text).otherwise(F.regexp_replace(text, F.lit(_INSIDE), F.lit("")))
