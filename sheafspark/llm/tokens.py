"""Exact token ids of whole texts, with each distinct word encoded once per worker.

The ids are those of the tokenizers library for the whole text. A tokenizer
that drops white space and never joins two words gives the same ids for a text
as for its words one after the other, so a batch is cut into words, made
distinct by Arrow, and only words that the worker has not met are encoded.
A tokenizer of another kind encodes whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from sheafspark.llm.buffers import SPACED, Text, find_words, lowered

#: A worker's memory of words is emptied when it holds this many.
MEMORY_WORDS = 500_000
#: Words per call of the library.
_CALL = 256

# Fixed value: the splitting pattern of a tokenizer whose words are independent.
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
# Contractions begin with an apostrophe, special tokens hold bars.
_PUNCTUATION[[0x27, 0x7C]] = False

# The public byte alphabet: printable bytes stand for themselves, the others for U+0100 and up, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_ALPHABET = {b: 0x100 + k for k, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}


class Encoder:
    """A tokenizer file and this worker's memory of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = _independent_words(config)
        self.memory: dict[bytes, bytes] = {}

    def encode(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, offset of each row's ids and the end)."""
        if not self.by_word:
            raw, spans = text.data.tobytes(), text.offsets.tolist()
            texts = [raw[a:b].decode() for a, b in zip(spans, spans[1:])]
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            offsets = np.cumsum([0, *map(len, found)])
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(offsets[-1])), offsets
        start, end, first = _cut(text)
        words = _distinct(text, start, end)
        known = self._look_up(_items(words.dictionary))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        table = np.frombuffer(b"".join(known), np.uint32)
        begins = np.cumsum(sizes) - sizes
        which = words.indices.to_numpy()
        counts = sizes[which]
        total = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat(begins[which] - total[:-1], counts) + np.arange(total[-1])
        return table[source], total[first]

    def _look_up(self, words: list[bytes]) -> list[bytes]:
        if len(self.memory) > MEMORY_WORDS:
            self.memory.clear()
        memory, tokenize, rest = self.memory, self.tokenizer.model.tokenize, []
        for word in [w for w in words if w not in memory]:
            symbols = _symbols(word)
            if symbols is None:
                rest.append(word)
            else:
                memory[word] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
        for at in range(0, len(rest), _CALL):
            part = rest[at : at + _CALL]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, encoding in zip(part, found):
                memory[word] = array("I", encoding.ids).tobytes()
        return [memory[w] for w in words]


def _symbols(word: bytes) -> str | None:
    """What the tokenizer's normaliser and byte alphabet make of a word of Latin letters; None for others.

    Such a word is one piece for the splitter, so its model can take it at once.
    """
    if word.isalpha():  # ASCII letters, lower case already: they stand for themselves
        return word.decode()
    text = word.decode()
    if not (text.isalpha() and max(text) < "\u0250"):
        return None
    text = unicodedata.normalize("NFC", text).lower()
    return text.encode().decode("latin-1").translate(_BYTE_ALPHABET) if text.isalpha() else None


def _independent_words(config: dict) -> bool:
    splitter = config.get("pre_tokenizer") or {}
    parts = splitter.get("pretokenizers", [])
    kinds = [n.get("type") for n in (config.get("normalizer") or {}).get("normalizers", [])]
    return (
        kinds == ["NFC", "Replace", "Lowercase"]
        and [p.get("type") for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": _WORD_PATTERN}
        and parts[0]["invert"]
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and config["model"]["type"] == "BPE"
        and all(not any(c.isspace() for c in t["content"]) for t in config["added_tokens"])
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and "|" in t["content"] for t in config["added_tokens"])
    )


def _cut(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of words, also cut between an ASCII letter and ASCII punctuation; first of each row."""
    words = find_words(text, SPACED)
    letter, punctuation = _LETTER[text.data], _PUNCTUATION[text.data]
    begins, ends = np.zeros(len(text.data) + 1, bool), np.zeros(len(text.data) + 1, bool)
    begins[1:-1] = (letter[1:] & punctuation[:-1]) | (punctuation[1:] & letter[:-1])
    begins[text.offsets] = False  # two rows that meet are no turn
    ends |= begins
    begins[words.start] = True
    ends[words.end] = True
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends), np.searchsorted(start, text.offsets)


def _distinct(text: Text, start: np.ndarray, end: np.ndarray) -> pa.DictionaryArray:
    """The words as a dictionary array; words of plain ASCII are lower-cased, which the tokenizer does too."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    plain = np.ones(len(sizes), bool)
    plain[np.searchsorted(start, np.flatnonzero((text.data >= 0x80) | (text.data == 0x7C)), side="right") - 1] = False
    data = text.data[SPACED[text.data]]
    data = np.where(np.repeat(plain, sizes), lowered(data), data)
    words = pa.Array.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]
    )
    return words.dictionary_encode()


def _items(words: pa.LargeBinaryArray) -> list[bytes]:
    """The values of an array without nulls (much faster than asking for each)."""
    _, offsets, data = words.buffers()
    spans = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1].tolist()
    raw = data.to_pybytes() if data is not None else b""
    return [raw[a:b] for a, b in zip(spans, spans[1:])]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path)
