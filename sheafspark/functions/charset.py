"""Charset detection and transcoding, as an Arrow UDF fed only the rows that need it.

Spark's ``decode`` knows few charsets and stops at malformed input, so UTF-16
and legacy content is decoded by the codecs of the Python worker. Rows that
need no transcoding carry null into the UDF and cost nothing there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

from sheafspark.functions.batches import slices
from sheafspark.schemas import TRANSCODED

# Two-byte charsets as (label, codec, token pattern). Group 1 of a token is a
# character of the everyday rows of the charset, group 2 a rare one.
_MULTIBYTE = (
    (
        "Shift_JIS",
        "cp932",
        rb"[\x00-\x7f]+|((?:\x81[\x40-\xac]|\x82[\x4f-\xf1]|\x83[\x40-\x96]|[\x88-\x97][\x40-\xfc]))"
        rb"|([\xa1-\xdf]|[\x81-\x9f\xe0-\xfc].)",
    ),
    (
        "EUC-JP",
        "euc_jp",
        rb"[\x00-\x7f]+|([\xa1\xa4\xa5][\xa1-\xfe])|(\x8f..|[\x8e\xa1-\xfe].)",
    ),
    (
        "GBK",
        "gb18030",
        rb"[\x00-\x7f]+|([\xa1\xa3\xb0-\xd7][\xa1-\xfe]|[\x81-\xfe][\x30-\x39]..)|([\x81-\xfe].)",
    ),
    (
        "Big5",
        "big5hkscs",
        rb"[\x00-\x7f]+|([\xa1-\xa3\xa4-\xc6][\x40-\x7e\xa1-\xfe])|([\x81-\xfe].)",
    ),
)
_TOKENS = {label: re.compile(pattern, re.DOTALL) for label, _, pattern in _MULTIBYTE}

# Share of everyday characters a two-byte charset must reach. Japanese is told
# by its kana, so a smaller share (the rest being kanji) is proof enough.
_NEEDED = {"Shift_JIS": 0.6, "EUC-JP": 0.3, "GBK": 0.6, "Big5": 0.6}

# Single-byte charsets of other scripts as (label, codec, script, everyday letters). The
# everyday letters make up some three quarters of running text in their script, and
# far less of text that was written in another charset.
_SCRIPTS = (
    ("windows-1251", "cp1251", "CYRILLIC", "оеаинтсрвлкм"),
    ("KOI8-U", "koi8_u", "CYRILLIC", "оеаинтсрвлкм"),
    ("windows-1253", "cp1253", "GREEK", "αοιετνσςηυρπκάίό"),
    ("windows-1255", "cp1255", "HEBREW", "יוהלאתרמבשנ"),
    ("windows-1256", "cp1256", "ARABIC", "ايلمونرتبهةدع"),
    ("windows-874", "cp874", "THAI", "านรกอเง่ยลวมดทตีั้สะไแคป็"),
)
# Share of everyday letters among the high bytes, and of high bytes in runs. The Thai
# letters fill most of the codes, so more is asked of them.
_EVERYDAY, _EVERYDAY_THAI, _IN_RUNS = 0.5, 0.7, 0.7
_LETTERS = 0.9
# Less than this in runs: accented letters between plain ones, not two-byte codes.
_TWO_BYTE_RUNS = 0.3
# More than this in runs: not the accented letters of a language in Latin letters.
_ACCENT_RUNS = 0.5
# Two-byte text can hide behind Thai and Korean codes when it is short.
_LEAST_THAI, _LEAST_KOREAN = 16, 8

_ASCII = bytes(range(0x80))
_HIGH_RUN = re.compile(rb"[\x80-\xff]{2,}")
# Characters of Korean text: Hangul, other two-byte codes, and bytes that do not pair.
_KOREAN = re.compile(rb"([\xb0-\xc8][\xa1-\xfe])|([\x81-\xfe][\x41-\xfe])|([\x80-\xff])")

# Central European letters that are symbols in Western text, inside a word.
_INSIDE_WORD = re.compile(rb"[A-Za-z][\xa3\xa5\xaf\xb3\xb9\xbc\xbe\xbf][A-Za-z\x80-\xff]")


def _single_byte_table(codec: str) -> dict[int, str]:
    """The codec's characters; bytes it leaves open map to the same code point."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            table[byte] = bytes([byte]).decode(codec)
        except UnicodeDecodeError:
            table[byte] = chr(byte)
    return table


_TABLES = {label: _single_byte_table(codec) for label, codec, _, _ in _SCRIPTS}
_TABLES |= {"windows-1250": _single_byte_table("cp1250"), "windows-1252": _single_byte_table("cp1252")}


def _bytes_where(label: str, test: Callable[[str], bool]) -> bytes:
    return bytes(byte for byte, char in _TABLES[label].items() if test(char))


# Per label: the bytes of its everyday letters and of its whole script.
_SCRIPT_BYTES = {
    label: (
        _bytes_where(label, lambda c: c in everyday),
        _bytes_where(label, lambda c: unicodedata.name(c, "").startswith(script)),
    )
    for label, _, script, everyday in _SCRIPTS
}


# What Python's cp932 makes of the bytes A0 and FD to FF, which are no Shift_JIS.
_NOT_SHIFT_JIS = re.compile("[\uf8f0-\uf8f3]")


def _strict(content: bytes, codec: str) -> str | None:
    try:
        text = content.decode(codec)
    except UnicodeDecodeError:
        return None
    return None if codec == "cp932" and _NOT_SHIFT_JIS.search(text) else text


def _everyday_share(label: str, content: bytes) -> float:
    everyday = rare = 0
    for token in _TOKENS[label].finditer(content):
        everyday += token.group(1) is not None
        rare += token.group(2) is not None
    return everyday / max(everyday + rare, 1)


def _other_script(high: bytes, in_runs: int) -> str | None:
    """Label of the script whose everyday letters fit the high bytes best, if any does."""
    if len(high) < 4 or in_runs < _IN_RUNS * len(high):
        return None
    found, best = None, _EVERYDAY
    for label, (everyday, letters) in _SCRIPT_BYTES.items():
        share = 1 - len(high.translate(None, everyday)) / len(high)
        inside = 1 - len(high.translate(None, letters)) / len(high)
        needed = max(best, _EVERYDAY_THAI) if label == "windows-874" else best
        if share > needed and inside >= _LETTERS:
            found, best = label, share
    return found


def _looks_korean(content: bytes) -> bool:
    """Nearly all Hangul: Chinese text takes two fifths of its characters from other rows."""
    hangul = others = 0
    for token in _KOREAN.finditer(content):
        if token.group(3) is not None:
            return False
        hangul += token.group(1) is not None
        others += token.group(2) is not None and token.group(2)[0] not in (0xA1, 0xA2, 0xA3)
    return hangul >= _LEAST_KOREAN and hangul >= 0.95 * (hangul + others)


def _looks_central_european(content: bytes, high: bytes) -> bool:
    """Polish by letters that are symbols elsewhere; Czech, South Slavic and Hungarian by letters that meet nowhere else."""
    seen = set(high)
    czech = {0xF8, 0xEC} <= seen
    slavic = {0x9E, 0x9A, 0xE8} <= seen
    hungarian = 0xF5 in seen and 0xE1 in seen and seen & {0xF6, 0xFC} and not seen & {0xE3, 0xE4}
    return bool(czech or slavic or hungarian) or _INSIDE_WORD.search(content) is not None


def _single_byte_text(content: bytes, label: str) -> str:
    return content.decode("latin-1").translate(_TABLES[label])


def detect_legacy(content: bytes) -> tuple[str, str]:
    """(label, text) for content that is not valid UTF-8; some label always fits."""
    high = content.translate(None, _ASCII)
    in_runs = sum(len(run) for run in _HIGH_RUN.findall(content))
    script = _other_script(high, in_runs)
    if script == "windows-874":
        text = _strict(content, "cp874") if len(high) >= _LEAST_THAI else None
        if text is not None:
            return script, text
        script = None
    if _looks_korean(content):
        text = _strict(content, "cp949")
        if text is not None:
            return "EUC-KR", text
    best = None
    for label, codec, _ in _MULTIBYTE if in_runs >= _TWO_BYTE_RUNS * len(high) else ():
        share = _everyday_share(label, content)
        if share < _NEEDED[label] or (best and share <= best[0]):
            continue
        text = _strict(content, codec)
        if text is not None:
            best = (share, label, text)
            if label == "EUC-JP":
                break
    if best:
        return best[1], best[2]
    accented = in_runs <= _ACCENT_RUNS * len(high)
    label = script or ("windows-1250" if accented and _looks_central_european(content, high) else "windows-1252")
    return label, _single_byte_text(content, label)


# A two-byte state that a line or the content ends in; the codecs of Python let it pass.
_OPEN_JIS = re.compile(rb"\x1b\$[^\x1b\n]*(?:\n|\Z)")


def detect_iso2022jp(content: bytes) -> str | None:
    """Text of well-formed seven-bit JIS content, or None.

    Well-formed as RFC 1468 has it: every line, and so the content, ends in a single-byte state.
    """
    if max(content, default=0) > 0x7F or _OPEN_JIS.search(content):
        return None
    text = _strict(content, "iso2022_jp")
    return text if text is not None else _strict(content, "iso2022_jp_ext")


def transcode_one(content: bytes, mode: str) -> tuple[str, str, bool] | None:
    """(text, encoding, had_replacements), or None to take the content as UTF-8.

    ``mode`` is a byte-order mark's encoding, or 'jis', 'legacy', 'jis+legacy'.
    """
    if mode.startswith("UTF-16"):
        codec = mode.lower().replace("16", "16-")
        strict = _strict(content[2:], codec)
        if strict is not None:
            return strict, mode, False
        return content[2:].decode(codec, "replace"), mode, True
    if mode.startswith("jis"):
        text = detect_iso2022jp(content)
        if text is not None:
            return text, "ISO-2022-JP", False
    if mode.endswith("legacy"):
        label, text = detect_legacy(content)
        return text, label, False
    return None


@F.arrow_udf(TRANSCODED)
def transcode(content: pa.Array, mode: pa.Array) -> pa.Array:
    fields = pa.struct([("text", pa.string()), ("encoding", pa.string()), ("had_replacements", pa.bool_())])
    parts, start = [], 0
    for part in slices(content):
        modes = mode.slice(start, len(part)).to_pylist()
        start += len(part)
        rows = [None if m is None or c is None else transcode_one(c, m) for c, m in zip(part.to_pylist(), modes)]
        named = [None if r is None else dict(zip(("text", "encoding", "had_replacements"), r)) for r in rows]
        parts.append(pa.array(named, fields))
    return pa.concat_arrays(parts) if parts else pa.array([], fields)
