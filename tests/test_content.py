import hashlib

import pytest

from catalogue.content import SENTENCES
from sheafspark.functions.charset import detect_iso2022jp, detect_legacy
from sheafspark.operators.classify import classify
from pyspark.sql import Observation

from sheafspark.operators.decode import conversion_report, decode_files, decode_metrics, observe_decoding

# Sentences whose encoded forms the detector must tell apart.
JAPANESE = "これは文字コード検出のための日本語の文章です。複数の文を含めて、短い入力による誤判定を避けます。古い文書も正しく読み取ります。\n"
SIMPLIFIED = "这是用于字符编码检测的中文文本。它包含多个自然句子，以避免短输入造成误判。旧文件也应该被正确读取。\n"
GB18030 = "这是用于字符编码检测的中文文本。它包含多个自然句子，以避免短输入造成误判。扩展字符𠀀用于验证四字节编码。\n"
TRADITIONAL = "這是用於字元編碼偵測的中文文字。它包含多個自然句子，以避免短輸入造成誤判。舊檔案也應該被正確讀取。\n"
RUSSIAN = "Это русский текст для проверки определения кодировки. Он содержит несколько естественных предложений. Старые файлы должны читаться правильно.\n"
WESTERN = "Voici un texte français pour vérifier la détection d’encodage. Il contient plusieurs phrases naturelles. Les fichiers anciens doivent être lus correctement.\n"
UTF16 = "UTF-16 text with 日本語, русский текст, and العربية. This fixture contains multiple natural sentences. It verifies byte-order-mark handling.\n"

# Fixed values: (text, codec, label, SHA-256 of the encoded bytes).
FIXTURES = [
    (JAPANESE, "shift_jis", "Shift_JIS", "3f5ea89b27d50f0978035ed513a81f359ba814ad39776fb402b762313d942dbf"),
    (JAPANESE, "euc_jp", "EUC-JP", "91a37bc153ef380393e5c2cb8f52e793e593c5cd1e0d9b7de1cd20c151023d0f"),
    (JAPANESE, "iso2022_jp", "ISO-2022-JP", "5e3a4177b42d3c7f2aaa7a5b48456d2bb0a16ca18acb7df2c902c45382b6888f"),
    (SIMPLIFIED, "gbk", "GBK", "7fd8f1bcec1064109b0511f69e94d0655a8894f8da29c60f45c03940936bc33e"),
    (GB18030, "gb18030", "GBK", "9e595b6e63720df4393911617670f8c3136f82757fee328b7f550dc12ad95cd4"),
    (TRADITIONAL, "big5", "Big5", "193d7f0e99d3a5964ebf217e629efef1c707d2c83be8317d7ec4f81271b91602"),
    (RUSSIAN, "cp1251", "windows-1251", "bc18e2357afd2a20f107a1c5ac44e3dbc17c9d9a7710369b3e92a7d6bfb5bb95"),
    (WESTERN, "cp1252", "windows-1252", "e4a57b8dc2af3b7865147af1ce6d9d0375d63ca9fa16200e52225b3eb116beb7"),
    ("﻿" + UTF16, "utf-16-le", "UTF-16LE", "89092b865c9a2447b8ea301b974459256ad938874750e44bcecea1ae6296576f"),
    ("﻿" + UTF16, "utf-16-be", "UTF-16BE", "f6dbc0c548d420a3fa7ebdedfbe73c4275693e895ac5161c52d5126439dd79fd"),
]

PNG = b"\x89PNG\r\n\x1a\n"
BOM = b"\xef\xbb\xbf"


def run(make_files, contents, utf8):
    files = make_files({str(i): c for i, c in enumerate(contents)})
    rows = decode_files(classify(files, utf8), utf8).collect()
    return [r for r in sorted(rows, key=lambda r: int(r.path))]


def test_encoding_fixtures(make_files):
    encoded = [text.encode(codec) for text, codec, _, _ in FIXTURES]
    assert [hashlib.sha256(b).hexdigest() for b in encoded] == [f[3] for f in FIXTURES]
    for row, (text, _, label, _) in zip(run(make_files, encoded, True), FIXTURES):
        assert row.text == text.removeprefix("﻿"), label
        assert (row.source_encoding, row.had_replacements, row.decode_class) == (label, False, "transcoded")


def test_conversion_off_keeps_bytes_or_calls_utf16_binary(make_files):
    jis = JAPANESE.encode("iso2022_jp")
    rows = run(make_files, [jis, b"\xff\xfeH\0i\0", b"\x80\x81\x82\x83", BOM + b"malformed \xff text"], False)
    assert (rows[0].text, rows[0].source_encoding) == (jis.decode("ascii"), None)
    assert (rows[1].binary_reason, rows[1].binary_detail) == ("Utf16ConversionDisabled", "UTF-16LE")
    assert rows[2].text == "�" * 4 and rows[2].decode_class == "lossy"
    assert rows[3].text == "﻿malformed � text" and not rows[3].utf8_had_replacements


def test_truncated_two_byte_text_falls_back(make_files):
    cut = [t.encode(c)[:-2] for t, c, _, _ in FIXTURES if c in ("shift_jis", "euc_jp", "gbk", "gb18030", "big5")]
    for row in run(make_files, cut, True):
        assert row.source_encoding == "windows-1252" and not row.had_replacements and "�" not in row.text
    jis = JAPANESE.encode("iso2022_jp")[:-2]
    assert detect_iso2022jp(jis) is None
    (row,) = run(make_files, [jis], True)
    assert (row.text, row.source_encoding, row.decode_class) == (jis.decode("ascii"), None, "valid")


def test_utf16_losses(make_files):
    cut = ("﻿" + UTF16).encode("utf-16-le")[:-1]
    lone = b"\xff\xfe" + b"\x00\xd8" + "A".encode("utf-16-le")
    literal = b"\xfe\xff" + "a�".encode("utf-16-be")
    rows = run(make_files, [cut, lone, literal, b"\xff\xfe", b"\xff\xfeH\0i\0"], True)
    assert rows[0].text.endswith("�") and rows[0].had_replacements
    assert rows[1].text == "�A" and rows[1].had_replacements
    assert rows[2].text == "a�" and not rows[2].had_replacements
    assert rows[3].text == "" and rows[4].text == "Hi"


CASES = [
    (b"a\0b", "NullByte"), (PNG + b"rest", "RecognizedMagic"), (b"\x01\x02\x03ab", "ControlDensity"),
    (b"\x01\x02\x03\x93A", "ControlDensity"), (BOM + b"text\0text", "NullByte"), (BOM + b"\x01\x02\x03ab", "ControlDensity"),
    (BOM + PNG, "RecognizedMagic"), (b"%PDF-1.7\n", "RecognizedMagic"), (b"PK\x03\x04archive", "RecognizedMagic"),
    (b"MZ\x90\0executable", "NullByte"), (PNG + b"\0", "NullByte"), (PNG + b"x" * 9000 + b"\0", "RecognizedMagic"),
    (b"x" * 9000 + b"\0", "NullByte"), (b"\x81 \x8d \x8f ", "ImplausibleDecodedData"),
    (b"\xff\xfe\x01\0\x02\0\x03\0a\0", "ImplausibleDecodedData"), (b"\xff\xfea\0\0\0", "ImplausibleDecodedData"),
    (b"\x01\x02\x03" + b"a" * 7, None), (b"", None), (b"\x7fplain", None), (b"\xff" * 4 + b"\x1b[31m", None),
    (b" " * 257 + b"ustar", "RecognizedMagic"), (b"1234ftypisom", "RecognizedMagic"), (b"RIFF1234WEBP", "RecognizedMagic"),
    (b"RIFF1234text", None), (b"<html></html>", None), (b"#!/bin/sh\n", None),
]


@pytest.mark.parametrize("utf8", [True])
def test_cascade(make_files, utf8):
    rows = run(make_files, [c for c, _ in CASES], utf8)
    assert [r.binary_reason for r in rows] == [reason for _, reason in CASES]


def test_magic_types(make_files):
    rows = run(make_files, [PNG, b"GIF89a", b"{\\rtf1", b"\x1f\x8b\x08", b"BM", b"ID3"], False)
    assert [r.binary_detail for r in rows] == [
        "image/png", "image/gif", "application/rtf", "application/gzip", "image/bmp", "audio/mpeg",
    ]


def test_jis_candidates(make_files):
    yes = [b"text \x1b$B", b"text \x1b$@", b"text \x1b$B!!"]
    no = [
        b"\x1b(Bplain ASCII", b"\x1b(Iplain ASCII", b"\x1b(Jplain ASCII", b"\x1b[31mred\x1b[0m text", b"text \x1bX text",
        b"truncated \x1b$(", BOM + b"text \x1b$B",
    ]
    rows = run(make_files, yes + no, False)
    assert [r.iso2022jp_candidate for r in rows] == [True] * len(yes) + [False] * len(no)
    for row, content in zip(run(make_files, no, True), no):
        assert row.text == content.decode() and row.source_encoding is None


def test_short_and_marked_input(make_files):
    rows = run(make_files, [b"", BOM, b"\x93Hi\x94", b"a \x91quick\x92 note \x97 nothing else", BOM + b"malformed \xff text"], True)
    assert [r.text for r in rows] == ["", "﻿", "“Hi”", "a ‘quick’ note — nothing else", "﻿malformed � text"]
    assert [r.source_encoding for r in rows] == [None, None, "windows-1252", "windows-1252", None]
    assert rows[4].utf8_had_replacements and rows[4].decode_class == "lossy"


@pytest.mark.parametrize("text", ["plain letters", "雨の日の記録", "雨天的记录", "Записи о дожде", "سجل المطر"])
def test_valid_utf8_is_untouched(make_files, text):
    (row,) = run(make_files, [text.encode()], True)
    assert (row.text, row.source_encoding, row.decode_class) == (text, None, "valid")


def test_lossy_decoding_replaces_maximal_subparts(make_files):
    broken = [b"a\xe3\x81b", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xc0\xaf", b"ok\xff", b"\xe3\x81\xff\x80"]
    for row, content in zip(run(make_files, broken, False), broken):
        assert row.text == content.decode("utf-8", "replace")


def test_single_byte_labels():
    assert detect_legacy("Привет, мир и люди".encode("cp1251"))[0] == "windows-1251"
    assert detect_legacy("naïve café".encode("cp1252")) == ("windows-1252", "naïve café")


@pytest.mark.parametrize("label, codec, sentence", SENTENCES, ids=[s[0] for s in SENTENCES])
def test_every_legacy_charset(label, codec, sentence):
    if codec == "iso2022_jp":
        assert detect_iso2022jp(sentence.encode(codec)) == sentence
    else:
        assert detect_legacy(sentence.encode(codec)) == (label, sentence)


@pytest.mark.parametrize(
    "text, codec, label",
    [
        ("Starý deník uchovává zápisky o počasí, každý řádek je důležitý a věrný.", "cp1250", "windows-1250"),
        ("A régi napló őrzi az időjárás följegyzéseit, minden sor számít, tűz és víz.", "cp1250", "windows-1250"),
        ("Così è più là, però già lunedì, università, virtù", "cp1252", "windows-1252"),
        ("As opções são três: não há razões; avó, pôr, coração", "cp1252", "windows-1252"),
        ("Å være på øya, blåbær og rødgrød", "cp1252", "windows-1252"),
        ("Käse über Straße, 5 m³", "cp1252", "windows-1252"),
    ],
)
def test_accented_letters(text, codec, label):
    assert detect_legacy(text.encode(codec)) == (label, text)


def test_metrics_and_report(make_files):
    valid, utf16, lossy = "é".encode(), b"\xff\xfeH\0i\0", BOM + b"\xff"
    files = make_files({"v": valid, "u": utf16, "l": lossy, "i": b"\x81 \x8d \x8f ", "b": PNG})
    decoded = decode_files(classify(files, True), True)
    row = decode_metrics(decoded).first()
    assert (row.valid_files, row.valid_bytes, row.transcoded_files, row.transcoded_bytes) == (1, 2, 1, 6)
    assert [(r.path, r.source_encoding) for r in conversion_report(decoded).collect()] == [("u", "UTF-16LE")]
    seen = Observation()
    assert observe_decoding(decoded, seen).count() == 5
    assert seen.get == {"valid_files": 1, "valid_bytes": 2, "transcoded_files": 1, "transcoded_bytes": 6}


def test_high_bytes_that_are_no_shift_jis():
    """Python's cp932 has characters for A0 and FD to FF; the charset has none."""
    text = "ASÍÍCO"
    for byte in (b"\xa0", b"\xfd", b"\xfe", b"\xff"):
        assert detect_legacy(text.encode() + byte)[0] == "windows-1252"


def test_jis_that_does_not_return_to_single_bytes(make_files):
    """An escape before a word of even length: two-byte codes by chance, but the line does not end as JIS does."""
    broken = [b"\x1b$BAndththwhes.", b"\x1b$@A.", b"\x1b$BA.\nThis is text.", b"\x1b(B\x1b$BA.\n\x1b(B"]
    assert [detect_iso2022jp(content) for content in broken] == [None] * 4
    for row, content in zip(run(make_files, broken, True), broken):
        assert (row.text, row.source_encoding, row.decode_class) == (content.decode(), None, "valid")
    sound = "日本\n".encode("iso2022_jp")
    assert detect_iso2022jp(sound) == "日本\n"
    assert detect_iso2022jp("日本".encode("iso2022_jp")) == "日本"
