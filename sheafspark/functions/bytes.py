"""Byte classification as column expressions over binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How much of a file the early binary test looks at, and the
# share of control bytes above which a file is binary.
PROBE_BYTES = 8192
CONTROL_DENSITY = 0.30

# Byte-order marks.
BOMS = (("UTF-8", "EFBBBF"), ("UTF-16LE", "FFFE"), ("UTF-16BE", "FEFF"))

# Four-letter brands of MP4 files.
MP4_BRANDS = (
    b"avc1", b"dash", b"iso2", b"iso3", b"iso4", b"iso5", b"iso6", b"isom", b"mmp4", b"mp41", b"mp42", b"mp4v", b"mp71",
    b"MSNV", b"NDAS", b"NDSC", b"NDSH", b"NDSM", b"NDSP", b"NDSS", b"NDXC", b"NDXH", b"NDXM", b"NDXP", b"NDXS", b"F4V ", b"F4P ",
)

# Media types of zip files by the first letters of the name of any member.
ZIP_MEMBERS = (
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "word/"),
    ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "xl/"),
    ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "ppt/"),
    ("application/java-archive", "META-INF/"),
)

# Binary signatures as (media type, ((offset, hex), ...)), tried in order.
SIGNATURES = (
    ("application/wasm", ((0, "0061736D"),)),
    ("application/x-executable", ((0, "7F454C46"),)),
    ("application/vnd.microsoft.portable-executable", ((0, "4D5A"),)),
    ("application/java", ((0, "CAFEBABE"),)),
    ("application/x-llvm", ((0, "4243"),)),
    ("application/x-mach-binary", ((0, "FEEDFACE"),)),
    ("application/x-mach-binary", ((0, "FEEDFACF"),)),
    ("application/x-mach-binary", ((0, "CEFAEDFE"),)),
    ("application/x-mach-binary", ((0, "CFFAEDFE"),)),
    ("application/vnd.android.dex", ((0, "6465780A"),)),
    ("application/vnd.android.dey", ((0, "6465790A"),)),
    ("application/epub+zip", ((0, "504B0304"), (30, "6D696D65747970656170706C69636174696F6E2F657075622B7A6970"))),
    ("application/x-mobipocket-ebook", ((60, "424F4F4B4D4F4249"),)),
    ("image/jpeg", ((0, "FFD8FF"),)),
    ("image/jp2", ((0, "0000000C6A5020200D0A870A"),)),
    ("image/png", ((0, "89504E47"),)),
    ("image/gif", ((0, "474946"),)),
    ("image/webp", ((0, "52494646"), (8, "57454250"))),
    ("image/tiff", ((0, "49492A00"),)),
    ("image/tiff", ((0, "4D4D002A"),)),
    ("image/bmp", ((0, "424D"),)),
    ("image/vnd.ms-photo", ((0, "4949BC"),)),
    ("image/vnd.adobe.photoshop", ((0, "38425053"),)),
    ("image/vnd.microsoft.icon", ((0, "00000100"),)),
    ("image/heif", ((4, "6674797068656963"),)),
    ("image/avif", ((4, "6674797061766966"),)),
    ("video/x-m4v", ((4, "667479704D345620"),)),
    ("audio/m4a", ((4, "667479704D344120"),)),
    ("video/quicktime", ((4, "6674797071742020"),)),
    *(("video/mp4", ((4, (b"ftyp" + brand).hex().upper()),)) for brand in MP4_BRANDS),
    ("video/x-matroska", ((0, "1A45DFA3"),)),
    ("video/x-msvideo", ((0, "52494646"), (8, "415649"))),
    ("video/x-ms-wmv", ((0, "3026B2758E66CF11A6D9"),)),
    ("video/mpeg", ((0, "000001BA"),)),
    ("video/mpeg", ((0, "000001B3"),)),
    ("video/x-flv", ((0, "464C5601"),)),
    ("audio/midi", ((0, "4D546864"),)),
    ("audio/mpeg", ((0, "494433"),)),
    ("audio/mpeg", ((0, "FFFB"),)),
    ("audio/ogg", ((0, "4F676753"),)),
    ("audio/x-flac", ((0, "664C6143"),)),
    ("audio/x-wav", ((0, "52494646"), (8, "57415645"))),
    ("audio/amr", ((0, "2321414D520A"),)),
    ("audio/aac", ((0, "FFF1"),)),
    ("audio/aac", ((0, "FFF9"),)),
    ("audio/x-aiff", ((0, "464F524D"), (8, "41494646"))),
    ("application/font-woff", ((0, "774F464600010000"),)),
    ("application/font-woff2", ((0, "774F463200010000"),)),
    ("application/font-sfnt", ((0, "0001000000"),)),
    ("application/font-sfnt", ((0, "4F54544F00"),)),
    ("application/zip", ((0, "504B0304"),)),
    ("application/zip", ((0, "504B0506"),)),
    ("application/zip", ((0, "504B0708"),)),
    ("application/x-tar", ((257, "7573746172"),)),
    ("application/vnd.rar", ((0, "526172211A07"),)),
    ("application/gzip", ((0, "1F8B08"),)),
    ("application/x-bzip2", ((0, "425A68"),)),
    ("application/x-7z-compressed", ((0, "377ABCAF271C"),)),
    ("application/x-xz", ((0, "FD377A585A00"),)),
    ("application/pdf", ((0, "25504446"),)),
    ("application/x-shockwave-flash", ((0, "465753"),)),
    ("application/x-shockwave-flash", ((0, "435753"),)),
    ("application/rtf", ((0, "7B5C727466"),)),
    ("application/postscript", ((0, "2521"),)),
    ("application/vnd.sqlite3", ((0, "53514C69"),)),
    ("application/x-google-chrome-extension", ((0, "43723234"),)),
    ("application/vnd.ms-cab-compressed", ((0, "4D534346"),)),
    ("application/vnd.debian.binary-package", ((0, "213C617263683E0A64656269616E2D62696E617279"),)),
    ("application/x-unix-archive", ((0, "213C617263683E"),)),
    ("application/x-compress", ((0, "1F9D"),)),
    ("application/x-lzip", ((0, "4C5A4950"),)),
    ("application/x-rpm", ((0, "EDABEEDB"),)),
    ("application/zstd", ((0, "28B52FFD"),)),
    ("application/x-ole-storage", ((0, "D0CF11E0A1B11AE1"),)),
)

# The last signature ends well before this many bytes.
SIGNATURE_BYTES = 512

# Control bytes that text does not use (tab, LF, CR are fine).
CONTROL_CLASS = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F]"
# Text free of NUL and control bytes. Single characters, not ranges, and one greedy run: Java
# then looks each character up in a bit set, several times faster than a search for a class.
CLEAN_TEXT = r"\A[^" + "".join(rf"\x{b:02X}" for b in (*range(9), 11, 12, *range(14, 32), 127)) + r"]*\z"
# UTF-8 of U+FFFE and U+FFFF, which XML 1.0 cannot hold either.
NONCHARACTERS = ("EFBFBE", "EFBFBF")
# After transcoding the C1 controls count as well.
DECODED_CONTROL_CLASS = r"[\x01-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"

# Escape sequences that switch to two-byte JIS.
JIS_ESCAPES = ("1B2440", "1B2442")


def _hex(value: str) -> Column:
    return F.lit(bytearray.fromhex(value))


def bom(content: Column) -> Column:
    """Name of the encoding its byte-order mark announces, or null."""
    cases = None
    for name, mark in BOMS:
        test = F.startswith(content, _hex(mark))
        cases = F.when(test, name) if cases is None else cases.when(test, name)
    return cases


def payload(content: Column) -> Column:
    """Content without a UTF-8 byte-order mark."""
    return F.when(F.startswith(content, _hex("EFBBBF")), content.substr(F.lit(4), F.octet_length(content))).otherwise(content)


def has_nul(content: Column) -> Column:
    return F.contains(content, _hex("00"))


def probe(content: Column) -> Column:
    return F.substring(content, 1, PROBE_BYTES)


def head(content: Column) -> Column:
    """The start of the payload, long enough for every signature."""
    return payload(F.substring(content, 1, SIGNATURE_BYTES))


def _signature(column: str, parts: tuple[tuple[int, str], ...]) -> str:
    return " AND ".join(
        f"startswith({column}, X'{value}')"
        if offset == 0
        else f"substring({column}, {offset + 1}, {len(value) // 2}) = X'{value}'"
        for offset, value in parts
    )


def magic_mime(column: str) -> Column:
    """Media type of the first matching binary signature, or null.

    ``column`` names a binary column, best the ``head`` of the content. Built
    as one SQL text: dozens of branches made call by call cost more to plan
    than to run.
    """
    cases = [f"WHEN {_signature(column, parts)} THEN '{mime}'" for mime, parts in SIGNATURES]
    return F.expr("CASE " + " ".join(cases) + " END")


def zip_mime(column: str) -> Column:
    """Media type that the members of a zip file tell, as far as its probed start lists them, or null.

    ``column`` names the binary payload. Open documents name their type in a stored first member.
    """
    start = f"decode(substring({column}, 1, {PROBE_BYTES}), 'ISO-8859-1')"
    stated = rf"regexp_extract({start}, '(?s)\\A.{{30}}mimetype(application/vnd\\.oasis\\.opendocument\\.[a-z]+)', 1)"
    members = " ".join(rf"WHEN {start} RLIKE '(?s)PK\\x03\\x04.{{26}}{name}' THEN '{mime}'" for mime, name in ZIP_MEMBERS)
    return F.expr(f"coalesce(nullif({stated}, ''), CASE {members} END)")


def refined_mime(mime: str, column: str) -> Column:
    """``mime`` with zip files told apart by their members; only their starts are searched."""
    return F.when(F.col(mime) == "application/zip", F.coalesce(zip_mime(column), F.col(mime))).otherwise(F.col(mime))


def _share(text: Column, char_class: str) -> Column:
    kept = F.regexp_replace(text, char_class, "")
    return (F.char_length(text) - F.char_length(kept)) / F.char_length(text)


def is_suspect(content: Column) -> Column:
    """Whether content holds any character that the density or the XML test minds.

    Most text holds none and is done with both tests after this one scan. A
    lossy view as text is enough: it keeps every control byte, being ASCII.
    """
    marks = [F.contains(content, _hex(mark)) for mark in NONCHARACTERS]
    return ~content.cast("string").rlike(CLEAN_TEXT) | marks[0] | marks[1]


def control_density(content: Column, suspect: Column | None = None) -> Column:
    """Share of control bytes; only suspect content is counted."""
    suspect = is_suspect(content) if suspect is None else suspect
    return F.when(suspect, _share(F.decode(content, "ISO-8859-1"), CONTROL_CLASS)).otherwise(F.lit(0.0))


def is_implausible(text: Column) -> Column:
    """Whether text that came out of a transcoder looks like binary data."""
    dense = F.when(
        text.rlike(DECODED_CONTROL_CLASS), _share(text, DECODED_CONTROL_CLASS) > CONTROL_DENSITY
    ).otherwise(F.lit(False))
    return F.contains(text, F.lit("\0")) | dense


def iso2022jp_candidate(content: Column) -> Column:
    return F.contains(content, _hex(JIS_ESCAPES[0])) | F.contains(content, _hex(JIS_ESCAPES[1]))
