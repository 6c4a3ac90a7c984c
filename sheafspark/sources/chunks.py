"""Files of any size, as chunks: each chunk is measured where it is read, and the measures of a file add up.

A chunk begins and ends at a character's border, at most three bytes after its nominal place, and looks one byte
further, so neither a UTF-8 sequence nor CR LF falls between two chunks. Its summary therefore needs no other chunk, and
the summary of a file is a plain sum over its chunks in any order: one aggregate, combined before the shuffle.
Neighbouring small chunks travel as one row, a span, and are read from one open file; each is still measured on its own.
No cell ever holds more than the start of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafspark.functions import bytes as B
from sheafspark.session import attach
from sheafspark.sources.corpus import TASK_BYTES, open_uri, said

CHUNK_BYTES = 64 * 1024 * 1024
# Chunks below these sizes go together: in one row, and in one read.
SPAN_BYTES, READ_BYTES = 64 * 1024 * 1024, 1024 * 1024
# A task hands over a batch of summaries when it has this many; each may hold the start of a file.
_BATCH_ROWS = 1000

_SUMMARY = (
    "bundle_id string, path string, size bigint, first boolean, head binary, n_bytes bigint, n_nul bigint, "
    "n_control bigint, n_lines bigint, jis boolean, valid_utf8 boolean, open_end boolean, read_error string"
)
_CONTROLS = bytes([*range(1, 9), 11, 12, *range(14, 32), 127])
_JIS = tuple(bytes.fromhex(e) for e in B.JIS_ESCAPES)
_LONGEST_ESCAPE = max(map(len, _JIS))


def span_rows(listing: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(bundle_id, path, size, uri, list_error, start, stop): neighbouring chunks of a file, whole ones but for its last; one row for an empty or unlisted file."""
    failed = F.col("list_error") if "list_error" in listing.columns else F.lit(None).cast("string")
    span = max(1, SPAN_BYTES // chunk_bytes) * chunk_bytes
    size = F.coalesce("size", F.lit(0).cast("long"))
    last = F.expr(f"greatest(0, (coalesce(size, 0) - 1) div {span})")
    starts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * span)
    spans = listing.select("bundle_id", "path", "size", "uri", failed.alias("list_error"), F.explode(starts).alias("start"))
    return spans.withColumn("stop", F.least(F.col("start") + span, size))


def _border(data: bytes) -> int:
    """Bytes before the first character that begins in ``data``, three at most."""
    at = 0
    while at < min(3, len(data)) and 0x80 <= data[at] < 0xC0:
        at += 1
    return at


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def measure(data: bytes, after: bytes) -> tuple[int, int, int, bool, bool]:
    """(NULs, control bytes, line ends, JIS escape, valid UTF-8) of a chunk and the bytes after it.

    A line ends with LF, CR LF or a lone CR. An escape counts if it begins in the chunk.
    """
    ends = data.count(b"\n") + data.count(b"\r") - data.count(b"\r\n")
    if data.endswith(b"\r") and after.startswith(b"\n"):
        ends -= 1
    controls = len(data) - len(data.translate(None, _CONTROLS))
    around = data[-_LONGEST_ESCAPE:] + after[: _LONGEST_ESCAPE - 1]
    jis = any(escape in data or escape in around for escape in _JIS)
    return data.count(b"\0"), controls, ends, jis, data.isascii() or _is_utf8(data)


def _measure_span(stream, start: int, stop: int, size: int, chunk_bytes: int) -> dict:
    """The sums over the chunks that begin from ``start`` up to ``stop``."""
    beyond = 3 + _LONGEST_ESCAPE
    step = max(1, READ_BYTES // chunk_bytes) * chunk_bytes
    head, total, jis, valid, open_end = None, [0, 0, 0, 0], False, True, False
    for at in range(start, max(stop, start + 1), step):
        stream.seek(at)
        wanted = min(step, max(stop - at, 0)) + beyond
        block = stream.read(wanted if at else max(wanted, B.PROBE_BYTES))
        if not at:
            head = block[: B.PROBE_BYTES]
        for offset in range(0, max(min(step, stop - at), 1), chunk_bytes):
            data = block[offset : offset + min(chunk_bytes, max(size - at - offset, 0)) + beyond]
            begin = _border(data[:3]) if at + offset else 0
            end = min(chunk_bytes, len(data))
            end += _border(data[end : end + 3])
            body = data[begin:end]
            nul, control, lines, has_jis, is_valid = measure(body, data[end:])
            total = [total[0] + len(body), total[1] + nul, total[2] + control, total[3] + lines]
            jis, valid = jis or has_jis, valid and is_valid
            if at + offset + end >= size:
                open_end = open_end or body[-1:] not in (b"", b"\n", b"\r")
    names = ("n_bytes", "n_nul", "n_control", "n_lines")
    return {"head": head, **dict(zip(names, total)), "jis": jis, "valid_utf8": valid, "open_end": open_end}


def span_summaries(spans: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One summary row per span."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema(
            [
                ("bundle_id", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("first", pa.bool_()), ("head", pa.binary()),
                ("n_bytes", pa.int64()), ("n_nul", pa.int64()), ("n_control", pa.int64()), ("n_lines", pa.int64()),
                ("jis", pa.bool_()), ("valid_utf8", pa.bool_()), ("open_end", pa.bool_()), ("read_error", pa.string()),
            ]
        )

        def made(row: dict) -> dict:
            out = {k: row[k] for k in ("bundle_id", "path", "size")} | {"first": row["start"] == 0, "read_error": row["list_error"]}
            if row["list_error"]:
                return out
            try:
                files, path = open_uri(row["uri"])
                with files.open_input_file(path) as stream:
                    return out | _measure_span(stream, row["start"], row["stop"], row["size"] or 0, chunk_bytes)
            except OSError as failure:
                return out | {"read_error": said(failure)}

        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH_ROWS):
                rows = batch.slice(at, _BATCH_ROWS).to_pylist()
                yield pa.RecordBatch.from_pylist([made(row) for row in rows], arrow)

    return spans.mapInArrow(summarise, _SUMMARY)


def measure_files(listing: DataFrame, utf8: bool = False, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per file of a listing: bundle_id, path, size, lines, binary_reason, binary_detail, bom, valid_utf8, iso2022jp_candidate, read_error.

    The same classification as ``classify`` on whole contents, from the start of a file and sums over its chunks. ``size`` is
    what was read. ``lines`` is null for UTF-16, whose line ends are not single bytes. An unreadable chunk
    makes its file unreadable.
    """
    spans = span_rows(listing, chunk_bytes)
    total = listing.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    tasks = max(-(-(total["bytes"] or 0) // TASK_BYTES), min(total["n"], listing.sparkSession.sparkContext.defaultParallelism), 1)
    spread = spans.repartition(tasks, "bundle_id", "path", "start")
    sums = (
        span_summaries(spread, chunk_bytes)
        .groupBy("bundle_id", "path")
        .agg(
            F.sum("n_bytes").alias("size"),
            F.max("head").alias("_start"),
            F.sum("n_nul").alias("_nul"),
            F.sum("n_control").alias("_control"),
            (F.sum("n_lines") + F.max("open_end").cast("long")).alias("_lines"),
            F.min("valid_utf8").alias("valid_utf8"),
            F.max("jis").alias("_jis"),
            F.max("read_error").alias("read_error"),
        )
    )
    start = F.col("_start")
    marked = sums.withColumns({"bom": B.bom(start), "_head": B.head(start), "_bare": B.payload(start)})
    marked = marked.withColumn("_magic", B.magic_mime("_head")).withColumn("_magic", B.refined_mime("_magic", "_start"))
    length = "(size - CASE WHEN startswith(_start, X'EFBBBF') THEN 3 ELSE 0 END)"
    reason = f"""
        CASE WHEN read_error IS NOT NULL THEN NULL
             WHEN startswith(bom, 'UTF-16') THEN {"NULL" if utf8 else "'Utf16ConversionDisabled'"}
             WHEN _magic IS NOT NULL AND NOT contains(_start, X'00') THEN 'RecognizedMagic'
             WHEN _nul > 0 THEN 'NullByte'
             WHEN try_divide(_control, {length}) > {B.CONTROL_DENSITY} THEN 'ControlDensity' END"""
    reasoned = attach(marked, binary_reason=F.expr(reason))
    detail = "CASE binary_reason WHEN 'RecognizedMagic' THEN _magic WHEN 'Utf16ConversionDisabled' THEN bom END"
    return reasoned.select(
        "bundle_id",
        "path",
        F.when(F.col("read_error").isNull(), F.col("size")).alias("size"),
        F.expr("CASE WHEN read_error IS NULL AND NOT coalesce(startswith(bom, 'UTF-16'), false) THEN _lines END").alias("lines"),
        "binary_reason",
        F.expr(detail).alias("binary_detail"),
        "bom",
        "valid_utf8",
        F.expr("coalesce(bom IS NULL AND binary_reason IS NULL AND _jis, false)").alias("iso2022jp_candidate"),
        "read_error",
    )
