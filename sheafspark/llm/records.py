"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record is framed as: length of the payload (8 bytes, little-endian), masked
CRC-32C of those 8 bytes, payload, masked CRC-32C of the payload. The payload
is the ids of one document, 2 bytes each if the vocabulary has at most 65,536
entries, else 4. Files are written by Spark tasks in ascending document
order under names that no other attempt of a task uses; the index, a Parquet
table written by Spark, names only the files of attempts that succeeded.

Null and empty texts are records of the end id alone; null document ids come first;
rows with equal ids are ordered by a hash of their text; repeated rows are repeated records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafspark.llm import storage
from sheafspark.llm.buffers import slices, text_of
from sheafspark.llm.tokens import encoder

#: A task begins a new file when the current one holds this many bytes.
FILE_BYTES = 256 * 1024 * 1024
_SLICE = 8 * 1024 * 1024
_SEGMENT = 512

# Fixed values of the record format.
_POLYNOMIAL = 0x82F63B78
_MASK_DELTA = 0xA282EAD8

INDEX = "doc_id long, part int, file string, offset long, n_tokens long, start_in_file long, width int"


def _tables() -> np.ndarray:
    """tables[k][b]: the checksum state of byte b followed by k zero bytes."""
    tables = np.zeros((8, 256), np.uint32)
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(_POLYNOMIAL), state >> 1).astype(np.uint32)
    tables[0] = state
    for k in range(1, 8):
        tables[k] = tables[0][tables[k - 1] & 0xFF] ^ (tables[k - 1] >> np.uint32(8))
    return tables


_T = _tables()


def _advance(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States after the number of zero bytes that ``tables`` stand for."""
    s = state
    return tables[0][s & 0xFF] ^ tables[1][(s >> 8) & 0xFF] ^ tables[2][(s >> 16) & 0xFF] ^ tables[3][s >> 24]


def _zero_tables() -> list[np.ndarray]:
    """For each k: what 2**k zero bytes make of each byte of a state."""
    one = np.arange(256, dtype=np.uint32)
    found = [np.stack([_T[0][one], one, one << np.uint32(8), one << np.uint32(16)])]
    for _ in range(40):
        last = found[-1]
        found.append(np.stack([_advance(last, last[k]) for k in range(4)]))
    return found


_ZEROS = _zero_tables()


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes, all rows at once.

    Rows are cut into segments of equal length, padded with zeros in front
    (which do not change a state of zero); the segments go through the tables
    side by side and are then joined per row.
    """
    sizes = np.diff(offsets)
    segments = -(-sizes // _SEGMENT)
    first = np.concatenate([[0], np.cumsum(segments)])
    flat = np.zeros(int(first[-1]) * _SEGMENT, np.uint8)
    shift = first[1:] * _SEGMENT - offsets[1:]
    flat[np.arange(len(data)) + np.repeat(shift, sizes)] = data
    words = np.ascontiguousarray(flat.view("<u4").reshape(-1, _SEGMENT // 4).T)
    state = np.zeros(words.shape[1], np.uint32)
    for j in range(0, _SEGMENT // 4, 2):
        a, b = state ^ words[j], words[j + 1]
        state = (
            _T[7][a & 0xFF] ^ _T[6][(a >> 8) & 0xFF] ^ _T[5][(a >> 16) & 0xFF] ^ _T[4][a >> 24]
            ^ _T[3][b & 0xFF] ^ _T[2][(b >> 8) & 0xFF] ^ _T[1][(b >> 16) & 0xFF] ^ _T[0][b >> 24]
        )
    whole = np.zeros(len(sizes), np.uint32)
    by_length = np.argsort(-segments, kind="stable")
    ordered = segments[by_length]
    for k in range(int(segments.max(initial=0))):
        rows = by_length[: np.searchsorted(-ordered, -k, side="left")]
        whole[rows] = _advance(_ZEROS[_SEGMENT.bit_length() - 1], whole[rows]) ^ state[first[rows] + k]
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max(initial=0)).bit_length()):
        rows = np.flatnonzero((sizes >> k) & 1)
        start[rows] = _advance(_ZEROS[k], start[rows])
    return whole ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


def frames(payload: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A framed record for each row of payload bytes."""
    lengths = np.diff(offsets).astype("<u8")
    heads = masked(crc32c(lengths.view(np.uint8), np.arange(len(lengths) + 1) * 8)).astype("<u4")
    tails = masked(crc32c(payload, offsets)).astype("<u4")
    raw = payload.tobytes()
    return [
        b"".join((n.tobytes(), h.tobytes(), raw[a:b], t.tobytes()))
        for n, h, a, b, t in zip(lengths, heads, offsets.tolist(), offsets[1:].tolist(), tails)
    ]


def unframe(raw: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payload bytes and offsets of records that lie one after the other; raises if one is damaged."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(lengths + 16)
    begins = ends - lengths - 16
    if int(ends[-1]) != len(data):
        raise ValueError("records do not fill the range that the index gives")

    def numbers(at: np.ndarray, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return np.ascontiguousarray(data[at[:, None] + np.arange(size)]).view(kind).ravel()

    stated = numbers(begins, "<u8")
    head = masked(crc32c(stated.view(np.uint8), np.arange(len(lengths) + 1) * 8))
    if (stated != lengths.astype(np.uint64)).any() or (head != numbers(begins + 8, "<u4")).any():
        raise ValueError("a record's length is damaged")
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    payload = data[np.repeat(begins + 12 - offsets[:-1], lengths) + np.arange(offsets[-1])]
    if (masked(crc32c(payload, offsets)) != numbers(ends - 4, "<u4")).any():
        raise ValueError("a record's payload is damaged")
    return payload, offsets


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write records below ``folder``; returns the offset index.

    One shuffle orders the texts by range of document id; encoding, framing
    and writing follow in the same task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, stream, name, offset, tokens = TaskContext.get().partitionId(), 0, None, "", 0, 0
        tool = encoder(tokenizer)
        width = 2 if max(tool.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        attempt = uuid.uuid4().hex
        try:
            for batch in batches:
                for rows in slices(batch, "text", _SLICE):
                    if stream is None or offset >= file_bytes:
                        if stream is not None:
                            stream.close()
                        name, offset, tokens = f"part-{part:08d}-{count:05d}-{attempt}.rec", 0, 0
                        files, path = storage.open_uri(f"{folder}/{name}")
                        stream = files.open_output_stream(path, compression=None)
                        count += 1
                    ids, first = tool.encode(text_of(rows.column("text")))
                    sizes = np.diff(first) + 1
                    ids = np.insert(ids, first[1:], end_id)
                    payload = ids.astype(f"<u{width}").view(np.uint8)
                    spans = np.concatenate([[0], np.cumsum(sizes)]) * width
                    records = frames(payload, spans)
                    stream.write(b"".join(records))
                    ends = np.cumsum([len(r) for r in records])
                    n = rows.num_rows
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": rows.column("doc_id").cast(pa.int64()),
                        "part": pa.array(np.full(n, part, np.int32)),
                        "file": pa.array([name] * n, pa.string()),
                        "offset": pa.array(offset + np.concatenate([[0], ends[:-1]])),
                        "n_tokens": pa.array(sizes),
                        "start_in_file": pa.array(tokens + np.cumsum(sizes) - sizes),
                        "width": pa.array(np.full(n, width, np.int32)),
                    })
                    offset += int(ends[-1])
                    tokens += int(sizes.sum())
        finally:
            if stream is not None:
                stream.close()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    ordered = keyed.repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
    index = f"{folder}/index"
    ordered.drop("key").mapInArrow(write, INDEX).write.parquet(index)
    return docs.sparkSession.read.schema(INDEX).parquet(index)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records that ``index`` names, in any order; checks every frame.

    Returns the index with ``ids`` (binary, 4 bytes each, little-endian). Rows
    of one file that follow each other are read in one go.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("file").to_pylist()
            sizes = batch.column("n_tokens").to_numpy()
            width = batch.column("width").to_numpy().astype(np.int64)
            length = sizes * width
            offset = batch.column("offset").to_numpy()
            breaks = [0]
            held = 0
            for k in range(1, len(names)):
                held += int(length[k - 1]) + 16
                if names[k] != names[k - 1] or offset[k] != offset[k - 1] + length[k - 1] + 16 or held > _SLICE:
                    breaks.append(k)
                    held = 0
            for a, b in zip(breaks, [*breaks[1:], len(names)]):
                if a == b:
                    continue
                with storage.reading(f"{folder}/{names[a]}") as stream:
                    stream.seek(int(offset[a]))
                    raw = stream.read(int((length[a:b] + 16).sum()))
                payload, spans = unframe(raw, length[a:b])
                ids = payload.view(f"<u{width[a]}").astype("<u4")
                spans = spans // width[a] * 4
                values = ids.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array([values[x:y] for x, y in zip(spans, spans[1:])], pa.binary())],
                    [*batch.schema.names, "ids"],
                )

    return index.mapInArrow(read, f"{INDEX}, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """The index with ``start``: ids of all documents before, over all files in order."""
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    base = files.select("file", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("base"))
    return index.join(base, "file").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the CRC-32 of its ids."""
    spark: SparkSession = docs.sparkSession
    folder = folder or storage.make_folder(spark)
    index = write_records(docs, folder, tokenizer, end_id)
    found = read_records(index, folder)
    return starts(found.select(*index.columns, F.crc32("ids").alias("ids_crc32"))).select(
        "doc_id", "start", "n_tokens", "ids_crc32"
    )
