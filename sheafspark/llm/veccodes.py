"""Vector code compression: product quantisation over integers, by per-dimension value dictionaries.

Components become integers, floor(4096 * x). Rows lie in slices; a slice keeps, for every dimension, the sorted distinct
integers that occur in it and each row's code into that dictionary. To compare all rows with the entries of a codebook,
the squared differences of every distinct integer to all entries are tabulated once per dimension, and a part's
distances are rows of these tables gathered by code and added. Nothing is ever subtracted per row and entry.

A slice has a bounded number of components, so its dictionaries, codes and tables do too, whatever the table's size. Codebooks (16
entries of one vector's width) and the sums that renew them (one row per part, entry and dimension) are all that passes through the driver.

Rows are dropped whose vector is null or holds null or non-finite components. Vectors are filled up with zeros to the width
of the longest, itself rounded up to a multiple of the parts, so vectors of unequal or no length have a result too.
Integers beyond the range whose squared distances fit a long saturate at it. A codebook has fewer than 16 entries if there are fewer ids;
null ids are larger than all others, and of repeated ids the smallest vector starts an entry. Repeated rows each have a
result. A table without kept rows gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafspark.llm.storage import stage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components in a slice, and rows; codes are 16 bits wide.
SLICE, SLICE_ROWS = 1 << 20, 1 << 15
_LONGEST = (1 << 63) - 1


@dataclass
class Shape:
    """Width of the vectors (filled up) and of a part, and the largest integer kept."""

    width: int
    parts: int = PARTS

    @property
    def per_part(self) -> int:
        return self.width // self.parts

    @property
    def most(self) -> int:
        return 1 << max((60 - max(self.width, 1).bit_length()) // 2, 1)

    @property
    def rows(self) -> int:
        """Rows of a slice."""
        return max(1, min(SLICE_ROWS, SLICE // max(self.width, 1)))


def kept_rows(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, embedding) whose vectors are whole and finite, the components as doubles."""
    wide = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    infinite = F.lit(float("inf"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == infinite))
    return wide.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def integers(column: pa.Array, shape: Shape) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(sizes), shape.width), np.int64)
    out[np.arange(shape.width)[None, :] < sizes[:, None]] = np.clip(values, -shape.most, shape.most).astype(np.int64)
    return out


# ---- slices


_SLICE_ROW = "n long, sizes array<int>, words array<int>, codes binary"


def sliced(kept: DataFrame, shape: Shape) -> DataFrame:
    """Slices: ids and labels of their rows, per dimension the dictionary's size, all dictionaries, and the codes by dimension."""
    fields = [T.StructField("ids", T.ArrayType(kept.schema["vec_id"].dataType)), T.StructField("labels", T.ArrayType(kept.schema["label"].dataType))]
    schema = T.StructType(fields + T.StructType.fromDDL(_SLICE_ROW).fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        waiting: list[pa.RecordBatch] = []

        def made(rows: pa.Table) -> pa.RecordBatch:
            grid = integers(rows.column("embedding"), shape)
            words, codes = [], np.empty((shape.width, len(grid)), np.uint16)
            for d in range(shape.width):
                known, codes[d] = np.unique(grid[:, d], return_inverse=True)
                words.append(known)
            flat = np.concatenate(words) if words else np.zeros(0, np.int64)
            ids, labels = (pa.array([rows.column(c).to_pylist()], arrow.field(f).type) for c, f in (("vec_id", "ids"), ("label", "labels")))
            columns = [ids, labels, pa.array([len(grid)], pa.int64()), pa.array([[len(w) for w in words]], arrow.field("sizes").type)]
            columns += [pa.array([flat.astype(np.int32)], arrow.field("words").type), pa.array([codes.tobytes()], arrow.field("codes").type)]
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        held = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                taken = batch.slice(at, min(shape.rows - held, batch.num_rows - at))
                waiting.append(taken)
                at, held = at + taken.num_rows, held + taken.num_rows
                if held == shape.rows:
                    yield made(pa.Table.from_batches(waiting))
                    waiting, held = [], 0
        if waiting:
            yield made(pa.Table.from_batches(waiting))

    return kept.mapInArrow(cut, schema)


@dataclass
class _Slice:
    """A slice row as arrays."""

    n: int
    words: list[np.ndarray]
    codes: np.ndarray

    @classmethod
    def read(cls, row: dict, shape: Shape) -> _Slice:
        ends = np.cumsum(np.array(row["sizes"], np.int64))
        words = np.split(np.array(row["words"], np.int64), ends[:-1]) if len(ends) else []
        return cls(row["n"], words, np.frombuffer(row["codes"], np.uint16).reshape(shape.width, row["n"]))

    def nearest(self, entries: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, by part and row; the lower index at ties."""
        found = np.zeros((shape.parts, self.n), np.int64)
        error = np.zeros((shape.parts, self.n), np.int64)
        for part in range(shape.parts):
            distance = np.zeros((self.n, len(entries)), np.int64)
            for d in range(part * shape.per_part, (part + 1) * shape.per_part):
                table = (self.words[d][:, None] - entries[None, :, d]) ** 2
                distance += table[self.codes[d]]
            found[part] = distance.argmin(axis=1)
            error[part] = distance[np.arange(self.n), found[part]]
        return found, error

    def sums(self, found: np.ndarray, n_entries: int, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
        """Rows per part and entry, and sums per entry and dimension: counts of codes, weighted by the dictionary's integers."""
        counts = np.stack([np.bincount(f, minlength=n_entries) for f in found])
        sums = np.zeros((n_entries, shape.width), np.int64)
        for d, words in enumerate(self.words):
            slot = found[d // shape.per_part] * len(words) + self.codes[d]
            used = np.bincount(slot, minlength=n_entries * len(words)).reshape(n_entries, len(words))
            sums[:, d] = used @ words
        return counts, sums


def _slices_of(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[tuple[dict, _Slice]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, _Slice.read(row, shape)


# ---- codebooks


def first_entries(kept: DataFrame, shape: Shape, entries: int = ENTRIES) -> np.ndarray:
    """The vectors of the smallest ids, ascending: one narrow job for the ids, one for at most ``entries`` vectors."""
    ids = [r.vec_id for r in kept.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    wanted = named | F.col("vec_id").isNull() if None in ids else named
    rows = kept.where(wanted).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).collect()
    by_id = {r.vec_id: r.embedding for r in rows}
    return integers(pa.array([by_id[i] for i in ids], pa.list_(pa.float64())), shape)


def renewed(slices: DataFrame, book: np.ndarray, shape: Shape) -> np.ndarray:
    """The codebook after one round: floor of the mean of each entry's parts; entries without parts stay."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((shape.parts, len(book)), np.int64), np.zeros((len(book), shape.width), np.int64)
        for _, part in _slices_of(batches, shape):
            found, _ = part.nearest(book, shape)
            n, s = part.sums(found, len(book), shape)
            counts, sums = counts + n, sums + s
        entry, dim = np.divmod(np.arange(len(book) * shape.width), max(shape.width, 1))
        n = counts[dim // max(shape.per_part, 1), entry]
        used = n > 0
        columns = [pa.array(c[used]) for c in (entry, dim, n, sums.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["entry", "dim", "n", "total"])

    parts = slices.select("n", "sizes", "words", "codes").mapInArrow(collect, "entry long, dim long, n long, total long")
    sums = parts.groupBy("entry", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    book = book.copy()
    for row in sums.collect():
        book[row.entry, row.dim] = int(row.total) // row.n
    return book


def book_digest(book: np.ndarray, shape: Shape) -> str:
    """SHA-256 of all components as decimal integers, by part, entry and position in the part."""
    ordered = book.reshape(len(book), shape.parts, shape.per_part).transpose(1, 0, 2)
    return hashlib.sha256(",".join(map(str, ordered.ravel().tolist())).encode()).hexdigest()


def assigned(slices: DataFrame, book: np.ndarray, shape: Shape) -> DataFrame:
    """Per row: vec_id, label, code (two hex digits per part), error (a decimal, the sum over parts)."""
    schema = T.StructType(
        [
            T.StructField("vec_id", slices.schema["ids"].dataType.elementType),
            T.StructField("label", slices.schema["labels"].dataType.elementType),
            T.StructField("code", T.StringType()),
            T.StructField("error", T.LongType()),
        ]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for row, part in _slices_of(batches, shape):
            found, error = part.nearest(book, shape)
            texts = [bytes(c).hex() for c in found.T.astype(np.uint8)]
            columns = [pa.array(row["ids"], arrow.field(0).type), pa.array(row["labels"], arrow.field(1).type)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, arrow.field(2).type), pa.array(error.sum(axis=0))], schema=arrow)

    return slices.mapInArrow(code, schema)


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> DataFrame:
    """Per kept row of (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    label_error sums the error over the rows of a label, nulls together; a sum beyond a long is its largest value.
    """
    kept = kept_rows(vectors)
    longest = kept.agg(F.max(F.size("embedding")).alias("most")).first().most or 0
    shape = Shape(-(-longest // parts) * parts, parts)
    slices = stage(sliced(kept, shape))
    book = first_entries(kept, shape, entries)
    if len(book):
        for _ in range(rounds):
            book = renewed(slices, book, shape)
    coded = stage(assigned(slices, book, shape))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONGEST).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of_label")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(book, shape)).alias("codebooks_sha256")
    )
