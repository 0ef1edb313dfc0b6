"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
TASK_ROWS = 100_000  # of a small table that one task of a round takes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text; null counts as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def drop_clashing(df: DataFrame, *names: str) -> DataFrame:
    """Without the columns that an operator is about to add (names compare without case, as Spark does)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files behind tables that have been written to shared storage.

    It does so once the driver's garbage is collected, which may else not happen during a query.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def compact(df: DataFrame, rows: float) -> DataFrame:
    """``df``, which has at most so many rows, in as few partitions as hold TASK_ROWS each; never in more than it has.

    Rounds over a table that is small, whatever its shuffles were dealt over, then need few tasks. A table that fits one
    partition is joined and aggregated without a shuffle.
    """
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """What tells rows apart: the id and a hash of the text. Rows equal in both are one document for an operator."""
    return F.col(doc_id).alias("k_id"), F.xxhash64(whole_text(text)).alias("k_text")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash; a bijection, so equal inputs and only those stay equal."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Polynomial prefix sums modulo 2**64 over a byte string, for the hash of any part of it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.sums[1:])
        self.back = powers(BASE_INVERSE, n + 1)

    def parts(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each ``data[start:end]``; it doesn't depend on the place."""
        raw = (self.sums[end] - self.sums[start]) * self.back[start]
        return mix64(raw ^ ((end - start).astype(np.uint64) << np.uint64(40)))

    def every(self, width: int) -> np.ndarray:
        """Hash of each part of ``width`` bytes, by its start."""
        raw = (self.sums[width:] - self.sums[:-width]) * self.back[: len(self.sums) - width]
        return mix64(raw)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column (null counts as empty) and the offsets of its rows, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices_by_bytes(batch: pa.RecordBatch, column: str = "text", most: int = 4_000_000):
    """Parts of a batch with about ``most`` bytes of text each (a longer text is alone) and at most
    50,000 rows; all rows, in order."""
    _, offsets = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        stop = min(n, max(start + 1, stop), start + 50_000)
        yield batch.slice(start, stop - start)
        start = stop


def column_parts(column: pa.Array, most: int = 2_000_000):
    """Parts of a text column with about ``most`` bytes each, in order; none of an empty column."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    return (part.column(0) for part in slices_by_bytes(batch, "text", most))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start+length-1`` of all rows, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


# Kinds of bytes. Words: runs of ASCII letters, digits, _ and all characters outside ASCII. Marks: runs of the rest
# but white space and control characters.
WORDS_ONLY = np.zeros(256, dtype=np.int8)
WORDS_ONLY[128:] = 1
for _c in b"0123456789_abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    WORDS_ONLY[_c] = 1
WORDS_AND_MARKS = np.where(WORDS_ONLY == 1, 1, 2).astype(np.int8)
WORDS_AND_MARKS[:33] = 0
WORDS_AND_MARKS[127] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def token_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORDS_ONLY):
    """Start, end and row of each run of bytes of one kind (not 0) of a batch of texts. No run crosses texts."""
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, none
    kind = kinds[data]
    edge = np.empty(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[offsets] = True
    cuts = np.flatnonzero(edge)
    keep = kind[cuts[:-1]] != 0
    start, end = cuts[:-1][keep], cuts[1:][keep]
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def sampled_labels(
    labels: DataFrame, label: str, folds: int, held_out: int, most: int, by_class: bool = False
) -> tuple[DataFrame, dict[int, int]]:
    """At most ``most`` labelled ids to learn from (of each class, if ``by_class``), by the smallest hash of the id,
    and how many labelled rows of each class there are. Rows whose crc32(id) mod ``folds`` is ``held_out`` are never
    among them, nor are rows with a null id or label.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).filter(fold(folds) != held_out)
    known = known.select("doc_id", F.col(label).cast("int").alias("label"))
    once = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    count = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    parts = [once.filter(F.col("label") == c) for c in (0, 1)] if by_class else [once]
    taken = [p.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for p in parts]
    return (taken[0].union(taken[1]) if by_class else taken[0]), count


def fold(folds: int, doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
