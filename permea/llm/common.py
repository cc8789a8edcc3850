"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one Python call handles at a time (bounds its memory).
SLICE_BYTES = 2 << 20


def release_memory() -> None:
    """Gives the system back what the driver's Python has freed: the C library and Arrow would
    otherwise hold it for later, beside all that the driver's JVM takes in the following jobs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def lean(fn: Callable) -> Callable:
    """``fn`` of a group of rows or of two (as in cogroups), after which the worker gives back what it
    has freed: it lives on beside the executor's JVM, and the next group would not reuse all of it."""
    def one(group):
        out = fn(group)
        release_memory()
        return out

    def two(left, right):
        out = fn(left, right)
        release_memory()
        return out
    return one if fn.__code__.co_argcount == 1 else two  # Spark counts the arguments


def some_bound(want: int, total: int) -> int:
    """What a 64-bit hash must not pass for about twice ``want`` of ``total`` distinct hashes."""
    return (1 << 63) - 1 if total <= 2 * want else int(-(1 << 63) + (1 << 64) * (2 * want / total))


def some_of(key: Column, want: int, total: int) -> Column:
    """Whether a row is among about twice ``want`` of ``total`` rows, by its 64-bit
    hash: what is then sorted and cut to ``want`` stays as small at any size.
    Where rows share a hash, ``total`` counts the distinct ones."""
    return key <= F.lit(some_bound(want, total))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """``row``, a struct of the columns ``keep`` (so their names clash with nothing),
    and, unless it is among them, ``text``."""
    text = [] if text_col in keep else [F.col(text_col).alias("text")]
    return docs.select(F.struct(*(F.col(c) for c in keep)).alias("row"), *text)


def text_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The text of the rows of :func:`with_row`."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("row").field(text_col)


def row_schema(rows: DataFrame) -> str:
    return f"row {rows.schema['row'].dataType.simpleString()}"


def hash_mod(col: str, k: int = 5) -> Column:
    """crc32 of an id written as text, modulo ``k`` (NULL for a NULL id)."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % k


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (n + 1) of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]] if len(offsets) else raw[:0], offsets - (offsets[0] if len(offsets) else 0)


def slices(batch: pa.RecordBatch | pa.Table, text: str | pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch | pa.Table]:
    """Consecutive runs of rows with about ``limit`` bytes of text each (a longer
    single text is a run of its own)."""
    if not batch.num_rows:
        return
    text = batch.column(text) if isinstance(text, str) else text
    ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def with_chunk(docs: DataFrame, id_col: str, text: str, chunk_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``_chunk``: rows dealt by a hash of their id and text, about
    ``chunk_bytes`` of text each.  The number of chunks follows the data, so no
    chunk grows with the input, and a repeated id does not gather in one chunk
    unless its text repeats as well (then a salt from the text's length cannot
    help; see :func:`salted_chunk`)."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first().b or 0
    n = max(1, math.ceil(total / chunk_bytes))
    return docs.withColumn("_chunk", F.pmod(F.xxhash64(F.col(id_col)), F.lit(n)).cast("int")), n


#: Bytes with A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def space_words(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased (A-Z) words of maximal runs without ASCII white space, as one
    flat array, and row offsets (n + 1) into it.  NULL has no words."""
    # Compact buffers: string kernels of Arrow misread a large string array whose first offset is not 0.
    raw, off = utf8(texts)
    lower = pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(np.ascontiguousarray(off)), pa.py_buffer(LOWER[raw]))
    lists = pc.ascii_split_whitespace(lower)
    counts = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        row = np.repeat(np.arange(len(counts)), counts)[full]
        counts = np.bincount(row, minlength=len(counts))
        flat = flat.filter(pa.array(full))
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd multiplier of the byte hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n].astype(np.uint64)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = _powers(_BASE, size), _powers(_INV, size)
    return _TABLES[size]


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span raw[start:end]; equal bytes give equal hashes."""
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    mixed = mix64(np.arange(1, 257, dtype=np.uint64))[raw]
    np.cumsum(mixed * up[:len(raw)], out=sums[1:])
    part = (sums[ends] - sums[starts]) * down[starts]
    return mix64(part + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hash(words: pa.Array) -> np.ndarray:
    """64-bit hash of each entry of a string array."""
    raw, off = utf8(words)
    return span_hash(raw, off[:-1], off[1:])
