"""Helpers the operators share: tables, words as hashes, written intermediates."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyfold.session import shared_folder

#: Bytes that end a word: space and \x09-\x0D. A-Z become a-z, nothing else changes.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_RANDOM = np.random.default_rng(20240229)
_LETTER = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 18
_POWERS: dict[str, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder `spark.checkpoint.dir`, so that later reads don't depend on any executor."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    path = f"{folder.rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table of ids or hashes is sent to all executors; beyond, it is shuffled.
BROADCAST_ROWS = 1_000_000


def sent(small: DataFrame) -> DataFrame:
    """`small` to be broadcast if its measured rows are within the bound, otherwise as it is."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least `n` of each."""
    if len(_POWERS.get("up", ())) < n:
        n = max(n, _SLICE + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[name] = np.multiply.accumulate(row)
    return _POWERS["up"], _POWERS["down"]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one row of UTF-8 bytes and each text's bounds in it; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null's bytes, if it has any, don't count
        empty = np.asarray(column.is_null()) & (np.diff(bounds) > 0)
        if empty.any():
            return string_bytes(column.fill_null(""))
    return raw, bounds - bounds[0]


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of texts laid end to end: starts, ends, 64-bit hashes, and each text's bounds among the words.

    Works through the bytes in slices that end between words, so memory beside
    the result is bounded by the slice or the longest word.
    """
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[bounds] = True
    starts, ends, hashes, at = [], [], [], 0
    while at < len(raw):
        stop = min(len(raw), at + _SLICE)
        while stop < len(raw):  # up to the end of a word
            tail = SPACE[raw[stop : stop + _SLICE]] | edge[stop : min(stop + _SLICE, len(raw))]
            if tail.any():
                stop += int(tail.argmax())
                break
            stop = min(len(raw), stop + _SLICE)
        part = raw[at:stop]
        letter = ~SPACE[part]
        before = np.empty_like(letter)
        before[0], before[1:] = False, letter[:-1]
        after = np.empty_like(letter)
        after[-1], after[:-1] = False, letter[1:]
        first = np.flatnonzero(letter & (~before | edge[at:stop]))
        last = np.flatnonzero(letter & (~after | edge[at + 1 : stop + 1])) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[LOWER[part]] * up[: len(part)], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first]))
        starts.append(first + at)
        ends.append(last + at)
        at = stop
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    start = np.concatenate(starts)
    return start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, bounds)


_WEIGHTS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct shingle hashes, sorted, of one text's words; fewer words than `width` are one shingle, none give none."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    total = np.full(len(hashes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += hashes[k : len(hashes) - width + 1 + k] * _WEIGHTS[k]
    return np.unique(mix(total))


#: What bounds a batch for Python by rows and by bytes, what a task holds of a table before it writes, and the rows it opens at once when it reads one; each with Spark's or the format's own value.
ARROW_ROWS, ARROW_BYTES, GROUP_BYTES, READ_ROWS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"), ("parquet.block.size", None), ("spark.sql.parquet.columnarReaderBatchSize", "4096")


#: A text may be large, and a batch of rows is held as one array of bytes that grows by doubling.
READ_AT_ONCE = 256


def bound_buffers(spark: SparkSession, rows: int, most: int, group: int = 16 << 20) -> None:
    """From now on batches for Python hold up to `rows` rows and `most` bytes, tables are written in row groups of `group` bytes and read READ_AT_ONCE rows at a time. A size that the session chose itself stays."""
    for (name, default), size in ((ARROW_ROWS, rows), (ARROW_BYTES, most), (GROUP_BYTES, group), (READ_ROWS, READ_AT_ONCE)):
        set_here = f"tidyfold.{name}"
        if spark.conf.get(name, default) in (default, spark.conf.get(set_here, default)):
            spark.conf.set(name, str(size))
            spark.conf.set(set_here, str(size))


#: Bytes of text that are worked on at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20


def batches(parts: Iterator[pa.RecordBatch], rows: int = 2000, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to `rows` rows, and to `most` bytes of strings if given, so that work space follows the rows at hand."""
    for part in parts:
        size = np.zeros(part.num_rows, np.int64)
        for column in part.columns if most else []:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                size += np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + part.num_rows + 1]) if part.num_rows else 0
        reach, at = np.cumsum(size), 0
        while at < part.num_rows:
            before = int(reach[at - 1]) if at else 0
            to = min(at + rows, part.num_rows)
            if most:
                to = max(at + 1, min(to, int(np.searchsorted(reach, before + most, side="right"))))
            yield part.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()
    if most:
        give_back()


def give_back() -> None:
    """Hands the worker's free memory back to the system, where the C library can; a worker outlives its task."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
