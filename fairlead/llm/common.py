"""What the operators share: shared scratch tables, Arrow slicing and word hashing.

Scratch tables live below ``spark.checkpoint.dir``, the folder that driver and
executors share; where a local session has none (tests on one machine) a temporary
folder is set once, and a session on a cluster is refused.  They are plain
Parquet, so a lost executor costs a task retry and never a result.
"""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.sources.scratch import scratch_path, shared_dir  # noqa: F401

#: Text bytes that the numpy kernels handle at once; one longer text is one slice.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch for operators that cut batches into slices anyway: executor and worker each hold a batch whole, and more while it grows.
BATCH_BYTES = 4 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SETTING = threading.Lock()
_settings: dict[tuple[str, str], list] = {}  # by session and key: threads inside, the setting before


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session's setting for a while; it returns when the last thread inside leaves."""
    name = str(spark._jsparkSession.hashCode()), key
    with _SETTING:
        held = _settings.setdefault(name, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _SETTING:
            held[0] -= 1
            if not held[0]:
                del _settings[name]
                spark.conf.unset(key) if held[1] is None else spark.conf.set(key, held[1])


def materialize(df: DataFrame, label: str, batch_bytes: int | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back, which cuts its lineage.

    The write's shuffle files go when it ends: nothing reads them again.  ``batch_bytes`` bounds the Arrow batches.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with _setting(spark, CLEANUP, "true"), _setting(spark, BATCHES, str(batch_bytes)) if batch_bytes else nullcontext():
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._fairlead_path = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(*frames: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_fairlead_path", None)
        if path:
            remove(df.sparkSession, path)


#: What this worker keeps for later tasks of the same kind, such as tokenizers with their memory.
KEPT: dict[str, object] = {}


@lru_cache(1)
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def give_back() -> None:
    """Return free pages of Arrow and of the C library to the system: an idle worker counts against its executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def forget() -> None:
    """Drop what is kept; a function of this module, since a task's own code would have a copy of ``KEPT``."""
    KEPT.clear()
    give_back()


def lean(run: Callable, keep: bool = False) -> Callable:
    """``run`` for mapInArrow, in a worker that gives back what tasks of other kinds left there and what this task has freed."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        yield from run(batches)
        give_back()

    return leaner


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of what a plan reads, from the statistics of its files; nothing is read for it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def in_fold(doc_id: Column) -> Column:
    """True for rows that may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def sized_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text, one row at least."""
    texts = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    _, offsets = text_buffers(texts)
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets (from 0) of a string array; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts, wide = texts.cast(pa.large_string()), True
    raw = texts.buffers()
    n = len(texts)
    if n == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(4)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 4096), 0x9FB21C651E98DF25, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def char_class(inside: str) -> np.ndarray:
    """256 flags of the bytes that belong to words: ``nonspace`` or ``alnum`` (with all non-ASCII)."""
    flags = np.zeros(256, bool)
    if inside == "nonspace":
        flags[:] = True
        flags[[0x20, *range(0x09, 0x0E)]] = False
    else:
        flags[0x30:0x3A] = flags[0x41:0x5B] = flags[0x61:0x7B] = True
        flags[0x80:] = True
    return flags


class Words:
    """Words of a run of texts: 64-bit hashes, byte spans and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, flags: np.ndarray):
        n = len(data)
        inside = flags[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[edges < n]
        begins[edges] = inside[edges]
        self.start = np.flatnonzero(begins)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        edges = edges[edges > 0]
        ends[edges - 1] |= inside[edges - 1]
        self.end = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        lengths = self.end - self.start
        if len(lengths):
            first = np.cumsum(lengths) - lengths
            at = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            value = _byte_codes(True)[data[inside]] * _powers(int(lengths.max()))[at]
            self.hash = mix64(np.add.reduceat(value, first) + lengths.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)


def crc_fold(doc_id: int) -> bool:
    """Plain-Python twin of :func:`in_fold`, for tests."""
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 != 2
