"""What the operators share: table reading, Arrow batches, stored intermediate tables and vectorised byte hashing.

Hashing works on the concatenated UTF-8 bytes of a chunk of texts. ``Prefix``
keeps the prefix sums S[i] = sum(T[byte_j] * B^j) mod 2^64 and answers the hash
of any substring as (S[j] - S[i]) * B^-i, one multiplication a substring.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are hashed in chunks of about this many bytes (a longer text is a chunk of its own).
CHUNK = 1 << 20
BATCH_BYTES = 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; where it is unset, a local one on a local master only."""
    sc = spark.sparkContext
    if (found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")) is None:
        if (known := sc._jsc.sc().getCheckpointDir()).isDefined():
            return known.get()
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage: written as a table to the shared folder and read again. The shuffle files of the step go as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["stored_at"] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from :func:`stored` that nothing reads any more."""
    for t in tables:
        jvm, path = t.sparkSession._jvm, t.__dict__["stored_at"]
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with batches bounded by bytes, so that long texts can't swell a worker, which gives its memory back after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from fn(batches)
        finally:
            give_back()

    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_keys(*cols: str) -> list[Column]:
    """Two 64-bit hashes that tell rows apart by content; equal rows share them."""
    return [F.xxhash64(*cols).alias("k1"), F.xxhash64(F.lit(7919), *reversed(cols)).alias("k2")]


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return b, o - o[0]


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values: high bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class Base:
    """Random byte codes and the powers of one odd base."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.codes = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return Base, (self.seed,)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, CHUNK + 1024)
            self.up, self.down = self._table(self.base, n), self._table(self.inverse, n)
        return self.up, self.down

    @staticmethod
    def _table(b: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(b), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


BASES = (Base(11), Base(23))


class Prefix:
    """Prefix polynomial hashes of a byte buffer."""

    def __init__(self, data: np.ndarray, which: int = 0):
        base = BASES[which]
        up, self.down = base.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(base.codes[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def of_worker(key: object, make: Callable[[], object]) -> object:
    """A value that a Python worker makes once and keeps for its later tasks."""
    kept = sys.modules.setdefault("_weftline_worker", types.ModuleType("_weftline_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes other than 0x20 and 0x09-0x0D; none crosses a text."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    word = ~space
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(word & (before | cut[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(word & (after | cut[1:])) + 1
    return starts, ends
