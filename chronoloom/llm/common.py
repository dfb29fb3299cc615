"""Helpers that the training-data operators share: durable intermediate tables, shared files, and byte kernels.

Words are maximal runs of bytes outside ``20 09-0D`` (hex). All of these are ASCII, so a scan of UTF-8 bytes finds
the same words as a scan of code points.
"""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own, but only
    where all run on one machine: a cluster must name its folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            at = "file://" + tempfile.mkdtemp(prefix="chronoloom-")
            spark.sparkContext.setCheckpointDir(at)
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronoloom-{name}-{uuid.uuid4().hex}"


class Scratch:
    """A scope of intermediate tables: those written inside are deleted when it is left, but for kept ones, which pass to
    the scope around it. Nothing that is read later may rest on a table that is not kept."""

    _open: contextvars.ContextVar[Scratch | None] = contextvars.ContextVar("scratch", default=None)

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.around = Scratch._open.get()
        self._token = Scratch._open.set(self)
        return self

    def __exit__(self, *_) -> None:
        Scratch._open.reset(self._token)
        for path in self.paths:
            delete(self.spark, path)

    @classmethod
    def enter(cls, path: str, keep: bool) -> None:
        scope = cls._open.get()
        scope = scope.around if scope and keep else scope
        if scope:
            scope.paths.append(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it. It outlives lost executors. keep: it also outlives the
    scope it is written in."""
    path = new_path(df.sparkSession, name)
    Scratch.enter(path, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keyed(docs: DataFrame, name: str, *, keep: bool = False) -> DataFrame:
    """docs with a key of our own for every row, ``_row``; written, so that it is the same whenever it is read."""
    return materialise(docs.withColumn("_row", F.monotonically_increasing_id()), name, keep=keep)


def filesystem(uri: str):
    """(pyarrow filesystem, path): reads and writes file:, hdfs:, s3: or gs: folders from executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package at hand on the executors."""
    ship(df.sparkSession)

    def lean(batches):
        yield from run(batches)
        release_memory()

    return df.mapInArrow(lean, schema)


def shielded(docs: DataFrame, *used: str):
    """(docs with all columns but the used ones under names of our own, a function that gives them their names back): a
    stage's own columns then cannot clash with those that only pass through."""
    own = {c: c if c in used else f"_passed{i}" for i, c in enumerate(docs.columns)}
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in own}
    return docs.select(*[quoted[c].alias(name) for c, name in own.items()]), lambda df: df.select(*[F.col(name).alias(c) for c, name in own.items()])


def release_memory() -> None:
    """Give what a finished task no longer uses back to the system: Python workers live on, beside those of later stages."""
    _powers.cache_clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % n


def word_count(text: Column) -> Column:
    """Words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def input_partitions(df: DataFrame) -> int:
    """Partitions of a scan: follows the input's size, so it is the number of ranges or shards to deal rows out to."""
    return max(1, df.rdd.getNumPartitions())


# ---------------------------------------------------------------- byte kernels


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose texts have about ``most`` bytes; a longer text is a range of its own."""
    col = batch.column(column)
    if not len(col):
        return
    sizes = text_sizes(col)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(col):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_sizes(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts on end, n + 1 offsets); null counts as empty."""
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(offsets) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


@functools.cache
def _is_word() -> np.ndarray:
    lut = np.ones(256, dtype=bool)
    lut[[0x20, *range(0x09, 0x0E)]] = False
    return lut


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, its end, n + 1 offsets of each text's words)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _is_word()[data]
    cuts = offsets[1:-1]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    before[cuts[cuts < len(data)]] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts[cuts > 0] - 1] = False
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@functools.cache
def _byte_codes(fold_case: bool) -> np.ndarray:
    codes = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of every word: a polynomial over its bytes from prefix sums, then mixed. fold_case folds A-Z."""
    if not len(starts):
        return np.empty(0, np.uint64)
    size = 1 << max(16, int(len(data) - 1).bit_length())
    up, down = _powers(size) if size <= 1 << 22 else _powers.__wrapped__(size)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_codes(fold_case)[data] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64))


def segments(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, on end."""
    at = segments(lengths)
    return np.repeat(starts - at[:-1], lengths) + np.arange(at[-1])


def sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each range between offsets; 0 for an empty range."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
