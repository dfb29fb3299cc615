"""A ledger of keys that stays cheap to ask, however long it grows.

Entries are kept in runs, one a write, in files by the leading digits of the key's digest. Beside every run is a table of Bloom filters, one for
about 2,048 of its keys; a lookup joins the keys that it is asked for with these, and opens only files that may hold one of them. Runs of a
level are merged once there are ``FAN`` of them, so a ledger of N writes has about FAN * log(N) / log(FAN) runs. A merge writes before it
deletes, and an entry may be there twice in between: a ledger is a set of keys, so that changes no answer. One writer at a time."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import LEDGER

FAN = 8
FILE_ROWS, BLOCK_KEYS = 1 << 20, 1 << 11  # entries a file, and keys a filter, at most about
FILTER = "digits int, block string, bucket string, bits binary, batch string"


def _digits(n: int, most: int) -> int:
    """How many hexadecimal digits deal n keys out to parts of at most about ``most``."""
    digits = 0
    while n > most * 16**digits:
        digits += 1
    return digits


def _positions(key: Column) -> list[Column]:
    """The bits of a key in a filter of 32,768."""
    return [F.shiftright(F.xxhash64(key, F.lit(seed)), 15 * i).bitwiseAND(F.lit(32767)) for seed in (1, 2) for i in range(4)]


def _has(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


class Ledger:
    """Entries (key, domain, name, ingested_at) under ``path``, their filters under ``path-filters``. Folders that have no filters, as those of a
    write that was cut off, are read whole."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.filters = spark, path.rstrip("/"), f"{path.rstrip('/')}-filters"
        self.opened: list[str] = []  # what the last lookup read

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, path: str) -> list[str]:
        where, fs = self._at(path)
        names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(n.removeprefix("batch=") for n in names if n.startswith("batch="))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(*paths)

    def _drop(self, run: str) -> None:
        for path in (self.filters, self.path):  # filters first: entries without them are still found
            where, fs = self._at(f"{path}/batch={run}")
            fs.delete(where, True)

    def runs(self) -> list[str]:
        """Names of the runs, whose number grows with the logarithm of the writes."""
        return self._folders(self.path)

    def enter(self, entries: DataFrame, run: str, n: int | None = None) -> None:
        """Write a run, in place of what it had; none if it has no entry. n: the number of entries, if known."""
        n = entries.count() if n is None else n
        self._drop(run)
        if not n:
            return
        files, blocks = _digits(n, FILE_ROWS), _digits(n, BLOCK_KEYS)
        bucket = lambda digest: F.concat(F.lit("x"), F.substring(digest, 1, files)).alias("bucket")
        own = entries.select(*LEDGER.fieldNames(), bucket(F.md5("key"))).repartition(16**files, "bucket").sortWithinPartitions("bucket", "key")
        own.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/batch={run}")
        keys = self._read([f"{self.path}/batch={run}"]).select(F.substring(F.md5("key"), 1, blocks).alias("block"), F.explode(F.array(*_positions(F.col("key")))).alias("at"))
        bits = keys.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits")).select(F.lit(blocks).alias("digits"), "block", bucket(F.col("block")), "bits")
        bits.sortWithinPartitions("block").write.mode("overwrite").parquet(f"{self.filters}/batch={run}")

    def entries_of(self, keys: DataFrame, but: str | None = None) -> DataFrame:
        """Entries that have all of the asked keys (key) that the ledger has, and others of the files that hold them; but: a run left out."""
        filtered = set(self._folders(self.filters))
        runs = [r for r in self.runs() if r != but]
        self.opened = [f"{self.path}/batch={r}" for r in runs if r not in filtered]
        if known := [f"{self.filters}/batch={r}" for r in runs if r in filtered]:
            filters = self.spark.read.schema(FILTER).option("basePath", self.filters).parquet(*known)
            lengths = F.array(*[F.lit(r["digits"]) for r in filters.select("digits").distinct().orderBy("digits").collect()])
            asked = keys.select("key").distinct().select("key", F.explode(lengths).alias("digits"))
            asked = asked.withColumn("block", F.substring(F.md5("key"), F.lit(1), F.col("digits")))
            every = functools.reduce(Column.__and__, [_has(F.col("bits"), p) for p in _positions(F.col("key"))])
            may = asked.join(filters, ["digits", "block"]).where(every).select("batch", "bucket").distinct()
            self.opened += sorted(f"{self.path}/batch={r['batch']}/bucket={r['bucket']}" for r in may.collect())
        return self._read(self.opened) if self.opened else self.spark.createDataFrame([], LEDGER)

    def merge(self, but: str | None = None) -> None:
        """Make one run of those of a level, where there are enough of them."""
        levels: dict[int, list[str]] = {}
        for run in self.runs():
            if run != but:
                levels.setdefault(int(run.split("-")[1]) if run.startswith("merged-") else 0, []).append(run)
        for level, names in sorted(levels.items()):
            if len(names) < FAN:
                continue
            held = self._read([f"{self.path}/batch={r}" for r in names])
            self.enter(held.dropDuplicates(["key"]), f"merged-{level + 1}-{uuid.uuid4().hex}", held.count())
            for run in names:
                self._drop(run)
