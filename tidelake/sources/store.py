"""A store with one row a key, whose appends read only files that may hold their keys.

A key's hash says its bucket.  Each version has a table of its own files: bucket, file, rows, smallest and largest hash, and a Bloom filter of
the hashes.  An append takes its batch's keys to the entries of their buckets; files that no filter admits aren't opened, so for
new keys the files read grow with the batch (and a filter's errors), not with the store.

A version is published by one rename of its file table; data of an append that failed, or that lost a race, is never read.  A writer that finds its version taken
checks its rows against the new versions' files and tries the next number, so keys stay unique with several writers.

Defined cases: of rows with equal keys in a batch any one is stored.  Null keys are keys.  An empty batch publishes nothing.  A path without versions has no store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.sources.staging import staged

_ENTRY = "bucket int, file string, rows long, low long, high long, bloom binary"
_PROBES, _BITS_A_KEY = 7, 10


def _spots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a filter: hashes x probes."""
    h = hashes.view(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(_PROBES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def bloom_of(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * _BITS_A_KEY // 8) * 8), bool)
    bits[_spots(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bloom: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(bloom, np.uint8))
    return bits[_spots(hashes, len(bits))].all(1)


@dataclass
class Appended:
    """What an append did."""

    rows: int
    files_read: int
    version: int | None


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _files(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        return at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        files, at = self._files()
        if not files.exists(at(f"{self.path}/_index")):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at(f"{self.path}/_index"))]
        return sorted(int(n[2:]) for n in names if n.startswith("v="))

    def index(self, since: int = -1) -> DataFrame | None:
        """The entries of all versions after one; a row a file."""
        found = [v for v in self.versions() if v > since]
        return self.spark.read.schema(_ENTRY).parquet(*[f"{self.path}/_index/v={v:09d}" for v in found]) if found else None

    def read(self) -> DataFrame:
        """All rows of all versions."""
        entries = self.index()
        if entries is None:
            raise ValueError(f"there is no store at {self.path}")
        names = sorted({r["run"] for r in entries.select(F.regexp_extract("file", r"(.*/_data/[^/]+)/", 1).alias("run")).distinct().collect()})  # a row a version
        return self._data(*names).drop("__hash", "bucket", "__b", "__run")

    def _data(self, *paths: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/_data").parquet(*paths)

    def _candidates(self, fresh: DataFrame, entries: DataFrame) -> list[str]:
        """Files that may hold a key of the batch: entries and the batch's hashes meet by bucket, in as many parts as the batch asks for."""

        def admit(key: tuple, hashes: pa.Table, files: pa.Table) -> pa.Table:
            h = np.unique(hashes.column("__hash").to_numpy())
            out = []
            for f in files.select(["file", "low", "high", "bloom"]).to_pylist() if len(h) else []:
                own = h[(h >= f["low"]) & (h <= f["high"])]
                if len(own) and may_hold(f["bloom"], own).any():
                    out.append(f["file"])
            return pa.table({"file": pa.array(out, pa.string())})

        by_bucket = fresh.select("bucket", "__hash").groupBy("bucket").cogroup(entries.groupBy("bucket"))
        return [r["file"] for r in by_bucket.applyInArrow(admit, "file string").collect()]  # files, bounded by the batch's keys

    def append(self, df: DataFrame) -> Appended:
        """Stores rows whose key isn't there."""
        spark, read, seen = self.spark, 0, -1
        marked = df.dropDuplicates(self.keys).withColumn("__hash", F.xxhash64(*self.keys))
        fresh = staged(marked.withColumn("bucket", F.pmod("__hash", F.lit(self.buckets)).cast("int")), "batch")
        files, at = self._files()
        while True:
            last = max(self.versions(), default=-1)  # before the entries are read: what is published in between is looked at in the next round
            entries = self.index(seen)
            if entries is not None:
                may = self._candidates(fresh, entries)
                read += len(may)
                if may:
                    there = self._data(*may).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(self.keys)], F.col("__hash").alias("__h"))
                    same = fresh["__hash"] == there["__h"]
                    for i, k in enumerate(self.keys):
                        same = same & fresh[k].eqNullSafe(there[f"__k{i}"])
                    fresh = staged(fresh.join(there, same, "left_anti"), "batch")
            seen = last
            n = fresh.count()
            if not n:
                return Appended(0, read, None)
            data = f"{self.path}/_data/__run={uuid.uuid4().hex}"
            # Files of one bucket each, in order of hashes, and the bucket stays a column.
            fresh.repartition(self.buckets, "bucket").sortWithinPartitions("bucket", "__hash").withColumn("__b", F.col("bucket")).write.partitionBy("__b").parquet(data)
            rows = spark.read.parquet(data).select("bucket", "__hash", F.input_file_name().alias("file"))

            def entry(key: tuple, own: pa.Table) -> pa.Table:
                h = own.column("__hash").to_numpy()
                return pa.table({"bucket": pa.array([key[1].as_py()], pa.int32()), "file": pa.array([key[0].as_py()]), "rows": pa.array([len(h)], pa.int64()), "low": pa.array([h.min()], pa.int64()), "high": pa.array([h.max()], pa.int64()), "bloom": pa.array([bloom_of(h)], pa.binary())})

            aside = f"{self.path}/_index/_{uuid.uuid4().hex}"
            rows.groupBy("file", "bucket").applyInArrow(entry, _ENTRY).write.parquet(aside)
            there = at(f"{self.path}/_index/v={last + 1:09d}")
            if not files.exists(there) and files.rename(at(aside), there):
                return Appended(n, read, last + 1)
            for lost in (aside, data):  # another writer was first: its files are looked at next
                files.delete(at(lost), True)
