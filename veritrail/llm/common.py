"""Shared parts of the corpus operators: the scratch folder, Arrow maps, prefix sums and components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII whitespace: the separators of the contracts' words, and exactly what bytes.split() takes.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


class Scratch:
    """Tables written once to the folder that all executors share (spark.checkpoint.dir).

    A written table cuts lineage as checkpoint() does, is compressed, and survives the loss of
    any executor. Where the setting is absent (tests), a temporary folder of this machine is used.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="veritrail-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self._remove, self.root)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables of keep() that no later plan reads."""
        for df in frames:
            self._remove(df._scratch_path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of finished steps now: it does so when the driver's garbage is collected."""
        for _ in range(3):  # a proxy, then what it holds, then what that holds; the cleaner follows in its own thread
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def _remove(self, path: str) -> None:
        try:
            sc = self.spark.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session is gone; the folder belongs to it
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with functions that yield dicts of columns, cast to ``schema``."""
    target = T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(target)

    def run(batches):
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [cols[f.name] if isinstance(cols[f.name], pa.Array) else pa.array(cols[f.name], type=f.type) for f in arrow],
                schema=arrow,
            )
        _give_back()

    return df.mapInArrow(run, schema)


def _give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside the workers and the heap of later steps."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(name: str, taken: Sequence[str]) -> str:
    """A column name based on ``name`` that clashes with none of ``taken``, in any case of letters."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


class WordHash(dict):
    """64-bit hashes of byte words, remembered up to a bounded number of words."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scrambler (the xor-shift-multiply pattern)."""
    x = (x ^ (x >> np.uint64(31))) * _K1
    x = (x ^ (x >> np.uint64(29))) * _K2
    return x ^ (x >> np.uint64(32))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """What F.xxhash64 gives for a column of longs."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(v: np.ndarray, by: int) -> np.ndarray:
        return (v << np.uint64(by)) | (v >> np.uint64(64 - by))

    h = (np.uint64(42) + p5 + np.uint64(8)) ^ (turned(x.view(np.uint64) * p2, 31) * p1)
    h = turned(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words, in order; a shorter sequence gives one hash of all of it."""
    n = len(hashes)
    if not n:
        return hashes
    w = min(k, n)
    out = hashes[: n - w + 1] + np.uint64(w if w < k else 0)
    for j in range(1, w):
        out = mix(out) * _K2 + hashes[j : n - w + 1 + j]
    return mix(out)


def seeds(n: int, seed: int) -> np.ndarray:
    """n odd multipliers made from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _K2 + np.uint64(seed)) | np.uint64(1)


#: Repeated ids (long) up to which they are broadcast.
BROADCAST_IDS = 1_000_000


def row_keys(docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The rows with a doc_id as doc_id (a key of the row), id, text, if some rows share a doc_id; else None.

    The key is the doc_id where it is the row's alone, else a 64-bit hash of doc_id and text, so that rows of one doc_id with
    other texts are told apart and true copies are not.
    """
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), "text")
    often = scratch.keep(known.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit(True).alias("often")), "repeated")
    n = often.count()
    if not n:
        return None
    joined = known.join(F.broadcast(often) if n <= BROADCAST_IDS else often, "id", "left")
    return joined.select(F.when(F.col("often"), row_hash("id", "text")).otherwise(F.col("id")).alias("doc_id"), "id", "text")


def row_hash(doc_id, text) -> Column:
    return F.xxhash64(doc_id, F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")))


def running(df: DataFrame, scratch: Scratch, group: list[str], order: list[str], size: str) -> DataFrame:
    """Adds ``before`` (sum of ``size`` of earlier rows of the group), ``idx`` (their number) and ``group_total``.

    The rows are range-partitioned by (group, order), so a hot group spreads over many partitions;
    the totals per (group, partition) are as many as the partitions and groups, and their running
    sums are added to the running sums inside each partition. ``group`` columns must not be null.
    """
    placed = scratch.keep(
        df.repartitionByRange(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *group, *order).withColumn("pid", F.spark_partition_id()),
        "placed",
    )
    totals = placed.groupBy(*group, "pid").agg(F.sum(size).alias("part_sum"), F.count(F.lit(1)).alias("part_n"))
    prior = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("pid")
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    base = totals.select(
        *group,
        "pid",
        F.coalesce(F.sum("part_sum").over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_sum"),
        F.coalesce(F.sum("part_n").over(prior.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_n"),
        F.sum("part_sum").over(whole).alias("group_total"),
        F.sum("part_n").over(whole).alias("group_n"),
    )
    inside = Window.partitionBy(*group, "pid").orderBy(*order)
    return (
        placed.join(base, [*group, "pid"])
        .withColumn("before", F.col("base_sum") + F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("idx", F.col("base_n") + F.row_number().over(inside) - 1)
        .drop("base_sum", "base_n", "pid")
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b) of longs: rows (node, component), component the smallest node.

    Alternating large-star and small-star steps; every step is a min per node and a join, so a hub
    with millions of neighbours is a partial aggregate and a join that AQE may split, never a list.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        out = both.join(least, "a")
        if large:
            out = out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return out.filter("a > b").distinct()

    def kept(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = scratch.keep(e.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")), "edges")
        return out, (seen.get["n"], seen.get["h"])

    now, was = kept(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    while was[0]:
        nxt, got = kept(star(star(now, True), False))
        scratch.drop(now)
        now = nxt
        if got == was:
            break
        was = got
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def ascii_lower(c: Column) -> Column:
    """Lower-case of A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
