"""The negative knowledge base: a log of rejections and revocations folded to its last state, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["subject", "object"]
SIMILAR = 0.85
#: Fingerprints whose places are all below this are compared as bit maps, others meet on their rare places.
PLACES = 4096
#: A group of n rows is cut into sqrt(n / CUT) chunks, so a cell of two chunks has about CUT * n pairs. Pairs and words of bit maps compared at once.
CUT, AT_ONCE = 1024, 1 << 16


def fold(log: DataFrame) -> DataFrame:
    """The last act of every key by sequence: a partial aggregate, no sort."""
    return log.groupBy(*KEY).agg(F.max_by("act", "seq").alias("act"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_acts"))


def rejected(log: DataFrame) -> DataFrame:
    return fold(log).filter("act = 'reject'").select(*KEY, "seq")


def sign_bits(vector: Column) -> Column:
    """The places of a vector's positive entries: a set fingerprint."""
    return F.filter(F.transform(vector, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())


def tanimoto(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def similar(items: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) of one group whose fingerprints ``bits`` have at least ``least`` Tanimoto similarity.

    ``bits`` holds places from 0. Where all are below PLACES every pair of a group is compared as bit maps; a prefix filter keeps
    few pairs apart when bits are dense. Else pairs meet on rare places. Nulls are in no pair.
    """
    known = items.filter(F.col("id").isNotNull() & F.col("group").isNotNull() & F.col("bits").isNotNull())
    low, high = known.agg(F.min(F.array_min("bits")), F.max(F.array_max("bits"))).first()
    if high is None or low >= 0 and high < PLACES:
        return _similar_maps(known, least)
    return _similar_sets(known, least)


def _similar_maps(items: DataFrame, least: float) -> DataFrame:
    """``similar`` of dense fingerprints: rows are dealt to cells of two chunks of their group, so a group of any size is many tasks."""

    def maps(batches):
        for batch in batches:
            bits = batch.column("bits")
            ends = np.concatenate([[0], np.cumsum(batch.column("n").to_numpy())]).astype(np.int64)
            flat = bits.flatten().to_numpy(zero_copy_only=False)
            wide = 64 * (int(flat.max()) // 64 + 1 if len(flat) else 1)
            rows = max(1, (1 << 24) // wide)
            out = []
            for at in range(0, len(batch), rows):
                end = min(len(batch), at + rows)
                on = np.zeros((end - at, wide), np.uint8)
                on[np.repeat(np.arange(end - at), np.diff(ends[at : end + 1])), flat[ends[at] : ends[end]]] = 1
                out += [x.tobytes() for x in np.packbits(on, axis=1, bitorder="little")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), pa.array(out, pa.binary())], ["id", "group", "map"])

    def cell(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        for a, b, similarity in _cell_pairs(key[1].as_py() == key[2].as_py(), *(rows.column(c).to_numpy() for c in ("id", "left")), rows.column("map").to_pylist(), least):
            yield pa.RecordBatch.from_arrays([pa.array(a, ids), pa.array(b, ids), pa.array(similarity)], ["a", "b", "similarity"])

    kinds = {f.name: f.dataType for f in items.schema.fields}
    ids = pa.int32() if kinds["id"].typeName() == "integer" else pa.int64()
    id_, group = kinds["id"].simpleString(), kinds["group"].simpleString()
    sets = items.select("id", "group", F.filter("bits", lambda x: x.isNotNull()).alias("bits")).withColumn("n", F.size("bits"))
    packed = sets.mapInArrow(maps, f"id {id_}, `group` {group}, map binary")
    chunks = F.ceil(F.sqrt(F.count(F.lit(1)) / CUT)).cast("int")
    dealt = packed.join(items.groupBy("group").agg(chunks.alias("chunks")), "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)"))).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    n = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, for cells are small in bytes, not in pairs
    cells = dealt.select("id", "group", "map", "i", "j", (F.col("own") == F.col("i")).alias("left")).repartition(n, "group", "i", "j")
    return cells.groupBy("group", "i", "j").applyInArrow(cell, f"a {id_}, b {id_}, similarity double")


def _cell_pairs(alone: bool, ids: np.ndarray, left: np.ndarray, maps: list[bytes], least: float):
    """(a, b, similarity) of the similar pairs of a left and a right row; if ``alone`` of any two rows, of which all are left."""
    words = max(len(m) for m in maps) // 8
    x = np.frombuffer(b"".join(m.ljust(8 * words, b"\0") for m in maps), "<u8").reshape(-1, words)
    size = np.bitwise_count(x).sum(1, dtype=np.int64)
    order = np.argsort(size, kind="stable")
    ids, left, x, size = ids[order], left[order], x[order], size[order]
    total = np.arange(128 * words + 1)  # places of two sets
    common = np.maximum(np.floor(least * total / (1 + least)).astype(np.int64) - 1, 0) + np.arange(4)[:, None]
    enough = np.where(total > common, common / np.maximum(total - common, 1), 0.0) >= least
    need = np.where(enough.any(0), common[enough.argmax(0), total], 64 * words + 1).astype(np.uint8 if words < 4 else np.int32)  # least common places
    a, b = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(left), np.flatnonzero(~left))
    columns = np.ascontiguousarray(x[b].T)
    out, held = [], 0
    cuts = np.flatnonzero(np.diff(size[a])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(a)]):
        if lo == hi or not len(b):
            continue
        n = int(size[a[lo]])
        wanted = need[n + size[b]]
        fit = np.flatnonzero(wanted <= np.minimum(n, size[b]))  # sizes allow it
        if not len(fit):
            continue
        first, last = int(fit[0]), int(fit[-1]) + 1
        step = max(1, AT_ONCE // (last - first))
        for at in range(lo, hi, step):
            end = min(hi, at + step)
            begin = max(first, at) if alone else first  # the others met before
            if begin >= last:
                break
            shared = np.bitwise_count(x[a[at:end], 0][:, None] & columns[0, begin:last])
            for w in range(1, words):
                shared = shared + np.bitwise_count(x[a[at:end], w][:, None] & columns[w, begin:last]).astype(need.dtype)
            p, q = np.nonzero(shared >= wanted[begin:last])
            if len(p):
                common_ = shared[p, q].astype(np.int64)
                p, q = a[at + p], b[begin + q]
                keep = (ids[p] != ids[q]) & ((p < q) if alone else True)
                p, q, common_ = p[keep], q[keep], common_[keep]
                union_ = n + size[q] - common_
                out.append((np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), common_ / np.maximum(union_, 1)))
                held += len(p)
                if held >= AT_ONCE:
                    yield [np.concatenate(c) for c in zip(*out)]
                    out, held = [], 0
    if out:
        yield [np.concatenate(c) for c in zip(*out)]


def _similar_sets(items: DataFrame, least: float) -> DataFrame:
    """``similar`` of sparse fingerprints.

    Exact prefix filter: with bits in one order from rare to frequent, two such sets share one of the first
    n - ceil(least * n) + 1 bits of each, so pairs meet on (group, bit) there instead of all within a group; sizes must fit too.
    """
    freq = items.select("group", F.explode("bits").alias("bit")).groupBy("group", "bit").agg(F.count(F.lit(1)).alias("f"))
    ordered = items.select("id", "group", F.size("bits").alias("n"), F.explode("bits").alias("bit")).join(freq, ["group", "bit"]).groupBy("id", "group", "n").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("f", "bit"))), lambda x: x["bit"]).alias("by_rarity")  # the bits of one fingerprint
    )
    prefix = ordered.select("id", "group", "n", F.explode(F.slice("by_rarity", F.lit(1), F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1)).alias("bit"))
    other = prefix.select(F.col("id").alias("b"), "group", F.col("n").alias("nb"), "bit")
    met = prefix.withColumnRenamed("id", "a").withColumnRenamed("n", "na").join(other, ["group", "bit"]).filter("a < b")
    met = met.filter((F.col("na") >= F.col("nb") * least) & (F.col("nb") >= F.col("na") * least)).select("a", "b").distinct()
    one, two = items.select(F.col("id").alias("a"), F.col("bits").alias("x")), items.select(F.col("id").alias("b"), F.col("bits").alias("y"))
    return met.join(one, "a").join(two, "b").withColumn("similarity", tanimoto(F.col("x"), F.col("y"))).filter(F.col("similarity") >= least).select("a", "b", "similarity")


def consulted(hypotheses: DataFrame, log: DataFrame) -> DataFrame:
    """Each hypothesis with the knowledge base's answer: block (rejected), clear (revoked), unknown (never decided)."""
    state = fold(log).select(*KEY, "act")
    return hypotheses.join(state, KEY, "left").withColumn("answer", F.when(F.col("act") == "reject", "block").when(F.col("act") == "revoke", "clear").otherwise("unknown"))
