"""Near-duplicate documents by a chosen-path set similarity join over min-hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, WordHash, arrow_map, components, fresh, mix, row_hash, row_keys, seeds, shingles, table

#: Words of a shingle, and the least intersection as a percentage of the union.
SHINGLE, PERCENT = 4, 80
#: Bins of the sketch that estimates similarity: a byte of the least hash in each, 0 for an empty bin.
BINS = 512
#: Independent trees. A pair of the least similarity 0.8 shares no first node with chance 0.2 ** TREES, and so many or fewer
#: first nodes with chance 0.00002: such pairs are not estimated.
TREES, FEW = 16, 4
#: Further min-hashes, a byte each, on which deeper nodes branch.
MORE = 32
#: A node is compared exhaustively if it has so many documents at most and makes so many comparisons at most: those of
#: documents outside of its largest component with all others.
SMALL, WORK = 20_000, 4_000_000
#: Min-hashes that one deeper branch takes together, and the chance of a second branch: on average (1 / 0.8) ** STEP
#: branches, so a pair at the least similarity keeps one shared node a level.
STEP, SECOND = 2, 0.5625
#: Pairs are compared in full if their estimate is less than so many deviations below the least similarity.
DEVIATIONS = 3.0
#: After so many levels the members of a node agree in nearly all min-hashes; what is still too large is dealt in cells, which hold
#: two chunks of so many members and together every pair.
LEVELS, CHUNK = 16, 1000

_A = seeds(TREES + MORE, 11)


def _sorted_set(raw: bytes, hashes: WordHash, k: int) -> np.ndarray:
    return np.unique(shingles(hashes.of(raw.lower().split()), k))


def _min_hashes(s: np.ndarray) -> np.ndarray:
    """The min-hash of each tree and further coordinate over the shingle hashes ``s`` (not empty)."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(least, (s[None, at : at + 4096] * _A[:, None]).min(1), out=least)
    return mix(least)


def _bins(s: np.ndarray) -> np.ndarray:
    """One byte of the least hash in each of BINS equal ranges of hashes; ``s`` is sorted."""
    out = np.zeros(BINS, np.uint8)
    at = (s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], at[1:] != at[:-1]])
    out[at[first]] = 1 + (mix(s[first]) % np.uint64(255)).astype(np.uint8)
    return out


def _likely(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which rows of two matrices of bins, of sets with so many shingles together, are similar enough to be compared in full.

    Used bins are drawn without replacement from the union (sizes / 1.8 at the least similarity), so the estimate of small
    sets hardly deviates.
    """
    used = np.maximum(((x | y) != 0).sum(1), 1)
    met = ((x == y) & (x != 0)).sum(1)
    left = np.clip(1 - used * 1.8 / sizes, 0.02, 1)
    return met >= used * (0.8 - DEVIATIONS * np.sqrt(0.8 * 0.2 * left / used)) - 1


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (identifies the set), sig (bins), more (bytes of min-hashes), roots (a node of each tree)."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            n, key, sig, more, roots = [], [], [], [], []
            for raw in batch.column(1).to_pylist():
                s = _sorted_set(raw, hashes, k)
                n.append(len(s))
                if not len(s):
                    key.append(None), sig.append(None), more.append(None), roots.append(None)
                    continue
                mixed = mix(s)
                key.append(np.array([mixed.sum(), np.bitwise_xor.reduce(mix(mixed)), len(s)], np.uint64).tobytes())
                h = _min_hashes(s)
                sig.append(_bins(s).tobytes())
                more.append(h[TREES:].astype(np.uint8).tobytes())
                roots.append(mix(h[:TREES] + np.arange(TREES, dtype=np.uint64)).astype("<u8").tobytes())
            yield {"doc_id": batch.column(0), "n_shingles": n, "set_key": key, "sig": sig, "more": more, "roots": roots}

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return arrow_map(source, run, "doc_id long, n_shingles long, set_key binary, sig binary, more binary, roots binary")


def _first_nodes(classes: DataFrame) -> DataFrame:
    """(rep, tree, node) of the representatives' first nodes."""

    def run(batches):
        for batch in batches:
            nodes = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i8")
            yield {"rep": np.repeat(batch.column(0).to_numpy(), TREES), "tree": np.tile(np.arange(TREES, dtype=np.int32), len(batch)), "node": nodes}

    return arrow_map(classes.select("rep", "roots"), run, "rep long, tree int, node long")


def _estimated(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is high enough."""
    joined = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n").alias("n_b")), "b")

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (2, 3))
            keep = _likely(x, y, batch.column(4).to_numpy())
            yield {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    return arrow_map(joined.select("a", "b", "sig_a", "sig_b", F.col("n_a") + F.col("n_b")), run, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are similar enough. Only documents of pairs are read into sets, once."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    involved = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw")).join(ids, "doc_id", "left_semi")

    def read(batches):
        hashes = WordHash()
        for batch in batches:
            got = [_sorted_set(x, hashes, k) for x in batch.column(1).to_pylist()]
            yield {"doc_id": batch.column(0), "members": [x.tobytes() for x in got]}

    sets = scratch.keep(arrow_map(involved, read, "doc_id long, members binary").dropDuplicates(["doc_id"]), "sets")
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").join(
        sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b"
    )

    def compare(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield {"a": batch.column(0).to_numpy()[keep], "b": batch.column(1).to_numpy()[keep]}

    links = scratch.keep(arrow_map(joined.select("a", "b", "x", "y"), compare, "a long, b long"), "links")
    scratch.drop(sets)
    return links


def _across(rep, comp, n, smalls, sig, roots, tree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a node's members in different components that are likely links. A pair that shares several first nodes is
    made in that of the lowest tree only whose node is small (a bit of ``smalls``; tree is -1 in deeper nodes)."""
    labels, size = np.unique(comp, return_counts=True)
    outside = np.flatnonzero(comp != labels[size.argmax()])
    a_out, b_out = [], []
    step = max(1, (1 << 18) // len(rep))
    for at in range(0, len(outside), step):
        u = outside[at : at + step]
        differ = comp[u][:, None] != comp[None]
        differ &= ~((np.isin(np.arange(len(rep)), outside)[None]) & (np.arange(len(rep))[None] < u[:, None]))  # once per pair
        shared = np.zeros(differ.shape, np.int8)
        for t in range(TREES):
            shared += roots[u, t][:, None] == roots[:, t][None]
        i, j = np.nonzero(differ & (shared > FEW))
        i = u[i]
        if tree >= 0 and len(i):
            here = (smalls[i][:, None] >> np.arange(TREES) & 1).astype(bool)
            own = ((roots[i] == roots[j]) & here).argmax(1) == tree
            i, j = i[own], j[own]
        for lo in range(0, len(i), 1 << 12):
            x, y = i[lo : lo + (1 << 12)], j[lo : lo + (1 << 12)]
            good = _likely(sig[x], sig[y], n[x] + n[y])
            a_out.append(rep[x[good]])
            b_out.append(rep[y[good]])
    if not a_out:
        return rep[:0], rep[:0]
    a, b = np.concatenate(a_out), np.concatenate(b_out)
    return np.maximum(a, b), np.minimum(a, b)


def _exhaustive(members: DataFrame) -> DataFrame:
    """Likely links within small nodes. ``members``: node, tree, rep, comp, n, smalls, sig, roots."""

    def run(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is None:
                now, rest = rest, None
            else:
                cols = [batch.column(i).to_numpy() for i in range(6)]
                cols += [np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(-1, BINS), np.frombuffer(b"".join(batch.column(7).to_pylist()), "<i8").reshape(-1, TREES)]
                now = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
                last = int(np.searchsorted(now[0], now[0][-1]))  # the last node may go on in the next batch
                now, rest = [x[:last] for x in now], [x[last:] for x in now]
            if now is None or not len(now[0]):
                continue
            cuts = np.flatnonzero(np.diff(now[0])) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(now[0])]):
                _, tree, rep, comp, n, smalls, sig, roots = (x[lo:hi] for x in now)
                a, b = _across(rep, comp, n, smalls, sig, roots, int(tree[0]))
                if len(a):
                    yield {"a": a, "b": b}

    dealt = members.select("node", "tree", "rep", "comp", "n", "smalls", "sig", "roots").repartition("node").sortWithinPartitions("node")
    return arrow_map(dealt, run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def _branched(members: DataFrame) -> DataFrame:
    """The members in the children of their nodes: which min-hashes a child takes follows from its parent alone."""

    def run(batches):
        for batch in batches:
            node = batch.column(0).to_numpy().view(np.uint64)
            more = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, MORE)
            row = np.arange(len(node))
            keys, rows = [], []
            for child in (1, 2):
                at = mix(node + np.uint64(child))
                taken = row if child == 1 else row[mix(node) >> np.uint64(40) < np.uint64(int(SECOND * 2**24))]
                key = at.copy()
                for j in range(STEP):
                    coordinate = (at >> np.uint64(7 * j + 3)) % np.uint64(MORE)
                    key = mix(key ^ more[row, coordinate.astype(np.int64)].astype(np.uint64))
                keys.append(key[taken])
                rows.append(taken)
            kept = batch.take(pa.array(np.concatenate(rows)))
            yield {"node": np.concatenate(keys).view(np.int64), "tree": np.full(len(kept), -1, np.int32), "rep": kept.column(1)}

    return arrow_map(members.select("node", "rep", "more"), run, "node long, tree int, rep long")


def _cells(large: DataFrame) -> DataFrame:
    """The members of large nodes in cells of two chunks each, so that every pair meets in one cell at least."""
    dealt = large.withColumn("chunks", F.ceil(F.col("n") / CHUNK)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks"))).withColumn("other", F.explode(F.expr("sequence(0L, chunks - 1)")))
    return dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), F.lit(-1).alias("tree"), "rep", "comp", F.lit(0).alias("smalls"))


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept; see _of_unique for the method.

    A row stands for its own text: of rows that share a doc_id each has the component of its text, named by the smallest
    doc_id in it, and is kept if that is its doc_id. Rows without doc_id are kept, with a null component.
    """
    keyed = row_keys(docs, scratch)
    if keyed is None:
        return _of_unique(docs, scratch, k, percent)
    got = _by_key(keyed, scratch, k, percent)
    rows = keyed.select("doc_id").join(got, "doc_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    return rows.union(_of_unique(docs.filter("doc_id is null"), scratch, k, percent))


def _by_key(keyed: DataFrame, scratch: Scratch, k: int, percent: int) -> DataFrame:
    """For each key of row_keys: doc_id (the key), id, n_shingles, least (the smallest id of its component), stays (one key of each component)."""
    got = scratch.keep(_of_unique(keyed.dropDuplicates(["doc_id"]), scratch, k, percent).join(keyed.select("doc_id", "id").distinct(), "doc_id"), "keys")
    least = got.groupBy("component_id").agg(F.min(F.struct("id", "doc_id")).alias("m"))
    return got.join(least, "component_id").select("doc_id", "id", "n_shingles", F.col("m.id").alias("least"), (F.col("doc_id") == F.col("m.doc_id")).alias("stays"))


def _of_unique(docs: DataFrame, scratch: Scratch, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``, whose doc_ids are unique or null: doc_id, n_shingles, component_id, kept.

    1. Each document's distinct k-word shingles are sketched; documents with the same set form a class, whose
       representative is the smallest doc_id.
    2. Representatives are put in the first nodes of TREES trees. Every member is paired with the least member of its node;
       each document's pair that shares most trees is confirmed on full sets. This links most of a group of copies,
       however large, by as many pairs as members.
    3. Nodes whose members are not yet in one component go on. If few comparisons are left, the members outside of the
       node's largest component are compared with all others; else the node branches on min-hashes that it chooses itself,
       and its members are paired with the ends of the new nodes. Likely links between components are confirmed on full sets.
    4. Connected components of the confirmed links; a document is kept if it is the smallest of its component.

    Recall: a pair at the least similarity shares a first node with chance 1 - 0.2 ** 16 and passes the estimate with
    chance 0.998; more similar pairs more often. It is compared in the lowest of these nodes that is small. Only if all of
    them are large does it rest on the branches: a shared node keeps a shared child with chance 0.77 a level, and over all
    its shared nodes the pair keeps one with chance 0.9995 for 4 levels, 0.991 for 8 and 0.935 for 16, if branches were
    independent (a calculation, not a measurement). Documents of fewer shingles than bins are estimated nearly exactly. Null or empty texts have no shingles and stand alone. A very
    long text is one set, read whole. Equal sets tie, and the smallest doc_id represents them. Rows without doc_id are kept,
    with a null component. An empty table gives no rows. Extra columns are ignored.
    """
    known = docs.filter("doc_id is not null")
    sketched = scratch.keep(sketches(docs, k), "sketches")
    full = sketched.filter("set_key is not null and doc_id is not null")
    classes = scratch.keep(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), *[F.first(c).alias(c) for c in ("sig", "more", "roots")]), "classes")
    nodes0 = scratch.keep(_first_nodes(classes), "nodes")

    least = nodes0.groupBy("node").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("node", "b")
    led = nodes0.join(least, "node").filter("rep > b").groupBy(F.col("rep").alias("a"), "b").agg(F.count(F.lit(1)).alias("trees")).filter(F.col("trees") > FEW)
    nearest = scratch.keep(led.groupBy("a").agg(F.max_by("b", F.struct("trees", -F.col("b"))).alias("b")), "pairs")
    links = _confirmed(nearest, known, scratch, k, percent)
    comps = scratch.keep(components(links, scratch), "components")

    def across(pairs: DataFrame) -> DataFrame:
        one, two = comps.select(F.col("node").alias("a"), F.col("component").alias("ca")), comps.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        return pairs.join(one, "a", "left").join(two, "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    candidates = []
    front = nodes0
    for level in range(LEVELS):
        placed = front.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("node", "tree", "rep", F.coalesce("component", "rep").alias("comp"))
        parts = placed.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("lo"), F.max("rep").alias("hi"))
        mixed = parts.groupBy("node").agg(F.sum("m").alias("n"), F.max("m").alias("most"), F.count(F.lit(1)).alias("n_comps"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("n_comps > 1")
        nodes = scratch.keep(mixed.withColumn("small", (F.col("n") <= SMALL) & (F.col("n") * (F.col("n") - F.col("most")) <= WORK)), "nodes")
        members = scratch.keep(placed.join(nodes, "node"), "members")
        features = classes.select("rep", "n", "sig", "roots")
        within = members.filter("small").select("node", "tree", "rep", "comp")
        if level:
            within = within.withColumn("smalls", F.lit(0))
        else:  # the trees in which a member's first node is compared here
            within = within.join(within.groupBy("rep").agg(F.expr("bit_or(shiftleft(1, tree))").alias("smalls")), "rep")
        candidates.append(scratch.keep(_exhaustive(within.join(features, "rep")), "pairs"))
        large = members.filter("not small")
        if level:  # the first nodes' least members are done
            ends = large.select(F.explode(F.array(F.struct(F.col("rep").alias("a"), F.col("lo").alias("b")), F.struct(F.col("hi").alias("a"), F.col("rep").alias("b")))).alias("p")).select("p.*").filter("a > b").distinct()
            candidates.append(scratch.keep(_estimated(across(ends), classes.select("rep", "n", "sig")), "pairs"))
        if not large.head(1):
            break
        if level == LEVELS - 1:
            candidates.append(scratch.keep(_exhaustive(_cells(large).join(features, "rep")), "pairs"))
            break
        front = scratch.keep(_branched(large.join(classes.select("rep", "more"), "rep")), "front")
    pairs = candidates[0]
    for c in candidates[1:]:
        pairs = pairs.union(c)
    more = _confirmed(scratch.keep(pairs.distinct(), "pairs"), known, scratch, k, percent)
    comps = scratch.keep(components(links.union(more), scratch), "components")
    label = classes.select("set_key", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return sketched.select("doc_id", "n_shingles", "set_key").join(label, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce("component", "doc_id") == F.col("doc_id"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that represent their component, all columns unchanged: those of its smallest doc_id.

    Rows that share a doc_id are judged each by its text, so a text goes only if a similar one stays.
    """
    names = docs.columns
    keyed = row_keys(docs, scratch)
    if keyed is None:
        gone = scratch.keep(_of_unique(docs, scratch, k, percent).filter("not kept").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in names])
    got = _by_key(keyed, scratch, k, percent)
    key, gone_key = fresh("row_key", names), fresh("gone_key", names)
    gone = scratch.keep(got.filter("not stays").select(F.when(F.col("id") == F.col("doc_id"), F.lit(None)).otherwise(F.col("doc_id")).alias("hash"), F.col("doc_id").alias(gone_key)), "gone")
    row = docs.withColumn(key, row_hash(F.col("doc_id").cast("long"), F.col("text")))
    alone = gone.filter("hash is null").select(F.col(gone_key).alias("doc_id"))
    left = row.join(gone.filter("hash is not null").select(F.col(gone_key).alias(key)), key, "left_anti").join(alone, "doc_id", "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in names])


def op4_minhash_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark))


OP4_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < {SHINGLE} THEN md5(array_to_string(words, ' ')) ELSE md5(array_to_string(words[i:i + {SHINGLE - 1}], ' ')) END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - {SHINGLE - 1}) + 1)) AS i FROM w WHERE len(words) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
sym AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sym s ON s.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
