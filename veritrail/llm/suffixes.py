"""Exact substring deduplication by a logarithmic family of sparse suffix arrays.

A text's suffixes are sampled at the minimizers of its windows of MATCH bytes: equal windows choose the same
suffix, so two texts that share MATCH bytes share a sampled suffix, at one distance from the match. A run is the
windows in a row that choose one suffix; what matters of the suffix is its first GRAM bytes (``key``) and the bytes
that the run's windows cover (``context``). Suffix arrays are the runs sorted by key.

Every batch of documents gets suffix arrays, one per key range. In each range the batches' arrays are scanned against
the levels of the family (sorted arrays of geometrically growing size) and then join it; levels of about equal size are
merged. A run whose whole context is in a smaller document is old. Runs with one key but several contexts are settled
window by window, on the bytes that they cover. Whole texts never meet.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, mix, running, seeds, spark_hash, table
from .packing import dealt, join, pack, ranges, split, unpack, values

#: Bytes of a match, and of a sampled suffix's key.
MATCH, GRAM = 50, 20
_W = MATCH - GRAM + 1
#: Bytes of text that are sampled at once; longer texts are cut into pieces that overlap by MATCH - 1 bytes.
PIECE = 1 << 21
#: Bytes of text of one batch of documents.
BATCH = 1 << 24
#: Contexts of a key that a batch hands on; more are settled window by window.
CONTEXTS = 64
#: Bits of a document's key that tell rows of one doc_id with other texts apart; ids that do not fit beside them become ranks.
TAG = 16
#: Bytes of open runs of one range that are settled at once; more are dealt out by window first.
SETTLE = 1 << 24
_POS = np.uint64((1 << 24) - 1)
_C = seeds(8, 5)
_T = mix(np.arange(256, dtype=np.uint64) * _C[0] + _C[1])
OLD, OPEN = 0, 1


class _Powers:
    """Powers of an odd base modulo 2 ** 64, and of its inverse, made once per worker."""

    base = int(_C[2])
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, PIECE + 2 * MATCH)
            cls.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, cls.base, np.uint64)]), dtype=np.uint64)
            cls.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, pow(cls.base, -1, 1 << 64), np.uint64)]), dtype=np.uint64)
        return cls.up[:n], cls.down[:n]


def _prefix(b: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] a hash of b[i:j] times the i-th power."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_T[b] * _Powers.upto(len(b))[0], out=out[1:])
    return out


def _hash(s: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    down = _Powers.upto(len(s))[1]
    return mix((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(np.uint64) * _C[3])


def _words64(b: np.ndarray, n: int, at: int) -> np.ndarray:
    """The 8 bytes from each of the first n positions, shifted by ``at``, as numbers."""
    return np.ndarray((n,), "<u8", b.data, at, (1,))


def _grams(b: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    n = len(b) - GRAM + 1
    h = _words64(b, n, 0) * _C[4] ^ _words64(b, n, 8) * _C[5]
    h ^= h >> np.uint64(32)
    h += _words64(b, n, GRAM - 8)
    return mix(h)


def runs(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, key, context) of the runs in texts that end at ``ends`` of the buffer ``b``."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(b) < MATCH:
        return none
    n = len(b) - GRAM + 1
    h = _grams(b)
    v = h & ~_POS
    v |= np.arange(n, dtype=np.uint64)
    least = v
    width = 1
    while 2 * width <= _W:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - _W + 1], least[_W - width :])
    good = np.ones(len(least), bool)
    bad = (ends[:, None] - np.arange(1, MATCH)[None]).ravel()  # windows that reach beyond their text
    good[bad[(bad >= 0) & (bad < len(good))]] = False
    at = np.flatnonzero(good)
    if not len(at):
        return none
    chosen = least[at]
    cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    lo, hi = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    key = mix(h[(chosen[np.concatenate([[0], cut])] & _POS).astype(np.int64)])
    return lo, hi - lo + 1, key, _hash(_prefix(b), lo, hi + MATCH)


def _pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Buffers of about PIECE bytes: (bytes, [(index of the text, where in the text the part begins)] with the parts joined)."""
    parts, held, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - MATCH + 1), PIECE):
            part = t[at : at + PIECE + MATCH - 1]
            if len(part) < MATCH:
                continue
            if size + len(part) > PIECE and held:
                yield parts, held
                parts, held, size = [], [], 0
            parts.append(part)
            held.append((i, at))
            size += len(part)
    if held:
        yield parts, held


def batch_runs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All runs of a batch of texts: doc (index), lo (first window), n (windows), key, ctx."""
    out = {c: [] for c in ("doc", "lo", "n", "key", "ctx")}
    for parts, held in _pieces(texts):
        b = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        lo, n, key, ctx = runs(b, ends)
        part = np.searchsorted(ends, lo, side="right")
        starts = ends - [len(p) for p in parts]
        doc, base = np.array([i for i, _ in held]), np.array([at for _, at in held])
        for c, x in (("doc", doc[part]), ("lo", lo - starts[part] + base[part]), ("n", n), ("key", key), ("ctx", ctx)):
            out[c].append(x)
    kinds = {"doc": np.int64, "lo": np.int64, "n": np.int64, "key": np.uint64, "ctx": np.uint64}
    return {c: np.concatenate(x) if x else np.zeros(0, kinds[c]) for c, x in out.items()}


def _spans(docs: np.ndarray, lo: np.ndarray, n: np.ndarray, kind: np.ndarray, n_ranges: int) -> dict:
    """Rows of packed spans for the documents' ranges: range, kind_of_row, and the arrays in one value."""
    out = {"part": [], "data": []}
    r = spark_hash(docs) % n_ranges
    order = np.lexsort((lo, docs, r))
    docs, lo, n, kind, r = docs[order], lo[order], n[order], kind[order], r[order]
    cuts = np.flatnonzero(np.diff(r)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(r)]):
        if b > a:
            ids, at = np.unique(docs[a:b], return_inverse=True)
            out["part"].append(int(r[a]))
            out["data"].append(join(zlib.compress(ids.astype("<i8").tobytes(), 1), pack(at.astype(np.uint64), 4), pack(lo[a:b].astype(np.uint64), 5), pack((n[a:b] * 2 + kind[a:b]).astype(np.uint64), 5)))
    return out


def _read_spans(raw: bytes) -> tuple[np.ndarray, ...]:
    ids, at, lo, n = split(raw, 4)
    n = unpack(n, 5).astype(np.int64)
    return np.frombuffer(zlib.decompress(ids), "<i8")[unpack(at, 4).astype(np.int64)], unpack(lo, 5).astype(np.int64), n >> 1, n & 1


class Level:
    """A suffix array of the family: rows sorted by key, then context; the rows of one context are of one document.
    ``open``: the row's key has several contexts, and the row is among the found spans."""

    def __init__(self, key, ctx, doc, lo, n, open_) -> None:
        self.key, self.ctx, self.doc, self.lo, self.n, self.open = key, ctx, doc, lo, n, open_
        self.place = (key << np.uint64(24)) | (ctx & _POS)

    def take(self, at) -> Level:
        return Level(*(x[at] for x in (self.key, self.ctx, self.doc, self.lo, self.n, self.open)))

    def find(self, place: np.ndarray) -> np.ndarray:
        """The first row at or after each place (the last row if there is none)."""
        return np.minimum(np.searchsorted(self.place, place), len(self.place) - 1)


class Family:
    """The levels, from large to small, and what they settle: spans (doc, lo, n, kind) with kind OLD or OPEN.

    A new row whose context is known from a smaller document is old. A new row whose key is known by other contexts only
    is open, and so are the key's other rows. A key keeps CONTEXTS contexts of a batch at most: further ones are open at
    once, and settled with all open runs, window by window.
    """

    def __init__(self) -> None:
        self.levels: list[Level] = []
        self.found: list[tuple] = []

    def _settle(self, rows: Level, kind: int) -> None:
        if len(rows.doc):
            self.found.append((rows.doc, rows.lo, rows.n, np.full(len(rows.doc), kind)))

    def add(self, new: Level) -> None:
        """Scan a batch's array against every level, then make it a level."""
        known = np.zeros(len(new.key), bool)
        opens = new.open.copy()
        for level in self.levels:
            if not len(level.key) or not len(new.key):
                continue
            at = level.find(new.place)
            hit = (level.key[at] == new.key) & (level.ctx[at] == new.ctx)
            later = hit & (new.doc >> TAG > level.doc[at] >> TAG)
            first = hit & (new.doc >> TAG < level.doc[at] >> TAG)
            self._settle(new.take(later), OLD)
            known |= later
            opens |= hit & level.open[at]
            if first.any():  # the level's rows are of a greater document than the new ones
                gone = np.isin(level.place, new.place[first]) & np.isin(level.ctx, new.ctx[first])
                self._settle(level.take(gone), OLD)
                self._replace(level, ~gone)
        rest = new.take(~known)
        rest.open = opens[~known]
        if len(rest.key):  # several contexts of one key, within the batch or beside a level's
            head = np.concatenate([[True], rest.key[1:] != rest.key[:-1]])
            group = np.cumsum(head) - 1
            change = np.concatenate([[False], (rest.key[1:] == rest.key[:-1]) & (rest.ctx[1:] != rest.ctx[:-1])])
            several = np.bincount(group, change) > 0
            keys = rest.key[head]
            for level in self.levels:
                if len(level.key):
                    several |= self._other_context(level, keys, rest.ctx[head])
            rest.open = rest.open | several[group]
            for level in self.levels:
                if len(level.key):
                    spot = np.minimum(np.searchsorted(keys, level.key), len(keys) - 1)
                    met = (keys[spot] == level.key) & several[spot] & ~level.open
                    self._settle(level.take(met), OPEN)
                    level.open = level.open | met
            self._settle(rest.take(rest.open), OPEN)
        self.levels.append(rest)
        while len(self.levels) > 1 and 2 * len(self.levels[-1].key) >= len(self.levels[-2].key):
            self.levels.append(_merged([self.levels.pop(), self.levels.pop()]))

    @staticmethod
    def _other_context(level: Level, keys: np.ndarray, ctx: np.ndarray) -> np.ndarray:
        """Whether the level has each key with another context than the given one."""
        lo = np.searchsorted(level.place, keys << np.uint64(24))
        hi = np.searchsorted(level.place, (keys << np.uint64(24)) | _POS, side="right")
        at = np.minimum(lo, len(level.key) - 1)
        last = np.maximum(hi - 1, 0)
        return (hi > lo) & ((level.ctx[at] != ctx) | (level.ctx[last] != ctx))

    @staticmethod
    def _replace(level: Level, keep: np.ndarray) -> None:
        kept = level.take(keep)
        level.__dict__.update(kept.__dict__)


def _merged(levels: list[Level]) -> Level:
    every = Level(*(np.concatenate([getattr(x, c) for x in levels]) for c in ("key", "ctx", "doc", "lo", "n", "open")))
    return every.take(np.argsort(every.place, kind="stable"))


def _batch_array(r: dict[str, np.ndarray], ids: np.ndarray, n_ranges: int) -> tuple[Level, tuple]:
    """A batch's suffix array, with what the batch settles by itself. Keys become their range and 40 bits, contexts 40 bits."""
    doc = ids[r["doc"]]
    key, ctx = (r["key"] & _POS) % np.uint64(n_ranges) | r["key"] & ~_POS, r["ctx"] >> np.uint64(24)
    order = np.lexsort((doc, ctx, key))
    key, ctx, doc, lo, n = key[order], ctx[order], doc[order], r["lo"][order], r["n"][order]
    head_key = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    head_ctx = head_key | np.concatenate([[True], ctx[1:] != ctx[:-1]]) if len(key) else head_key
    group = np.cumsum(head_ctx) - 1
    old = doc >> TAG > doc[np.flatnonzero(head_ctx)][group] >> TAG if len(key) else np.zeros(0, bool)
    nth = group - group[np.flatnonzero(head_key)][np.cumsum(head_key) - 1] if len(key) else group  # of the key's contexts
    wide = ~old & (nth >= CONTEXTS)
    settled = old | wide
    out = Level(*(x[~settled] for x in (key, ctx, doc, lo, n)), np.zeros(int((~settled).sum()), bool))
    return out, (doc[settled], lo[settled], n[settled], np.where(old, OLD, OPEN)[settled])


def _suffix_rows(docs: DataFrame, n_ranges: int) -> DataFrame:
    """part (key range, or -1 - document range), first (smallest doc_id of the batch), data."""

    def rows_of(ids: np.ndarray, texts: list[bytes]) -> dict:
        level, settled = _batch_array(batch_runs(texts), ids, n_ranges)
        local = _spans(*settled, n_ranges)
        parts, data = [-1 - p for p in local["part"]], local["data"]
        r = (level.key & _POS).astype(np.int64)
        order = np.argsort(r, kind="stable")
        level, r = level.take(order), r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(r)]):
            if b > a:
                some = level.take(slice(a, b))
                used, at = np.unique(some.doc, return_inverse=True)
                parts.append(int(r[a]))
                data.append(
                    join(
                        zlib.compress(used.astype("<i8").tobytes(), 1), pack(at.astype(np.uint64), 4), pack(some.key >> np.uint64(24), 5), pack(some.ctx, 5),
                        pack(some.lo.astype(np.uint64), 5), pack(some.n.astype(np.uint64), 1),
                    )
                )
        return {"part": parts, "first": [int(ids.min())] * len(parts), "data": data}

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([0, *(x.as_buffer().size for x in batch.column(1))])
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH, side="right")) - 1)
                yield rows_of(batch.column(0).to_numpy()[at:end], batch.column(1)[at:end].to_pylist())
                at = end

    return arrow_map(docs, run, "part int, first long, data binary")


def _scanned(rows: DataFrame, n_ranges: int) -> DataFrame:
    """part (document range), data (packed spans): each key range's family over its batches in order of ``first``."""

    def run(batches):
        family, now = None, None
        for part, raw in values(batches):
            if part != now:
                if family:
                    yield from _found(family.found, n_ranges)
                family, now = Family(), part
            if part is None:
                break
            if part < 0:
                yield {"part": [-1 - part], "data": [raw]}
                continue
            ids, at, key, ctx, lo, n = split(raw, 6)
            n = unpack(n, 1).astype(np.int64)
            level = Level(unpack(key, 5), unpack(ctx, 5), np.frombuffer(zlib.decompress(ids), "<i8")[unpack(at, 4).astype(np.int64)], unpack(lo, 5).astype(np.int64), n, np.zeros(len(n), bool))
            family.add(level.take(np.argsort(level.place, kind="stable")))

    return arrow_map(dealt(rows, "first").select("part", "data"), run, "part int, data binary")


def _found(found: list[tuple], n_ranges: int):
    if found:
        yield _spans(*(np.concatenate(x) for x in zip(*found)), n_ranges)


def _with_texts(docs: DataFrame, spans: DataFrame, n_ranges: int) -> DataFrame:
    """Spans and compressed texts dealt by document range, the spans of a range before its texts: part, doc_id, raw, data."""
    placed = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(n_ranges)).cast("int").alias("part"), "doc_id", "raw", "id")

    def squeezed(batches):
        for batch in batches:
            yield {"part": batch.column(0), "doc_id": batch.column(1), "raw": [zlib.compress(x, 1) for x in batch.column(2).to_pylist()], "data": pa.nulls(len(batch), pa.binary()), "id": batch.column(3)}

    texts = arrow_map(placed, squeezed, "part int, doc_id long, raw binary, data binary, id long")
    none = F.lit(None)
    both = spans.select("part", none.cast("long").alias("doc_id"), none.cast("binary").alias("raw"), "data", none.cast("long").alias("id")).union(texts)
    return both.repartition("part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())


def _by_document(batches):
    """(batch's documents) as (key, id, raw, spans of the document: lo, n, kind)."""
    now, held, sorted_ = None, [], None
    for batch in batches:
        out = []
        for part, doc, raw, data, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), batch.column(4).to_pylist()):
            if part != now:
                now, held, sorted_ = part, [], None
            if doc is None:
                held.append(_read_spans(data.as_buffer().to_pybytes()))
                continue
            if sorted_ is None:
                if held:
                    d, lo, n, kind = (np.concatenate(x) for x in zip(*held))
                    order = np.lexsort((lo, d))
                    sorted_ = d[order], lo[order], n[order], kind[order]
                else:
                    sorted_ = tuple(np.zeros(0, np.int64) for _ in range(4))
                held = []
            d, lo, n, kind = sorted_
            a, b = np.searchsorted(d, doc), np.searchsorted(d, doc, side="right")
            out.append((doc, own, zlib.decompress(raw.as_buffer()), lo[a:b], n[a:b], kind[a:b]))
        yield out


def _open_runs(dealt: DataFrame, n_ranges: int) -> DataFrame:
    """The open runs with the bytes that their windows cover, packed by key range: part, data."""

    def run(batches):
        for docs in _by_document(batches):
            out = {c: [] for c in ("key", "doc", "lo", "n", "off")}
            bodies: list[bytes] = []
            for doc_id, _, raw, lo, n, kind in docs:
                sel = (kind == OPEN) & (lo + n - 1 + MATCH <= len(raw))
                lo, n = lo[sel], n[sel]
                for base in range(0, max(1, len(raw)), PIECE):
                    own = (lo >= base) & (lo < base + PIECE)
                    if not own.any():
                        continue
                    l, m = lo[own], n[own]
                    h = _grams(np.frombuffer(raw[base : base + PIECE + 2 * MATCH], np.uint8))
                    near = h[(l - base)[:, None] + np.arange(_W)]  # the suffixes of each run's first window
                    off = (near & ~_POS).argmin(1)
                    out["key"].append(mix(near[np.arange(len(l)), off]))
                    for c, x in (("doc", np.full(len(l), doc_id)), ("lo", l), ("n", m), ("off", off)):
                        out[c].append(x)
                    bodies += [raw[i:j] for i, j in zip(l.tolist(), (l + m - 1 + MATCH).tolist())]
            if not bodies:
                continue
            cols = {c: np.concatenate(x) for c, x in out.items()}
            r = ((cols["key"] & _POS) % np.uint64(n_ranges)).astype(np.int64)
            order = np.lexsort((cols["key"], r))
            cols, r = {c: x[order] for c, x in cols.items()}, r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            parts, data = [], []
            for a, b in zip([0, *cuts], [*cuts, len(r)]):
                used, i = np.unique(cols["doc"][a:b], return_inverse=True)
                parts.append(int(r[a]))
                body = zlib.compress(b"".join(bodies[k] for k in order[a:b].tolist()), 1)  # like contexts stand together
                data.append(
                    join(
                        zlib.compress(used.astype("<i8").tobytes(), 1), pack(i.astype(np.uint64), 4), pack(cols["key"][a:b] >> np.uint64(24), 5), pack(cols["lo"][a:b].astype(np.uint64), 5),
                        pack(cols["n"][a:b].astype(np.uint64), 1), pack(cols["off"][a:b].astype(np.uint64), 1), body,
                    )
                )
            yield {"part": parts, "data": data}

    return arrow_map(dealt, run, "part int, data binary")


def _run_windows(raw: bytes) -> tuple[np.ndarray, ...]:
    """(hash, second hash, doc, position) of every window of packed open runs. Equal hashes have an equal key and distance from it."""
    ids, i, key, lo, n, off, body = split(raw, 7)
    doc = np.frombuffer(zlib.decompress(ids), "<i8")[unpack(i, 4).astype(np.int64)]
    key, lo, n, off = unpack(key, 5), unpack(lo, 5).astype(np.int64), unpack(n, 1).astype(np.int64), unpack(off, 1).astype(np.int64)
    b = np.frombuffer(zlib.decompress(body), np.uint8)
    size = n + MATCH - 1
    start = np.cumsum(size) - size
    run = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = start[run] + nth
    h = np.zeros(len(at), np.uint64)
    for a in range(0, len(b), PIECE):  # hashes are of pieces, as powers are
        own = (at >= a) & (at < a + PIECE)
        if own.any():
            h[own] = _hash(_prefix(b[a : a + PIECE + MATCH]), at[own] - a, at[own] - a + MATCH)
    h = mix(h + key[run] * _C[6] + (off[run] - nth).astype(np.uint64) * _C[7])
    words = _words64(b, len(b) - 7, 0)
    g = mix(words[at] * _C[6] + words[at + MATCH - 8] * _C[7] + key[run]) >> np.uint64(48)
    return h, g, doc[run], lo[run] + nth


def _settled_windows(rows: DataFrame, n_ranges: int) -> DataFrame:
    """The windows of open runs that also start in a smaller document, as spans by document range.

    Windows are dealt out in slices by their own hash, so a common key with many contexts is settled in pieces of SETTLE bytes.
    """

    def settle(held):
        size = sum(len(x) for x in held)
        slices = -(-size // SETTLE)
        for k in range(slices):
            cols = []
            for raw in held:
                h, g, doc, at = _run_windows(raw)
                mine = (h >> np.uint64(32)) % np.uint64(slices) == k
                cols.append((h[mine], g[mine], doc[mine], at[mine]))
            yield from settled(*(np.concatenate(x) for x in zip(*cols)))

    def settled(h, g, doc, at):
        order = np.lexsort((doc, g, h))
        h, g, doc, at = h[order], g[order], doc[order], at[order]
        head = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]) if len(h) else np.zeros(0, bool)
        old = doc >> TAG > doc[np.flatnonzero(head)][np.cumsum(head) - 1] >> TAG if len(h) else head
        doc, at = doc[old], at[old]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order]
        if len(doc):
            cut = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
            start = np.flatnonzero(cut)
            n = at[np.concatenate([start[1:] - 1, [len(at) - 1]])] - at[start] + 1
            yield _spans(doc[start], at[start], n, np.full(len(start), OLD), n_ranges)

    def run(batches):
        now, held = None, []
        for part, raw in values(batches):
            if part != now:
                if held:
                    yield from settle(held)
                now, held = part, []
            if part is not None:
                held.append(raw)

    return arrow_map(dealt(rows), run, "part int, data binary")


def removed_ranges(lo: np.ndarray, n: np.ndarray, size: int) -> list[tuple[int, int]]:
    """The maximal ranges of bytes that old windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in zip(lo.tolist(), (lo + n - 1 + MATCH).tolist()):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(texts, bytes): the rows with a doc_id as doc_id (a key in the order of ids whose low TAG bits are the text's), raw, id."""
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    n_bytes, low, high = known.agg(F.sum(F.octet_length("raw")), F.min("id"), F.max("id")).first()
    tag = F.crc32("raw") % (1 << TAG)
    if low is not None and (low < -(1 << 62 - TAG) or high >= 1 << 62 - TAG):
        ids = known.select("id").distinct().withColumn("one", F.lit(1).cast("long"))
        rank = running(ids, scratch, [], ["id"], "one").select("id", F.col("idx").alias("rank"))
        known = known.join(rank, "id")
        return known.select((F.col("rank") * (1 << TAG) + tag).alias("doc_id"), "raw", "id"), n_bytes
    return known.select((F.col("id") * (1 << TAG) + tag).alias("doc_id"), "raw", "id"), n_bytes or 0


def old_spans(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(texts, spans, number of ranges): every old window of every document, packed by document range."""
    texts, n_bytes = _keyed(docs, scratch)
    n_ranges = ranges(docs.sparkSession, n_bytes)
    spans = scratch.keep(_scanned(_suffix_rows(texts.select("doc_id", "raw"), n_ranges), n_ranges), "spans")
    scratch.release()
    more = scratch.keep(_settled_windows(_open_runs(_with_texts(texts, spans, n_ranges), n_ranges), n_ranges), "spans")
    scratch.release()
    return texts, spans.union(more), n_ranges


def _cut(docs: DataFrame, scratch: Scratch, row, schema: str) -> DataFrame:
    texts, spans, n_ranges = old_spans(docs, scratch)

    def run(batches):
        for docs_ in _by_document(batches):
            rows = []
            for _, doc_id, raw, lo, n, kind in docs_:
                b = raw
                gone = removed_ranges(lo[kind == OLD], n[kind == OLD], len(b))
                at, kept = 0, []
                for lo_, hi_ in gone:
                    kept.append(b[at:lo_])
                    at = hi_
                kept.append(b[at:])
                rows.append(row(doc_id, b, gone, b"".join(kept)))
            yield {c: [r[i] for r in rows] for i, c in enumerate(x.split()[0] for x in schema.split(", "))}

    return arrow_map(_with_texts(texts, spans, n_ranges), run, schema)


def exact_substrings(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs`` with a doc_id: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each UTF-8 byte covered by a string of MATCH bytes that also starts in a document with a smaller doc_id,
    judged on the input. The result is exact but for collisions of the 80-bit hashes of runs and windows.

    A null text is empty. Texts under MATCH bytes lose nothing; very long ones are sampled in pieces that overlap.
    Rows that share a doc_id are judged each on its own text, and never lose bytes to each other. Rows without doc_id are left out. An empty table gives no rows. Extra columns are ignored.
    """

    def digest(doc_id, raw, gone, kept):
        return doc_id, len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()

    return _cut(docs, scratch, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, kept (the remaining bytes) and the removed ranges' starts and ends, per document."""

    def whole(doc_id, raw, gone, kept):
        return doc_id, kept, [a for a, _ in gone], [b for _, b in gone]

    return _cut(docs, scratch, whole, "doc_id long, kept binary, starts array<long>, ends array<long>")


def op8_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_substrings(table(spark, sf_dir, "documents"), Scratch(spark))
