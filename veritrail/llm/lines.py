"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, one occurrence per group.

One changed character moves 6 to 8 of the 64 bits of a short line's SimHash, so blocks cut out of those bits would have to be
too small to tell lines apart. The fingerprint therefore has BLOCKS further blocks whose voters are few: each takes the vote of
one window of the line, the window with the least hash of its own. An edit touches only the windows that hold it, so lines with
few edits agree in a whole block, which is what the pigeonhole join needs; the SimHash then tells which lines of a bucket are
worth an edit distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, components, mix, seeds, table
from .packing import dealt, join, pack, ranges, split, unpack

#: Lines with fewer normalised bytes are left alone.
MIN_BYTES = 10
#: Lines are linked if 100 * edit distance <= (100 - SIMILAR) * the longer length, in characters. Pairs whose SimHashes differ in more
#: than BITS bits are not compared: a bit of a short line has few voters, so lines under SHORT characters may differ in SHORT_BITS.
SIMILAR, BITS, SHORT_BITS, SHORT = 90, 18, 24, 100
#: Blocks of a line, and for lines of so many bytes or more the bytes of a window. Lines near a border have the blocks of both sides.
BLOCKS = 10
LEVELS = ((0, 5), (20, 8), (40, 12), (100, 16), (400, 24))
#: Buckets with more lines are dealt again, by length, then in cells of chunks.
SMALL = 4096
#: A batch sends one line on for a bucket with more of its lines, and the others by themselves.
HOT = 64
#: So many pairs or fewer are compared at once: smaller rounds cost more than the comparisons that they save.
AT_ONCE = 4096
#: Diagonals of pairs that are compared at once; pairs of like rooms go together, fewer than FEW one by one. From the room LONG on a
#: pair is looked at for simple edits before.
ROOM, ROOMS, FEW, LONG = 1 << 19, (16, 64, 128, 200), 12, 100
#: So many pairs are looked at before comparisons begin.
POOL = 1 << 14
#: In nodes with more rows the NEXT neighbours of a row are compared in any case, and others if the node is the pair's first one. Links
#: are settled when so many pairs were looked at, as most of what is left of a large group is connected then.
LARGE, NEXT, LOOKED = 1024, 4, 1 << 17
#: Characters of a gram, and bins of grams.
GRAM, BINS = 3, 1024
#: So many rows of hot buckets are held back to leave out repeated ones.
HELD = 1 << 18
#: Bytes of text of one batch.
BATCH = 1 << 24

_FOLD = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if 97 <= c <= 122 or c >= 128 or c == 10 else 32 for c in range(256))
_GRAMS, _PIECE = 1024, 1 << 17
_A, _C = seeds(BLOCKS, 3), seeds(3, 9)
_rng = np.random.default_rng(7)
#: The votes of a hashed 4-gram for each bit; every bit has as many votes for as against.
_VOTES = np.stack([_rng.permutation(np.repeat([1.0, -1.0], _GRAMS // 2)) for _ in range(64)], 1).astype(np.float32)
#: The marks of buckets of two bands of lengths and of cells, in the low bits where other buckets have their level and block.
_MARK = 127


def normal_lines(raw: bytes) -> list[tuple[int, bytes]]:
    """(line number from 0, normalised line) of the lines that are long enough: A-Z to lower case, digits to 0, runs of other ASCII to one space."""
    raw = raw.translate(_FOLD)
    while b"  " in raw:  # each time runs are half as long
        raw = raw.replace(b"  ", b" ")
    return [(i, y) for i, x in enumerate(raw.split(b"\n")) if len(x) >= MIN_BYTES and len(y := x.strip(b" ")) >= MIN_BYTES]


def _pieces(lines: list[bytes]):
    """(first, last + 1) of lines with about _PIECE bytes together."""
    at, held = 0, 0
    for i, x in enumerate(lines):
        held += len(x)
        if held >= _PIECE or i - at >= 128:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(lines):
        yield at, len(lines)


def _buffer(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(x) for x in lines])
    return np.frombuffer(b"".join(lines) + bytes(32), np.uint8), np.cumsum(lens) - lens, lens


def simhashes(lines: list[bytes]) -> np.ndarray:
    """The SimHash of each line: for each bit the majority of the votes of its 4-grams of bytes (ties: 1)."""
    out = np.zeros(len(lines), np.uint64)
    for lo, hi in _pieces(lines):
        b, starts, lens = _buffer(lines[lo:hi])
        n = int(lens.sum())
        gram = np.repeat(np.arange(hi - lo) * _GRAMS, lens)
        gram += (np.ndarray((n,), "<u4", b.data, 0, (1,)) * np.uint32(2654435761)) >> np.uint32(22)
        for k in (1, 2, 3):
            gram[starts + lens - k] = (hi - lo) * _GRAMS  # beyond the line's end
        counts = np.bincount(gram, minlength=(hi - lo) * _GRAMS + 1)[:-1]
        out[lo:hi] = np.packbits(counts.astype(np.float32).reshape(-1, _GRAMS) @ _VOTES >= 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _windows(b: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q bytes from each position; the buffer ends in 32 bytes of padding."""
    word = lambda at: np.ndarray((len(b) - 32,), "<u8", b.data, at, (1,))
    if q < 8:
        return mix((word(0) & np.uint64((1 << 8 * q) - 1)) * _C[0] + np.uint64(q))
    h = word(0) * _C[0] ^ word(q - 8) * _C[1]
    return mix(h ^ word(8) * _C[2]) if q > 16 else mix(h)


def blocks(lines: list[bytes], q: int) -> np.ndarray:
    """The blocks of lines: for each of BLOCKS orders the least hash of their windows of q bytes."""
    out = np.empty((len(lines), BLOCKS), np.uint64)
    for lo, hi in _pieces(lines):
        b, starts, lens = _buffer(lines[lo:hi])
        h = _windows(b, q)
        cuts = np.minimum(np.stack([starts, starts + np.maximum(1, lens - q + 1)], 1).ravel(), len(h) - 1)
        for j in range(BLOCKS):
            out[lo:hi, j] = np.minimum.reduceat(h * _A[j], cuts)[::2]
    return out


def buckets(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, index of the line): the bucket's low bits tell its level and block."""
    size = np.array([len(x) for x in lines])
    node, row = [], []
    for level, (least, q) in enumerate(LEVELS):
        above = LEVELS[level + 1][0] if level + 1 < len(LEVELS) else np.inf
        here = np.flatnonzero((size >= 0.9 * least) & (size < above / 0.9))
        if len(here):
            got = mix(blocks([lines[i] for i in here], q) + np.arange(BLOCKS, dtype=np.uint64))
            node.append((got & ~np.uint64(127) | np.uint64(level << 4) | np.arange(BLOCKS, dtype=np.uint64)).ravel())
            row.append(np.repeat(here, BLOCKS))
    return (np.concatenate(node), np.concatenate(row)) if node else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance by bit vectors as long as the shorter string."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for c in b:  # one column of the dynamic program at a time, as vertical differences
        eq = where.get(c, 0)
        diag = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(diag | up) & full, up & diag
        score += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(diag | plus)) & full, plus & diag & full
    return score


def _within(pairs: list[tuple[np.ndarray, np.ndarray]], rooms: np.ndarray) -> np.ndarray:
    """Which pairs of arrays of codes under 250, the first not longer, have a Levenshtein distance up to their ``rooms``.

    The dynamic program of all pairs at once, antidiagonal by antidiagonal, on the diagonals that edits within the room can
    reach. Equal codes before both arrays and behind them change no distance, so pairs of all lengths begin and end together.
    """
    out = np.zeros(len(pairs), bool)
    m, n = np.array([len(x) for x, _ in pairs]), np.array([len(y) for _, y in pairs])
    live = np.flatnonzero(n - m <= rooms)
    if not len(live):
        return out
    m, n, rooms = m[live], n[live], np.asarray(rooms)[live]
    below = (rooms - (n - m)) // 2  # so many diagonals before that of the beginning
    goal = n - m + below
    half = int((goal + below).max()) // 2 + 1  # even diagonals, and as many odd ones
    ends = 2 * m + goal
    last = int(ends.max())
    top = last // 2
    kind, cap = (np.uint8, 200) if rooms.max() < 200 else (np.uint16, 60_000) if rooms.max() < 60_000 else (np.int32, 1 << 30)
    # A column for each pair; the first array stands backwards, so that rows side by side are the cells of an antidiagonal.
    one, two = (np.full((top + half + 1, len(live)), 251, np.uint8) for _ in "ab")
    one[top:] = 250
    two[np.arange(len(two))[:, None] < below] = 250
    for side, lens in enumerate((m, n)):
        codes = np.concatenate([pairs[i][side] for i in live]).astype(np.uint8)
        column = np.repeat(np.arange(len(live)), lens)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        if side:
            two[place + below[column], column] = codes
        else:
            one[top - 1 - place, column] = codes
    cells = np.abs(np.arange(-1, 2 * half + 1)[:, None] - below).astype(kind)
    odd, even = cells[::2].copy(), cells[1::2].copy()  # a row before the odd ones and one behind the even ones are out of reach
    odd[0] = even[-1] = cap
    for step in range(1, last + 1):
        at, to = top - step // 2, (step + 1) // 2 - 1
        mine, other = (odd[1:], even) if step & 1 else (even[:-1], odd)
        mine += one[at : at + half] != two[to : to + half]
        near = np.minimum(other[:-1], other[1:])
        near += 1
        np.minimum(mine, near, out=mine)
        if step % 32 == 0 or step == last:
            np.minimum(odd, cap, out=odd)
            np.minimum(even, cap, out=even)
            done = ends <= step
            got = np.where(goal & 1, odd[(goal + 1) // 2, np.arange(len(live))], even[goal // 2, np.arange(len(live))])
            out[live[done & (got <= rooms)]] = True
            stay = ~done & (np.minimum(odd.min(0), even.min(0)) <= rooms)
            if not stay.any():
                break
            if 4 * stay.sum() < 3 * len(stay):
                live, rooms, goal, ends = live[stay], rooms[stay], goal[stay], ends[stay]
                one, two, odd, even = (np.ascontiguousarray(x[:, stay]) for x in (one, two, odd, even))
    return out


def _few_edits(x: np.ndarray, y: np.ndarray, room: int) -> bool:
    """Whether substitutions and one run of insertions into x, the shorter one, make y with ``room`` edits or fewer: then the distance is no larger."""
    n, more = len(x), len(y) - len(x)
    if not n or more > room:
        return False
    ahead, behind = np.cumsum(x != y[:n]), np.cumsum((x != y[more:])[::-1])[::-1]  # before the run, and after it
    best = min(int(ahead[-1]), int(behind[0]))
    if n > 1:
        best = min(best, int((ahead[:-1] + behind[1:]).min()))
    return best + more <= room


def _held(x: str, y: str) -> bool:
    """Whether y holds the characters of x in their order: then the distance is the difference of the lengths."""
    at = -1
    for c in x:
        if (at := y.find(c, at + 1)) < 0:
            return False
    return True


def similar_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Which pairs of strings have enough edit similarity. Common ends are cut off; what is left is compared, many pairs at once."""
    out = np.zeros(len(a), bool)
    wait: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, (s, t) in enumerate(zip(a, b)):
        room = (100 - SIMILAR) * max(len(s), len(t)) // 100
        if abs(len(s) - len(t)) > room:
            continue
        x, y = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<u4"), np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        if len(x) > len(y):
            x, y = y, x
        for _ in range(2):  # the common beginning, then the common end
            differ = x != y[: len(x)]
            cut = int(differ.argmax()) if len(x) else 0
            cut = cut if cut or len(x) and differ[0] else len(x)
            x, y = x[cut:][::-1], y[cut:][::-1]
        if len(y) <= room or room >= LONG and (_few_edits(x, y, room) or _held(*sorted((s, t), key=len))):
            out[i] = True
        elif len(x):
            wait.append((i, room, x, y))
    tier = lambda w: sum(w[1] >= r for r in ROOMS)
    wait.sort(key=lambda w: (tier(w), len(w[3])))
    at = 0
    while at < len(wait):
        end = at + 1
        while end < len(wait) and tier(wait[end]) == tier(wait[at]) and (end - at) * wait[end][1] < ROOM:
            end += 1
        part, at = wait[at:end], end
        if len(part) < FEW:
            for i, room, x, y in part:
                out[i] = edit_distance("".join(map(chr, x)), "".join(map(chr, y))) <= room
            continue
        lens = [len(v) for w in part for v in w[2:]]
        flat = np.concatenate([v for w in part for v in w[2:]])
        used = np.zeros(int(flat.max()) + 1, bool)
        used[flat] = True
        if used.sum() < 250:
            flat = (np.cumsum(used) - 1).astype(np.uint8)[flat]
            codes = np.split(flat, np.cumsum(lens[:-1]))
            out[[w[0] for w in part]] = _within(list(zip(codes[::2], codes[1::2])), np.array([w[1] for w in part]))
        else:
            for i, room, x, y in part:
                out[i] = edit_distance("".join(map(chr, x)), "".join(map(chr, y))) <= room
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))


def _line_id(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line)


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line (64-bit id of the normalised line), n_bytes; one row per line that is long enough."""

    def run(batches):
        for batch in batches:
            found = [normal_lines(raw) for raw in batch.column(1).to_pylist()]
            if flat := [x for doc in found for x in doc]:
                no, text = zip(*flat)
                ids = np.fromiter(map(_line_id, text), np.uint64, len(text)).view(np.int64)
                row = np.repeat(np.arange(len(found)), [len(doc) for doc in found])
                yield {"doc_id": batch.column(0).take(pa.array(row)), "line_no": no, "line": ids, "n_bytes": list(map(len, text))}

    return arrow_map(_texts(docs), run, "doc_id long, line_no int, line long, n_bytes int")


_MEMBER = "node long, line long, size int, simhash long"


def _batch_buckets(texts: list[bytes], n_ranges: int) -> dict:
    """A batch's members packed by range of buckets (part, data); of buckets with more than HOT lines the first is packed, and all are rows of _MEMBER."""
    known = {_line_id(x): x for raw in texts for _, x in normal_lines(raw)}
    ids = np.sort(np.fromiter(known, np.uint64, len(known)))
    lines = [known[i] for i in ids.tolist()]
    node, row = buckets(lines)
    size = np.array([len(x) if x.isascii() else len(x.decode(errors="replace")) for x in lines], np.int64)
    sim = simhashes(lines)
    order = np.argsort(node, kind="stable")  # lines of one node stay in the order of their ids
    node, row = node[order], row[order]
    head = np.concatenate([[True], node[1:] != node[:-1]]) if len(node) else np.zeros(0, bool)
    hot = (np.bincount(np.cumsum(head) - 1) > HOT)[np.cumsum(head) - 1] if len(node) else head
    hot_node, hot_row = node[hot], row[hot]
    go = head | ~hot
    node, row, hot = node[go], row[go], hot[go]
    part = ((node >> np.uint64(7)) % np.uint64(n_ranges)).astype(np.uint16 if n_ranges < 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    node, row, hot, part = node[order], row[order], hot[order], part[order]
    cuts = np.flatnonzero(np.diff(part)) + 1
    parts, data = [], []
    for a, b in zip([0, *cuts], [*cuts, len(part)]):
        if b > a:
            r = row[a:b]
            parts.append(int(part[a]))
            data.append(join(pack(node[a:b], 8), pack(ids[r], 8), pack(size[r].astype(np.uint64), 4), pack(sim[r], 8), np.packbits(hot[a:b]).tobytes()))
    n, m = len(parts), len(hot_node)
    spread = (ids[hot_row] % np.uint64(n_ranges)).astype(np.int64).tolist()  # these travel through any range
    own = {"node": hot_node.view(np.int64), "line": ids[hot_row].view(np.int64), "size": size[hot_row], "simhash": sim[hot_row].view(np.int64)}
    return {"part": parts + spread, "data": data + [None] * m} | {c: pa.array([None] * n + v.tolist(), pa.int32() if c == "size" else pa.int64()) for c, v in own.items()}


def _near(size_a, sim_a, size_b, sim_b) -> np.ndarray:
    """Where length and SimHash allow a link."""
    longer = np.maximum(size_a, size_b)
    return (np.bitwise_count(sim_a ^ sim_b) <= np.where(longer < SHORT, SHORT_BITS, BITS)) & (100 * np.abs(size_a - size_b) <= (100 - SIMILAR) * longer)


def _steps(node: np.ndarray, size: np.ndarray):
    """(i, i + step) for the pairs of rows of one node whose lengths allow a link; rows are sorted by node and size. Nearest rows come first."""
    if not len(node):
        return
    size = size.astype(np.int64)
    span = int(size.max()) + 1
    start = np.cumsum(np.concatenate([[False], node[1:] != node[:-1]])) * span
    end = np.searchsorted(start + size, start + np.minimum(100 * size // SIMILAR, span - 1), side="right")
    at, step = np.arange(len(node)), 1
    while len(at := at[at + step < end[at]]):
        yield at, at + step
        step += 1


def _members(docs: DataFrame, n_ranges: int) -> DataFrame:
    """Members (_MEMBER) of buckets with several lines. Of buckets with SMALL lines or fewer, those with another one that length and SimHash allow.

    A bucket with many lines of a batch is no large group in one task: its members are rows at once, and one line stands for them.
    """

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([0, *(x.as_buffer().size for x in batch.column(0))])
            at = 0
            while at < len(batch):
                end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + BATCH, side="right")) - 1)
                yield _batch_buckets(batch.column(0)[at:end].to_pylist(), n_ranges)
                at = end

    def settle(held):
        node, line, size, sim, hot = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((line, node))
        node, line, size, sim, hot = (x[order] for x in (node, line, size, sim, hot))
        new = np.concatenate([[True], (node[1:] != node[:-1]) | (line[1:] != line[:-1])])
        hot = np.logical_or.reduceat(hot, np.flatnonzero(new))
        node, line, size, sim = (x[new] for x in (node, line, size, sim))
        group = np.cumsum(np.concatenate([[True], node[1:] != node[:-1]])) - 1
        n = np.bincount(group)
        whole = ((np.bincount(group, hot) > 0) | (n > SMALL))[group]  # judged with what other batches have of it
        good = whole.copy()
        rest = np.flatnonzero(~whole & (n > 1)[group])
        rest = rest[np.lexsort((size[rest], group[rest]))]
        for i, j in _steps(group[rest], size[rest]):
            i, j = rest[i], rest[j]
            near = _near(size[i], sim[i], size[j], sim[j])
            good[i[near]] = good[j[near]] = True
        return {"node": node[good].view(np.int64), "line": line[good].view(np.int64), "size": size[good], "simhash": sim[good].view(np.int64)}

    def once(own):
        """Rows of hot buckets, each once: batches send them without knowing of each other."""
        cols = [np.concatenate(x) for x in zip(*own)]
        order = np.lexsort((cols[1], cols[0]))
        cols = [x[order] for x in cols]
        new = np.concatenate([[True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
        return [x[new] for x in cols]

    def meet(batches):
        now, held, own = None, [], []
        names = [c.split()[0] for c in _MEMBER.split(", ")]
        for batch in batches:
            hot = batch.column(1).is_null()
            if hot.true_count:
                own.append([batch.column(2 + i).filter(hot).to_numpy(zero_copy_only=False) for i in range(4)])
                if sum(len(x[0]) for x in own) >= HELD:  # those of one line come one after another
                    own = [once(own)]
                    if 2 * len(own[0][0]) >= HELD:
                        yield dict(zip(names, own[0]))
                        own = []
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if part != now:
                    if held:
                        yield settle(held)
                    now, held = part, []
                if raw.is_valid:
                    node, line, size, sim, hot = split(raw.as_buffer().to_pybytes(), 5)
                    node = unpack(node, 8)
                    held.append((node, unpack(line, 8), unpack(size, 4).astype(np.int64), unpack(sim, 8), np.unpackbits(np.frombuffer(hot, np.uint8), count=len(node)).astype(bool)))
        if held:
            yield settle(held)
        if own:
            yield dict(zip(names, once(own)))

    return arrow_map(dealt(arrow_map(_texts(docs).select("raw"), run, "part int, data binary, " + _MEMBER)), meet, _MEMBER)


def _whole_nodes(batches, n_columns: int):
    """The columns of batches cut where a node ends; rows are sorted by node, the first column."""
    rest = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_columns)]
        now = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
        if len(now[0]):
            last = int(np.searchsorted(now[0], now[0][-1]))
            now, rest = [x[:last] for x in now], [x[last:] for x in now]
            if last:
                yield now
    if rest is not None:
        yield rest


def _line_texts(live: DataFrame, lines: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """line, norm of the lines of ``live``, read from their first occurrences' documents."""
    wanted = scratch.keep(lines.join(live.select("line").distinct(), "line", "left_semi").groupBy("doc_id").agg(F.collect_set("line_no").alias("numbers")), "wanted")  # numbers of one document
    n = wanted.agg(F.sum(F.size("numbers") + 8)).first()[0] or 0
    source = _texts(docs).join(F.broadcast(wanted) if n <= BROADCAST_NUMBERS else wanted, "doc_id")

    def read(batches):
        for batch in batches:
            line, text = [], []
            for raw, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole = raw.translate(_FOLD).split(b"\n")
                for i in numbers:
                    if i < len(whole):
                        text.append(b" ".join(whole[i].split()))
                        line.append(_line_id(text[-1]))
            yield {"line": np.array(line, np.uint64).view(np.int64), "norm": text}

    ids = live.select("line").distinct()  # rows that share a doc_id may hold other lines at these numbers
    return scratch.keep(arrow_map(source.select("raw", "numbers"), read, "line long, norm binary").dropDuplicates(["line"]).join(ids, "line", "left_semi"), "texts")


#: Line numbers and ids (4 bytes each) of the documents that are read again, up to which they are broadcast.
BROADCAST_NUMBERS = 4_000_000


def _bags(norm: list[bytes], text: list[str]) -> np.ndarray:
    """How often each line has the characters of each remainder by 64, which the last byte of a character tells."""
    out = np.zeros((len(norm), 64), np.int32)
    for lo, hi in _pieces(norm):
        b, _, lens = _buffer(norm[lo:hi])
        last = b[1 : lens.sum() + 1] & 0xC0 != 0x80
        out[lo:hi] = np.bincount((np.repeat(np.arange(hi - lo) * 64, lens) + (b[: lens.sum()] & 63))[last], minlength=(hi - lo) * 64).reshape(-1, 64)
    for i, x in enumerate(text):
        if "\ufffd" in x:  # perhaps bytes that are no character
            out[i] = np.bincount(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") & 63, minlength=64)
    return out


def _grams(text: list[str]) -> np.ndarray:
    """How often each line has grams of GRAM characters, in BINS bins; 255 stands for more."""
    out = np.zeros((len(text), BINS), np.uint8)
    for lo, hi in _pieces(text):
        codes = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in text[lo:hi]]
        lens = np.array([len(x) for x in codes])
        flat = np.concatenate([*codes, np.zeros(GRAM - 1, "<u4")])
        n = len(flat) - GRAM + 1
        gram = np.zeros(n, np.uint32)
        for k in range(GRAM):
            gram = (gram ^ flat[k : n + k]) * np.uint32(2654435761)
        place = np.repeat(np.arange(hi - lo) * BINS, lens) + (gram >> np.uint32(22))
        fit = np.arange(n) + GRAM <= np.repeat(np.cumsum(lens), lens)  # not beyond the line's end
        out[lo:hi] = np.minimum(np.bincount(place[fit], minlength=(hi - lo) * BINS), 255).reshape(-1, BINS)
    return out


def _apart(bags: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The greater of what row i of counts has more than row j, and row j more than row i."""
    out = np.empty(len(i), np.int64)
    step = (1 << 18) // bags.shape[1]  # what is added up stays near the processor
    for at in range(0, len(i), step):
        x, y = bags[i[at : at + step]], bags[j[at : at + step]]
        more = np.maximum(x, y).sum(1, dtype=np.int32)
        out[at : at + step] = more - np.minimum(x.sum(1, dtype=np.int32), y.sum(1, dtype=np.int32))
    return out


def _close(node, line, size, sim):
    """(i, j) of the pairs of rows of one node that length and SimHash allow, some at a time."""
    for i, j in _steps(node, size):
        near = _near(size[i], sim[i], size[j], sim[j]) & (line[i] != line[j])
        yield i[near], j[near]


def _many(pairs):
    """The pairs of arrays, so many together that POOL or more are in each but the last."""
    held, n = [], 0
    for i, j in pairs:
        if len(i):
            held.append((i, j))
            n += len(i)
        if n >= POOL:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _links(members: DataFrame) -> DataFrame:
    """Links (a, b) within nodes, as few as connect what is similar. ``members``: node, line, size, simhash, hidden, norm.

    A pair that shares several nodes is compared in that of its first block only, but for neighbours in large nodes; ``hidden``
    has a bit for each level and block of a line whose node is too large to be compared as it is. A task compares no pair that
    its links connect already: in a node with many like lines most pairs are passed over before anything is computed for them.
    Two bounds spare edit distances: an edit moves one character, and at most GRAM grams of either line.
    """

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        def settle(pool):
            """Rounds: each takes few pairs of a group, so most of what these connect is never compared; no pair is left over."""
            a, b, most = [], [], 1
            while pool:
                used: dict[int, int] = {}
                now, later = [], []
                for p in pool:
                    x, y = top(p[0]), top(p[1])
                    if x == y:
                        continue
                    n, m = used.get(x, 0), used.get(y, 0)
                    if len(pool) <= AT_ONCE or n < most and m < most:
                        used[x], used[y] = n + 1, m + 1
                        now.append(p)
                    else:
                        later.append(p)
                for k in np.flatnonzero(similar_pairs([p[2] for p in now], [p[3] for p in now])).tolist():
                    x, y = top(now[k][0]), top(now[k][1])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a.append(max(now[k][:2])), b.append(min(now[k][:2]))
                pool, most = later, 4 * most
            return {"a": a, "b": b}

        def tops(ids: list[int]) -> np.ndarray:
            return np.fromiter(map(top, ids), np.int64, len(ids))

        pool, looked = [], 0
        for node, line, size, sim, hidden, norm in _whole_nodes(batches, 6):
            mark, sim = node & 127, sim.view(np.uint64)  # bits are counted of what has no sign
            text = [x.decode(errors="replace") for x in norm]
            bags = np.minimum(_bags(norm, text), 32_767).astype(np.int16)
            own, known = np.zeros((len(node), BLOCKS), np.uint64), np.zeros(len(node), bool)
            grams, counted = None, known.copy()
            head = np.concatenate([[True], node[1:] != node[:-1]])
            cell, large = mark == _MARK, (np.bincount(np.cumsum(head) - 1) > LARGE)[np.cumsum(head) - 1]
            ids = line.tolist()
            group = tops(ids)
            for i, j in _many(_close(node, line, size, sim)):
                fit = group[i] != group[j]
                i, j = i[fit], j[fit]
                looked += len(i)
                room = (100 - SIMILAR) * np.maximum(size[i], size[j]) // 100
                fit = _apart(bags, i, j) <= room  # letters that only one of the lines has need an edit each
                i, j, room = i[fit], j[fit], room[fit]
                new = np.zeros(len(node), bool)
                new[i] = new[j] = True
                new &= ~known & ~cell
                known |= new
                for level, (_, q) in enumerate(LEVELS):
                    here = np.flatnonzero(new & (mark >> 4 == level))
                    if len(here):
                        own[here] = blocks([norm[x] for x in here], q)
                shown = ~(hidden[i] | hidden[j])[:, None] >> (BLOCKS * (mark[i] >> 4)[:, None] + np.arange(BLOCKS)) & 1
                first = ((own[i] == own[j]) & shown.astype(bool)).argmax(1)
                fit = cell[i] | large[i] & (j - i <= NEXT) | (first == (mark[i] & 15))
                i, j, room = i[fit], j[fit], room[fit]
                if len(i):
                    grams = np.zeros((len(node), BINS), np.uint8) if grams is None else grams
                    new = np.zeros(len(node), bool)
                    new[i] = new[j] = True
                    here = np.flatnonzero(new & ~counted)
                    counted |= new
                    if len(here):
                        grams[here] = _grams([text[x] for x in here])
                    fit = _apart(grams, i, j) <= GRAM * room
                    i, j = i[fit], j[fit]
                pool += [(ids[x], ids[y], text[x], text[y]) for x, y in zip(i.tolist(), j.tolist())]
                if len(pool) >= POOL or pool and looked >= LOOKED:
                    yield settle(pool)
                    pool, looked, group = [], 0, tops(ids)
        yield settle(pool)

    cols = members.select("node", "line", "size", "simhash", "hidden", "norm")
    return arrow_map(cols.repartition("node").sortWithinPartitions("node", "size", "simhash"), run, "a long, b long")


def _smaller(members: DataFrame, large: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, line): the members of large nodes in nodes of two neighbouring bands of sizes, and where these are large too, in cells of two chunks each.

    Lines of one node whose lengths allow a link are in one band or in neighbouring ones, so every such pair meets, also if it
    shares no other node.
    """
    marked = lambda *c: F.xxhash64(*c).bitwiseOR(F.lit(_MARK))
    band = F.floor(F.ln(F.greatest(F.col("size"), F.lit(1)).cast("double")) / -math.log(SIMILAR / 100 - 0.01))  # a little wider than what a link needs
    one = members.join(large.select("node"), "node").select("node", "line", band.alias("band"))
    child = scratch.keep(one.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).select(marked("node", "band").alias("node"), "line").distinct(), "children")
    size = child.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = child.join(size, "node")
    chunks = F.ceil(F.col("n") / SMALL)
    cells = (
        sized.filter(F.col("n") > SMALL).withColumn("chunks", chunks).withColumn("own", F.pmod(F.xxhash64("line"), F.col("chunks")))
        .withColumn("with", F.explode(F.expr("sequence(0L, chunks - 1)"))).select(marked("node", F.least("own", "with"), F.greatest("own", "with")).alias("node"), "line")
    )
    return sized.filter(F.col("n") <= SMALL).select("node", "line").union(cells)


def removed_lines(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(occurrences, removed): removed has doc_id, line_no of every occurrence but the first of its group.

    Groups are the connected components of equal normalised lines and of links between different ones: lines that agree in
    one of BLOCKS blocks, whose SimHashes differ in few bits, and that have enough edit similarity. Buckets of more than
    SMALL lines are dealt again by length, and where those are as large, by cells that hold every pair. The first
    occurrence is that of the smallest (doc_id, line_no).
    """
    seen = scratch.keep(occurrences(docs), "occurrences")
    lines = scratch.keep(
        seen.groupBy("line").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("n")).select("line", "n", "at.*"), "lines"
    )
    total = seen.agg(F.sum("n_bytes")).first()[0] or 0
    members = scratch.keep(_members(docs, ranges(docs.sparkSession, total)), "members")
    large = scratch.keep(members.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SMALL).select("node"), "large")
    if large.head(1):
        feature = members.select("line", "size", "simhash").dropDuplicates(["line"])
        slot = F.expr(f"if((node & {_MARK}) = {_MARK}, 0L, shiftleft(1L, cast((shiftright(node, 4) & 7) * {BLOCKS} + (node & 15) as int)))")
        hidden = members.join(large, "node").groupBy("line").agg(F.bit_or(slot).alias("hidden"))
        parts = members.join(large, "node", "left_anti").unionByName(_smaller(members, large, scratch).join(feature, "line"))
        members = scratch.keep(parts.join(hidden, "line", "left").withColumn("hidden", F.coalesce("hidden", F.lit(0).cast("long"))), "members")
    else:
        members = members.withColumn("hidden", F.lit(0).cast("long"))
    texts = _line_texts(members, lines, docs, scratch)
    links = scratch.keep(_links(members.join(texts, "line")), "links")
    comps = scratch.keep(components(links, scratch), "components")
    more = lines.join(comps.withColumnRenamed("node", "line"), "line", "left").filter("n > 1 or component is not null")  # others are alone
    grouped = scratch.keep(more.withColumn("g", F.coalesce("component", "line")).drop("component"), "grouped")
    several = grouped.groupBy("g").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.sum("n").alias("total")).filter("total > 1")
    member = grouped.select("line", "g").join(several, "g").select("line", "first")
    removed = seen.join(member, "line").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("line_no") != F.col("first.line_no"))).select("doc_id", "line_no")
    return seen, scratch.keep(removed.distinct(), "removed")


def fuzzy_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per doc_id: n_lines (long enough to be looked at), n_removed, removed (their numbers from 0, ascending).

    Null or empty texts have no lines. A very long text or line is read whole. Lines are equal if they are after
    normalisation. Of equally early occurrences there is only one place, so ties need no rule, but for rows that share a
    doc_id: they are one document, whose lines of one number stay or go together. Rows without doc_id are left out. An
    empty table gives no rows. Extra columns are ignored.
    """
    seen, removed = removed_lines(docs, scratch)
    counts = seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
    gone = removed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("line_no").cast("long"))).alias("removed"))  # bounded by one document
    ids = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    none = F.expr("cast(array() as array<bigint>)")
    return ids.join(counts, "doc_id", "left").join(gone, "doc_id", "left").select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest(F.coalesce(F.size("removed"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("removed", none).alias("removed"),
    )


def without_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with the removed lines cut out of their texts; all columns stay."""
    names = docs.columns
    gone = fuzzy_lines(docs, scratch).filter("n_removed > 0").select(F.col("doc_id").alias("gone_doc"), F.col("removed").alias("gone_lines"))
    joined = docs.join(gone, F.col("doc_id") == F.col("gone_doc"), "left")
    cut = F.expr("if(gone_lines is null, text, array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(gone_lines, cast(i as bigint))), '\\n'))")
    return joined.withColumn("text", cut).select(*[F.col(f"`{c}`") for c in names])


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(table(spark, sf_dir, "documents"), Scratch(spark))
