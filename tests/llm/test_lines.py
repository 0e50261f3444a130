"""Fuzzy lines against edit similarity alone, without the operator's fingerprints."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veritrail.llm import common, lines

from .test_corpus import ROWS, SCHEMA, docs, empty, groups, scratch  # noqa: F401


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def similar(a, b):
    longer = max(len(a), len(b))
    return 100 * abs(len(a) - len(b)) <= 10 * longer and 100 * brute_edit(a, b) <= 10 * longer


def test_edit_distances():
    rng = random.Random(9)
    pairs = []
    for _ in range(200):
        a = "".join(rng.choices("abcé日", k=rng.choice([0, 3, 20, 64, 70, 150])))
        b = "".join(rng.choices("abc", k=rng.randint(0, 30))) if rng.random() < 0.3 else "".join(c if rng.random() < 0.93 else rng.choice(["", "x", "yz"]) for c in a)
        pairs.append((a, b))
        assert lines.edit_distance(a, b) == brute_edit(a, b)
    assert lines.similar_pairs(*zip(*pairs)).tolist() == [similar(a, b) for a, b in pairs]
    wide = "".join(map(chr, range(200, 400)))  # more characters than the tables have codes
    assert lines.similar_pairs([wide, wide], ["x" + wide[3:], wide[40:] + wide[:40]]).tolist() == [True, False]


def brute_lines(rows):
    seen, at = {}, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        at += [(i, no, x.decode()) for no, x in lines.normal_lines((t or "").encode())]
    texts = list(dict.fromkeys(s for *_, s in at))
    near = [(x, y) for x, a in enumerate(texts) for y, b in enumerate(texts) if x < y and 10 * abs(len(a) - len(b)) <= max(len(a), len(b)) and len(set(a.split()) & set(b.split())) >= 0.3 * len(set(a.split()))]
    group = groups(range(len(texts)), [(x, y) for x, y in near if similar(texts[x], texts[y])])
    number = {s: x for x, s in enumerate(texts)}
    out = defaultdict(list)
    for i, no, s in at:
        g = group[number[s]]
        if g in seen:
            out[i].append(no)
        seen.setdefault(g, (i, no))
    return {i: (sum(1 for x in at if x[0] == i), len(out[i]), out[i]) for i, *_ in rows}


SHORT = [r for r in ROWS if len(r[1] or "") < 2000]


@pytest.mark.parametrize("small", [lines.SMALL, 4])
def test_fuzzy_lines(spark, empty, scratch, small, monkeypatch):  # noqa: F811
    monkeypatch.setattr(lines, "SMALL", small)
    df = spark.createDataFrame(SHORT, SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in lines.fuzzy_lines(df, scratch).collect()}
    want = brute_lines(SHORT)
    assert got == want and any(w[1] for w in want.values())
    cut = {r.doc_id: r.text for r in lines.without_lines(df, scratch).collect()}
    for i, t, *_ in SHORT:
        keep = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i][2])
        assert cut[i] == keep
    assert lines.fuzzy_lines(empty, scratch).count() == 0


def test_recall_on_lines_with_few_edits(spark, scratch):  # noqa: F811
    """Planted pairs of lines of 5 to 50 words with one to three edited characters, or 5 %, judged by edit similarity alone."""
    rng = random.Random(11)
    words = ["".join(rng.choices("aabcdeeefghiiklmnooprstuv", k=rng.randint(2, 9))) for _ in range(4000)]
    rows, pairs = [], []
    for i in range(1200):
        line = " ".join(rng.choice(words) for _ in range(rng.choice([5, 8, 12, 20, 30, 50])))
        other = list(line)
        for _ in range(rng.choice([1, 2, 3, max(1, len(line) // 20)])):
            k = rng.randrange(len(other))
            other[k] = rng.choice(["", rng.choice("xyz"), other[k] + rng.choice("xyz")])
        other = " ".join("".join(other).split())
        rows += [(2 * i, line, None, None, None, None, 0), (2 * i + 1, other, None, None, None, None, 0)]
        if other != line and similar(line, other):
            pairs.append(2 * i + 1)
    got = {r.doc_id for r in lines.fuzzy_lines(spark.createDataFrame(rows, SCHEMA), scratch).filter("n_removed = 1").collect()}
    recall = np.mean([i in got for i in pairs])
    assert len(pairs) > 1000 and recall >= 0.96 and not got - {2 * i + 1 for i in range(1200)}


def test_members_of_a_group_that_its_first_line_does_not_reach(spark, scratch):  # noqa: F811
    """A chain of lines in which neighbours are similar and the ends are not is one group; repeated ids and rows change nothing."""
    rng = random.Random(12)
    line = [rng.choice("abcdefgh") for _ in range(80)]
    rows = []
    for i in range(30):
        rows.append((i, "".join(line), None, None, None, None, 0))
        line[rng.randrange(80)] = rng.choice("uvwxyz")
        line[rng.randrange(80)] = rng.choice("uvwxyz")
    got = {r.doc_id: r.n_removed for r in lines.fuzzy_lines(spark.createDataFrame(rows + rows[:3] + [(None, "x" * 20, None, None, None, None, 0)], SCHEMA), scratch).collect()}
    assert set(got) == set(range(30)) and sum(got.values()) >= 27 and got[0] == 0


def test_pairs_that_share_one_large_bucket_only(spark, scratch, monkeypatch):  # noqa: F811
    """Every similar pair of a large bucket is found, also if it shares no other bucket."""
    monkeypatch.setattr(lines, "SMALL", 16)
    monkeypatch.setattr(lines, "_near", lambda a, _, b, __: 10 * np.abs(a - b) <= np.maximum(a, b))
    rng = random.Random(13)
    texts = []
    for i in range(100):
        line = [rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(rng.randrange(60, 90))]
        line[10:30] = "a common part of all"
        other = list(line)
        for k in range(31, len(other), 9):
            other[k] = "z"
        texts += [" ".join("".join(x).split()) for x in (line, other)]
    node, row = lines.buckets([x.encode() for x in texts])
    size = dict(zip(*np.unique(node, return_counts=True)))
    of = defaultdict(set)
    for n, r in zip(node.tolist(), row.tolist()):
        of[r].add(n)
    alone = [i for i in range(0, len(texts), 2) if texts[i] != texts[i + 1] and similar(texts[i], texts[i + 1]) and len(both := of[i] & of[i + 1]) == 1 and size[next(iter(both))] > 16]
    got = {r.doc_id for r in lines.fuzzy_lines(spark.createDataFrame([(i, x, None, None, None, None, 0) for i, x in enumerate(texts)], SCHEMA), scratch).filter("n_removed = 1").collect()}
    assert len(alone) >= 5 and all(i in got or i + 1 in got for i in alone)


def test_pairs_that_links_connect_already_are_not_compared(spark, monkeypatch):  # noqa: F811
    """A group of n like lines takes far fewer comparisons than it has pairs, and is connected whole."""
    rng = random.Random(14)
    base = "".join(rng.choice("abcdefgh") for _ in range(100))
    norm = [(base[: 2 * i] + "x" + base[2 * i + 1 :]).encode() for i in range(40)]
    runs, compared, plain = [], [], lines.similar_pairs
    monkeypatch.setattr(lines, "AT_ONCE", 0, raising=False)
    monkeypatch.setattr(lines, "arrow_map", lambda _, run, __: runs.append(run))
    monkeypatch.setattr(lines, "similar_pairs", lambda a, b: compared.append(len(a)) or plain(a, b))
    lines._links(spark.createDataFrame([], "node long, line long, size int, simhash long, hidden long, norm binary"))
    cols = [np.full(40, lines._MARK), np.arange(40), np.full(40, 100), np.zeros(40, np.int64), np.zeros(40, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(norm, pa.binary())], names=list("abcdef"))
    links = [(x, y) for out in runs[0]([batch]) for x, y in zip(out["a"], out["b"])]
    group = groups(range(40), links)
    assert len({group[i] for i in range(40)}) == 1 and len(links) == 39 and sum(compared) < 40 * 39 / 4


def test_pairs_within_their_rooms():
    """Pairs of all lengths at once, each with a room of its own, also at the room itself and one below it."""
    rng = random.Random(12)
    pairs, rooms = [], []
    for n in (1, 2, 7, 8, 9, 40, 64, 65, 300, 700):
        for edits in (0, 1, 2, n // 10, n // 3):
            one = [rng.randrange(4) for _ in range(n)]
            two = list(one)
            for _ in range(edits):
                k = rng.randrange(len(two) + 1)
                two[k : k + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(2)
            one, two = sorted((one, two), key=len)
            far = lines.edit_distance("".join(map(chr, one)), "".join(map(chr, two)))
            for room in {max(0, far - 1), far, far + 3, n // 10}:
                if len(two) - len(one) <= room:
                    pairs.append((np.array(one, np.int64), np.array(two, np.int64)))
                    rooms.append((room, far))
    got = lines._within(pairs, np.array([r for r, _ in rooms]))
    assert got.tolist() == [far <= room for room, far in rooms] and 20 < got.sum() < len(got) - 10


def test_few_edits_is_never_too_generous():
    rng = random.Random(15)
    hit = 0
    for _ in range(300):
        a = "".join(rng.choices("abc", k=rng.randint(1, 40)))
        k = rng.randint(0, len(a))
        b = "".join(c if rng.random() < 0.9 else "z" for c in a[:k] + "".join(rng.choices("abc", k=rng.randint(0, 4))) + a[k:])
        x, y = (np.array(list(map(ord, v)), np.uint32) for v in (a, b))
        for room in (0, 2, 5):
            few = lines._few_edits(x, y, room)
            hit += few
            assert not few or brute_edit(a, b) <= room
    assert hit > 100


def test_long_pairs_of_insertions_take_no_edit_distance(monkeypatch):
    """A line that another one holds in its order is as far from it as they differ in length: no distance is computed."""
    line = "a b c d e f g " * 2000
    more = "".join(c + "xy" * (k % 40 == 0) for k, c in enumerate(line))
    for name in ("_within", "edit_distance"):
        monkeypatch.setattr(lines, name, lambda *_: pytest.fail("compared in full"))
    assert lines.similar_pairs([line, more], [more, line]).tolist() == [True, True]


def test_blocks_of_rows_without_a_close_pair_are_not_made(spark, monkeypatch):  # noqa: F811
    """Rows of one node whose characters differ too much for a link need no blocks; the like pair among them is still linked."""
    norm = [(c * 60).encode() for c in "abcdefgh"] + [b"z" * 60 + b"y"]
    norm.append(b"z" * 60 + b"x")
    runs, made, plain = [], [], lines.blocks
    monkeypatch.setattr(lines, "arrow_map", lambda _, run, __: runs.append(run))
    monkeypatch.setattr(lines, "blocks", lambda x, q: made.extend(x) or plain(x, q))
    lines._links(spark.createDataFrame([], "node long, line long, size int, simhash long, hidden long, norm binary"))
    node = 1 << 20 | 2 << 4 | int((plain(norm[-2:-1], 12) == plain(norm[-1:], 12)).argmax())
    cols = [np.full(10, node), np.arange(10), np.array([len(x) for x in norm]), np.zeros(10, np.int64), np.zeros(10, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(norm, pa.binary())], names=list("abcdef"))
    links = [(x, y) for out in runs[0]([batch]) for x, y in zip(out["a"], out["b"])]
    assert links == [(9, 8)] and sorted(made) == sorted(norm[-2:])


def test_normal_lines_and_characters_as_in_their_plain_forms():
    rng = random.Random(16)
    raws = ["".join(rng.choices("aB9 ,.\t\n\r\x0bé日😀", k=rng.randint(0, 200))).encode() for _ in range(300)] + [b"long enough \xff\xc3 \x80\x80 bytes"]
    for raw in raws:
        plain = [(i, b" ".join(x.split())) for i, x in enumerate(raw.translate(lines._FOLD).split(b"\n"))]
        assert lines.normal_lines(raw) == [(i, x) for i, x in plain if len(x) >= lines.MIN_BYTES]
    norm = [x for raw in raws for _, x in lines.normal_lines(raw)]
    text = [x.decode(errors="replace") for x in norm]
    assert lines._bags(norm, text).tolist() == [np.bincount([ord(c) & 63 for c in x], minlength=64).tolist() for x in text]


def _links_of(spark, monkeypatch, norm, sizes, node=None):
    """The links of lines that share one node, by the function that runs in tasks."""
    runs, n = [], len(norm)
    monkeypatch.setattr(lines, "arrow_map", lambda _, run, __: runs.append(run))
    lines._links(spark.createDataFrame([], "node long, line long, size int, simhash long, hidden long, norm binary"))
    cols = [np.full(n, lines._MARK if node is None else node), np.arange(n), np.array(sizes), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    batch = pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(norm, pa.binary())], names=list("abcdef"))
    return [(x, y) for out in runs[0]([batch]) for x, y in zip(out["a"], out["b"])]


def test_pairs_of_one_node_whose_lengths_differ_too_much_are_passed_over(spark, monkeypatch):  # noqa: F811
    """A common window in lines of all lengths: their pairs are not looked at one by one, and like lines are linked as before."""
    norm = sorted([("common part " + c * n).encode() for n in range(20, 420, 4) for c in "ab"], key=len)
    seen, plain = [], lines._near
    monkeypatch.setattr(lines, "_near", lambda *x: seen.append(len(x[0])) or plain(*x))
    links = _links_of(spark, monkeypatch, norm, [len(x) for x in norm])
    group = groups(range(len(norm)), links)
    brute = groups(range(len(norm)), [(i, j) for j in range(len(norm)) for i in range(j) if lines.similar_pairs([norm[i].decode()], [norm[j].decode()])[0]])
    assert group == brute and sum(seen) < len(norm) ** 2 / 8


def test_lines_with_the_same_characters_in_another_order_take_no_edit_distance(spark, monkeypatch):  # noqa: F811
    rng = random.Random(17)
    base = list("abcdefghijklmnopqrstuvwxyz" * 4)
    norm = ["".join(rng.sample(base, len(base))).encode() for _ in range(30)]
    norm.append(norm[-1][:-1] + b"!")
    compared, plain = [], lines.similar_pairs
    monkeypatch.setattr(lines, "similar_pairs", lambda a, b: compared.append(len(a)) or plain(a, b))
    assert _links_of(spark, monkeypatch, norm, [len(x) for x in norm]) == [(30, 29)] and sum(compared) == 1


def test_gram_bound_is_never_above_the_distance():
    rng = random.Random(18)
    for _ in range(300):
        a = "".join(rng.choices("abé日😀 ", k=rng.randint(1, 60)))
        b = list(a)
        for _ in range(rng.randint(0, 8)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randrange(2)] = rng.choices("abé日😀 ", k=rng.randrange(2))
        b = "".join(b)
        assert lines._apart(lines._grams([a, b]), np.array([0]), np.array([1]))[0] <= lines.GRAM * brute_edit(a, b)


def test_neighbours_in_large_nodes_connect_what_later_pairs_skip(spark, monkeypatch):  # noqa: F811
    """In a large node that is no pair's first one, like lines are still connected, and most of their pairs are passed over."""
    rng = random.Random(19)
    base = "".join(rng.choice("abcdefgh ") for _ in range(200)).replace("  ", "a ")
    norm = [(base[:k] + "x" + base[k + 1 :]).encode() for k in range(5, 195)]
    looked, plain = [], lines._apart
    monkeypatch.setattr(lines, "_apart", lambda b, i, j: looked.append(len(i)) or plain(b, i, j))
    for name, value in (("LARGE", 100), ("POOL", 64), ("LOOKED", 64)):
        monkeypatch.setattr(lines, name, value)
    links = _links_of(spark, monkeypatch, norm, [200] * 190, node=3 << 4 | 15)  # no line has a 16th block
    assert len({*groups(range(190), links).values()}) == 1 and sum(looked) < 190 * 189 / 4


def test_rows_of_hot_buckets_leave_once_however_many_batches_send_them(monkeypatch):
    runs = []
    monkeypatch.setattr(lines, "arrow_map", lambda _, run, __: runs.append(run))
    monkeypatch.setattr(lines, "dealt", lambda rows: rows)
    monkeypatch.setattr(lines, "_texts", lambda docs: docs)
    lines._members(type("Docs", (), {"select": lambda *_: None})(), 1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0] * 100), pa.array([None] * 100, pa.binary()), *(pa.array(np.arange(100) % 10) for _ in range(4))], names=list("abcdef")
    )
    got = [x for out in runs[1]([batch] * 5) for x in out["line"].tolist()]
    assert sorted(got) == list(range(10))
