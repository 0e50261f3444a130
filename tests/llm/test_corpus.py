"""The corpus operators against brute force on a small corpus with nulls, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from veritrail.llm import common, decontamination, language, licences, mixing, neardup, passages, quality, sharding, suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(rng.choice([8, 60, 120, 200])) for _ in range(25)]
    long_ = text(9000)
    passage = text(70)
    texts: list[str | None] = [None, "", "   \n ", "one", "Ünï çödé 日本語 &&& ###", "1234 5678"]
    texts += base + base[:6] + [long_, long_ + " tail"]
    for b in base[:12]:
        ws = b.split()
        for _ in range(3):
            c = list(ws)
            for _ in range(rng.randint(1, 5)):
                c[rng.randrange(len(c))] = rng.choice(words)
            texts.append(" ".join(c))
    texts += [f"{text(40)}\n{passage}\n{text(rng.randint(5, 60))}" for _ in range(6)]
    texts += [f"{text(60)}\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. " + text(55)]
    texts += ["same line of words here\n" * 30, text(80) + "\nA line, that is LONG enough to be compared with others fuzzily 17\n" + text(20)]
    texts += [text(80) + "\na line that is long enough to be compared with others fuzzily 99\n" + text(20)]
    rows = [(3 * i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else f"s{i % 4}", None, "x", 1) for i, t in enumerate(texts)]
    rows[7] = (rows[7][0], rows[7][1], None, None, None, None, None)
    rng.shuffle(rows)
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def scratch(spark):
    return common.Scratch(spark)


def words(t: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t: str | None, k: int) -> set:
    w = words(lower(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(ids, links) -> dict:
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_spark_hash(spark):
    xs = [0, 1, -1, 2**62, -(2**63), 12345]
    got = [r.h for r in spark.createDataFrame([(x,) for x in xs], "x long").selectExpr("xxhash64(x) as h").collect()]
    assert common.spark_hash(np.array(xs, np.int64)).tolist() == got


def test_components(spark, scratch):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long"), scratch).collect()}
    want = groups({x for p in links for x in p if p[0] != p[1]}, links)
    assert got == want


def test_sharding(docs, empty, scratch):
    got = sharding.balanced_shards(docs, scratch).collect()
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in ROWS}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t, *_ in ROWS}
    total, before = sum(size.values()), 0
    slots: Counter = Counter()
    for r in sorted(got, key=lambda r: r.doc_id):
        assert r.shard == min(15, (2 * before + r.size) * 16 // (2 * total)) and r.slot == slots[r.shard]
        slots[r.shard] += 1
        before += r.size
    assert sharding.balanced_shards(empty, scratch).count() == 0


def brute_quality(t):
    w = words(t)
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for j in range(3)}
    ls = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(covered), len(ls)


def brute_verdicts(rows):
    """doc_id -> (base counts, base_failed, kept), with limits of sources drawn to those of languages and of the corpus."""
    feats = {r[0]: brute_quality(r[1]) for r in rows}
    group = {r[0]: (r[2], r[3]) for r in rows}
    base = {i: f[0] < 50 or 100 * f[4] > 50 * f[0] for i, f in feats.items()}
    parts = {"word_length": (1, 0, 300), "symbol_share": (2, 0, 20), "dup_line_share": (3, 5, 120), "repeat_share": (4, 0, 60)}
    value = lambda f, m: f[parts[m][0]] * 1000 // max(f[parts[m][1]], 1)
    rough = lambda v: v if v < 1024 else v >> v.bit_length() - 10 << v.bit_length() - 10

    def fences(m, ids):
        v = sorted(rough(value(feats[i], m)) for i in ids)
        q1, q3 = (next(x for k, x in enumerate(v, 1) if 4 * k >= q * len(v)) for q in (1, 3))
        return len(v), q3 + 6 * (q3 - q1 + parts[m][2]), max(0, q1 - 3 * (q3 - q1 + parts[m][2]))

    def fine(i):
        for m in parts:
            high, low = None, None
            for inside in (lambda j: True, lambda j: group[j][0] == group[i][0], lambda j: group[j] == group[i]):
                n, h, lo = fences(m, [j for j in feats if not base[j] and inside(j)])
                high, low = (h, lo) if high is None else ((n * h + 50 * high) // (n + 50), (n * lo + 50 * low) // (n + 50))
            if value(feats[i], m) > high or m == "word_length" and value(feats[i], m) < low:
                return False
        return True

    return {i: (*f[:5], base[i], not base[i] and fine(i)) for i, f in feats.items()}


def test_quality(docs, empty, scratch):
    want = brute_verdicts(ROWS)
    got = {r.doc_id: tuple(r)[1:] for r in quality.quality_verdicts(docs, scratch).collect()}
    assert got == want
    kept = quality.quality_filter(docs, scratch)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if w[-1]}
    assert quality.quality_verdicts(empty, scratch).count() == 0 and quality.quality_filter(empty, scratch).count() == 0


def test_quality_limits_of_groups_decide(spark, scratch):
    """Symbols are usual in one source of code and long words in one language: the same text is kept there and rejected elsewhere."""
    rng = random.Random(14)
    text = lambda k, extra: " ".join("".join(rng.choices("abcdefg", k=k)) + extra for _ in range(60 + rng.randrange(9)))
    kinds = {("en", "web"): (4, ""), ("en", "code"): (4, "##$"), ("de", "web"): (9, ""), (None, "web"): (4, "")}
    rows = [(k, text(*kind), *g) for n, (g, kind) in enumerate(kinds.items()) for k in range(600 * n, 600 * n + 600)]
    odd = [(9000, text(4, "##$"), "en", "web"), (9001, text(4, "##$"), "en", "code"), (9002, text(4, "##$"), "de", "web"), (9003, "a " * 30 + text(1, "")[:50], "de", "web")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(df, scratch).collect()}
    assert {i: got[i] for i, *_ in odd[:3]} == {9000: False, 9001: True, 9002: False}
    assert sum(got[i] for i, *_ in rows) >= 0.99 * len(rows)


def test_licences(docs, empty):
    got = {r.doc_id: r for r in licences.licence_scan(docs).collect()}
    df = Counter(x for _, t, *_ in ROWS for x in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))))
    for i, t, *_ in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places, labels = [], set()
        for phrase, label in licences.BASE.items():
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        have = " " + " ".join(w) + " "
        for name, (text, must) in licences.TEMPLATES.items():  # every template at every position
            tw = [x.decode() for x in licences.words_of(text.encode())]
            weight = [math.log((1 + len(ROWS)) / (1 + df[x])) + 1e-6 for x in tw]
            cover = max((sum(g for k, g in enumerate(weight) if 0 <= s + k < len(w) and w[s + k] == tw[k]) for s in range(-len(tw), len(w))), default=0) / sum(weight)
            label = name.removesuffix(licences.SUFFIX)
            if cover >= licences.MIN_COVER and all(f" {p} " in have for p in must):
                labels.add(label)
                assert labels - {label} and r.score == 1 or r.score >= cover - 1e-9
        assert set(r.labels.split(",")) == (labels or {""})
    assert "cc-by-nc" in {x for r in got.values() for x in r.labels.split(",")}
    assert licences.licence_scan(empty).count() == 0


def test_licences_in_linear_time():
    import time

    words = [b"cc", b"by"] * 100_000
    joined = b" " + b" ".join(words) + b" "
    at = time.time()
    places, _ = licences.base_places(joined)
    assert len(places) == 100_000 and places[:3] == [0, 2, 4] and time.time() - at < 2


def test_language_rejects_mixed_texts(spark):
    rng = random.Random(21)
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    make = lambda letters: " ".join("".join(rng.choices(letters, k=5)) for _ in range(30))
    rows = [(i, make(a), k) for i in range(900) for k, a in [rng.choice(list(kinds.items()))]]
    odd = [(5000 + i, make("abcde") + " " + make("fghij"), None) for i in range(50)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(df, language.fit_language(df)).collect()}
    assert sum(got[i].accepted for i, *_ in rows) >= 0.95 * len(rows)
    assert sum(got[i].accepted for i, *_ in odd) <= 0.2 * len(odd)


def test_language(spark, empty):
    rng = random.Random(2)
    kinds = {"xx": "abcde", "yy": "fghij", "zz": "klmno"}
    rows = [(i, " ".join("".join(rng.choices(a, k=5)) for _ in range(30)), k, "s", None, "", 0) for i in range(300) for k, a in [rng.choice(list(kinds.items()))]]
    rows += [(1000, None, "xx", "s", None, "", 0), (1001, "123 !?", "yy", "s", None, "", 0), (1002, "", None, None, None, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in language.identify(df, language.fit_language(df)).collect()}
    assert len(got) == len(rows)
    for i, _, k, *_ in rows[:300]:
        assert got[i].lang_pred == k and 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert language.identify(empty, language.fit_language(empty)).count() == 0
    assert {r.lang_pred for r in language.identify(df, language.fit_language(empty)).collect()} == {"und"}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, empty, scratch, k):
    sets = {i: shingle_set(t, k) for i, t, *_ in ROWS}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(ids, links)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, scratch, k).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}
    stays = neardup.one_of_each(docs, scratch, k)
    assert stays.columns == docs.columns and {r.doc_id for r in stays.collect()} == {i for i in ids if want[i] == i}
    assert neardup.near_duplicates(empty, scratch).count() == 0


def test_rows_that_share_an_id(spark, scratch):
    """Each row stands for its own text, and no text goes unless a similar one stays."""
    rng = random.Random(4)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(80)) for _ in range(3))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (4, c), (5, c), (5, a), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(df, scratch).collect())
    assert got == [(0, 0, True), (1, 1, True), (2, 1, False), (2, 2, True), (2, 2, True), (3, 2, False), (4, 4, True), (5, 1, False), (5, 4, False)]
    stays = sorted((r.doc_id or 0, r.text) for r in neardup.one_of_each(df, scratch).collect())
    assert stays == sorted([(0, a), (1, a), (2, b), (2, b), (4, c)])
    found = sorted((r.doc_id, r.class_id) for r in passages.near_duplicate_passages(df, scratch).collect())
    assert found == [(1, 1), (2, 1), (2, 2), (3, 2), (4, 4), (5, 1), (5, 4)]


def test_near_duplicates_dealt_in_cells(spark, scratch, monkeypatch):
    """Nodes that stay large to the last level are compared in cells."""
    rng = random.Random(31)
    ws = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        c = list(ws)
        for _ in range(rng.randint(0, 3)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    for name, value in (("WORK", 10), ("LEVELS", 1), ("CHUNK", 20)):
        monkeypatch.setattr(neardup, name, value)
    sets = {i: shingle_set(t, 4) for i, t in rows}
    want = groups(sorted(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got)


def test_near_duplicates_in_a_large_group(spark, scratch, monkeypatch):
    """Nodes need more comparisons than WORK, so they branch; single documents hang on others than the ends."""
    rng = random.Random(3)
    ws = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(220):
        c = list(ws)
        for _ in range(rng.randint(0, 4)):
            c[rng.randrange(len(c))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(c)))
    monkeypatch.setattr(neardup, "WORK", 300)
    sets = {i: shingle_set(t, 4) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(sorted(sets), links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert sum(got[i] == want[i] for i in got) >= 0.99 * len(got)


def test_near_duplicates_whose_lowest_node_is_large(spark, scratch, monkeypatch):
    """A passage in all documents makes large first nodes; pairs that share one meet in their small ones, without branches."""
    rng = random.Random(8)
    hot = [f"hot{i}" for i in range(45)]
    rows = []
    for f in range(60):
        a = [f"f{f}w{i}" for i in range(100)]
        b, c = list(a), list(a)
        for i in (10, 20, 30):
            b[i] = f"x{rng.randrange(10**9)}"
        for i in (50, 60, 70, 80, 90):
            c[i] = f"x{rng.randrange(10**9)}"
        rows += [(3 * f + i, " ".join(hot + ws)) for i, ws in enumerate((c, a, b))]  # the least is similar to both, but not enough
    monkeypatch.setattr(neardup, "WORK", 300)
    monkeypatch.setattr(neardup, "LEVELS", 1)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {i: i - (i % 3 == 2) for i, _ in rows}


def test_decontamination(spark, empty, scratch):
    items = [
        (0, "A train leaves Boston at 40 mph and reaches Denver after 30 hours; how far is Denver from Boston?"),
        (1, "the quick brown fox jumps over the lazy dog while nobody at all is watching the field"),
        (2, None),
        (3, "too short"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = "and so it goes on with words that nobody needs to read"
    rows = [
        (0, f"{filler} THE QUICK brown fox jumps over the lazy dog, while nobody at all is watching the field. {filler}"),
        (1, f"{filler} A train leaves Paris at 55 mph and reaches Lyon after 12 hours; how far is Lyon from Paris? {filler}"),
        (2, f"{filler} A train leaves Paris at 55 mph and reaches Lyon after 12 hours; how far is Rome from Paris? {filler}"),
        (3, filler), (4, None), (5, ""), (6, "too short"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", None, "", 0) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.item_id): (r.kind, r.first_word) for r in decontamination.leaks(df, bench, scratch).collect()}
    assert got == {(0, 1): ("exact", 12), (1, 0): ("template", 12)}
    assert sorted(r.doc_id for r in decontamination.decontaminated(df, bench, scratch).collect()) == [2, 3, 4, 5, 6]
    assert decontamination.leaks(empty, bench, scratch).count() == 0
    assert decontamination.leaks(df, bench.limit(0), scratch).count() == 0


def test_decontamination_of_items_rich_in_names_and_numbers(spark, scratch):
    """A verbatim copy is found by its lower-cased words, however few of an item's words are literals."""
    items = [
        (0, "On 4 July 1776 the Continental Congress in Philadelphia adopted the Declaration of Independence"),
        (1, "Who wrote War and Peace in 1869? Leo Tolstoy"),
        (2, "Simplify 3 x 4 y 5 z"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = "and so it goes on with words that nobody needs to read"
    texts = [f"{filler} {case(t)} {filler}" for _, t in items for case in (str, str.lower, str.upper)]
    df = spark.createDataFrame(list(enumerate([*texts, filler])), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.cover, r.first_word) for r in decontamination.leaks(df, bench, scratch).collect()}
    assert got == {(i, i // 3): ("exact", 1.0, 12) for i in range(9)}


def test_decontamination_judges_every_alignment_in_its_windows(spark, scratch):
    item = "A train leaves Boston at 40 mph and reaches Denver after 30 hours; how far is Denver from Boston?"
    bad = "A train leaves Paris at 55 mph and reaches Lyon after 12 hours; how far is Rome from Paris?"
    good = bad.replace("Rome", "Lyon")
    start = "The people of the old town went to the market by the river with their baskets in hand and"
    story = f"{start} bought bread. The baker was glad. The rain fell on them all."
    bench = spark.createDataFrame([(0, item), (1, story)], "item_id long, text string")
    filler = "and so it goes on with words that nobody needs to read"
    texts = [f"{bad} {filler} {item}", f"{bad} {filler} {good}", f"{bad} {filler} {bad}", f"{start} sold bread. However it was dry. Today rain fell."]
    texts += [f"{good} {filler} {item}", f"{start.replace('river', 'Rhine')} sold bread. However it was dry."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.first_word) for r in decontamination.leaks(df, bench, scratch).collect()}
    assert got == {(0, 0): ("exact", 31), (1, 0): ("template", 31), (3, 1): ("exact", 0), (4, 0): ("exact", 31)}


def test_mixing(docs, empty, scratch):
    tokens = Counter()
    for _, t, _, s, *_ in ROWS:
        tokens[s or mixing.NO_SOURCE] += len(words(t))
    alpha, w = mixing.temperature(dict(tokens))
    assert abs(sum(w.values()) - 1) < 1e-9 and 0 <= alpha <= 1
    ratio = max(tokens.values()) / min(n for n in tokens.values() if n)
    assert ratio ** (1 - alpha) <= mixing.MAX_REPEATS + 1e-6
    due = mixing.budgets(dict(tokens), w)
    blocks, _ = mixing.mixing_plan(docs, scratch)
    rows = blocks.collect()
    got = Counter()
    for r in rows:
        got[r.source] += r.n_tokens
    longest = max(len(words(t)) for _, t, *_ in ROWS)
    for s, n in due.items():
        assert n <= got[s] < n + longest + 1
    for key, block in _by(rows, lambda r: (r.source, r.epoch)).items():
        at = 0
        for p, r in enumerate(sorted(block, key=lambda r: r.position)):
            assert (r.position, r.tokens_before) == (p, at)
            at += r.n_tokens
    times = Counter(r.doc_id for r in mixing.mixed(docs, scratch).collect())
    assert times == Counter(r.doc_id for r in rows) and set(times) == {i for i, *_ in ROWS}
    assert mixing.mixing_plan(empty, scratch)[0].count() == 0 and mixing.mixed(empty, scratch).count() == 0


def test_temperature_targets():
    even, uneven = {"a": 100, "b": 100}, {"a": 10_000, "b": 10}
    assert mixing.temperature(even)[0] == 1.0
    alpha, w = mixing.temperature(uneven, max_repeats=1e9)
    entropy = -sum(x * np.log(x) for x in w.values()) / np.log(2)
    assert abs(entropy - mixing.TARGET_ENTROPY) < 1e-6 and 0 < alpha < 1


def _by(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[key(r)].append(r)
    return out


def brute_substrings() -> dict:
    first: dict[bytes, int] = {}
    raw = {i: (t or "").encode() for i, t, *_ in ROWS}
    for i in sorted(raw):
        for p in range(len(raw[i]) - 49):
            first.setdefault(raw[i][p : p + 50], i)
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        starts = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        out[i] = len(b), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()
    return out


@pytest.mark.parametrize("piece", [suffixes.PIECE, 700])
def test_substrings(docs, empty, scratch, piece, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", piece)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.exact_substrings(docs, scratch).collect()}
    assert got == brute_substrings()
    assert suffixes.exact_substrings(empty, scratch).count() == 0


@pytest.mark.parametrize("far", [0, 1 << 61])
def test_substrings_of_rows_that_share_an_id(spark, scratch, far):
    """Each row is judged on its own text; rows of one id lose nothing to each other, and large ids keep their order."""
    rng = random.Random(6)
    x, y, z = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(3))
    rows = [(1 - far, x + y), (2 + far, z), (2 + far, x + y), (2 + far, z + x), (3 + far, z), (3 + far, z)]
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffixes.exact_substrings(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {(1 - far, 600, 0), (2 + far, 300, 0), (2 + far, 600, 600), (2 + far, 600, 300), (3 + far, 300, 300)}


def test_rows_follow_bytes_not_partitions(docs, scratch, spark):
    made = {}
    for n in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        texts, n_bytes = suffixes._keyed(docs, scratch)
        made[n] = suffixes._suffix_rows(texts.select("doc_id", "raw"), suffixes.ranges(spark, n_bytes)).count()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert made["4"] == made["64"]


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(0)
    family = suffixes.Family()
    for i in range(40):
        key = np.unique(rng.integers(0, 5000, 50)).astype(np.uint64)
        n = len(key)
        family.add(suffixes.Level(key, key + np.uint64(1), np.full(n, i << suffixes.TAG), np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, bool)))
    sizes = [len(x.key) for x in family.levels]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and len(np.unique(np.concatenate([x.key for x in family.levels]))) == sum(sizes)


def brute_windows(h, lo, hi, least):
    if hi - lo + 1 < least:
        return []
    m = lo + int(np.argmin(h[lo : hi + 1]))
    return [(lo, m, hi), *brute_windows(h, lo, m - 1, least), *brute_windows(h, m + 1, hi, least)]


def test_compact_windows():
    rng = np.random.default_rng(4)
    for n, top in ((10, 5), (200, 1000), (500, 20), (3, 9)):
        h = rng.integers(1, top, n).astype(np.uint64)
        for least in (1, 3, 46):
            got = sorted(zip(*(x.tolist() for x in passages.compact_windows(h, least))))
            assert got == sorted(brute_windows(h, 0, n - 1, least))


def test_passages(docs, empty, scratch):
    got = {r.doc_id: r for r in passages.near_duplicate_passages(docs, scratch).collect()}
    where = defaultdict(set)
    for i, t, *_ in ROWS:
        w = words(lower(t))
        for p in range(len(w) - 59):
            where[tuple(w[p : p + 60])].add(i)
    must = set().union(*(x for x in where.values() if len(x) > 1))
    assert must and must <= set(got)
    sets = {i: shingle_set(t, 5) for i, t, *_ in ROWS}
    for i in got:  # each shares at least the shingles of one passage with another document
        assert max(len(sets[i] & sets[j]) for j in sets if j != i) >= 0.8 * passages.LEAST
        assert got[i].class_id <= i and got[i].n_passage_words >= passages.WORDS
    links = passages.passage_links(docs, scratch).collect()
    texts = {i: words(lower(t)) for i, t, *_ in ROWS}
    for r in links:
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (texts[r.a][r.a_first : r.a_last + 1], texts[r.b][r.b_first : r.b_last + 1]))
        assert len(a & b) >= 0.8 * len(a | b)
    assert passages.near_duplicate_passages(empty, scratch).count() == 0


def test_passages_that_an_earlier_document_holds_in_part(spark, scratch):
    """Exact copies of 60 words are found, also where a smaller document shares 40 of these words."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choices("abcdefghijkl", k=6))
    text = lambda n: [word() for _ in range(n)]
    rows, pairs = [], []
    for i in range(150):
        shared = text(60)
        rows += [(3 * i, " ".join(text(30) + shared[10:50] + text(30))), (3 * i + 1, " ".join(text(40) + shared + text(40))), (3 * i + 2, " ".join(text(25) + shared + text(70)))]
        pairs.append((3 * i + 1, 3 * i + 2))
    links = {(r.a, r.b) for r in passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert sum(p in links for p in pairs) >= 0.99 * len(pairs)


def test_passages_that_the_first_and_the_last_document_hold_in_part(spark, scratch):
    """Documents between others that share 40 of their 60 common words: every leader fails the verification, so the pair itself must meet."""
    rng = random.Random(19)
    text = lambda n: ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n)]
    rows, pairs = [], []
    for i in range(100):
        shared = text(60)
        part = lambda: " ".join(text(30) + shared[10:50] + text(30))
        rows += [(8 * i + k, part()) for k in (0, 1, 2, 5, 6, 7)] + [(8 * i + k, " ".join(text(40) + shared + text(40))) for k in (3, 4)]
        pairs.append((8 * i + 3, 8 * i + 4))
    links = {(r.a, r.b) for r in passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert links == set(pairs)


def test_window_pairs_of_every_size_of_group():
    """Small groups meet in all pairs, larger ones by their documents' longest windows, and no window of the others is without one."""
    rng = np.random.default_rng(5)
    for n, docs in ((5, 4), (60, 20), (300, 30), (900, 400)):
        doc = np.sort(rng.integers(0, docs, n))
        at = rng.integers(100, 200, n)
        lo, hi = at - rng.integers(30, 90, n), at + rng.integers(30, 90, n)
        cand = passages._meeting(np.full(n, 8, np.uint64), doc, lo, hi, at)
        got = set(zip(cand["a"].tolist(), cand["b"].tolist()))
        every = {(x, y) for x in doc.tolist() for y in doc.tolist() if x < y}
        assert got == every if docs <= passages.SMALL else {x for p in got for x in p} == set(doc.tolist())
    none = np.zeros(0, np.int64)
    assert not len(passages._meeting(none.astype(np.uint64), none, none, none, none)["a"])


def parts_one_by_one(x, y, lo, hi):
    """The similar parts of x[lo:hi] and y, by their definition."""
    there = [9 * (v in set(y)) - 8 for v in x]
    stretches = [(b + 1 - a, b, a) for a in range(lo, hi) for b in range(a + passages.LEAST - 1, hi) if sum(there[a : b + 1]) >= 0]
    if not stretches:
        return []
    n, b, a = max(stretches)
    p, out = set(x[a : b + 1]), []
    for slack in (len(x) + len(y), max(1, n // 10)):
        at = [i for i, v in enumerate(y) if v in p and a - slack <= i <= b + slack]
        q = set(y[at[0] : at[-1] + 1]) if at else set()
        if at and at[-1] - at[0] + 1 >= passages.LEAST and len(p & q) >= 0.8 * len(p | q):
            out = [(a, b, at[0], at[-1])]
            break
    return out + parts_one_by_one(x, y, lo, a) + parts_one_by_one(x, y, b + 1, hi)


def test_similar_parts_of_many_pairs_at_once():
    rng = np.random.default_rng(8)
    pairs = [(np.arange(5), np.arange(0))]
    for k in range(40):
        x = rng.integers(0, 1 << 32, rng.integers(46, 200))
        y = x.copy()
        y[rng.random(len(y)) < rng.choice([0, 0.02, 0.1, 0.3])] = 7
        if k % 4 == 0:
            y = np.concatenate([y[60:], x[:50], y[:60]])  # parts in another order, and one twice
        if k % 5 == 0:
            x = np.concatenate([x[:50], np.full(30, k), x])
        pairs.append((x, y))
    row, *ends = passages.similar_parts(*([v.astype("<u4").tobytes() for v in side] for side in zip(*pairs)))
    got = defaultdict(set)
    for r, *part in zip(row.tolist(), *(e.tolist() for e in ends)):
        got[r].add(tuple(part))
    want = {i: set(parts) for i, (x, y) in enumerate(pairs) if (parts := parts_one_by_one(x.tolist(), y.tolist(), 0, len(x)))}
    assert got == want and sum(map(len, want.values())) > 20
    assert not any(len(v) for v in passages.similar_parts([], []))


def test_passage_recall_at_the_least_similarity(spark, scratch):
    """Planted passages of 80 words with words replaced, similarity of 0.8 and more by brute force, beside shadowing documents."""
    rng = random.Random(18)
    text = lambda n: ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(n)]
    rows, pairs = [], []
    for i in range(300):
        one = text(80)
        two = list(one)
        for _ in range(rng.randint(0, 2)):
            two[rng.randrange(80)] = text(1)[0]
        a, b = ({tuple(x[k : k + 5]) for k in range(76)} for x in (one, two))
        rows += [(3 * i, " ".join(text(20) + one[:45] + text(20))), (3 * i + 1, " ".join(text(20) + one + text(20))), (3 * i + 2, " ".join(text(20) + two + text(20)))]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((3 * i + 1, 3 * i + 2))
    links = {(r.a, r.b) for r in passages.passage_links(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert len(pairs) > 200 and sum(p in links for p in pairs) >= 0.95 * len(pairs)


def test_pipeline_matches_its_stages(spark, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, ROWS[20][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    s = common.Scratch(spark)
    kept = {r.doc_id for r in quality.quality_verdicts(docs, s).filter("kept").collect()}
    sets = {i: shingle_set(t, 5) for i, t, *_ in ROWS if i in kept}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = groups(sorted(sets), links)
    one = {i for i in sets if group[i] == i}
    assert out and {r.doc_id for r in out} <= one and len({r.doc_id for r in out}) >= 0.8 * len(one) and {r.shard for r in out} <= set(range(16))
    assert corpus_pipeline.ORACLE_SQL is None and [len(corpus_pipeline.STAGES)] == [5]


def test_pipeline_rows_match_brute_force(spark, tmp_path):
    """Full rows: what each stage keeps, how often mixing reads it, and where it stands. The item is a kept document."""
    import corpus_pipeline

    verdict = brute_verdicts(ROWS)
    sets = {i: shingle_set(t, 5) for i, t, *_ in ROWS if verdict[i][-1]}
    group = groups(sorted(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    text, source = {i: t or "" for i, t, *_ in ROWS}, {i: s or mixing.NO_SOURCE for i, _, _, s, *_ in ROWS}
    one = sorted(i for i in sets if group[i] == i)
    item = text[one[3]]
    plain = {i: re.findall(r"[^\W\d_]+|\d+(?:[.,]\d+)*", text[i].lower()) for i in one}
    cut = lambda w: [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    wanted = defaultdict(list)
    for k, x in enumerate(cut(plain[one[3]])):
        wanted[x].append(k)
    shifts = {i: Counter(p - k for p, x in enumerate(cut(plain[i])) for k in wanted.get(x, ())) for i in one}
    clean = [i for i in one if max(shifts[i].values(), default=0) < 6]
    assert one[3] not in clean and len(clean) > 10

    tokens = {i: len(words(text[i])) for i in clean}
    totals = Counter()
    for i in clean:
        totals[source[i]] += tokens[i]
    due = mixing.budgets(dict(totals), mixing.temperature(dict(totals))[1])
    times = {i: due[source[i]] // totals[source[i]] for i in clean}
    last = spark.createDataFrame([(i, source[i], times[i]) for i in clean], "doc_id long, source string, epoch long")
    h = {r.doc_id: r.h for r in last.selectExpr("doc_id", f"xxhash64({mixing.SEED}, source, epoch, doc_id) as h").collect()}
    before = Counter()
    for i in sorted(clean, key=lambda i: (h[i], i)):
        if before[source[i]] < due[source[i]] % totals[source[i]]:
            times[i] += 1
        before[source[i]] += tokens[i]
    rows = [i for i in sorted(clean) for _ in range(times[i])]
    size = {i: len(text[i].encode()) + 1 for i in clean}
    total, at, slots, want = sum(size[i] for i in rows), 0, Counter(), Counter()
    for i in rows:
        s = min(15, (2 * at + size[i]) * 16 // (2 * total))
        want[i, size[i], zlib.crc32(text[i].encode()), s, slots[s]] += 1
        slots[s] += 1
        at += size[i]

    folder = str(tmp_path)
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in out) == want
