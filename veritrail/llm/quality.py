"""Quality rules whose limits come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, Scratch, arrow_map, fresh, table

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The limits of a metric are the fences upper quartile + SPREAD * (interquartile range + slack) and, where it has one,
#: lower quartile - SPREAD_LOW * (interquartile range + slack), so a narrow group is not cut at its edge.
SPREAD, SPREAD_LOW = 6, 3
#: A sketch has a bin for every value under EXACT (parts per thousand), and EXACT / 2 bins for each doubling above it.
EXACT = 1024
#: The limits of a group with n rows are drawn towards those of the group above it with PRIOR / (n + PRIOR): a source of a
#: language towards the language, a language towards the corpus. A large group has limits of its own, a small one nearly its parent's.
PRIOR = 50

FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: name of the metric, its numerator and denominator, its slack, and whether it has a lower fence; values are per thousand.
#: A few repeated lines or words are usual in short clean texts, so their slack is larger.
METRICS = {
    "word_length": ("word_chars", "n_words", 300, True),
    "symbol_share": ("n_symbols", "n_words", 20, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 120, False),
    "repeat_share": ("n_repeat_words", "n_words", 60, False),
}


def text_features(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """The base counts of one text, in the order of FEATURES."""
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0
    dense = raw.translate(None, SPACE)
    chars = len(dense) - int(np.count_nonzero(np.frombuffer(dense, np.uint8) >> 6 == 2))  # less UTF-8 continuation bytes
    lines = Counter(x for x in raw.split(b"\n") if x and not x.isspace())
    total = sum(lines.values())
    repeated = 0
    if n >= 3:
        code: dict[bytes, int] = {}
        ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
        v = len(code)
        if v < 2_000_000:
            three = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            three = np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]], 1), axis=0, return_inverse=True)[1].ravel()
        order = np.argsort(three, kind="stable")
        sorted_ = three[order]
        same = np.zeros(len(three), bool)
        hit = sorted_[1:] == sorted_[:-1]
        same[1:] |= hit
        same[:-1] |= hit
        if hit.any():
            covered = np.zeros(n, bool)
            at = order[same]
            for j in range(3):
                covered[at + j] = True
            repeated = int(covered.sum())
    return n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), total - len(lines), repeated, total


def with_features(docs: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """``keep`` columns of ``docs`` and a struct column ``prefix`` of the counts of its whole text."""
    text = fresh("raw", keep)
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias(text))
    inner = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches):
        for batch in batches:
            got = np.array([text_features(x) for x in batch.column(text).to_pylist()], np.int64).reshape(-1, len(inner))
            out = {c: batch.column(c) for c in keep}
            out |= {f"{prefix}_{c}": got[:, i] for i, c in enumerate(inner)}
            yield out

    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"`{prefix}_{c}` long" for c in inner])
    return arrow_map(source, run, schema)


def _permille(prefix: str, metric: str) -> Column:
    num, den, *_ = METRICS[metric]
    return F.expr(f"`{prefix}_{num}` * 1000 div greatest(`{prefix}_{den}`, 1)")


def sketch(rows: DataFrame, prefix: str) -> DataFrame:
    """Mergeable quantile sketches: counts of the bins of each metric per (lang, source).

    Two sketches merge by adding their counts, so they can be built per day or per folder. Values under EXACT have a bin
    each; larger ones share bins of a relative width of 2 / EXACT, so a sketch has under EXACT * 27 bins however many rows it
    has. Rows that the fixed base rules reject teach nothing.
    """
    values = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _permille(prefix, m).alias("v")) for m in METRICS])).alias("x"))
    bins = F.expr(f"if(x.v < {EXACT}, x.v, x.v - x.v % shiftleft(1L, cast(floor(log2(x.v)) as int) - {EXACT.bit_length() - 2}))")
    return values.groupBy("lang", "source", F.col("x.metric").alias("metric"), bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def limits(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """lang, source, metric, high, low: the limits of every (lang, source), from the quartiles of merged sketches.

    Nulls are groups of their own. Quartiles are the least bins that hold a quarter and three quarters of the rows.
    """
    level = lambda n, lang, source: F.struct(F.lit(n).alias("level"), lang.alias("lang"), source.alias("source"))
    none = F.lit(None).cast("string")
    merged = (
        sketches.select(F.explode(F.array(level(0, none, none), level(1, F.col("lang"), none), level(2, F.col("lang"), F.col("source")))).alias("g"), "metric", "bin", "n")
        .groupBy("g.level", "g.lang", "g.source", "metric", "bin").agg(F.sum("n").alias("n"))
    )
    key = ["level", "lang", "source", "metric"]
    w = Window.partitionBy(*key)
    run = merged.select(*key, "bin", F.sum("n").over(w.orderBy("bin")).alias("upto"), F.sum("n").over(w).alias("total"))
    quart = run.groupBy(*key).agg(
        F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bin"))).alias("q3"),
        F.max("total").alias("total"),
    )
    slack = F.expr("case metric " + " ".join(f"when '{m}' then {s}" for m, (_, _, s, _) in METRICS.items()) + " end")
    wide = F.col("q3") - F.col("q1") + slack
    own = quart.select(*key, "total", (F.col("q3") + SPREAD * wide).alias("high"), F.greatest(F.lit(0), F.col("q1") - SPREAD_LOW * wide).alias("low"))

    def at(n: int) -> DataFrame:
        return own.filter(F.col("level") == n).select(F.col("lang").alias(f"lang{n}"), F.col("source").alias(f"source{n}"), F.col("metric").alias(f"metric{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("total", "high", "low")])

    drawn = lambda c, n, above: F.expr(f"(total{n} * {c}{n} + {prior} * ({above})) div (total{n} + {prior})")
    tree = at(2).join(at(1), F.col("lang2").eqNullSafe(F.col("lang1")) & (F.col("metric2") == F.col("metric1"))).join(at(0), F.col("metric2") == F.col("metric0"))
    for c in ("high", "low"):
        tree = tree.withColumn(f"{c}_lang", drawn(c, 1, f"{c}0")).withColumn(c, drawn(c, 2, f"{c}_lang"))
    return tree.select(F.col("lang2").alias("lang"), F.col("source2").alias("source"), F.col("metric2").alias("metric"), "high", "low")


def judged(rows: DataFrame, prefix: str) -> DataFrame:
    """Adds ``{prefix}_base_failed`` and ``{prefix}_kept`` to rows with features.

    Groups compare lang and source null-safely: a null is a group of its own. The limits have as many rows as there are
    groups; Spark picks the join by their measured size.
    """
    base = f"(`{prefix}_n_words` < {MIN_WORDS} or 100 * `{prefix}_n_repeat_words` > {MAX_REPEAT_PERCENT} * `{prefix}_n_words`)"
    rows = rows.withColumn(f"{prefix}_base_failed", F.expr(base))
    lim = limits(sketch(rows.filter(~F.col(f"{prefix}_base_failed")), prefix))
    pick = [F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{m}_{c}") for m in METRICS for c in ("high", "low")]
    own = lim.groupBy(F.col("lang").alias("g_lang"), F.col("source").alias("g_source")).agg(*pick)
    joined = rows.join(own, rows["lang"].eqNullSafe(own["g_lang"]) & rows["source"].eqNullSafe(own["g_source"]), "left")
    fine = F.lit(True)
    for m, (_, _, _, lower) in METRICS.items():
        fine = fine & F.coalesce(_permille(prefix, m) <= F.col(f"{m}_high"), F.lit(True))
        if lower:
            fine = fine & F.coalesce(_permille(prefix, m) >= F.col(f"{m}_low"), F.lit(True))
    return joined.withColumn(f"{prefix}_kept", ~F.col(f"{prefix}_base_failed") & fine).drop(*[f"{m}_{c}" for m in METRICS for c in ("high", "low")], "g_lang", "g_source")


def quality_verdicts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base counts, base_failed and kept.

    Every whole text is counted once; the counts (no texts) are written, sketched per (lang, source)
    and joined with the limits. A null text has no words and fails the base rules. A very long text is counted whole. Repeated
    rows, and rows that share a doc_id, are judged each. A value equal to a limit is kept. An empty table gives no rows. Extra columns are ignored.
    """
    rows = scratch.keep(with_features(docs.select("doc_id", "lang", "source", "text"), ["doc_id", "lang", "source"], "f"), "features")
    return judged(rows, "f").select(
        "doc_id", *[F.col(f"f_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col("f_base_failed").alias("base_failed"), F.col("f_kept").alias("kept"),
    )


def quality_filter(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged."""
    names = docs.columns
    prefix = fresh("quality_rule", names)
    while any(c.lower().startswith(prefix.lower()) for c in names):
        prefix = "_" + prefix
    rows = scratch.keep(with_features(docs, names, prefix), "features")
    return judged(rows, prefix).filter(f"`{prefix}_kept`").select(*[F.col(f"`{c}`") for c in names])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"), Scratch(spark))


OP7_SQL = f"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY rid
),
tri AS (
  SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri) WHERE n > 1),
reps AS (SELECT rid, count(DISTINCT i + j) AS n_repeat_words FROM twice, range(3) r(j) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN reps USING (rid)
),
g AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM f),
vals AS (
  {" UNION ALL ".join(f"SELECT rid, lang, source, base_failed, '{m}' AS metric, {a} * 1000 // greatest({b}, 1) AS v FROM g" for m, (a, b, _, _) in METRICS.items())}
),
bins AS (SELECT *, CASE WHEN v < 1024 THEN v ELSE v - v % (1::BIGINT << (floor(log2(v))::INT - 9)) END AS bin FROM vals WHERE NOT base_failed),
sk AS (
  SELECT 2 AS level, lang, source, metric, bin, count(*) AS n FROM bins GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, metric, bin, count(*) FROM bins GROUP BY ALL
  UNION ALL SELECT 0, NULL, NULL, metric, bin, count(*) FROM bins GROUP BY ALL
),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bin) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM sk
),
lim AS (
  SELECT level, lang, source, metric, max(total)::BIGINT AS total, min(bin) FILTER (4 * upto >= total) AS q1, min(bin) FILTER (4 * upto >= 3 * total) AS q3,
    CASE metric {' '.join(f"WHEN '{m}' THEN {s}" for m, (_, _, s, _) in METRICS.items())} END AS slack
  FROM cum GROUP BY level, lang, source, metric
),
own AS (SELECT *, q3 + 6 * (q3 - q1 + slack) AS high, greatest(0, q1 - 3 * (q3 - q1 + slack)) AS low FROM lim),
langs AS (
  SELECT o.lang, o.metric, (o.total * o.high + 50 * e.high) // (o.total + 50) AS high, (o.total * o.low + 50 * e.low) // (o.total + 50) AS low
  FROM own o JOIN own e ON o.level = 1 AND e.level = 0 AND o.metric = e.metric
),
fence AS (
  SELECT o.lang, o.source, o.metric, (o.total * o.high + 50 * l.high) // (o.total + 50) AS high, (o.total * o.low + 50 * l.low) // (o.total + 50) AS low
  FROM own o JOIN langs l ON o.level = 2 AND o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang
),
bad AS (
  SELECT DISTINCT v.rid FROM vals v JOIN fence o ON o.metric = v.metric AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
  WHERE v.v > o.high OR (v.metric = 'word_length' AND v.v < o.low)
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, (NOT base_failed AND rid NOT IN (SELECT rid FROM bad)) AS kept
FROM g
"""
