"""Queries over scored rows: ranking, calibration, selective prediction, agreement, tests, performance cards, trails."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import calibrate, metrics
from ..sources import tables as t

_V = "CASE WHEN {0} >= 0.8 THEN 'promising' WHEN {0} >= 0.6 THEN 'conditional' WHEN {0} >= 0.35 THEN 'hold' ELSE 'reject' END"


def _scored(spark, d):
    s = t.scored(spark, d)
    verdict = lambda c: F.when(c >= 0.8, "promising").when(c >= 0.6, "conditional").when(c >= 0.35, "hold").otherwise("reject")
    return s.withColumn("verdict_a", verdict(F.col("score_a"))).withColumn("verdict_b", verdict(F.col("score_b")))


def q_auroc(spark, d):
    one = metrics.auroc(_scored(spark, d), "score_b", "y", ["lang"])
    lo, hi = metrics.auroc_interval(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return one.select("lang", F.round("auc", 9).alias("auc"), "n_pos", "n_neg", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def q_ece5(spark, d):
    s = _scored(spark, d)
    return metrics.calibration_error(s, "score_a", "y", metrics.bins_right_closed(F.col("score_a"))).select(F.round("ece", 9).alias("ece"), "n")


def q_ece10(spark, d):
    s = _scored(spark, d)
    return metrics.calibration_error(s, "score_a", "y", metrics.bins_left_closed(F.col("score_a"))).select(F.round("ece", 9).alias("ece"), "n")


def q_brier(spark, d):
    s = _scored(spark, d)
    spec = F.try_divide(F.count_if((F.col("score_a") < 0.5) & (F.col("y") == 0)), F.count_if(F.col("y") == 0))
    sens = F.try_divide(F.count_if((F.col("score_a") >= 0.5) & (F.col("y") == 1)), F.count_if(F.col("y") == 1))
    return s.groupBy("source").agg(F.round(F.avg(F.pow(F.col("score_a") - F.col("y"), 2)), 9).alias("brier_a"), F.round(F.avg(F.pow(F.col("score_b") - F.col("y"), 2)), 9).alias("brier_b"), spec.alias("specificity"), sens.alias("sensitivity"))


def q_confusion_ci(spark, d):
    """Share of right predictions of the toxic label by source with its interval."""
    g = _scored(spark, d).groupBy("source").agg(F.count_if(F.col("y") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select("source", "k", "n", F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def q_selective(spark, d):
    """Coverage and accuracy with conditional verdicts abstaining (strict) and following their score (loose)."""
    s = _scored(spark, d)
    out = None
    for name, strict in (("strict", True), ("loose", False)):
        p = metrics.verdict_prediction(F.col("verdict_b"), F.col("score_b"), strict)
        row = s.withColumn("pred", p).agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("n_answered"), F.count_if(F.col("pred") == F.col("y")).alias("n_right")).withColumn("mode", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out.select("mode", "n", "n_answered", (F.col("n_answered") / F.col("n")).alias("coverage"), F.try_divide("n_right", "n_answered").alias("accuracy"))


def q_risk_coverage(spark, d):
    return metrics.risk_coverage(_scored(spark, d).select("id", "y", "score_b"), "score_b", "y", ["id"]).select("id", "k", F.round("coverage", 9).alias("coverage"), F.round("risk", 9).alias("risk"), F.round("grisk", 9).alias("grisk"))


def q_aurc(spark, d):
    rc = metrics.risk_coverage(_scored(spark, d).select("id", "y", "score_b"), "score_b", "y", ["id"])
    return metrics.curve_areas(rc).select("n", "errors", *[F.round(c, 9).alias(c) for c in ("aurc", "augrc", "optimal_aurc")])


def q_risk_at_coverage(spark, d):
    """Risk at six coverages of the curve."""
    rc = metrics.risk_coverage(_scored(spark, d).select("id", "y", "score_b"), "score_b", "y", ["id"])
    cut = rc.drop("coverage").withColumn("at", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.2, 0.4, 0.6, 0.8, 1.0)]))).filter(F.col("k") == F.floor(F.col("n") * F.col("at") + 1e-9))
    return cut.select(F.col("at").alias("coverage"), "k", F.round("risk", 9).alias("risk"))


def q_tie_repeats(spark, d):
    """Mean and deviation of aurc over 20 orders of ties: scores are coarse, ties are ordered by a hash of (seed, id)."""
    s = _scored(spark, d).select("id", "y", F.round("score_b", 1).alias("s")).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(20))))
    w = Window.partitionBy("seed").orderBy(F.desc(F.abs(F.col("s") - 0.5)), F.md5(F.concat_ws(":", F.col("seed").cast("string"), F.col("id").cast("string"))))
    run = s.withColumn("wrong", ((F.col("s") > 0.5).cast("int") != F.col("y")).cast("int")).withColumn("risk", F.sum("wrong").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.row_number().over(w))
    per = run.groupBy("seed").agg(F.avg("risk").alias("aurc"))
    return per.agg(F.round(F.avg("aurc"), 9).alias("mean"), F.round(F.stddev_pop("aurc"), 9).alias("sd"), F.count(F.lit(1)).alias("repeats"))


def q_reject_precision(spark, d):
    return metrics.reject_precision(_scored(spark, d).select("id", "y", "score_b"), "score_b", "y", ["id"], (10, 20, 50, 100)).select("k", "n", F.round("precision", 9).alias("precision"))


def q_kappa(spark, d):
    return metrics.kappa(_scored(spark, d), "verdict_a", "verdict_b").select("n_all", *[F.round(c, 9).alias(c) for c in ("observed", "expected", "kappa", "lo", "hi")])


def q_mcnemar_counts(spark, d):
    s = _scored(spark, d)
    right = lambda c: (F.col(c) > 0.5).cast("int") == F.col("y")
    return metrics.paired(s, right("score_a"), right("score_b")).withColumn("p", F.round("p", 9))


def q_fisher(spark, d):
    """Per source: toxic against quality, the exact two-sided p."""
    g = _scored(spark, d).groupBy("source").agg(*[F.count_if((F.col("toxic") == a) & (F.col("y") == b)).alias(n) for n, a, b in (("a", 1, 1), ("b", 1, 0), ("c", 0, 1), ("d", 0, 0))])
    return g.select("source", "a", "b", "c", "d", F.round(stats.fisher(F.col("a"), F.col("b"), F.col("c"), F.col("d")), 9).alias("p"))


def q_binomial(spark, d):
    """Per source: the chance of at least its number of low-quality rows at a rate of 0.15."""
    g = _scored(spark, d).groupBy("source").agg(F.count_if(F.col("y") == 0).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select("source", "k", "n", F.round(stats.binomial_at_least(F.col("k"), F.col("n"), F.lit(0.15)), 9).alias("p"))


def q_power(spark, d):
    """Power of each pair of languages' comparison of quality rates."""
    g = _scored(spark, d).groupBy("lang").agg(F.avg("y").alias("p"), F.count(F.lit(1)).alias("n"))
    pairs = g.select(F.col("lang").alias("a"), F.col("p").alias("p1"), F.col("n").alias("n1")).join(g.select(F.col("lang").alias("b"), F.col("p").alias("p2"), F.col("n").alias("n2")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", "n1", "n2", F.round(stats.power_two(F.col("p1"), F.col("p2"), F.col("n1"), F.col("n2")), 6).alias("power"))


def q_wilcoxon_ranks(spark, d):
    s = _scored(spark, d).select(F.round(F.col("score_a") - F.col("score_b"), 2).alias("diff"))
    return metrics.signed_ranks(s, "diff").select("n", "w_plus", "w_minus", F.round("z", 9).alias("z"))


def q_holm(spark, d):
    return metrics.holm(q_binomial(spark, d), "p", ["source"]).select("source", "p", F.round("adjusted", 9).alias("adjusted"))


def q_bootstrap_ci(spark, d):
    return calibrate.bootstrap_brier(_scored(spark, d), "score_a", "score_b", "y", ["id"])


def q_platt(spark, d):
    s = _scored(spark, d)
    a, b = calibrate.fit_platt(s, "score_b", "y")
    return s.agg(F.lit(round(a, 6)).alias("a"), F.lit(round(b, 6)).alias("b"), F.round(F.avg(F.pow(1 / (1 + F.exp(F.lit(a) * F.col("score_b") + b)) - F.col("y"), 2)), 6).alias("brier"))


def q_perf_card(spark, d):
    s = _scored(spark, d)
    subsets = {"all": F.lit(True), "unknown": F.abs(F.col("score_a") - 0.5) <= 0.15, "clean": F.col("toxic") == 0}
    return metrics.performance(s, subsets, "verdict_b", "y")


def q_verdict_cube(spark, d):
    """Verdicts by language and label, with all partial totals."""
    return _scored(spark, d).rollup("verdict_b", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"), F.grouping_id().cast("int").alias("level"))


def q_reject_split(spark, d):
    """Kinds of verdicts by label, as columns."""
    s = _scored(spark, d).withColumn("kind", F.col("verdict_b"))
    return s.groupBy("y").pivot("kind", ["promising", "conditional", "hold", "reject"]).count().na.fill(0)


def q_ci_overlap(spark, d):
    """Whether the languages' intervals of quality share a point."""
    g = _scored(spark, d).groupBy("lang").agg(F.count_if(F.col("y") == 1).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = stats.wilson(F.col("k"), F.col("n"))
    return g.select(lo.alias("lo"), hi.alias("hi")).agg(F.round(F.max("lo"), 9).alias("max_lo"), F.round(F.min("hi"), 9).alias("min_hi"), (F.max("lo") <= F.min("hi")).alias("overlap"))


def q_quantiles(spark, d):
    """Median, upper median and index quantiles of text lengths by language."""
    docs = t.table(spark, d, "documents").groupBy("lang", "n_chars").agg(F.count(F.lit(1)).alias("m"))
    w = Window.partitionBy("lang").orderBy("n_chars")
    run = docs.select("lang", "n_chars", F.sum("m").over(w).alias("upto"), F.sum("m").over(Window.partitionBy("lang")).alias("n"))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("n_chars")))
    return run.groupBy("lang").agg(((at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2).alias("median"), at(F.floor(F.col("n") / 2)).alias("upper_median"), at(F.floor(F.col("n") * 0.9)).alias("q90"))


def _turns(spark, d):
    return t.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def q_trail_last_gate(spark, d):
    return _turns(spark, d).groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_gate"), F.max_by("role", "turn").alias("last_gate"), F.count(F.lit(1)).alias("n"))


def q_flips(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _turns(spark, d).withColumn("was", F.lag("role").over(w)).groupBy("conv_id").agg(F.count_if(F.col("was") != F.col("role")).alias("flips"))


def q_killed(spark, d):
    """Trails with any system turn, and the turns after it that are skipped."""
    first = _turns(spark, d).filter("role = 'system'").groupBy("conv_id").agg(F.min("turn").alias("killed_at"))
    j = _turns(spark, d).join(first, "conv_id", "left")
    return j.groupBy("conv_id").agg(F.max(F.col("killed_at").isNotNull()).alias("killed"), F.count_if(F.col("turn") > F.col("killed_at")).alias("n_skipped"))


def q_cost_report(spark, d):
    """Calls by purpose; calls without text are unmetered and counted apart."""
    e = t.table(spark, d, "events")
    return e.groupBy(F.col("event_type").alias("purpose")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") < 0).alias("unmetered"), F.round(F.sum("value"), 4).alias("spent"), F.count_distinct("user_id").alias("users"))


def q_top_spelling(spark, d):
    """The most frequent spelling of each folded part type, ties by name."""
    p = t.table(spark, d, "part").withColumn("spelling", F.when(F.col("p_size") % 3 == 0, F.upper("p_type")).otherwise(F.col("p_type")))
    n = p.groupBy(F.lower("p_type").alias("key"), "spelling").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "spelling"))).filter("r = 1").select("key", "spelling", "n")


def q_search_difference(spark, d):
    """Per language: documents of two searches, common and only in one, and their Jaccard share."""
    docs = t.table(spark, d, "documents").select("lang", "doc_id", "n_chars", "source")
    g = docs.groupBy("lang").agg(
        F.count_if((F.col("n_chars") > 1500) & F.col("source").isin("src1", "src2", "src3")).alias("both"),
        F.count_if((F.col("n_chars") > 1500) & ~F.col("source").isin("src1", "src2", "src3")).alias("only_long"),
        F.count_if(~(F.col("n_chars") > 1500) & F.col("source").isin("src1", "src2", "src3")).alias("only_source"),
    )
    return g.withColumn("jaccard", F.coalesce(F.try_divide("both", F.col("both") + F.col("only_long") + F.col("only_source")), F.lit(0.0)))


QUERIES = {f.__name__: f for f in (
    q_auroc, q_ece5, q_ece10, q_brier, q_confusion_ci, q_selective, q_risk_coverage, q_aurc, q_risk_at_coverage, q_tie_repeats, q_reject_precision, q_kappa, q_mcnemar_counts, q_fisher, q_binomial,
    q_power, q_wilcoxon_ranks, q_holm, q_bootstrap_ci, q_platt, q_perf_card, q_verdict_cube, q_reject_split, q_ci_overlap, q_quantiles, q_trail_last_gate, q_flips, q_killed, q_cost_report,
    q_top_spelling, q_search_difference,
)}

_S = f"WITH {t.SCORED_SQL}, s AS (SELECT *, {_V.format('score_a')} AS verdict_a, {_V.format('score_b')} AS verdict_b FROM scored)"
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_W = "greatest(0, ({k} / {n}::DOUBLE + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}) - 1.96 * sqrt({k} / {n}::DOUBLE * (1 - {k} / {n}::DOUBLE) / {n} + 3.8416 / (4.0 * {n} * {n})) / (1 + 3.8416 / {n}))"
_WLO = _W.format(k="k", n="n")
_WHI = _WLO.replace("greatest(0,", "least(1,").replace(") - 1.96", ") + 1.96")
_RC = f"""{_S}, o AS (SELECT id, y, score_b, row_number() OVER (ORDER BY abs(score_b - 0.5) DESC, id) AS k, ((score_b > 0.5)::INT <> y)::INT AS wrong, count(*) OVER () AS n FROM s),
rc AS (SELECT *, sum(wrong) OVER (ORDER BY k) AS errors FROM o)"""
_BIN = f"""{_S}, g AS (SELECT source, count(CASE WHEN y = 0 THEN 1 END) AS k, count(*) AS n FROM s GROUP BY source),
x AS (SELECT source, k, n, unnest(range(k, n + 1)) AS i FROM g),
b AS (SELECT source, k, n, round(CASE WHEN k <= 0 THEN 1 ELSE least(1, sum(exp({_LC.format('n', 'i')} + i * ln(0.15) + (n - i) * ln(0.85)))) END, 9) AS p FROM x GROUP BY source, k, n)"""

ORACLES = {
    "q_auroc": f"""{_S}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY score_b) + (count(*) OVER (PARTITION BY lang, score_b) - 1) / 2.0::DOUBLE AS r FROM s),
        a AS (SELECT lang, sum(y)::BIGINT AS n_pos, (count(*) - sum(y))::BIGINT AS n_neg, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc FROM r GROUP BY lang),
        v AS (SELECT *, (auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg) AS var FROM a)
        SELECT lang, round(auc, 9) AS auc, n_pos, n_neg, round(greatest(0, auc - 1.96 * sqrt(greatest(var, 0))), 9) AS lo, round(least(1, auc + 1.96 * sqrt(greatest(var, 0))), 9) AS hi FROM v""",
    "q_ece5": f"""{_S}, b AS (SELECT greatest(ceil(score_a * 5) - 1, 0) AS bin, count(*) AS n, avg(score_a) AS c, avg(y) AS r FROM s GROUP BY 1) SELECT round(sum(n * abs(c - r)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b""",
    "q_ece10": f"""{_S}, b AS (SELECT least(floor(score_a * 10), 9) AS bin, count(*) AS n, avg(score_a) AS c, avg(y) AS r FROM s GROUP BY 1) SELECT round(sum(n * abs(c - r)) / sum(n), 9) AS ece, sum(n)::BIGINT AS n FROM b""",
    "q_brier": f"""{_S} SELECT source, round(avg(pow(score_a - y, 2)), 9) AS brier_a, round(avg(pow(score_b - y, 2)), 9) AS brier_b, count(CASE WHEN score_a < 0.5 AND y = 0 THEN 1 END) / nullif(count(CASE WHEN y = 0 THEN 1 END), 0)::DOUBLE AS specificity,
        count(CASE WHEN score_a >= 0.5 AND y = 1 THEN 1 END) / nullif(count(CASE WHEN y = 1 THEN 1 END), 0)::DOUBLE AS sensitivity FROM s GROUP BY source""",
    "q_confusion_ci": f"{_S}, g AS (SELECT source, count(CASE WHEN y = 1 THEN 1 END) AS k, count(*) AS n FROM s GROUP BY source) SELECT source, k, n, round({_WLO}, 9) AS lo, round({_WHI}, 9) AS hi FROM g",
    "q_selective": f"""{_S}, p AS (SELECT mode, y, CASE WHEN verdict_b = 'hold' THEN NULL WHEN verdict_b = 'promising' THEN 1 WHEN verdict_b = 'reject' THEN 0 WHEN mode = 'strict' THEN NULL WHEN abs(score_b - 0.5) > 0.02 THEN (score_b > 0.5)::INT END AS pred
        FROM s, (SELECT unnest(['strict', 'loose']) AS mode)) SELECT mode, count(*) AS n, count(pred) AS n_answered, count(pred) / count(*)::DOUBLE AS coverage, count(CASE WHEN pred = y THEN 1 END) / nullif(count(pred), 0)::DOUBLE AS accuracy FROM p GROUP BY mode""",
    "q_risk_coverage": f"{_RC} SELECT id, k, round(k / n::DOUBLE, 9) AS coverage, round(errors / k::DOUBLE, 9) AS risk, round(errors / n::DOUBLE, 9) AS grisk FROM rc",
    "q_aurc": f"""{_RC}, a AS (SELECT count(*)::INT AS n, max(errors)::INT AS errors, avg(errors / k::DOUBLE) AS aurc, avg(errors / n::DOUBLE) AS augrc FROM rc)
        SELECT n, errors, round(aurc, 9) AS aurc, round(augrc, 9) AS augrc, round(coalesce((SELECT sum(j / (n - errors + j)::DOUBLE) FROM range(1, errors + 1) r(j)), 0) / n, 9) AS optimal_aurc FROM a""",
    "q_risk_at_coverage": f"{_RC} SELECT cov::DOUBLE AS coverage, k, round(errors / k::DOUBLE, 9) AS risk FROM rc, (SELECT unnest([0.1, 0.2, 0.4, 0.6, 0.8, 1.0])::DOUBLE AS cov) WHERE k = floor(n * cov + 1e-9)",
    "q_tie_repeats": f"""{_S}, x AS (SELECT id, y, round(score_b, 1) AS s, seed, ((round(score_b, 1) > 0.5)::INT <> y)::INT AS wrong FROM s, range(1, 21) r(seed)),
        o AS (SELECT seed, sum(wrong) OVER w / row_number() OVER w::DOUBLE AS risk FROM x WINDOW w AS (PARTITION BY seed ORDER BY abs(s - 0.5) DESC, md5(seed || ':' || id) ROWS UNBOUNDED PRECEDING)), a AS (SELECT seed, avg(risk) AS aurc FROM o GROUP BY seed)
        SELECT round(avg(aurc), 9) AS mean, round(stddev_pop(aurc), 9) AS sd, count(*) AS repeats FROM a""",
    "q_reject_precision": f"""{_S}, o AS (SELECT y, row_number() OVER (ORDER BY score_b, id) AS r FROM s) SELECT k::INT AS k, count(*) AS n, round(sum(1 - y) / k::DOUBLE, 9) AS precision FROM o, (SELECT unnest([10, 20, 50, 100]) AS k) WHERE r <= k GROUP BY k""",
    "q_kappa": f"""{_S}, c AS (SELECT verdict_a AS x, verdict_b AS z, count(*) AS n FROM s GROUP BY ALL), a AS (SELECT x, sum(n) AS na FROM c GROUP BY x), b AS (SELECT z, sum(n) AS nb FROM c GROUP BY z),
        t AS (SELECT sum(n) AS n_all, sum(n) FILTER (x = z) / sum(n)::DOUBLE AS po FROM c), e AS (SELECT sum(na * nb) / (SELECT n_all * n_all FROM t)::DOUBLE AS pe FROM a JOIN b ON x = z)
        SELECT n_all::BIGINT AS n_all, round(po, 9) AS observed, round(pe, 9) AS expected, round((po - pe) / (1 - pe), 9) AS kappa, greatest(-1, (po - pe) / (1 - pe) - 1.96 * sqrt(po * (1 - po) / (n_all * (1 - pe) * (1 - pe)))) AS lo, least(1, (po - pe) / (1 - pe) + 1.96 * sqrt(po * (1 - po) / (n_all * (1 - pe) * (1 - pe)))) AS hi FROM t, e""",
    "q_mcnemar_counts": f"""{_S}, r AS (SELECT (score_a > 0.5)::INT = y AS a, (score_b > 0.5)::INT = y AS b FROM s), c AS (SELECT count(CASE WHEN a AND b THEN 1 END) AS both, count(CASE WHEN a AND NOT b THEN 1 END) AS only_a, count(CASE WHEN NOT a AND b THEN 1 END) AS only_b, count(CASE WHEN NOT a AND NOT b THEN 1 END) AS neither FROM r)
        SELECT "both", only_a, only_b, neither, round(CASE WHEN only_a + only_b = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp({_LC.format('(only_a + only_b)', 'i')} - (only_a + only_b) * ln(2))) FROM range(0, least(only_a, only_b) + 1) x(i))) END, 9) AS p FROM c""".replace("AS both", 'AS "both"'),
    "q_fisher": f"""{_S}, g AS (SELECT source, count(CASE WHEN toxic = 1 AND y = 1 THEN 1 END) AS a, count(CASE WHEN toxic = 1 AND y = 0 THEN 1 END) AS b, count(CASE WHEN toxic = 0 AND y = 1 THEN 1 END) AS c, count(CASE WHEN toxic = 0 AND y = 0 THEN 1 END) AS d FROM s GROUP BY source),
        x AS (SELECT *, unnest(range(greatest(0, a + c - (c + d)), least(a + b, a + c) + 1)) AS i FROM g),
        l AS (SELECT source, a, b, c, d, {_LC.format('(a + b)', 'i')} + {_LC.format('(c + d)', '(a + c - i)')} - {_LC.format('(a + b + c + d)', '(a + c)')} AS lp,
          {_LC.format('(a + b)', 'a')} + {_LC.format('(c + d)', 'c')} - {_LC.format('(a + b + c + d)', '(a + c)')} AS seen FROM x)
        SELECT source, a, b, c, d, round(least(1, sum(CASE WHEN lp <= seen + 1e-9 THEN exp(lp) ELSE 0 END)), 9) AS p FROM l GROUP BY source, a, b, c, d""",
    "q_binomial": f"{_BIN} SELECT source, k, n, p FROM b",
    "q_holm": f"""{_BIN}, o AS (SELECT source, p, p * (count(*) OVER () - row_number() OVER (ORDER BY p, source) + 1) AS step, row_number() OVER (ORDER BY p, source) AS r FROM b)
        SELECT source, p, round(least(1, max(step) OVER (ORDER BY r)), 9) AS adjusted FROM o""",
    "q_wilcoxon_ranks": f"""{_S}, d AS (SELECT round(score_a - score_b, 2) AS diff FROM s), r AS (SELECT diff, rank() OVER (ORDER BY abs(diff)) + (count(*) OVER (PARTITION BY abs(diff)) - 1) / 2.0::DOUBLE AS r FROM d WHERE diff <> 0),
        w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (diff > 0), 0) AS w_plus, coalesce(sum(r) FILTER (diff < 0), 0) AS w_minus FROM r)
        SELECT n, w_plus, w_minus, round(CASE WHEN n >= 6 THEN (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE + 0.5) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0::DOUBLE) END, 9) AS z FROM w""",
    "q_perf_card": f"""{_S}, e AS (SELECT *, unnest(list_filter(['all', CASE WHEN abs(score_a - 0.5) <= 0.15 THEN 'unknown' END, CASE WHEN toxic = 0 THEN 'clean' END], lambda x: x IS NOT NULL)) AS subset FROM s)
        SELECT subset, count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_tp, count(CASE WHEN verdict_b = 'reject' THEN 1 END) AS n_reject, count(CASE WHEN verdict_b = 'reject' AND y = 0 THEN 1 END) / nullif(count(CASE WHEN verdict_b = 'reject' THEN 1 END), 0)::DOUBLE AS reject_precision,
          count(CASE WHEN verdict_b = 'reject' AND y = 0 THEN 1 END) / nullif(count(CASE WHEN y = 0 THEN 1 END), 0)::DOUBLE AS reject_recall, count(CASE WHEN verdict_b = 'reject' AND y = 1 THEN 1 END) / nullif(count(CASE WHEN y = 1 THEN 1 END), 0)::DOUBLE AS false_reject, count(CASE WHEN verdict_b = 'hold' THEN 1 END) / count(*)::DOUBLE AS hold_share FROM e GROUP BY subset""",
    "q_verdict_cube": f"{_S} SELECT verdict_b, lang, count(*) AS n, sum(y)::BIGINT AS n_pos, grouping(verdict_b, lang)::INT AS level FROM s GROUP BY ROLLUP (verdict_b, lang)",
    "q_reject_split": f"{_S} SELECT y, count(CASE WHEN verdict_b = 'promising' THEN 1 END) AS promising, count(CASE WHEN verdict_b = 'conditional' THEN 1 END) AS conditional, count(CASE WHEN verdict_b = 'hold' THEN 1 END) AS hold, count(CASE WHEN verdict_b = 'reject' THEN 1 END) AS reject FROM s GROUP BY y",
    "q_ci_overlap": f"{_S}, g AS (SELECT lang, count(CASE WHEN y = 1 THEN 1 END) AS k, count(*) AS n FROM s GROUP BY lang), i AS (SELECT {_WLO} AS lo, {_WHI} AS hi FROM g) SELECT round(max(lo), 9) AS max_lo, round(min(hi), 9) AS min_hi, max(lo) <= min(hi) AS overlap FROM i",
    "q_quantiles": """WITH o AS (SELECT lang, list_sort(list(n_chars)) AS v, count(*) AS n FROM documents GROUP BY lang)
        SELECT lang, (v[(n - 1) // 2 + 1] + v[n // 2 + 1]) / 2.0::DOUBLE AS median, v[n // 2 + 1] AS upper_median, v[floor(n * 0.9)::BIGINT + 1] AS q90 FROM o""",
    "q_trail_last_gate": "SELECT conv_id, arg_min(role, turn) AS first_gate, arg_max(role, turn) AS last_gate, count(*) AS n FROM conversations GROUP BY conv_id",
    "q_flips": "WITH l AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) SELECT conv_id, count(CASE WHEN was <> role THEN 1 END) AS flips FROM l GROUP BY conv_id",
    "q_killed": """WITH f AS (SELECT conv_id, min(turn) AS k FROM conversations WHERE role = 'system' GROUP BY conv_id) SELECT conv_id, bool_or(k IS NOT NULL) AS killed, count(CASE WHEN turn > k THEN 1 END) AS n_skipped FROM conversations LEFT JOIN f USING (conv_id) GROUP BY conv_id""",
    "q_cost_report": "SELECT event_type AS purpose, count(*) AS calls, count(CASE WHEN value < 0 THEN 1 END) AS unmetered, round(sum(value), 4) AS spent, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "q_top_spelling": """WITH n AS (SELECT lower(p_type) AS key, CASE WHEN p_size % 3 = 0 THEN upper(p_type) ELSE p_type END AS spelling, count(*) AS n FROM part GROUP BY ALL)
        SELECT key, spelling, n FROM n QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling) = 1""",
    "q_search_difference": """WITH g AS (SELECT lang, count(CASE WHEN n_chars > 1500 AND source IN ('src1', 'src2', 'src3') THEN 1 END) AS b, count(CASE WHEN n_chars > 1500 AND source NOT IN ('src1', 'src2', 'src3') THEN 1 END) AS l, count(CASE WHEN n_chars <= 1500 AND source IN ('src1', 'src2', 'src3') THEN 1 END) AS s FROM documents GROUP BY lang)
        SELECT lang, b AS "both", l AS only_long, s AS only_source, coalesce(b / nullif(b + l + s, 0)::DOUBLE, 0) AS jaccard FROM g""",
}
