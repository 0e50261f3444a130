"""Queries over the evidence view: weights, deduplication, attenuation, veto, verdicts, fragility, cut-offs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as ev
from ..sources import tables as t


def _case(values: dict, key: str, default: float) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + f" ELSE {default}::DOUBLE END"


#: The SQL twins of the operators, as common table expressions.
_FIRM = "study_type IN ('rct', 'meta')"
WEIGHTED_SQL = f"""
weighted AS (
  SELECT *, round({_case(ev.BASE, 'study_type', 0.3)} * {_case(ev.SIZE, 'size', 0.8)} * CASE WHEN decisive AND {_FIRM} THEN 1.5::DOUBLE ELSE 1::DOUBLE END
    * {_case(ev.CONFIDENCE, 'confidence', 0.7)} * {_case(ev.REVIEW, 'review', 1.0)}, 3) AS weight
  FROM evidence
)
"""
_RANK = "weight DESC, direction, study_type, size, decisive, confidence, review, year, source_id, rid"
DEDUPED_SQL = f"""
cited AS (SELECT * EXCLUDE (trials), unnest(list_distinct(trials)) AS trial FROM weighted),
lost AS (SELECT DISTINCT rid FROM (SELECT rid, row_number() OVER (PARTITION BY subject, object, trial ORDER BY {_RANK}) AS rn FROM cited) WHERE rn > 1),
deduped AS (SELECT * FROM weighted WHERE rid NOT IN (SELECT rid FROM lost))
"""


def summary_sql(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT subject, object, count(CASE WHEN direction = 'support' THEN 1 END) AS n_support, count(CASE WHEN direction = 'refute' THEN 1 END) AS n_refute,
    coalesce(sum(weight * pow(0.5::DOUBLE, k)) FILTER (direction = 'support'), 0) AS w_support, coalesce(sum(weight * pow(0.5::DOUBLE, k)) FILTER (direction = 'refute'), 0) AS w_refute,
    count(CASE WHEN direction = 'support' AND {_FIRM} THEN 1 END) AS firm_support, count(CASE WHEN direction = 'refute' AND {_FIRM} THEN 1 END) AS firm_refute,
    coalesce(sum(weight) FILTER (direction = 'support' AND {_FIRM}), 0) AS firm_w_support, coalesce(sum(weight) FILTER (direction = 'refute' AND {_FIRM}), 0) AS firm_w_refute,
    count(CASE WHEN direction = 'refute' AND {_FIRM} AND decisive THEN 1 END) AS hard_refute
  FROM (SELECT *, row_number() OVER (PARTITION BY subject, object, direction ORDER BY weight DESC, rid) - 1 AS k FROM {source}) GROUP BY subject, object
)
"""


_RATIO = "CASE WHEN firm_support = 0 OR firm_refute = 0 THEN 0::DOUBLE ELSE coalesce(least(firm_w_support, firm_w_refute) / nullif(greatest(firm_w_support, firm_w_refute), 0), 0) END"
_VETO = "(hard_refute >= 2 AND firm_support = 0)"
_P = "round(100::DOUBLE / (1 + exp(-greatest(-4::DOUBLE, least(4::DOUBLE, w_support - w_refute)))), 0)::INT"


def verdict_sql(source: str, profile: ev.Profile = ev.STANDARD) -> str:
    return f"""
SELECT *, CASE WHEN {_VETO} THEN 'reject' WHEN n_support = 0 AND n_refute = 0 THEN 'hold'
    WHEN firm_support > 0 AND firm_refute > 0 AND {_RATIO} >= {profile.balance} THEN 'conditional'
    WHEN {_P} >= {profile.promising} THEN 'promising' WHEN {_P} >= {profile.reject} THEN 'hold' ELSE 'reject' END AS verdict,
  CASE WHEN {_VETO} THEN 0 ELSE {_P} END AS p FROM {source}
"""


_BASE = f"WITH {t.EVIDENCE_SQL}, {WEIGHTED_SQL}"
_DEDUPED = f"{_BASE}, {DEDUPED_SQL}"
_SUMMED = f"{_DEDUPED}, {summary_sql('summed', 'deduped')}"
_PUBLIC = "subject, object, n_support, n_refute, w_support, w_refute, firm_support, firm_refute, p, verdict"
_COLUMNS = _PUBLIC.split(", ")


def q_weight(spark, d):
    return ev.weighted(t.evidence(spark, d)).groupBy("study_type", "size", "decisive", "confidence", "review", "weight").agg(F.count(F.lit(1)).alias("n"))


def q_dedupe_trials(spark, d):
    return ev.dedupe_trials(ev.weighted(t.evidence(spark, d))).groupBy("subject", "object").agg(F.count(F.lit(1)).alias("kept"), F.sum("weight").alias("total"))


def q_attenuate(spark, d):
    return ev.attenuated(ev.dedupe_trials(ev.weighted(t.evidence(spark, d))))


def _summed(spark, d):
    return ev.summary(ev.dedupe_trials(ev.weighted(t.evidence(spark, d))))


def q_contested(spark, d):
    return _summed(spark, d).select("subject", "object", ev.balance_ratio().alias("ratio"), ((F.col("firm_support") > 0) & (F.col("firm_refute") > 0) & (ev.balance_ratio() >= 0.5)).alias("contested"))


def q_veto(spark, d):
    return _summed(spark, d).filter(ev.vetoed()).select("subject", "object", "hard_refute")


def q_adjudicate(spark, d):
    return ev.adjudicated(t.evidence(spark, d)).select(*_COLUMNS)


def q_adjudicate_emergency(spark, d):
    return ev.adjudicated(t.evidence(spark, d), ev.EMERGENCY).select(*_COLUMNS)


def q_verdict_counts(spark, d):
    return ev.adjudicated(t.evidence(spark, d)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"))


def q_cutoff(spark, d):
    """Records known at a cut-off year; a record without a year stays."""
    e = t.evidence(spark, d).withColumn("year", F.when(F.col("source_id") % 7 != 0, F.col("year")))
    return e.filter(F.col("year").isNull() | (F.col("year") <= 1998)).groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year").isNull()).alias("n_unknown_year"))


def q_leak_exclude(spark, d):
    """Records that cite no trial of the label list; the reason of every exclusion is counted."""
    leaked = t.table(spark, d, "supplier").filter("s_acctbal < 0").select(F.concat(F.lit("S"), (F.col("s_suppkey") % 40).cast("string")).alias("trial")).distinct()
    e = t.evidence(spark, d).select("rid", "direction", "trials")
    hit = e.select("rid", F.explode("trials").alias("trial")).join(leaked, "trial", "left_semi").select("rid").distinct()
    out = e.join(hit.withColumn("leaked", F.lit(True)), "rid", "left").withColumn("status", F.when(F.col("leaked"), "label trial").otherwise("live"))
    return out.groupBy("direction", "status").agg(F.count(F.lit(1)).alias("n"))


def q_fragility(spark, d):
    e = ev.weighted(t.evidence(spark, d))
    return ev.fragility(ev.dedupe_trials(e)).select("subject", "object", "base", "n", "fragility")


_SCENARIOS = f"""
sided AS (SELECT *, row_number() OVER (PARTITION BY subject, object ORDER BY {_RANK}) AS r, count(*) OVER (PARTITION BY subject, object) AS n
  FROM deduped WHERE direction IN ('support', 'refute')),
scen AS (SELECT *, r <= removed AS gone FROM (SELECT *, unnest(range(0, least(8, n) + 1)) AS removed FROM sided)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY subject, object, removed, direction, gone ORDER BY weight DESC, rid) - 1 AS k FROM scen),
sums AS (
  SELECT subject, object, removed, n, count(CASE WHEN NOT gone AND direction = 'support' THEN 1 END) AS n_support, count(CASE WHEN NOT gone AND direction = 'refute' THEN 1 END) AS n_refute,
    coalesce(sum(weight * pow(0.5::DOUBLE, k)) FILTER (NOT gone AND direction = 'support'), 0) AS w_support, coalesce(sum(weight * pow(0.5::DOUBLE, k)) FILTER (NOT gone AND direction = 'refute'), 0) AS w_refute,
    count(CASE WHEN NOT gone AND direction = 'support' AND {_FIRM} THEN 1 END) AS firm_support, count(CASE WHEN NOT gone AND direction = 'refute' AND {_FIRM} THEN 1 END) AS firm_refute,
    coalesce(sum(weight) FILTER (NOT gone AND direction = 'support' AND {_FIRM}), 0) AS firm_w_support, coalesce(sum(weight) FILTER (NOT gone AND direction = 'refute' AND {_FIRM}), 0) AS firm_w_refute,
    CASE WHEN count(CASE WHEN direction = 'refute' AND {_FIRM} AND decisive THEN 1 END) >= 2 AND count(CASE WHEN direction = 'support' AND {_FIRM} THEN 1 END) = 0 THEN 2 ELSE 0 END AS hard_refute FROM ranked GROUP BY subject, object, removed, n
)"""


def q_tier_dependence(spark, d):
    """Verdicts with and without the preprints, and whether they differ."""
    e = ev.weighted(t.evidence(spark, d))
    whole = ev.verdicts(ev.summary(ev.dedupe_trials(e))).select("subject", "object", F.col("verdict").alias("with_tier"))
    rest = ev.verdicts(ev.summary(ev.dedupe_trials(e.filter("review <> 'preprint'")))).select("subject", "object", F.col("verdict").alias("without_tier"))
    joined = whole.join(rest, ["subject", "object"], "left").withColumn("without_tier", F.coalesce("without_tier", F.lit("hold")))
    return joined.groupBy("with_tier", "without_tier").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("with_tier") != F.col("without_tier")).alias("changed"))


def q_existence_gate(spark, d):
    """Two layers: how many records a pair has, else how many its subject has."""
    e = t.evidence(spark, d).filter("year >= 2000")
    pairs = e.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("pair_count"))
    subjects = e.groupBy("subject").agg(F.count(F.lit(1)).alias("entity_count"))
    hypotheses = t.table(spark, d, "part").select(F.col("p_partkey").alias("subject")).crossJoin(F.broadcast(t.table(spark, d, "customer").select(F.col("c_mktsegment").alias("object")).distinct()))
    joined = hypotheses.join(pairs, ["subject", "object"], "left").join(subjects, "subject", "left")
    return joined.select("subject", "object", F.coalesce("pair_count", F.lit(0)).alias("pair_count"), ev.existence(F.coalesce("pair_count", F.lit(0)), F.col("entity_count")).alias("outcome"))


def q_comparative_survey(spark, d):
    """Per object: records, confirmatory, decisive, large, and the share of usable ones."""
    e = t.evidence(spark, d)
    firm = F.col("study_type").isin(*ev.CONFIRMATORY)
    return e.groupBy("object").agg(F.count(F.lit(1)).alias("n"), F.count_if(firm).alias("n_confirmatory"), F.count_if(F.col("decisive")).alias("n_decisive"), F.count_if(F.col("size") == "large").alias("n_large"),
        F.try_divide(F.count_if(firm & F.col("decisive")), F.count_if(firm)).alias("usable_share"))


def q_repeat_stability(spark, d):
    """The two halves of the records as two runs: agreement of verdicts and weight ratio per hypothesis, overall."""
    e = ev.weighted(t.evidence(spark, d))
    run = lambda r: ev.verdicts(ev.summary(e.filter(F.col("source_id") % 2 == r))).select("subject", "object", F.col("verdict").alias(f"v{r}"), F.col("p").alias(f"p{r}"))
    met = run(0).join(run(1), ["subject", "object"])
    return met.groupBy("v0", "v1").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("p0") - F.col("p1"))).alias("mean_gap"))


QUERIES = {f.__name__: f for f in (
    q_weight, q_dedupe_trials, q_attenuate, q_contested, q_veto, q_adjudicate, q_adjudicate_emergency, q_verdict_counts, q_cutoff, q_leak_exclude, q_fragility,
    q_tier_dependence, q_existence_gate, q_comparative_survey, q_repeat_stability,
)}

ORACLES = {
    "q_weight": f"{_BASE} SELECT study_type, size, decisive, confidence, review, weight, count(*) AS n FROM weighted GROUP BY ALL",
    "q_dedupe_trials": f"{_DEDUPED} SELECT subject, object, count(*) AS kept, sum(weight) AS total FROM deduped GROUP BY subject, object",
    "q_attenuate": f"""{_DEDUPED} SELECT subject, object, direction, count(*) AS n, sum(weight) AS total, sum(weight * pow(0.5::DOUBLE, k)) AS attenuated
        FROM (SELECT *, row_number() OVER (PARTITION BY subject, object, direction ORDER BY weight DESC, rid) - 1 AS k FROM deduped) GROUP BY subject, object, direction""",
    "q_contested": f"{_SUMMED} SELECT subject, object, {_RATIO} AS ratio, firm_support > 0 AND firm_refute > 0 AND {_RATIO} >= 0.5 AS contested FROM summed",
    "q_veto": f"{_SUMMED} SELECT subject, object, hard_refute FROM summed WHERE {_VETO}",
    "q_adjudicate": f"{_SUMMED} SELECT {_PUBLIC} FROM ({verdict_sql('summed')})",
    "q_adjudicate_emergency": f"{_SUMMED} SELECT {_PUBLIC} FROM ({verdict_sql('summed', ev.EMERGENCY)})",
    "q_verdict_counts": f"{_SUMMED} SELECT verdict, count(*) AS n, sum(p)::BIGINT AS sum_p FROM ({verdict_sql('summed')}) GROUP BY verdict",
    "q_cutoff": f"""WITH {t.EVIDENCE_SQL}, y AS (SELECT subject, object, CASE WHEN source_id % 7 <> 0 THEN year END AS year FROM evidence)
        SELECT subject, object, count(*) AS n, count(CASE WHEN year IS NULL THEN 1 END) AS n_unknown_year FROM y WHERE year IS NULL OR year <= 1998 GROUP BY subject, object""",
    "q_leak_exclude": f"""WITH {t.EVIDENCE_SQL}, leaked AS (SELECT DISTINCT 'S' || (s_suppkey % 40) AS trial FROM supplier WHERE s_acctbal < 0),
        hit AS (SELECT DISTINCT rid FROM (SELECT rid, unnest(trials) AS trial FROM evidence) JOIN leaked USING (trial))
        SELECT direction, CASE WHEN h.rid IS NULL THEN 'live' ELSE 'label trial' END AS status, count(*) AS n FROM evidence e LEFT JOIN hit h ON e.rid = h.rid GROUP BY ALL""",
    "q_fragility": f"""{_DEDUPED}, {_SCENARIOS},
        judged AS ({verdict_sql('sums')}),
        based AS (SELECT *, max(verdict) FILTER (removed = 0) OVER (PARTITION BY subject, object) AS base FROM judged)
        SELECT subject, object, base, n, min(removed) FILTER (verdict <> base) AS fragility FROM based GROUP BY subject, object, base, n""",
    "q_tier_dependence": f"""{_SUMMED}, {WEIGHTED_SQL.replace('weighted AS', 'weighted2 AS').replace('FROM evidence', "FROM evidence WHERE review <> 'preprint'")},
        {DEDUPED_SQL.replace('cited', 'cited2').replace('lost', 'lost2').replace('deduped', 'deduped2').replace('weighted', 'weighted2')}, {summary_sql('summed2', 'deduped2')},
        a AS ({verdict_sql('summed')}), b AS ({verdict_sql('summed2')})
        SELECT a.verdict AS with_tier, coalesce(b.verdict, 'hold') AS without_tier, count(*) AS n, bool_or(a.verdict <> coalesce(b.verdict, 'hold')) AS changed
        FROM a LEFT JOIN b USING (subject, object) GROUP BY ALL""",
    "q_existence_gate": f"""WITH {t.EVIDENCE_SQL}, e AS (SELECT * FROM evidence WHERE year >= 2000),
        pc AS (SELECT subject, object, count(*) AS n FROM e GROUP BY ALL), sc AS (SELECT subject, count(*) AS n FROM e GROUP BY ALL),
        h AS (SELECT p_partkey AS subject, object FROM part, (SELECT DISTINCT c_mktsegment AS object FROM customer))
        SELECT subject, object, coalesce(pc.n, 0) AS pair_count, CASE WHEN pc.n > 0 THEN 'PASS' WHEN coalesce(sc.n, 0) > 0 THEN 'FLAG' ELSE 'KILL' END AS outcome
        FROM h LEFT JOIN pc USING (subject, object) LEFT JOIN sc USING (subject)""",
    "q_comparative_survey": f"""WITH {t.EVIDENCE_SQL} SELECT object, count(*) AS n, count(CASE WHEN {_FIRM} THEN 1 END) AS n_confirmatory, count(CASE WHEN decisive THEN 1 END) AS n_decisive, count(CASE WHEN size = 'large' THEN 1 END) AS n_large,
        count(CASE WHEN {_FIRM} AND decisive THEN 1 END) / nullif(count(CASE WHEN {_FIRM} THEN 1 END), 0)::DOUBLE AS usable_share FROM evidence GROUP BY object""",
    "q_repeat_stability": f"""{_BASE}, w0 AS (SELECT * FROM weighted WHERE source_id % 2 = 0), w1 AS (SELECT * FROM weighted WHERE source_id % 2 = 1), {summary_sql('s0', 'w0')}, {summary_sql('s1', 'w1')},
        a AS ({verdict_sql('s0')}), b AS ({verdict_sql('s1')})
        SELECT a.verdict AS v0, b.verdict AS v1, count(*) AS n, avg(abs(a.p - b.p)) AS mean_gap FROM a JOIN b USING (subject, object) GROUP BY ALL""",
}
