"""Measures of a run against itself and against labels: faithfulness, refutation, false negatives, baselines, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats

# The shares of pairs with a hit up to which a signal separates and above which it is dropped.
SEPARATES, DROPPED = 0.60, 0.90
# The gates that gather refutations, and the kinds of limitation sections by priority.
REFUTING = ["rag", "skeptic", "registry"]
SECTIONS = ["section", "paragraph", "after discussion"]


def _share(df: DataFrame, name: str, k: str, n: str) -> DataFrame:
    lo, hi = stats.wilson(F.col(k), F.col(n))
    return df.withColumn(name, F.try_divide(F.col(k), F.col(n))).withColumn(f"{name}_lo", lo).withColumn(f"{name}_hi", hi)


def faithfulness(quotes: DataFrame, keys: list[str], ok: str) -> DataFrame:
    """Layers with a denominator each: of all quotes those that could be checked, of checked ones those that stand in the source. ``ok`` is null where nothing was checked."""
    counted = quotes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(ok).alias("checked"), F.count_if(F.col(ok)).alias("faithful"), F.count_if(~F.col(ok)).alias("made_up"))
    return _share(_share(counted, "faithfulness", "faithful", "checked"), "relevance", "checked", "n")


def refute_recall(records: DataFrame, keys: list[str], candidate: str, refutes: Column, skeptic: Column) -> DataFrame:
    """Candidates with a refutation, of all; refutations, and the share that the sceptic added (null without any). Not a recall: how many could be refuted is unknown."""
    per = records.groupBy(*keys, candidate).agg(F.count_if(refutes).alias("r"), F.count_if(refutes & skeptic).alias("s"))
    out = per.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") > 0).alias("with_refutation"), F.sum("r").alias("refutations"), F.sum("s").alias("by_skeptic"))
    return out.withColumn("skeptic_share", F.round(F.try_divide(F.col("by_skeptic"), F.col("refutations")), 3))


def false_negatives(df: DataFrame, keys: list[str], rejected: Column, valid: Column) -> DataFrame:
    """Rejected ones with a label, how many are valid after all, the rate and its interval; null without rejections, not 0."""
    known = df.filter(valid.isNotNull())
    out = known.groupBy(*keys).agg(F.count_if(rejected).alias("n"), F.count_if(rejected & valid).alias("n_valid"))
    return _share(out, "rate", "n_valid", "n")


def time_to_refute(timing: DataFrame, keys: list[str], candidate: str, gate: str, seconds: str) -> DataFrame:
    """Seconds of the gates that gather refutations, of all gates, and of all per candidate."""
    out = timing.groupBy(*keys).agg(F.sum(F.when(F.col(gate).isin(*REFUTING), F.col(seconds))).alias("refuting"), F.sum(seconds).alias("total"), F.count_distinct(candidate).alias("candidates"))
    return out.withColumn("per_candidate", F.col("total") / F.greatest(F.col("candidates"), F.lit(1)))


def zero_ratio(pairs: DataFrame, key: str, count: str) -> DataFrame:
    """Of each key with pairs without records: how many, of how many."""
    out = pairs.groupBy(key).agg(F.count_if(F.col(count) == 0).alias("zero"), F.count(F.lit(1)).alias("total")).filter("zero > 0")
    return out.withColumn("ratio", F.col("zero") / F.col("total"))


def universe_baseline(labels: DataFrame, vocabulary: DataFrame, key: str, item: str, label: str, unknown: str = "unknown") -> DataFrame:
    """The expected share of each label when items are drawn blindly from the vocabulary for every key.

    The expectation itself, not a simulation: labelled pairs over all pairs; pairs without a label count as unknown. ``labels`` has a label for a
    (key, item) once.
    """
    every = labels.agg(F.count_distinct(key).alias("keys")).crossJoin(vocabulary.agg(F.count_distinct(item).alias("items")))  # one row each
    counts = labels.join(vocabulary.select(item).distinct(), item, "left_semi").groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    rest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("known")).crossJoin(every).select(F.lit(unknown).alias("label"), (F.col("keys") * F.col("items") - F.col("known")).alias("n"))
    return counts.unionByName(rest).crossJoin(F.broadcast(every)).select("label", "n", (F.col("n") / (F.col("keys") * F.col("items"))).alias("expected"))


def use_signal(pairs: DataFrame, linked: Column, hits: str, positive: Column) -> DataFrame:
    """One row: pairs, those not linked (no zeros: left out), those with a hit, rate and interval, both labels' hits, Fisher's p, and the decision."""
    live, hit = pairs.filter(linked), F.col(hits) > 0
    out = live.agg(
        F.count(F.lit(1)).alias("n_evaluable"), F.count_if(hit).alias("n_hit"), F.count_if(positive).alias("n_tp"), F.count_if(positive & hit).alias("tp_hit"),
        F.count_if(~positive).alias("n_tn"), F.count_if(~positive & hit).alias("tn_hit"), F.max(F.when(hit, F.col(hits))).alias("most"),
    ).crossJoin(pairs.agg(F.count_if(~linked).alias("n_unlinked")))
    out = _share(out, "rate", "n_hit", "n_evaluable")
    p = stats.fisher(F.col("tp_hit"), F.col("n_tp") - F.col("tp_hit"), F.col("tn_hit"), F.col("n_tn") - F.col("tn_hit"))
    rate = F.round(F.col("rate"), 4)
    decision = F.when(rate.isNull(), "not measurable").when(rate <= SEPARATES, "separates").when(rate > DROPPED, "dropped").otherwise("unclear")
    return out.withColumn("fisher_p", F.when((F.col("n_tp") > 0) & (F.col("n_tn") > 0), p)).withColumn("decision", decision)


def fresh_ids(found: DataFrame, seen: DataFrame, keys: list[str], id_: str, order: str) -> DataFrame:
    """Ids that a candidate has not seen, once, in the order of the queries that found them."""
    new = found.join(seen.select(*keys, id_).distinct(), [*keys, id_], "left_anti").groupBy(*keys, id_).agg(F.min(order).alias(order))
    return new.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(order, id_)))


def top_sections(sections: DataFrame, keys: list[str], kind: str, order: str, most: int = 3) -> DataFrame:
    """The sections to read: by kind, then in order, ``most`` of each key."""
    rank = F.coalesce(*[F.when(F.col(kind) == s, i) for i, s in enumerate(SECTIONS)], F.lit(9))
    return sections.withColumn("rank", rank).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("rank", order))).filter(F.col("place") <= most)


def nearest_deadline(df: DataFrame, keys: list[str], day: str, deadline: Column, order: str, most: int) -> DataFrame:
    """The rows nearest to a day, those before it ahead of equally far ones after it."""
    away = F.datediff(F.col(day), deadline)
    return df.withColumn("days", away).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.abs("days"), "days", order))).filter(F.col("place") <= most)
