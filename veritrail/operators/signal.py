"""Signals over reports and patents: disproportionality, merged discovery, capped counts, co-claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PRR_LEAST, COUNT_LEAST = 2.0, 3
FIELD_CLAIMS, CAP = 2, 200_000


def disproportionality(reports: DataFrame) -> DataFrame:
    """(drug, event, a, n_drug, prr, signal): null PRR where its denominator is empty, never infinity."""
    cell = reports.groupBy("drug", "event").agg(F.count(F.lit(1)).alias("a"))
    drug = cell.groupBy("drug").agg(F.sum("a").alias("n_drug"))
    event = cell.groupBy("event").agg(F.sum("a").alias("n_event"))
    total = cell.agg(F.sum("a").alias("n_total"))
    joined = cell.join(drug, "drug").join(event, "event").crossJoin(F.broadcast(total))  # one row
    rest = F.col("n_event") - F.col("a")
    others = F.greatest(F.col("n_total") - F.col("n_drug"), F.lit(1))
    prr = F.when(rest > 0, (F.col("a") / F.col("n_drug")) / (rest / others))
    return joined.select("drug", "event", "a", "n_drug", prr.alias("prr"), F.coalesce((F.col("a") >= COUNT_LEAST) & (prr >= PRR_LEAST), F.lit(False)).alias("signal"))


def reverse_merge(signals: DataFrame) -> DataFrame:
    """Per drug: how many events signal, the strongest (ties: the smaller event), the largest count."""
    hit = signals.filter("signal")
    return hit.groupBy("drug").agg(
        F.count(F.lit(1)).alias("n_events"), F.max("prr").alias("prr"), F.max_by("event", F.struct("prr", -F.col("event"))).alias("top_event"), F.max("a").alias("n_max")
    )


def capped_counts(claims: DataFrame, cap: int = CAP) -> DataFrame:
    """(compound, field, n, kept): a compound's claims up to ``cap``, fields in ascending order; the rest is counted, not lost.

    The cap works on counts per (compound, field), so no compound's rows are ranked.
    """
    counts = claims.groupBy("compound", "field").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("compound").orderBy("field").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.withColumn("kept", F.greatest(F.lit(0), F.least(F.col("n"), cap - before)))


def co_claims(claims: DataFrame, entities: DataFrame, field: int = FIELD_CLAIMS) -> DataFrame:
    """(compound, entity, n_patents): distinct patents that claim a compound and name an entity.

    The claims' side is filtered and made distinct first: it is the smaller one.
    """
    drug = claims.filter(F.col("field") == field).select("patent", "compound").distinct()
    return drug.join(entities.select("patent", "entity").distinct(), "patent").groupBy("compound", "entity").agg(F.count(F.lit(1)).alias("n_patents"))


def recent(claims: DataFrame, entities: DataFrame, since: int, k: int = 3) -> DataFrame:
    """Each entity's k latest claimed patents since a year: (entity, patent, year, place)."""
    claimed = claims.filter(F.col("field") == FIELD_CLAIMS).select("patent").distinct()
    hit = entities.filter(F.col("year") >= since).join(claimed, "patent", "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("year"), "patent"))
    return hit.withColumn("place", place).filter(F.col("place") <= k)


def label_size_rank(reports: DataFrame) -> DataFrame:
    """Per drug: distinct events, reports, and events per report of its label."""
    return reports.groupBy("drug").agg(F.count_distinct("event").alias("n_events"), F.count(F.lit(1)).alias("n_reports")).withColumn("density", F.try_divide("n_events", "n_reports"))
