"""Heterogeneous graph operators: two-hop candidates, shared genes, degree-preserving scores, link prediction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats


def multihop(cg: DataFrame, gd: DataFrame, cd: DataFrame, min_shared: int = 2) -> DataFrame:
    """(d, c, shared): compounds that share genes with a disease, without its known compounds. A join, a count, an anti join."""
    shared = gd.join(cg, "g").groupBy("d", "c").agg(F.count(F.lit(1)).alias("shared"))
    return shared.filter(F.col("shared") >= min_shared).join(cd, ["d", "c"], "left_anti")


def shared_genes(pairs: DataFrame, cg: DataFrame, gd: DataFrame) -> DataFrame:
    """pairs (c, d) with shared: 0 if both ends are in the graph without a common gene, null with a status if one is not."""
    met = pairs.join(cg, "c").join(gd, ["g", "d"]).groupBy("c", "d").agg(F.count(F.lit(1)).alias("shared"))
    c_in, d_in = cg.select("c").distinct().withColumn("c_in", F.lit(True)), gd.select("d").distinct().withColumn("d_in", F.lit(True))
    out = pairs.join(c_in, "c", "left").join(d_in, "d", "left").join(met, ["c", "d"], "left")
    status = F.when(F.col("c_in").isNull(), "compound not in graph").when(F.col("d_in").isNull(), "disease not in graph").otherwise("ok")
    return out.select("c", "d", status.alias("status"), F.when(status == "ok", F.coalesce("shared", F.lit(0))).alias("shared"))


def degree_scores(cg: DataFrame, gd: DataFrame, cd: DataFrame, min_shared: int = 2, min_degree: int = 2) -> DataFrame:
    """Adds degree n, expectation, variance and z of the shared count under degree-preserving draws.

    A compound of degree n meets a gene of weight w with 1 - (1 - w) ** n. Expectations depend on (disease, degree) alone, so
    they are summed once per distinct degree rather than per candidate.
    """
    cand = multihop(cg, gd, cd, min_shared)
    degree = cg.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    total = cg.agg(F.count(F.lit(1)).alias("total"))
    weight = cg.groupBy("g").agg(F.count(F.lit(1)).alias("deg")).crossJoin(F.broadcast(total)).select("g", (F.col("deg") / F.col("total")).alias("w"))  # one row
    degrees = degree.select("n").distinct()  # as many as different degrees
    p = 1 - F.pow(1 - F.col("w"), F.col("n"))
    expected = gd.join(weight, "g").crossJoin(F.broadcast(degrees)).groupBy("d", "n").agg(F.sum(p).alias("expected"), F.sum(p * (1 - p)).alias("variance"))
    return (
        cand.join(degree, "c").filter(F.col("n") >= min_degree).join(expected, ["d", "n"])
        .withColumn("z", F.when(F.col("variance") > 0, (F.col("shared") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0))
    )


def hypergeometric(scored: DataFrame, cg: DataFrame, gd: DataFrame) -> DataFrame:
    """Adds p: the chance of so many shared genes among the compound's. Computed once per distinct (shared, disease size, degree)."""
    genes = cg.select("g").distinct()
    population = genes.agg(F.count(F.lit(1)).alias("population"))
    marked = gd.join(genes, "g", "left_semi").groupBy("d").agg(F.count(F.lit(1)).alias("marked"))
    full = scored.join(marked, "d").crossJoin(F.broadcast(population))  # one row
    keys = full.select("shared", "population", "marked", "n").distinct()
    p = keys.withColumn("p", stats.hypergeometric_at_least(F.col("shared"), F.col("population"), F.col("marked"), F.col("n")))
    return full.join(p, ["shared", "population", "marked", "n"])


def ranked(scored: DataFrame, by: str, descending: bool = True) -> DataFrame:
    order = [F.desc(by) if descending else F.asc(by), "c"]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("d").orderBy(*order)))


def recall(ranks: DataFrame, hidden: DataFrame, ks: tuple[int, ...] = (20, 100)) -> DataFrame:
    """Recall at each k, mean reciprocal rank and the reachable ceiling of hidden (c, d) edges, over all of them."""
    met = hidden.join(ranks.select("c", "d", "rank"), ["c", "d"], "left")
    return met.agg(
        F.count(F.lit(1)).alias("n_hidden"), F.count("rank").alias("n_reachable"),
        *[F.count_if(F.col("rank") <= k).alias(f"hits_at_{k}") for k in ks],
        F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("sum_reciprocal"),
    ).select(
        "n_hidden", "n_reachable", *[F.try_divide(f"hits_at_{k}", "n_hidden").alias(f"recall_at_{k}") for k in ks],
        F.try_divide("sum_reciprocal", "n_hidden").alias("mrr"), F.try_divide("n_reachable", "n_hidden").alias("ceiling"),
    )
