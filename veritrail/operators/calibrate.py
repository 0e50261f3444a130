"""Platt scaling, bootstraps and the sequential matchers: the operators that need a driver loop or a draw table."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_platt(df: DataFrame, score: str, y: str, steps: int = 500) -> tuple[float, float]:
    """(A, B) of p = 1 / (1 + exp(A s + B)) by Newton's method on smoothed targets.

    Each step is one aggregate of five sums over the table; only they come to the driver.
    """
    n1, n = df.agg(F.sum(F.col(y)), F.count(F.lit(1))).first()
    n1 = n1 or 0
    n0 = n - n1
    hi, lo = (n1 + 1.0) / (n1 + 2.0), 1.0 / (n0 + 2.0)
    points = df.groupBy(F.col(score).cast("double").alias("s"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("m")).cache()
    a, b = 0.0, math.log((n0 + 1.0) / (n1 + 1.0))
    try:
        for _ in range(steps):
            p = 1 / (1 + F.exp(F.lit(a) * F.col("s") + b))
            err, w = p - F.when(F.col("y") == 1, hi).otherwise(lo), F.greatest(p * (1 - p), F.lit(1e-12))
            m, s = F.col("m"), F.col("s")
            g1, g2, h11, h12, h22 = points.agg(F.sum(-s * err * m), F.sum(-err * m), F.sum(s * s * w * m), F.sum(s * w * m), F.sum(w * m)).first()
            det = h11 * h22 - h12 * h12
            if abs(det) < 1e-14:
                break
            da, db = (h22 * g1 - h12 * g2) / det, (h11 * g2 - h12 * g1) / det
            a, b = a - da, b - db
            if abs(da) < 1e-10 and abs(db) < 1e-10:
                break
    finally:
        points.unpersist()
    return a, b


def bootstrap_brier(df: DataFrame, a: str, b: str, y: str, order: list, replicates: int = 500, seed: int = 812) -> DataFrame:
    """lo, hi, mean of the difference of two systems' Brier scores over resamples with replacement.

    A row's number of draws in a replicate is Poisson with mean 1 (the limit of resampling for large tables), made from a
    hash of the row and the replicate: no draw table is shipped, rows are never collected, and a rerun gives the same draws.
    """
    rows = df.select(F.pow(F.col(a) - F.col(y), 2).alias("ea"), F.pow(F.col(b) - F.col(y), 2).alias("eb"), *order)
    reps = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    u = F.pmod(F.xxhash64(F.lit(seed), "rep", *order), F.lit(1_000_003)) / 1_000_003.0
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    draws = sum(((u >= t).cast("int") for t in steps), F.lit(0))
    per = reps.withColumn("m", draws).groupBy("rep").agg((F.sum(F.col("m") * (F.col("eb") - F.col("ea"))) / F.sum("m")).alias("gap"))
    ordered = F.array_sort(F.collect_list("gap"))  # as many as replicates
    return per.agg(ordered.alias("v"), F.avg("gap").alias("mean")).select("mean", F.element_at("v", int(0.025 * replicates) + 1).alias("lo"), F.element_at("v", int(0.975 * replicates)).alias("hi"))


def bucket(n: Column) -> Column:
    """0 for none, else 1 plus the decimal magnitude."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.floor(F.log10(n.cast("double"))) + 1).cast("int")


def greedy_match(left: DataFrame, right: DataFrame, reach: int = 2) -> DataFrame:
    """Pairs of rows of the same or, in turn, a neighbouring magnitude, each used once: (id, n, other, other_n).

    The order of the turns is part of the rule. In each turn the k-th row of one bucket meets the k-th of the other, so a
    turn is a ranking and an equi join rather than a loop over rows.
    """
    def ranked(df: DataFrame, shift: int) -> DataFrame:
        return df.withColumn("key", F.col("bucket") + shift).withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("n", "id")))

    a, b = left.withColumn("bucket", bucket(F.col("n"))), right.withColumn("bucket", bucket(F.col("n")))
    out = None
    for shift in [0] + [s for r in range(1, reach + 1) for s in (-r, r)]:
        met = ranked(a, 0).join(ranked(b, shift).select("key", "k", F.col("id").alias("other"), F.col("n").alias("other_n")), ["key", "k"]).select("id", "n", "other", "other_n", F.lit(shift).alias("shift"))
        met = met.persist()  # what is left after a turn depends on it twice; a lost part is made anew
        out = met if out is None else out.unionByName(met)
        a, b = a.join(met, "id", "left_anti"), b.join(met.select(F.col("other").alias("id")), "id", "left_anti")
    return out


def sample_indices(n: int, replicates: int, seed: int) -> list[list[int]]:
    """Index draws of the standard library's generator, where a published resample must be reproduced exactly."""
    rng = random.Random(seed)
    return [[rng.randrange(n) for _ in range(n)] for _ in range(replicates)]
