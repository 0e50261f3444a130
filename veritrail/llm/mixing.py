"""Mixing sources to target weights by temperature, realised as budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, running, table

#: The flattened shares must reach this part of the entropy of equal shares ...
TARGET_ENTROPY = 0.97
#: ... as far as no source has to be read more often than this.
MAX_REPEATS = 2.0
SEED = 20_240_817
NO_SOURCE = "(none)"


def temperature(tokens: dict[str, int], target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> tuple[float, dict[str, float]]:
    """The exponent and the normalised weights of sources with the given token counts.

    Shares are raised to an exponent in [0, 1]: 1 keeps them, 0 makes them equal. The exponent is the
    largest that reaches ``target_entropy`` (a part of the entropy of equal shares), or the smallest at which
    the rarest source is read ``max_repeats`` times while the largest is read once, whichever is larger. Both
    are found by bisection. Sources without tokens get weight 0.
    """
    live = {s: n for s, n in sorted(tokens.items()) if n > 0}
    if not live:
        return 1.0, {s: 0.0 for s in tokens}
    total = sum(live.values())

    def weights(alpha: float) -> dict[str, float]:
        powers = {s: math.exp(alpha * math.log(n / total)) for s, n in live.items()}
        z = math.fsum(powers.values())
        return {s: p / z for s, p in powers.items()}

    def entropy(alpha: float) -> float:
        return -math.fsum(w * math.log(w) for w in weights(alpha).values()) / max(math.log(len(live)), 1e-12)

    def repeats(alpha: float) -> float:
        return (max(live.values()) / min(live.values())) ** (1 - alpha)

    def bisect(good) -> float:
        """The largest exponent in [0, 1] that is good, where smaller ones are good too; 0 if none is."""
        lo, hi = 0.0, 1.0
        if good(hi):
            return hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if good(mid) else (lo, mid)
        return lo

    by_entropy = bisect(lambda a: entropy(a) >= target_entropy) if len(live) > 1 else 1.0
    by_repeats = 1 - bisect(lambda b: repeats(1 - b) <= max_repeats)
    alpha = max(by_entropy, by_repeats)
    w = weights(alpha)
    return alpha, {s: w.get(s, 0.0) for s in tokens}


def budgets(tokens: dict[str, int], weights: dict[str, float], budget: int | None = None) -> dict[str, int]:
    """Whole tokens to take from each source. Without a budget: the least at which every source is read once in full."""
    live = [s for s in tokens if tokens[s] > 0]
    if not live:
        return {s: 0 for s in tokens}
    if budget is None:
        scale = max(tokens[s] / weights[s] for s in live)
    else:
        scale = float(budget)
    # a relative slack of 1e-9 keeps a source that is due once in full from falling a token short
    return {s: math.floor(scale * weights[s] * (1 + 1e-9)) for s in tokens}


def _source():
    return F.coalesce(F.col("source"), F.lit(NO_SOURCE))


def _order_hash(seed: int, epoch):
    return F.xxhash64(F.lit(seed), F.col("source"), epoch.cast("long"), F.col("doc_id"))


def mixing_plan(docs: DataFrame, scratch: Scratch, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS, budget: int | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(blocks, plan). plan has one row per source: tokens, exponent, weight, budget, full epochs and the last block's cut.

    blocks has one row for each time that a document is read: doc_id, source, epoch, n_tokens, position,
    tokens_before. A block is a source's epoch: its documents in the order of a seeded hash. All but the last
    block of a source are whole; the last ends where the source's budget is used up (a document that would
    start at or beyond the budget is left out).

    Tokens are runs of non-space characters of the whole text. A null or empty text has none and is read as
    often as the source has full epochs. A null source is a source of its own, named ``(none)``. Rows with the
    same doc_id and source stand next to each other in a block (mixed() takes all of them if one is due). An empty table gives empty blocks. Only the
    totals, one row per source, come to the driver. The running sums are range-partitioned, so that a source
    with a third of all rows is spread over the cluster.
    """
    spark = docs.sparkSession
    counted = scratch.keep(
        docs.select("doc_id", _source().alias("source"), F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")),
        "tokens",
    )
    totals = {r.source: r.n for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per source
    alpha, weights = temperature(totals, target_entropy, max_repeats)
    due = budgets(totals, weights, budget)
    rows = []
    for s, n in sorted(totals.items()):
        full, rest = divmod(due[s], n) if n else (1, 0)
        rows.append((s, n, alpha, weights[s], due[s], full, rest))
    plan = spark.createDataFrame(rows, "source string, tokens long, exponent double, weight double, budget long, full long, rest long")
    epochs = counted.join(F.broadcast(plan.select("source", "full", "rest")), "source").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - F.when(F.col("rest") > 0, 0).otherwise(1)))
    ).filter("full > 0 or rest > 0")
    keyed = epochs.select("doc_id", "source", "epoch", "n_tokens", "full", "rest", _order_hash(seed, F.col("epoch")).alias("h"))
    ran = running(keyed, scratch, ["source", "epoch"], ["h", "doc_id", "n_tokens"], "n_tokens")
    taken = scratch.keep(ran.filter("epoch < full or before < rest"), "blocks")
    last = taken.filter("epoch = full").groupBy("source").agg(F.max("h").alias("cut"))
    blocks = taken.select(
        "doc_id", "source", "epoch", "n_tokens", F.col("idx").cast("long").alias("position"), F.col("before").alias("tokens_before")
    )
    return blocks, plan.join(last, "source", "left")


def mixed(docs: DataFrame, scratch: Scratch, **options) -> DataFrame:
    """``docs`` with each row as often as its blocks read it; all columns unchanged.

    The plan's cut of each source's last block is a hash value, so the texts are not shuffled or joined with
    the blocks: a row repeats itself by its own hash and its source's plan (one row per source, broadcast).
    """
    names = docs.columns
    _, plan = mixing_plan(docs, scratch, **options)
    seed = options.get("seed", SEED)
    plan = scratch.keep(plan.select(F.col("source").alias("plan_source"), F.col("full").alias("plan_full"), F.col("cut").alias("plan_cut")), "plan")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", _source().alias("source"))
    times = F.col("plan_full") + F.when(_order_hash(seed, F.col("plan_full")) <= F.col("plan_cut"), 1).otherwise(0)  # no cut: no last block
    return (
        row.join(F.broadcast(plan), F.col("source") == F.col("plan_source"))
        .select("row", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
        .select("row.*")
    )


def op1_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, plan = mixing_plan(table(spark, sf_dir, "documents"), Scratch(spark))
    return blocks.join(F.broadcast(plan.select("source", "exponent", "weight", "budget")), "source")
