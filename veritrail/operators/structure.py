"""Structures: identity of compounds, ranking and refusal of targets, chains of polyproteins, alerts, accessibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the structural alerts.
HERG_LOGP, DILI_LOGP = 3.7, 3.0
HUMAN = "Homo sapiens"


def skeleton(inchikey: Column) -> Column:
    """The first block of an InChIKey: the connections without stereo and charge; null if there is none."""
    key = F.upper(F.trim(inchikey))
    return F.when(F.length(key) >= 14, F.left(key, F.lit(14)))


def ranked(structures: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Structures without ligand first, then by resolution (unknown last), then by coverage."""
    w = Window.partitionBy(*keys).orderBy(F.desc("apo"), F.coalesce(F.when(F.col("resolution") > 0, F.col("resolution")), F.lit(99.0)), F.desc(F.coalesce("covered", F.lit(0))), order)
    return structures.withColumn("place", F.row_number().over(w))


def dock_verdict(species_same: Column, n_apo: Column, site_formed: Column) -> Column:
    """Whether docking may be used, or why not: what is unknown refuses."""
    return (
        F.when(species_same.isNull(), "species unknown").when(~species_same, "other species").when(F.coalesce(n_apo, F.lit(0)) == 0, "only solved with ligand")
        .when(site_formed.isNull(), "site unknown").when(~site_formed, "no site without ligand").otherwise("allowed")
    )


def organism(mechanism: Column, disease_organism: Column) -> Column:
    """Host targets are human, pathogen targets of the disease's pathogen; else null, which refuses."""
    return F.when(mechanism.contains("숙주"), HUMAN).when(mechanism.contains("병원체"), disease_organism)


def accessibility(essential: Column, violations: Column, small: Column) -> Column:
    """struct(eml, oral_ok, small): signals that are not merged; absence from a partial list is null, not false."""
    return F.struct(F.when(essential, True).alias("eml"), (violations == 0).alias("oral_ok"), small.alias("small"))


def herg_alert(basic_nitrogens: Column, logp: Column, aromatic_rings: Column) -> Column:
    """alert, caution or none by three features of a structure; unknown without its descriptors. No reason to reject."""
    n = (basic_nitrogens >= 1).cast("int") + (logp >= HERG_LOGP).cast("int") + (aromatic_rings >= 2).cast("int")
    return F.when(n.isNull(), "unknown").when(n == 3, "alert").when(n == 2, "caution").otherwise("none")


def dili_alert(logp: Column, groups: Column) -> Column:
    """caution, weak or none by lipophilicity and the number of reactive groups; the dose is not known."""
    n = (logp >= DILI_LOGP).cast("int") + groups
    return F.when(n.isNull(), "unknown").when(n >= 2, "caution").when(n == 1, "weak").otherwise("none")


def same_token(a: Column, b: Column) -> Column:
    """Equal, or one begins the other and no digit follows: nsp1 is not nsp12."""
    short, long_ = F.when(F.length(a) < F.length(b), a).otherwise(b), F.when(F.length(a) < F.length(b), b).otherwise(a)
    next_ = F.substring(long_, F.length(short) + 1, F.lit(1))
    return (a == b) | ((F.length(short) > 0) & F.startswith(long_, short) & ~next_.rlike("^[0-9]"))


def localized(targets: DataFrame, chains: DataFrame) -> DataFrame:
    """target, kind, chain: the chain whose tokens match most of the target's, if it alone does; one chain needs no choice.

    ``targets``: target, protein, tokens; ``chains``: protein, chain, tokens. What is not decided is refused (unclear), never widened to the whole.
    """
    hits = F.size(F.filter("t_tokens", lambda t: F.exists("c_tokens", lambda c: same_token(t, c))))
    met = targets.select("target", "protein", F.col("tokens").alias("t_tokens")).join(chains.select("protein", "chain", F.col("tokens").alias("c_tokens")), "protein", "left").withColumn("score", F.when(F.col("chain").isNotNull(), hits))
    best = met.groupBy("target").agg(F.count("chain").alias("n"), F.max("score").alias("best"), F.max_by("chain", "score").alias("chain"), F.sort_array(F.collect_list("score"), asc=False).alias("scores"))  # of one protein's chains
    alone = (F.col("best") >= 1) & (F.col("best") > F.coalesce(F.get("scores", F.lit(1)), F.lit(0)))
    kind = F.when(F.col("n") <= 1, "single").when(alone, "localized").otherwise("unclear")
    return best.select("target", kind.alias("kind"), F.when(kind == "localized", F.col("chain")).alias("chain"))
