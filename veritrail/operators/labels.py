"""Label building: relevance, usability, best-of-group, first occurrence, sampling, matching of records to names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phases by rank, adjunct therapies that are no treatment of their own, and salts under which they are named too.
PHASES = {"Phase 3": 4, "Phase 2/Phase 3": 3, "Phase 2": 2, "Phase 1/Phase 2": 1, "Phase 1": 0, "Early Phase 1": 0, "NA": -1}
ADJUNCT = [
    "leucovorin", "folinic acid", "levoleucovorin", "mesna", "dexrazoxane", "amifostine", "filgrastim", "pegfilgrastim", "sargramostim", "epoetin alfa", "darbepoetin alfa", "ondansetron",
    "granisetron", "palonosetron", "aprepitant", "dexamethasone", "prednisone", "prednisolone", "diphenhydramine", "ranitidine", "famotidine", "allopurinol", "rasburicase", "heparin", "saline",
    "water", "glucose", "dextrose", "sodium chloride", "lidocaine", "midazolam", "propofol", "fentanyl", "morphine", "acetaminophen", "paracetamol", "ibuprofen", "aspirin", "vitamin d",
    "calcium carbonate", "folic acid", "cyanocobalamin", "oxygen", "nitrous oxide", "ethanol", "alcohol",
]
SALTS = [
    "phosphate", "sodium", "succinate", "acetate", "hydrochloride", "hcl", "sulfate", "sulphate", "citrate", "tartrate", "maleate", "mesylate", "besylate", "fumarate", "palmitate", "valerate",
    "propionate",
]
MONTHS, ENROLLED = (6, 36), 50


def phase_rank(c: Column) -> Column:
    out = F.lit(-1)
    for name, rank in PHASES.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def adjunct(drug: Column) -> Column:
    """Whether a drug only helps another treatment, with or without a salt's name."""
    name = F.lower(F.trim(drug))
    return F.coalesce(name.isin(*ADJUNCT) | F.regexp_replace(name, f" ({'|'.join(SALTS)})$", "").isin(*ADJUNCT), F.lit(False))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The first rule's name that holds; null if none does. A row is usable if its reason is null."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in rules])


def months_between(later: Column, earlier: Column) -> Column:
    """Whole months between two 'YYYY-MM' strings."""
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    return (part(later, 1, 4) - part(earlier, 1, 4)) * 12 + part(later, 6, 2) - part(earlier, 6, 2)


def usable(randomised: Column, phase: Column, enrolled: Column, months: Column) -> Column:
    return first_reason([
        ("not randomised", ~F.coalesce(randomised, F.lit(False))),
        ("phase 1", phase_rank(phase) < 2),
        ("too small", F.coalesce(enrolled, F.lit(0)) < ENROLLED),
        ("no date", months.isNull()),
        ("outside the window", ~months.between(*MONTHS)),
    ])


def best_of_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn = 1").drop("rn")


def best_evidence(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the record of the highest phase; of one phase, efficacy beats safety, then the earliest."""
    return best_of_group(df, keys, [F.desc(phase_rank(F.col("phase"))), F.desc(F.col("kind") == "efficacy"), F.asc("ord")])


def cascade_match(names: DataFrame, targets: DataFrame, variants: list[tuple[str, Column]]) -> DataFrame:
    """names (name) joined with targets (key, id) by the first variant that hits; unmatched names stay, with a status.

    The variants of a name are one exploded column with a rank, so the cascade is one equi join and a ranking.
    """
    made = names.withColumn("v", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(n).alias("rule"), c.alias("key")) for i, (n, c) in enumerate(variants)]))).select("name", "v.*")
    hit = best_of_group(made.join(targets, "key"), ["name"], [F.asc("rank"), F.asc("id")])
    return names.join(hit.select("name", "rule", "key", "id"), "name", "left").withColumn("status", F.when(F.col("id").isNull(), "unmatched").otherwise("ok"))


def stratified(df: DataFrame, stratum: str, quotas: dict[str, int], order: list[Column]) -> DataFrame:
    """The first rows of each stratum by its quota."""
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(stratum) == name, n).otherwise(quota)
    return df.withColumn("place", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).filter(F.col("place") <= quota)


def interleaved(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Per hypothesis the first k distinct ids of several result lists: lists by ``prio``, then their order."""
    first = df.groupBy(*keys, "id").agg(F.min(F.struct("prio", "ord")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("at", "id"))).filter(F.col("place") <= k).select(*keys, "id", "at.prio", "place")
