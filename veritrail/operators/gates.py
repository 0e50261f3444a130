"""Gates: DataFrame to DataFrame steps that append audit rows, run in the order of their cost, and leave dead rows alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A named step: ``outcome`` is a column over the hypothesis row; outcome KILL ends it."""

    name: str
    outcome: Callable[[], Column]
    detail: Callable[[], Column] | None = None


def run(hypotheses: DataFrame, gates: list[Gate], enabled: dict[str, bool] | None = None) -> DataFrame:
    """Adds trail (array of seq, gate, outcome, detail) and killed.

    Disabled gates and those after a KILL append SKIP, so every trail is complete. All gates are column expressions of one
    projection: no step reads the table again.
    """
    df = hypotheses.withColumn("killed", F.lit(False))
    rows = []
    for i, g in enumerate(gates):
        name = f"_outcome_{i}"
        on = F.lit(enabled is None or enabled.get(g.name, True))
        df = df.withColumn(name, F.when(F.col("killed") | ~on, F.lit("SKIP")).otherwise(g.outcome()))
        df = df.withColumn("killed", F.col("killed") | (F.col(name) == "KILL"))
        detail = g.detail() if g.detail else F.lit(None).cast("string")
        rows.append(F.struct(F.lit(i).alias("seq"), F.lit(g.name).alias("gate"), F.col(name).alias("outcome"), detail.alias("detail")))
    return df.withColumn("trail", F.array(*rows)).drop(*[f"_outcome_{i}" for i in range(len(gates))])


def trail(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.explode("trail").alias("t")).select(*keys, "t.*")


# Agents that stop a run, agents that stop it in a context of weapons, and that context.
BLOCKED = [
    "sarin", "soman", "tabun", "cyclosarin", "vx nerve", "novichok", "sulfur mustard", "sulphur mustard", "nitrogen mustard gas", "lewisite", "phosgene oxime", "tear gas agent",
    "chlorine gas weapon", "사린", "소만", "타분", "노비촉", "겨자가스", "루이사이트", "신경작용제",
]
CONTEXT_BOUND = ["anthrax", "botulinum toxin", "ricin", "smallpox", "variola", "탄저", "보툴리눔", "리신", "두창"]
CONTEXT = r"(?i)weapon|aerosoliz|militar|warfare|무기|살포|에어로졸화|대량살상"


def screen(c: Column) -> Column:
    """The first blocked term of a text; null if it passes. Research on a disease passes, a weapon's context does not."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    always = [F.when(low.contains(w), F.lit(w)) for w in BLOCKED]
    bound = [F.when(low.contains(w) & low.rlike(CONTEXT), F.lit(w)) for w in CONTEXT_BOUND]
    return F.coalesce(*always, *bound)


# Mechanism classes and their routes; an unknown mechanism has none.
ROUTES = {"직접·병원체": "structure", "직접·숙주": "evidence", "간접": "evidence", "오프타겟": "evidence", "불명": None}


def route(mechanism: Column) -> Column:
    return F.coalesce(*[F.when(mechanism == k, F.lit(v)) for k, v in ROUTES.items() if v])


def docking_advised(mechanism: Column, confidence: Column, has_target: Column) -> Column:
    return F.coalesce(route(mechanism) == "structure", F.lit(False)) & (confidence != "low") & has_target


def binding_verdict(best: Column) -> Column:
    """By the best affinity on the negative log scale."""
    return F.when(best.isNull(), "unknown").when(best >= 7.0, "strong").when(best >= 5.0, "weak").otherwise("none")


def apo(bound: Column, has_cofactor: Column, benign: list[str]) -> Column:
    """No ligand but benign ones; an unknown list is not apo."""
    return bound.isNotNull() & (F.size(F.array_except(F.transform(bound, lambda x: F.upper(x)), F.array(*[F.lit(b) for b in benign]))) == 0) & ~F.coalesce(has_cofactor, F.lit(False))


def covered(lo: Column, hi: Column, ranges: Column) -> Column:
    """How many of the places lo..hi the ranges (array of struct lo, hi) cover, overlaps once."""
    places = F.sequence(lo, hi)
    return F.size(F.filter(places, lambda p: F.exists(ranges, lambda r: (r["lo"] <= p) & (p <= r["hi"]))))


def site_quality(scores: Column, sites: Column) -> Column:
    """struct(n, mean, low, out_of_range) of the scores (from place 1) at the sites."""
    hit = F.filter(F.transform(sites, lambda i: F.try_element_at(scores, i)), lambda x: x.isNotNull())
    total = F.aggregate(hit, F.lit(0.0), lambda s, x: s + x)
    return F.struct(F.size(hit).alias("n"), F.try_divide(total, F.size(hit)).alias("mean"), F.array_min(hit).alias("low"), (F.size(sites) - F.size(hit)).alias("out_of_range"))


def transient(message: Column) -> Column:
    """Failures that may pass: never stored as an answer."""
    return F.coalesce(message.rlike(r"(?i)timeout|timed out|temporar|rate limit|429|502|503|connection"), F.lit(False))


# Name endings of biologics.
BIOLOGIC = ["mab", "cept", "ase", "kin", "ximab", "zumab", "tide", "parin", "poetin", "grastim", "gene", "cel"]


def small_molecule(name: Column, molecule_type: Column | None = None) -> Column:
    """False for the endings of biologics, else what a molecule type says; null if nothing is known."""
    ends = F.lower(F.trim(name)).rlike(f"({'|'.join(BIOLOGIC)})$")
    known = F.lit(None).cast("boolean") if molecule_type is None else F.lower(molecule_type) == "small molecule"
    return F.when(F.coalesce(ends, F.lit(False)), F.lit(False)).otherwise(known)


def approved(max_phase: Column) -> Column:
    """Whether the highest phase is 4; null if it is unknown or no number."""
    return max_phase.cast("string").try_cast("double").cast("int") == 4


def leak_flag(answer: Column, label: Column, confidence: Column) -> Column:
    """A closed-book answer that equals the label with high confidence."""
    return F.coalesce((answer == label) & (confidence == "high"), F.lit(False))
