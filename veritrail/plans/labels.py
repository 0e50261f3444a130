"""Queries of label building, gates and structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import gates, labels
from ..sources import tables as t


def _trials(spark, d):
    """Registry-like records from the orders."""
    o = t.table(spark, d, "orders")
    phase = F.element_at(F.array(*[F.lit(p) for p in labels.PHASES]), (F.col("o_custkey") % 7 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("ord"), (F.col("o_custkey") % 50).cast("int").alias("drug"), (F.col("o_custkey") % 7).cast("int").alias("disease"), phase.alias("phase"),
        F.when(F.col("o_orderstatus") == "F", "efficacy").otherwise("safety").alias("kind"), (F.col("o_orderpriority") < "4").alias("randomised"), (F.col("o_totalprice") / 2000).cast("int").alias("enrolled"),
        F.date_format("o_orderdate", "yyyy-MM").alias("done"),
    )


_PHASE = "CASE o_custkey % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(labels.PHASES)) + " END"
_RANK = "CASE phase " + " ".join(f"WHEN '{p}' THEN {r}" for p, r in labels.PHASES.items()) + " ELSE -1 END"
_TRIALS = f"""trials AS (SELECT o_orderkey AS ord, (o_custkey % 50)::INT AS drug, (o_custkey % 7)::INT AS disease, {_PHASE} AS phase, CASE o_orderstatus WHEN 'F' THEN 'efficacy' ELSE 'safety' END AS kind,
  o_orderpriority < '4' AS randomised, trunc(o_totalprice / 2000)::INT AS enrolled, strftime(o_orderdate, '%Y-%m') AS done FROM orders)"""


def q_usable_trials(spark, d):
    months = labels.months_between(F.lit("2000-06"), F.col("done"))
    reason = labels.usable(F.col("randomised"), F.col("phase"), F.col("enrolled"), months)
    return _trials(spark, d).groupBy(F.coalesce(reason, F.lit("usable")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q_best_evidence(spark, d):
    return labels.best_evidence(_trials(spark, d), ["drug", "disease"]).select("drug", "disease", "ord", "phase", "kind")


def q_first_occurrence(spark, d):
    return labels.best_of_group(_trials(spark, d), ["drug"], [F.asc("done"), F.asc("ord")]).select("drug", "ord", "done")


def q_cascade_match(spark, d):
    """Part names matched with types: exact, inverted words, first word."""
    names = t.table(spark, d, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("name")).distinct()
    targets = t.table(spark, d, "part").select(tx.fold(F.col("p_type")).alias("key")).distinct().withColumn("id", F.crc32(F.col("key")))
    folded = tx.fold(F.col("name"))
    words = F.split(folded, " ")
    variants = [("exact", folded), ("inverted", F.array_join(F.reverse(words), " ")), ("truncated", words[0])]
    return labels.cascade_match(names, targets, variants).select("name", "rule", "key", "status")


def q_stratified_sample(spark, d):
    quotas = {"efficacy": 30, "safety": 10}
    return labels.stratified(_trials(spark, d), "kind", quotas, [F.desc("enrolled"), F.asc("ord")]).select("kind", "ord", "place")


def q_interleaved(spark, d):
    """Two result lists per drug, negatives first, eight distinct ids."""
    r = _trials(spark, d)
    lists = r.filter("kind = 'safety'").select("drug", F.col("ord").alias("id"), F.lit(0).alias("prio"), "ord").unionByName(r.select("drug", F.col("ord").alias("id"), F.lit(1).alias("prio"), "ord"))
    return labels.interleaved(lists, ["drug"], 8)


def q_negative_pairs(spark, d):
    """Made pairs of drugs and diseases that no record has, in hash order, 40 of them."""
    known = _trials(spark, d).filter("enrolled > 240").select("drug", "disease").distinct()
    every = known.select("drug").distinct().crossJoin(F.broadcast(known.select("disease").distinct()))  # dimensions: drugs by diseases
    return every.join(known, ["drug", "disease"], "left_anti").orderBy(F.md5(F.concat_ws(":", F.col("drug").cast("string"), F.col("disease").cast("string"))), "drug", "disease").limit(40)


def q_ceiling(spark, d):
    """Per pair: trials, randomised ones, and whether enough are large."""
    return _trials(spark, d).groupBy("drug", "disease").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("randomised")).alias("n_randomised"), F.count_if(F.col("randomised") & (F.col("enrolled") >= labels.ENROLLED)).alias("n_usable"))


def q_safety_screen(spark, d):
    """Conversation turns, some with added terms, by the first blocked term."""
    c = t.table(spark, d, "conversations")
    added = F.when(F.col("turn") == 0, F.concat("text", F.lit(" ricin as a weapon"))).when(F.col("turn") == 1, F.concat("text", F.lit(" ricin antidotes"))).when(F.col("turn") == 2, F.concat("text", F.lit(" SARIN"))).otherwise(F.col("text"))
    return c.groupBy(gates.screen(added).alias("term")).agg(F.count(F.lit(1)).alias("n"))


def q_gate_trail(spark, d):
    """Existence, size and phase gates over pairs, as a complete trail."""
    pairs = q_ceiling(spark, d)
    steps = [
        gates.Gate("existence", lambda: F.when(F.col("n") >= 2, "PASS").otherwise("KILL"), lambda: F.col("n").cast("string")),
        gates.Gate("randomised", lambda: F.when(F.col("n_randomised") > 0, "PASS").otherwise("FLAG")),
        gates.Gate("size", lambda: F.when(F.col("n_usable") > 0, "PASS").otherwise("KILL")),
        gates.Gate("review", lambda: F.lit("DONE")),
    ]
    return gates.trail(gates.run(pairs, steps, {"randomised": True}), ["drug", "disease"]).groupBy("gate", "outcome").agg(F.count(F.lit(1)).alias("n"))


def q_router(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", F.element_at(F.array(*[F.lit(m) for m in [*gates.ROUTES, "other"]]), (F.col("p_size") % 6 + 1).cast("int")).alias("mechanism"), F.when(F.col("p_retailprice") > 1200, "high").otherwise("low").alias("confidence"))
    return p.groupBy("mechanism", gates.route(F.col("mechanism")).alias("route"), gates.docking_advised(F.col("mechanism"), F.col("confidence"), F.col("p_partkey") > 5).alias("advised")).agg(F.count(F.lit(1)).alias("n"))


def q_binding(spark, d):
    """Best affinity per part over its suppliers, its verdict, the number and the median."""
    a = t.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_quantity") / 6).alias("affinity"))
    g = a.groupBy("l_partkey").agg(F.max("affinity").alias("best"), F.min_by("l_suppkey", F.struct(-F.col("affinity"), "l_suppkey")).alias("target"), F.count(F.lit(1)).alias("n"), F.median("affinity").alias("middle"))
    return g.select("l_partkey", F.round("best", 9).alias("best"), "target", "n", F.round("middle", 9).alias("middle"), gates.binding_verdict(F.col("best")).alias("verdict"))


def q_interval_cover(spark, d):
    """How many of the places 1..60 the suppliers' ranges cover, by nation."""
    s = t.table(spark, d, "supplier").select("s_nationkey", F.struct((F.col("s_suppkey") % 50 + 1).cast("int").alias("lo"), (F.col("s_suppkey") % 50 + 6).cast("int").alias("hi")).alias("r"))
    g = s.groupBy("s_nationkey").agg(F.collect_set("r").alias("ranges"))  # at most 50 different ranges
    return g.select("s_nationkey", gates.covered(F.lit(1), F.lit(60), F.col("ranges")).alias("n_covered"))


def q_site_quality(spark, d):
    """Scores of vectors at five places, one of them beyond the end."""
    e = t.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("scores"))
    return e.select("vec_id", gates.site_quality(F.col("scores"), F.array(*[F.lit(i) for i in (1, 7, 20, 64, 65)])).alias("q")).select("vec_id", "q.n", F.round(F.col("q.mean") * F.col("q.n"), 6).alias("total"), "q.low", "q.out_of_range")


def q_leak_flags(spark, d):
    s = t.scored(spark, d)
    answer = F.when(F.col("score_a") > 0.7, 1).when(F.col("score_a") < 0.3, 0)
    conf = F.when(F.abs(F.col("score_a") - 0.5) > 0.4, "high").otherwise("low")
    return s.groupBy("y", gates.leak_flag(answer, F.col("y"), conf).alias("leak")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    q_usable_trials, q_best_evidence, q_first_occurrence, q_cascade_match, q_stratified_sample, q_interleaved, q_negative_pairs, q_ceiling, q_safety_screen, q_gate_trail, q_router, q_binding,
    q_interval_cover, q_site_quality, q_leak_flags,
)}

_CEIL = f"WITH {_TRIALS}, c AS (SELECT drug, disease, count(*) AS n, count(CASE WHEN randomised THEN 1 END) AS n_randomised, count(CASE WHEN randomised AND enrolled >= 50 THEN 1 END) AS n_usable FROM trials GROUP BY drug, disease)"
_BLOCK = """WHEN contains(x, 'sarin') THEN 'sarin' WHEN contains(x, 'novichok') THEN 'novichok' WHEN contains(x, 'ricin') AND regexp_matches(x, 'weapon|aerosoliz|militar|warfare') THEN 'ricin'"""
_ROUTE = "CASE mechanism WHEN '직접·병원체' THEN 'structure' WHEN '직접·숙주' THEN 'evidence' WHEN '간접' THEN 'evidence' WHEN '오프타겟' THEN 'evidence' END"
_FOLD = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"

ORACLES = {
    "q_usable_trials": f"""WITH {_TRIALS}, m AS (SELECT *, (2000 - left(done, 4)::INT) * 12 + 6 - right(done, 2)::INT AS months, {_RANK} AS rank FROM trials)
        SELECT CASE WHEN NOT randomised THEN 'not randomised' WHEN rank < 2 THEN 'phase 1' WHEN enrolled < 50 THEN 'too small' WHEN months NOT BETWEEN 6 AND 36 THEN 'outside the window' ELSE 'usable' END AS reason, count(*) AS n FROM m GROUP BY reason""",
    "q_best_evidence": f"WITH {_TRIALS} SELECT drug, disease, ord, phase, kind FROM trials QUALIFY row_number() OVER (PARTITION BY drug, disease ORDER BY {_RANK} DESC, kind = 'efficacy' DESC, ord) = 1",
    "q_first_occurrence": f"WITH {_TRIALS} SELECT drug, ord, done FROM trials QUALIFY row_number() OVER (PARTITION BY drug ORDER BY done, ord) = 1",
    "q_cascade_match": f"""WITH n AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part), k AS (SELECT DISTINCT {_FOLD.format('p_type')} AS key FROM part), f AS (SELECT name, {_FOLD.format('name')} AS f FROM n),
        v AS (SELECT name, unnest([{{'r': 0, 'rule': 'exact', 'key': f}}, {{'r': 1, 'rule': 'inverted', 'key': array_to_string(list_reverse(string_split(f, ' ')), ' ')}}, {{'r': 2, 'rule': 'truncated', 'key': string_split(f, ' ')[1]}}]) AS v FROM f),
        h AS (SELECT name, v.rule AS rule, v.key AS key FROM v JOIN k ON v.key = k.key QUALIFY row_number() OVER (PARTITION BY name ORDER BY v.r) = 1)
        SELECT name, rule, key, CASE WHEN key IS NULL THEN 'unmatched' ELSE 'ok' END AS status FROM n LEFT JOIN h USING (name)""",
    "q_stratified_sample": f"""WITH {_TRIALS}, r AS (SELECT kind, ord, row_number() OVER (PARTITION BY kind ORDER BY enrolled DESC, ord) AS place FROM trials) SELECT kind, ord, place FROM r WHERE place <= CASE kind WHEN 'efficacy' THEN 30 ELSE 10 END""",
    "q_interleaved": f"""WITH {_TRIALS}, l AS (SELECT drug, ord AS id, CASE kind WHEN 'safety' THEN 0 ELSE 1 END AS prio FROM trials) SELECT drug, id, prio, row_number() OVER (PARTITION BY drug ORDER BY prio, id) AS place FROM l QUALIFY place <= 8""",
    "q_negative_pairs": f"""WITH {_TRIALS}, k AS (SELECT DISTINCT drug, disease FROM trials WHERE enrolled > 240) SELECT a.drug, b.disease FROM (SELECT DISTINCT drug FROM k) a, (SELECT DISTINCT disease FROM k) b
        WHERE (a.drug, b.disease) NOT IN (SELECT (drug, disease) FROM k) ORDER BY md5(a.drug || ':' || b.disease), 1, 2 LIMIT 40""",
    "q_ceiling": f"{_CEIL} SELECT * FROM c",
    "q_safety_screen": f"""WITH a AS (SELECT lower(CASE turn WHEN 0 THEN text || ' ricin as a weapon' WHEN 1 THEN text || ' ricin antidotes' WHEN 2 THEN text || ' SARIN' ELSE text END) AS x FROM conversations)
        SELECT CASE {_BLOCK} END AS term, count(*) AS n FROM a GROUP BY term""",
    "q_gate_trail": f"""{_CEIL}, g AS (SELECT *, CASE WHEN n >= 2 THEN 'PASS' ELSE 'KILL' END AS o1, CASE WHEN n < 2 THEN 'SKIP' WHEN n_randomised > 0 THEN 'PASS' ELSE 'FLAG' END AS o2, CASE WHEN n < 2 THEN 'SKIP' WHEN n_usable > 0 THEN 'PASS' ELSE 'KILL' END AS o3,
        CASE WHEN n < 2 OR n_usable = 0 THEN 'SKIP' ELSE 'DONE' END AS o4 FROM c), u AS (SELECT 'existence' AS gate, o1 AS outcome FROM g UNION ALL SELECT 'randomised', o2 FROM g UNION ALL SELECT 'size', o3 FROM g UNION ALL SELECT 'review', o4 FROM g)
        SELECT gate, outcome, count(*) AS n FROM u GROUP BY ALL""",
    "q_router": f"""WITH p AS (SELECT p_partkey, ['직접·병원체', '직접·숙주', '간접', '오프타겟', '불명', 'other'][p_size % 6 + 1] AS mechanism, p_retailprice > 1200 AS high FROM part)
        SELECT mechanism, {_ROUTE} AS route, coalesce({_ROUTE} = 'structure', false) AND high AND p_partkey > 5 AS advised, count(*) AS n FROM p GROUP BY ALL""",
    "q_binding": """WITH a AS (SELECT l_partkey, l_suppkey, l_quantity / 6 AS x FROM lineitem), g AS (SELECT l_partkey, max(x) AS best, arg_min(l_suppkey, (-x, l_suppkey)) AS target, count(*) AS n, median(x) AS middle FROM a GROUP BY l_partkey)
        SELECT l_partkey, round(best, 9) AS best, target, n, round(middle, 9) AS middle, CASE WHEN best >= 7 THEN 'strong' WHEN best >= 5 THEN 'weak' ELSE 'none' END AS verdict FROM g""",
    "q_interval_cover": """WITH r AS (SELECT DISTINCT s_nationkey, s_suppkey % 50 + 1 AS lo, s_suppkey % 50 + 6 AS hi FROM supplier), p AS (SELECT DISTINCT s_nationkey, x FROM r, range(1, 61) t(x) WHERE x BETWEEN lo AND hi)
        SELECT s_nationkey, count(*)::INT AS n_covered FROM p GROUP BY s_nationkey""",
    "q_site_quality": """WITH e AS (SELECT vec_id, list_transform([1, 7, 20, 64], lambda i: round(embedding[i]::DOUBLE, 6)) AS h FROM embeddings) SELECT vec_id, 4 AS n, round(list_sum(h), 6) AS total, list_min(h) AS low, 1 AS out_of_range FROM e""",
    "q_leak_flags": f"""WITH {t.SCORED_SQL} SELECT y, coalesce(CASE WHEN score_a > 0.7 THEN 1 WHEN score_a < 0.3 THEN 0 END = y AND abs(score_a - 0.5) > 0.4, false) AS leak, count(*) AS n FROM scored GROUP BY ALL""",
}
