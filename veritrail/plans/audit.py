"""Queries of the measures of a run, of structures, and of the rungs before adjudication. Oracles state their values by themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as tx
from ..operators import audit, gates, labels, structure
from ..operators import evidence as ev
from ..sources import tables as t
from .evidence import _SUMMED, q_existence_gate, verdict_sql
from .labels import _TRIALS, _trials
from .metrics import _S, _scored


def q_ladder(spark, d):
    """Verdicts behind the existence gate, some of whose look-ups failed, found nothing, or did not run."""
    s = F.col("subject")
    summed = ev.summary(ev.dedupe_trials(ev.weighted(t.evidence(spark, d)))).withColumns({"f0_ran": s % 5 != 0, "f0_error": s % 11 == 3, "f0_count": F.when(s % 7 != 2, s % 3), "link_zero": s % 2 == 0})
    return ev.laddered(summed).select("subject", "object", "verdict", "p")


def q_faithfulness(spark, d):
    e = t.evidence(spark, d).withColumn("ok", F.when(F.col("source_id") % 5 != 0, F.col("confidence") != "low"))
    return audit.faithfulness(e, ["object"], "ok")


def q_refute_recall(spark, d):
    return audit.refute_recall(t.evidence(spark, d), ["object"], "subject", F.col("direction") == "refute", F.col("source_id") % 3 == 0)


def q_false_negatives(spark, d):
    return audit.false_negatives(_scored(spark, d), ["lang"], F.col("verdict_b") == "reject", F.when(F.col("toxic") == 0, F.col("y") == 1))


def q_time_to_refute(spark, d):
    gate = F.element_at(F.array(*[F.lit(g) for g in ("f0", "rag", "skeptic", "registry", "s2", "router", "hitl")]), F.col("l_linenumber").cast("int"))
    lines = t.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("run"), F.col("l_suppkey").alias("candidate"), gate.alias("gate"), F.col("l_quantity").cast("double").alias("seconds"))
    return audit.time_to_refute(lines, ["run"], "candidate", "gate", "seconds")


def q_zero_ratio(spark, d):
    return audit.zero_ratio(q_existence_gate(spark, d), "object", "pair_count")


def q_universe_baseline(spark, d):
    """Blind draws of drugs for diseases: labels by the kind of their earliest trial over 120 patients."""
    tr = _trials(spark, d)
    first = labels.best_of_group(tr.filter("enrolled > 120"), ["drug", "disease"], [F.asc("done"), F.asc("ord")]).select("drug", "disease", F.col("kind").alias("label"))
    return audit.universe_baseline(first, tr.select("drug").distinct(), "disease", "drug", "label")


def q_use_signal(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", "p_size")
    hits = t.table(spark, d, "lineitem").filter("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("hits"))
    pairs = p.join(hits, "p_partkey", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    return audit.use_signal(pairs, F.col("p_size") % 4 != 0, "hits", F.col("p_size") % 3 == 0)


def q_fresh_ids(spark, d):
    """Orders that a part's later lines found and its first lines had not."""
    lines = t.table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("subject"), (F.col("l_suppkey") % 97).alias("id"), "l_linenumber", "l_orderkey")
    found, seen = lines.filter("l_linenumber > 3 and l_orderkey % 10 = 0"), lines.filter("l_linenumber = 1 and l_orderkey % 20 = 1")
    return audit.fresh_ids(found, seen, ["subject"], "id", "l_linenumber").select("subject", "id", "place")


def q_top_sections(spark, d):
    c = t.table(spark, d, "conversations").withColumn("kind", F.element_at(F.array(*[F.lit(x) for x in ("after discussion", "other", "paragraph", "section")]), (F.col("turn") % 4 + 1).cast("int")))
    return audit.top_sections(c, ["conv_id"], "kind", "turn").select("conv_id", "turn", "place")


def q_nearest_deadline(spark, d):
    o = t.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return audit.nearest_deadline(o, ["o_custkey"], "day", F.lit("1997-06-30").cast("date"), "o_orderkey", 3).select("o_custkey", "o_orderkey", "days", "place")


def q_skeleton(spark, d):
    """Made keys: of every third compound too short to have a skeleton."""
    key = F.concat(F.lit(" "), F.md5((F.col("p_partkey") % 40).cast("string")), F.lit("-uhfffaoysa-n "))
    p = t.table(spark, d, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.substring(key, 1, 9)).otherwise(key).alias("key"))
    return p.groupBy(structure.skeleton(F.col("key")).alias("skeleton")).agg(F.count(F.lit(1)).alias("n"))


def q_structure_rank(spark, d):
    p = t.table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("part"), (F.col("p_size") % 2 == 0).alias("apo"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 10.0).alias("resolution"), (F.col("p_partkey") % 9).alias("covered"))
    return structure.ranked(p, ["brand"], "part").filter("place <= 5").select("brand", "part", "place")


def q_dock_verdict(spark, d):
    k, z = F.col("p_partkey"), F.col("p_size")
    p = t.table(spark, d, "part").select(structure.dock_verdict(F.when(k % 5 != 0, k % 7 != 0), F.when(z % 4 != 1, z % 3), F.when(k % 11 != 0, z % 2 == 0)).alias("verdict"))
    return p.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


def q_organism(spark, d):
    mech = F.element_at(F.array(*[F.lit(m) for m in gates.ROUTES]), (F.col("p_size") % 5 + 1).cast("int"))
    p = t.table(spark, d, "part").select(structure.organism(mech, F.when(F.col("p_partkey") % 2 == 0, "SARS-CoV-2")).alias("organism"))
    return p.groupBy("organism").agg(F.count(F.lit(1)).alias("n"))


def q_accessibility(spark, d):
    """Names with made endings of biologics; molecule types of every second part."""
    k = F.col("p_partkey")
    name = F.concat(F.lower(F.split("p_name", " ")[0]), F.element_at(F.array(*[F.lit(x) for x in ("mab", "ine", "tide", "ol", "parin")]), (k % 5 + 1).cast("int")))
    small = gates.small_molecule(name, F.when(k % 2 == 0, F.when(k % 3 == 0, "Protein").otherwise("Small molecule")))
    a = t.table(spark, d, "part").select(structure.accessibility(k % 10 == 0, F.when(k % 4 != 0, F.col("p_size") % 3), small).alias("a"))
    return a.groupBy("a.eml", "a.oral_ok", "a.small").agg(F.count(F.lit(1)).alias("n"))


def q_alerts(spark, d):
    logp = F.when(F.col("p_partkey") % 6 != 0, F.col("p_size") / 10.0)
    p = t.table(spark, d, "part").select(structure.herg_alert(F.col("p_partkey") % 3, logp, F.col("p_partkey") % 4).alias("herg"), structure.dili_alert(logp, F.col("p_partkey") % 3).alias("dili"))
    return p.groupBy("herg", "dili").agg(F.count(F.lit(1)).alias("n"))


def q_localized(spark, d):
    """Targets named by words of part names, among the chains of their brand's manufacturer; numbers at the end tell chains apart."""
    p = t.table(spark, d, "part").withColumn("tokens", F.array_append(F.split(F.lower("p_name"), " "), F.concat(F.lit("nsp"), (F.col("p_partkey") % 13).cast("string"))))
    chains = p.filter("p_partkey % 20 = 0").select(F.col("p_brand").alias("protein"), F.col("p_partkey").cast("string").alias("chain"), "tokens")
    targets = p.filter("p_partkey % 20 = 1").select(F.col("p_partkey").cast("string").alias("target"), F.col("p_brand").alias("protein"), F.slice("tokens", 1, 3).alias("tokens"))
    return structure.localized(targets, chains)


def q_in_outcome(spark, d):
    """Quotes of 20 characters of every document, in and before the outcome's part."""
    docs = t.table(spark, d, "documents").select("doc_id", F.concat(F.substring("text", 1, 100), F.lit(f" {tx.OUTCOME_MARK}\n"), F.substring("text", 101, 10**7)).alias("document"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 11, 20)).otherwise(F.substring("text", 111, 20)).alias("quote"))
    return docs.groupBy(tx.in_outcome(F.col("quote"), F.col("document")).alias("inside")).agg(F.count(F.lit(1)).alias("n"))


def q_source_tag(spark, d):
    e = t.evidence(spark, d)
    tag = tx.source_tag(F.when(F.col("source_id") % 3 == 0, "Lancet"), F.when(F.col("source_id") % 2 == 0, F.col("year")), F.col("source_id") % 10, F.col("study_type"), F.col("direction"))
    return e.groupBy(tag.alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def q_adjunct(spark, d):
    names = spark.createDataFrame([(x,) for x in ("Mesna", "mesna sodium", "dexamethasone phosphate", "sodium mesna", "metformin", "folic acid", "saline", "aspirin citrate")], "name string")
    return names.select("name", labels.adjunct(F.col("name")).alias("adjunct"))


def q_mcnemar_power(spark, d):
    k = t.table(spark, d, "part").select((F.col("p_size") % 30).cast("long").alias("n"), (F.lit(0.5) + (F.col("p_size") % 4) / 10).alias("psi")).distinct()
    return k.select("n", "psi", stats.mcnemar_power(F.col("n"), F.col("psi")).alias("power"))


QUERIES = {f.__name__: f for f in (
    q_ladder, q_faithfulness, q_refute_recall, q_false_negatives, q_time_to_refute, q_zero_ratio, q_universe_baseline, q_use_signal, q_fresh_ids, q_top_sections, q_nearest_deadline, q_skeleton,
    q_structure_rank, q_dock_verdict, q_organism, q_accessibility, q_alerts, q_localized, q_in_outcome, q_source_tag, q_adjunct, q_mcnemar_power,
)}


def _ci(k: str, n: str, name: str) -> str:
    p = f"({k} / nullif({n}, 0)::DOUBLE)"
    mid, half, den = f"({p} + 3.8416 / (2 * nullif({n}, 0)))", f"1.96 * sqrt({p} * (1 - {p}) / nullif({n}, 0) + 3.8416 / (4.0 * {n} * nullif({n}, 0)))", f"(1 + 3.8416 / nullif({n}, 0))"
    lo, hi = f"({mid} - {half}) / {den}", f"({mid} + {half}) / {den}"
    return f"{p} AS {name}, CASE WHEN {n} > 0 THEN greatest(0, {lo}) END AS {name}_lo, CASE WHEN {n} > 0 THEN least(1, {hi}) END AS {name}_hi"


_LN = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_E = f"WITH {t.EVIDENCE_SQL}"

ORACLES = {
    "q_ladder": f"""{_SUMMED}, v AS ({verdict_sql('summed')}) SELECT subject, object,
        CASE WHEN subject % 5 <> 0 AND subject % 11 = 3 THEN 'hold' WHEN subject % 5 <> 0 AND (subject % 7 = 2 OR subject % 3 = 0) THEN CASE WHEN subject % 2 = 0 THEN 'hold' ELSE 'reject' END ELSE verdict END AS verdict,
        CASE WHEN subject % 5 <> 0 AND subject % 11 = 3 THEN NULL WHEN subject % 5 <> 0 AND (subject % 7 = 2 OR subject % 3 = 0) THEN CASE WHEN subject % 2 = 0 THEN 50 ELSE 0 END ELSE p END AS p FROM v""",
    "q_faithfulness": f"""{_E}, c AS (SELECT object, count(*) AS n, count(CASE WHEN source_id % 5 <> 0 THEN 1 END) AS checked, count(CASE WHEN source_id % 5 <> 0 AND confidence <> 'low' THEN 1 END) AS faithful,
        count(CASE WHEN source_id % 5 <> 0 AND confidence = 'low' THEN 1 END) AS made_up FROM evidence GROUP BY object) SELECT *, {_ci('faithful', 'checked', 'faithfulness')}, {_ci('checked', 'n', 'relevance')} FROM c""",
    "q_refute_recall": f"""{_E}, p AS (SELECT object, subject, count(CASE WHEN direction = 'refute' THEN 1 END) AS r, count(CASE WHEN direction = 'refute' AND source_id % 3 = 0 THEN 1 END) AS s FROM evidence GROUP BY ALL)
        SELECT object, count(*) AS n, count(CASE WHEN r > 0 THEN 1 END) AS with_refutation, sum(r) AS refutations, sum(s) AS by_skeptic, round(sum(s) / nullif(sum(r), 0)::DOUBLE, 3) AS skeptic_share FROM p GROUP BY object""",
    "q_false_negatives": f"""{_S}, c AS (SELECT lang, count(CASE WHEN verdict_b = 'reject' THEN 1 END) AS n, count(CASE WHEN verdict_b = 'reject' AND y = 1 THEN 1 END) AS n_valid FROM s WHERE toxic = 0 GROUP BY lang) SELECT *, {_ci('n_valid', 'n', 'rate')} FROM c""",
    "q_time_to_refute": """SELECT l_returnflag || l_linestatus AS run, sum(l_quantity) FILTER (l_linenumber IN (2, 3, 4)) AS refuting, sum(l_quantity) AS total, count(DISTINCT l_suppkey) AS candidates,
        sum(l_quantity) / count(DISTINCT l_suppkey) AS per_candidate FROM lineitem GROUP BY ALL""",
    "q_zero_ratio": f"""{_E}, e AS (SELECT DISTINCT subject, object FROM evidence WHERE year >= 2000), h AS (SELECT p_partkey AS subject, object FROM part, (SELECT DISTINCT c_mktsegment AS object FROM customer))
        SELECT h.object, count(*) - count(e.subject) AS zero, count(*) AS total, (count(*) - count(e.subject)) / count(*)::DOUBLE AS ratio FROM h LEFT JOIN e USING (subject, object) GROUP BY h.object HAVING zero > 0""",
    "q_universe_baseline": f"""WITH {_TRIALS}, f AS (SELECT drug, disease, kind FROM trials WHERE enrolled > 120 QUALIFY row_number() OVER (PARTITION BY drug, disease ORDER BY done, ord) = 1),
        t AS (SELECT (SELECT count(DISTINCT disease) FROM f) * (SELECT count(DISTINCT drug) FROM trials) AS every), c AS (SELECT kind AS label, count(*) AS n FROM f GROUP BY kind UNION ALL SELECT 'unknown', (SELECT every FROM t) - count(*) FROM f)
        SELECT label, n, n / (SELECT every FROM t)::DOUBLE AS expected FROM c""",
    "q_use_signal": f"""WITH h AS (SELECT l_partkey AS k, count(*) AS hits FROM lineitem WHERE l_quantity > 45 GROUP BY ALL), p AS (SELECT p_size, coalesce(hits, 0) AS hits FROM part LEFT JOIN h ON k = p_partkey),
        c AS (SELECT count(CASE WHEN p_size % 4 <> 0 THEN 1 END) AS n_evaluable, count(CASE WHEN p_size % 4 = 0 THEN 1 END) AS n_unlinked, count(CASE WHEN p_size % 4 <> 0 AND hits > 0 THEN 1 END) AS n_hit,
          count(CASE WHEN p_size % 4 <> 0 AND p_size % 3 = 0 THEN 1 END) AS n_tp, count(CASE WHEN p_size % 4 <> 0 AND p_size % 3 = 0 AND hits > 0 THEN 1 END) AS tp_hit, count(CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 THEN 1 END) AS n_tn,
          count(CASE WHEN p_size % 4 <> 0 AND p_size % 3 <> 0 AND hits > 0 THEN 1 END) AS tn_hit, max(hits) FILTER (p_size % 4 <> 0) AS most FROM p),
        x AS (SELECT *, unnest(range(greatest(0, n_hit - n_tn), least(n_tp, n_hit) + 1)) AS i FROM c), l AS (SELECT *, {_LN.format('n_tp', 'i')} + {_LN.format('n_tn', '(n_hit - i)')} - {_LN.format('n_evaluable', 'n_hit')} AS lp,
          {_LN.format('n_tp', 'tp_hit')} + {_LN.format('n_tn', 'tn_hit')} - {_LN.format('n_evaluable', 'n_hit')} AS seen FROM x)
        SELECT c.*, {_ci('n_hit', 'n_evaluable', 'rate')}, (SELECT least(1, sum(exp(lp))) FROM l WHERE lp <= seen + 1e-9) AS fisher_p,
          CASE WHEN round(n_hit / n_evaluable::DOUBLE, 4) <= 0.6 THEN 'separates' WHEN round(n_hit / n_evaluable::DOUBLE, 4) > 0.9 THEN 'dropped' ELSE 'unclear' END AS decision FROM c""",
    "q_fresh_ids": """WITH l AS (SELECT l_partkey % 50 AS subject, l_suppkey % 97 AS id, l_linenumber, l_orderkey FROM lineitem), f AS (SELECT subject, id, min(l_linenumber) AS o FROM l WHERE l_linenumber > 3 AND l_orderkey % 10 = 0
        AND (subject, id) NOT IN (SELECT (subject, id) FROM l WHERE l_linenumber = 1 AND l_orderkey % 20 = 1) GROUP BY ALL) SELECT subject, id, row_number() OVER (PARTITION BY subject ORDER BY o, id) AS place FROM f""",
    "q_top_sections": """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY [2, 9, 1, 0][turn % 4 + 1], turn) AS place FROM conversations QUALIFY place <= 3""",
    "q_nearest_deadline": """SELECT o_custkey, o_orderkey, o_orderdate::DATE - DATE '1997-06-30' AS days, row_number() OVER (PARTITION BY o_custkey ORDER BY abs(o_orderdate::DATE - DATE '1997-06-30'), o_orderdate::DATE, o_orderkey) AS place FROM orders QUALIFY place <= 3""",
    "q_skeleton": """SELECT CASE WHEN p_partkey % 3 <> 0 THEN upper(left(md5((p_partkey % 40)::VARCHAR), 14)) END AS skeleton, count(*) AS n FROM part GROUP BY ALL""",
    "q_structure_rank": """SELECT p_brand AS brand, p_partkey AS part, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 2, CASE WHEN p_size % 5 <> 0 AND p_size > 0 THEN p_size / 10.0 ELSE 99 END, p_partkey % 9 DESC, p_partkey) AS place FROM part QUALIFY place <= 5""",
    "q_dock_verdict": """SELECT CASE WHEN p_partkey % 5 = 0 THEN 'species unknown' WHEN p_partkey % 7 = 0 THEN 'other species' WHEN p_size % 4 = 1 OR p_size % 3 = 0 THEN 'only solved with ligand' WHEN p_partkey % 11 = 0 THEN 'site unknown'
        WHEN p_size % 2 = 1 THEN 'no site without ligand' ELSE 'allowed' END AS verdict, count(*) AS n FROM part GROUP BY ALL""",
    "q_organism": """SELECT CASE p_size % 5 WHEN 1 THEN 'Homo sapiens' WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'SARS-CoV-2' END END AS organism, count(*) AS n FROM part GROUP BY ALL""",
    "q_accessibility": """SELECT CASE WHEN p_partkey % 10 = 0 THEN true END AS eml, CASE WHEN p_partkey % 4 <> 0 THEN p_size % 3 = 0 END AS oral_ok,
        CASE WHEN p_partkey % 5 IN (0, 2, 4) THEN false WHEN p_partkey % 2 = 0 THEN p_partkey % 3 <> 0 END AS small, count(*) AS n FROM part GROUP BY ALL""",
    "q_alerts": """WITH x AS (SELECT (p_partkey % 3 >= 1)::INT + (p_size / 10.0 >= 3.7)::INT + (p_partkey % 4 >= 2)::INT AS h, (p_size / 10.0 >= 3)::INT + p_partkey % 3 AS l, p_partkey % 6 = 0 AS u FROM part)
        SELECT CASE WHEN u THEN 'unknown' WHEN h = 3 THEN 'alert' WHEN h = 2 THEN 'caution' ELSE 'none' END AS herg, CASE WHEN u THEN 'unknown' WHEN l >= 2 THEN 'caution' WHEN l = 1 THEN 'weak' ELSE 'none' END AS dili, count(*) AS n FROM x GROUP BY ALL""",
    "q_localized": """WITH p AS (SELECT p_partkey, p_brand, list_append(string_split(lower(p_name), ' '), 'nsp' || (p_partkey % 13)) AS tokens FROM part), t AS (SELECT p_partkey::VARCHAR AS target, p_brand, unnest(tokens[1:3]) AS x FROM p WHERE p_partkey % 20 = 1),
        c AS (SELECT p_partkey::VARCHAR AS chain, p_brand, tokens FROM p WHERE p_partkey % 20 = 0),
        s AS (SELECT target, chain, count(CASE WHEN len(list_filter(tokens, lambda y: y = x OR (starts_with(y, x) AND x <> '' AND NOT regexp_matches(y[len(x) + 1:], '^[0-9]')) OR (starts_with(x, y) AND y <> '' AND NOT regexp_matches(x[len(y) + 1:], '^[0-9]')))) > 0 THEN 1 END) AS score
          FROM t LEFT JOIN c USING (p_brand) GROUP BY ALL),
        r AS (SELECT target, count(chain) AS n, max(score) AS best, count(CASE WHEN chain IS NOT NULL AND score = m THEN 1 END) AS tied, arg_max(chain, score) AS chain FROM (SELECT *, max(score) OVER (PARTITION BY target) AS m FROM s) GROUP BY target)
        SELECT target, CASE WHEN n <= 1 THEN 'single' WHEN best >= 1 AND tied = 1 THEN 'localized' ELSE 'unclear' END AS kind, CASE WHEN n > 1 AND best >= 1 AND tied = 1 THEN chain END AS chain FROM r""",
    "q_in_outcome": """WITH q AS (SELECT lower(trim(regexp_replace(CASE WHEN doc_id % 2 = 0 THEN substr(text, 11, 20) ELSE substr(text, 111, 20) END, '\\s+', ' ', 'g'))) AS q, lower(trim(regexp_replace(substr(text, 101), '\\s+', ' ', 'g'))) AS b FROM documents)
        SELECT coalesce(q <> '' AND contains(b, q), false) AS inside, count(*) AS n FROM q GROUP BY ALL""",
    "q_source_tag": f"""{_E} SELECT CASE WHEN source_id % 6 = 0 THEN 'Lancet ' || year WHEN source_id % 3 = 0 THEN 'Lancet' WHEN source_id % 2 = 0 THEN year::VARCHAR ELSE 'PMID ' || (source_id % 10) END || ' ' ||
        CASE study_type WHEN 'meta' THEN '메타분석' WHEN 'rct' THEN 'RCT' WHEN 'trial' THEN '임상시험' WHEN 'observational' THEN '관찰연구' WHEN 'review' THEN '고찰' WHEN 'in_vitro' THEN '시험관' WHEN 'case' THEN '증례' ELSE '기타' END ||
        CASE WHEN direction = 'support' THEN '(지지)' ELSE '(반박)' END AS tag, count(*) AS n FROM evidence GROUP BY ALL""",
    "q_adjunct": """SELECT * FROM (VALUES ('Mesna', true), ('mesna sodium', true), ('dexamethasone phosphate', true), ('sodium mesna', false), ('metformin', false), ('folic acid', true), ('saline', true), ('aspirin citrate', true)) x(name, adjunct)""",
    "q_mcnemar_power": f"""WITH k AS (SELECT DISTINCT p_size % 30 AS n, 0.5::DOUBLE + (p_size % 4) / 10.0::DOUBLE AS psi FROM part), x AS (SELECT n, psi, unnest(range(0, n + 1)) AS k FROM k),
        t AS (SELECT n, psi, k, CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp({_LN.format('x.n', 'i')} - x.n * ln(2))) FROM range(0, 31) r(i) WHERE i <= least(x.k, x.n - x.k))) END AS p FROM x)
        SELECT n, psi, coalesce(sum(exp({_LN.format('n', 'k')} + k * ln(psi) + (n - k) * ln(1 - psi))) FILTER (n > 0 AND p <= 0.05), 0) AS power FROM t GROUP BY n, psi""",
}
