"""Queries over the graph, the reports, the patents and the knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibrate, graph, kb, metrics, signal
from ..sources import tables as t


def q_multihop(spark, d):
    return graph.multihop(*t.edges(spark, d))


def q_known_excluded(spark, d):
    """Per disease: candidates, and known compounds that were left out."""
    cg, gd, cd = t.edges(spark, d)
    found = graph.multihop(cg, gd, cd).groupBy("d").agg(F.count(F.lit(1)).alias("n_candidates"))
    known = cd.groupBy("d").agg(F.count(F.lit(1)).alias("n_known"))
    return found.join(known, "d", "full").select("d", F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("n_known", F.lit(0)).alias("n_known"))


def q_degree_z(spark, d):
    return graph.degree_scores(*t.edges(spark, d)).select("d", "c", "shared", "n", F.round("expected", 6).alias("expected"), F.round("z", 6).alias("z"))


def q_hypergeom(spark, d):
    cg, gd, cd = t.edges(spark, d)
    return graph.hypergeometric(graph.degree_scores(cg, gd, cd), cg, gd).select("d", "c", "shared", "marked", "n", "p")


def _hidden(cd):
    """Every fifth known edge by a hash of the pair; hidden edges leave the known ones."""
    mark = (F.col("c") * 7 + F.col("d") * 13) % 5 == 0
    return cd.filter(mark), cd.filter(~mark)


def q_recall_at_k(spark, d):
    cg, gd, cd = t.edges(spark, d)
    hidden, known = _hidden(cd)
    scored = graph.degree_scores(cg, gd, known)
    out = None
    for name, by in (("shared", "shared"), ("degree", "n")):
        row = graph.recall(graph.ranked(scored, by), hidden).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def q_top_candidates(spark, d):
    """Each disease's ten best compounds by shared genes, with five of the genes."""
    cg, gd, cd = t.edges(spark, d)
    top = graph.ranked(graph.multihop(cg, gd, cd), "shared").filter("rank <= 10")
    via = top.join(cg, "c").join(gd, ["g", "d"]).groupBy("d", "c").agg(F.array_join(F.slice(F.array_sort(F.collect_list("g")), 1, 5), ",").alias("via"))
    return top.join(via, ["d", "c"]).select("d", "c", "shared", "rank", "via")


def q_shared_genes_status(spark, d):
    cg, gd, _ = t.edges(spark, d)
    pairs = t.table(spark, d, "part").select((F.col("p_partkey") + 1).alias("c"), (F.col("p_size") % 30).cast("int").alias("d")).distinct()
    return graph.shared_genes(pairs, cg, gd)


def q_coclaim(spark, d):
    return signal.co_claims(t.claims(spark, d), t.entities(spark, d))


def q_field_counts_capped(spark, d):
    return signal.capped_counts(t.claims(spark, d), 20)


def q_recent_patents(spark, d):
    return signal.recent(t.claims(spark, d), t.entities(spark, d), 1998)


def q_year_signal(spark, d):
    """Per entity: the share of claimed patents of recent years against the share of all of them."""
    e = t.entities(spark, d)
    claimed = t.claims(spark, d).filter(F.col("field") == signal.FIELD_CLAIMS).select("patent").distinct().withColumn("claimed", F.lit(True))
    j = e.join(claimed, "patent", "left")
    recent = F.col("year") >= 1998
    return j.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("claimed")).alias("n_claimed"), F.try_divide(F.count_if(recent & F.col("claimed")), F.count_if(F.col("claimed"))).alias("claimed_share"), F.try_divide(F.count_if(recent), F.count(F.lit(1))).alias("all_share"))


def q_prr(spark, d):
    return signal.disproportionality(t.reports(spark, d))


def q_reverse_merge(spark, d):
    return signal.reverse_merge(signal.disproportionality(t.reports(spark, d)))


def q_label_sizes(spark, d):
    return signal.label_size_rank(t.reports(spark, d))


def q_kb_fold(spark, d):
    return kb.fold(t.kb_log(t.table(spark, d, "events")))


def q_kb_block(spark, d):
    hypotheses = t.table(spark, d, "events").select(F.col("user_id").alias("subject"), (t.event_k() % 10).alias("object")).distinct()
    return kb.consulted(hypotheses, t.kb_log(t.table(spark, d, "events"))).groupBy("answer").agg(F.count(F.lit(1)).alias("n"))


def q_tanimoto_pairs(spark, d):
    items = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), kb.sign_bits(F.col("embedding")).alias("bits"))
    return kb.similar(items, 0.5).select("a", "b", F.round("similarity", 9).alias("similarity"))


def q_stream_kb(spark, d):
    from ..streaming import kb as live

    return live.fold_as_stream(spark, d)


def q_stream_prr(spark, d):
    from ..streaming import kb as live

    return live.reports_as_stream(spark, d)


def q_match_bucket(spark, d):
    n = t.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return t.table(spark, d, "customer").select("c_custkey").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", calibrate.bucket(F.coalesce("n", F.lit(0))).alias("bucket"))


def q_greedy_match(spark, d):
    n = t.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("n"))
    brand = t.table(spark, d, "part").join(n, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_partkey").alias("id"), "n", "p_size")
    return calibrate.greedy_match(brand.filter("p_size <= 10").select("id", "n"), brand.filter("p_size > 40").select("id", "n"))


QUERIES = {f.__name__: f for f in (
    q_multihop, q_known_excluded, q_degree_z, q_hypergeom, q_recall_at_k, q_top_candidates, q_shared_genes_status, q_coclaim, q_field_counts_capped, q_recent_patents, q_year_signal, q_prr,
    q_reverse_merge, q_label_sizes, q_kb_fold, q_kb_block, q_tanimoto_pairs, q_stream_kb, q_stream_prr, q_match_bucket, q_greedy_match,
)}

_HOP = f"""WITH {t.EDGES_SQL}, shared AS (SELECT d, c, count(*) AS shared FROM gd JOIN cg USING (g) GROUP BY d, c), hop AS (SELECT * FROM shared WHERE shared >= 2 AND (d, c) NOT IN (SELECT (d, c) FROM cd))"""
_SCORED = f"""{_HOP}, total AS (SELECT count(*) AS total FROM cg), degree AS (SELECT c, count(*) AS n FROM cg GROUP BY c),
weight AS (SELECT g, count(*) / (SELECT total FROM total)::DOUBLE AS w FROM cg GROUP BY g),
expected AS (SELECT d, n, sum(1 - pow(1 - w, n)) AS expected, sum((1 - pow(1 - w, n)) * pow(1 - w, n)) AS variance FROM gd JOIN weight USING (g), (SELECT DISTINCT n FROM degree) GROUP BY d, n),
scored AS (SELECT *, CASE WHEN variance > 0 THEN (shared - expected) / sqrt(variance) ELSE 0 END AS z FROM hop JOIN degree USING (c) JOIN expected USING (d, n) WHERE n >= 2)"""
_LC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
_PRR = f"""WITH {t.REPORTS_SQL}, cell AS (SELECT drug, event, count(*) AS a FROM reports GROUP BY ALL), dr AS (SELECT drug, sum(a) AS n_drug FROM cell GROUP BY drug), evt AS (SELECT event, sum(a) AS n_event FROM cell GROUP BY event),
prr AS (SELECT drug, event, a, n_drug::BIGINT AS n_drug, CASE WHEN n_event - a > 0 THEN (a / n_drug::DOUBLE) / ((n_event - a) / greatest((SELECT sum(a) FROM cell) - n_drug, 1)::DOUBLE) END AS prr FROM cell JOIN dr USING (drug) JOIN evt USING (event)),
sig AS (SELECT *, coalesce(a >= 3 AND prr >= 2, false) AS signal FROM prr)"""

ORACLES = {
    "q_multihop": f"{_HOP} SELECT d, c, shared FROM hop",
    "q_known_excluded": f"""{_HOP}, f AS (SELECT d, count(*) AS n FROM hop GROUP BY d), k AS (SELECT d, count(*) AS n FROM cd GROUP BY d)
        SELECT d, coalesce(f.n, 0) AS n_candidates, coalesce(k.n, 0) AS n_known FROM f FULL JOIN k USING (d)""",
    "q_degree_z": f"{_SCORED} SELECT d, c, shared, n, round(expected, 6) AS expected, round(z, 6) AS z FROM scored",
    "q_hypergeom": f"""{_SCORED}, genes AS (SELECT DISTINCT g FROM cg), mk AS (SELECT d, count(*) AS marked FROM gd JOIN genes USING (g) GROUP BY d), keys AS (SELECT DISTINCT shared, marked, n FROM scored JOIN mk USING (d)),
        terms AS (SELECT shared, marked, n, unnest(range(shared, least(marked, n) + 1)) AS i, (SELECT count(*) FROM genes) AS pop FROM keys),
        p AS (SELECT shared, marked, n, least(1, sum(CASE WHEN n - i <= pop - marked THEN exp({_LC.format('marked', 'i')} + {_LC.format('(pop - marked)', '(n - i)')} - {_LC.format('pop', 'n')}) ELSE 0 END)) AS p FROM terms GROUP BY ALL)
        SELECT d, c, shared, marked, n, p FROM scored JOIN mk USING (d) JOIN p USING (shared, marked, n)""",
    "q_recall_at_k": f"""{_SCORED.replace('(d, c) NOT IN (SELECT (d, c) FROM cd)', '(d, c) NOT IN (SELECT (d, c) FROM cd WHERE (c * 7 + d * 13) % 5 <> 0)')},
        hidden AS (SELECT * FROM cd WHERE (c * 7 + d * 13) % 5 = 0),
        r AS (SELECT 'shared' AS method, d, c, row_number() OVER (PARTITION BY d ORDER BY shared DESC, c) AS rank FROM scored UNION ALL SELECT 'degree', d, c, row_number() OVER (PARTITION BY d ORDER BY n DESC, c) FROM scored),
        m AS (SELECT method, h.c, h.d, rank FROM hidden h CROSS JOIN (SELECT unnest(['shared', 'degree']) AS method) LEFT JOIN r USING (method, d, c))
        SELECT method, count(*) AS n_hidden, count(rank) AS n_reachable, count(CASE WHEN rank <= 20 THEN 1 END) / count(*)::DOUBLE AS recall_at_20, count(CASE WHEN rank <= 100 THEN 1 END) / count(*)::DOUBLE AS recall_at_100,
          sum(coalesce(1 / rank::DOUBLE, 0)) / count(*) AS mrr, count(rank) / count(*)::DOUBLE AS ceiling FROM m GROUP BY method""",
    "q_top_candidates": f"""{_HOP}, top AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY shared DESC, c) AS rank FROM hop QUALIFY rank <= 10)
        SELECT d, c, shared, rank, array_to_string(list_sort(list(g))[1:5], ',') AS via FROM top JOIN cg USING (c) JOIN gd USING (g, d) GROUP BY ALL""",
    "q_shared_genes_status": f"""WITH {t.EDGES_SQL}, p AS (SELECT DISTINCT p_partkey + 1 AS c, (p_size % 30)::INT AS d FROM part), m AS (SELECT c, d, count(*) AS n FROM p JOIN cg USING (c) JOIN gd USING (g, d) GROUP BY c, d),
        s AS (SELECT c, d, CASE WHEN c NOT IN (SELECT c FROM cg) THEN 'compound not in graph' WHEN d NOT IN (SELECT d FROM gd) THEN 'disease not in graph' ELSE 'ok' END AS status FROM p)
        SELECT c, d, status, CASE WHEN status = 'ok' THEN coalesce(n, 0) END AS shared FROM s LEFT JOIN m USING (c, d)""",
    "q_coclaim": f"WITH {t.CLAIMS_SQL} SELECT compound, entity, count(DISTINCT patent) AS n_patents FROM claims JOIN entities USING (patent) WHERE field = 2 GROUP BY compound, entity",
    "q_field_counts_capped": f"""WITH {t.CLAIMS_SQL}, n AS (SELECT compound, field, count(*) AS n FROM claims GROUP BY ALL)
        SELECT compound, field, n, greatest(0, least(n, 20 - coalesce(sum(n) OVER (PARTITION BY compound ORDER BY field ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS kept FROM n""",
    "q_recent_patents": f"""WITH {t.CLAIMS_SQL}, h AS (SELECT DISTINCT entity, patent, year FROM entities WHERE year >= 1998 AND patent IN (SELECT patent FROM claims WHERE field = 2))
        SELECT entity, patent, year, row_number() OVER (PARTITION BY entity ORDER BY year DESC, patent) AS place FROM h QUALIFY place <= 3""",
    "q_year_signal": f"""WITH {t.CLAIMS_SQL}, j AS (SELECT entity, year, patent IN (SELECT patent FROM claims WHERE field = 2) AS claimed FROM entities)
        SELECT entity, count(*) AS n, count(CASE WHEN claimed THEN 1 END) AS n_claimed, count(CASE WHEN claimed AND year >= 1998 THEN 1 END) / nullif(count(CASE WHEN claimed THEN 1 END), 0)::DOUBLE AS claimed_share, count(CASE WHEN year >= 1998 THEN 1 END) / count(*)::DOUBLE AS all_share FROM j GROUP BY entity""",
    "q_prr": f"{_PRR} SELECT drug, event, a, n_drug, prr, signal FROM sig",
    "q_reverse_merge": f"""{_PRR} SELECT drug, count(*) AS n_events, max(prr) AS prr, arg_max(event, (prr, -event)) AS top_event, max(a) AS n_max FROM sig WHERE signal GROUP BY drug""",
    "q_label_sizes": f"WITH {t.REPORTS_SQL} SELECT drug, count(DISTINCT event) AS n_events, count(*) AS n_reports, count(DISTINCT event) / count(*)::DOUBLE AS density FROM reports GROUP BY drug",
    "q_kb_fold": f"WITH {t.KB_SQL} SELECT subject, object, arg_max(act, seq) AS act, max(seq) AS seq, count(*) AS n_acts FROM kb GROUP BY subject, object",
    "q_kb_block": f"""WITH {t.KB_SQL}, h AS (SELECT DISTINCT user_id AS subject, (props->>'$.k')::INT % 10 AS object FROM events), f AS (SELECT subject, object, arg_max(act, seq) AS act FROM kb GROUP BY ALL)
        SELECT CASE act WHEN 'reject' THEN 'block' WHEN 'revoke' THEN 'clear' ELSE 'unknown' END AS answer, count(*) AS n FROM h LEFT JOIN f USING (subject, object) GROUP BY answer""",
    "q_tanimoto_pairs": """WITH e AS (SELECT vec_id AS id, label, list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] > 0 THEN i END), lambda x: x IS NOT NULL) AS bits FROM embeddings),
        p AS (SELECT x.id AS a, y.id AS b, len(list_intersect(x.bits, y.bits)) AS i, len(x.bits) + len(y.bits) AS s FROM e x JOIN e y ON x.label = y.label AND x.id < y.id)
        SELECT a, b, round(i / (s - i)::DOUBLE, 9) AS similarity FROM p WHERE i / nullif(s - i, 0)::DOUBLE >= 0.5""",
    "q_stream_kb": f"WITH {t.KB_SQL} SELECT subject, object, arg_max(act, seq) AS act, max(seq) AS seq FROM kb GROUP BY subject, object",
    "q_stream_prr": "SELECT user_id AS drug, (props->>'$.k')::INT % 20 AS event, count(*) AS a FROM events GROUP BY ALL",
    "q_match_bucket": """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT c_custkey, CASE WHEN coalesce(n, 0) <= 0 THEN 0 ELSE floor(log10(n)) + 1 END::INT AS bucket FROM customer LEFT JOIN n ON c_custkey = o_custkey""",
}
