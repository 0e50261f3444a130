"""Operators by value, and every query against its oracle on the smallest tables."""

from __future__ import annotations

import gzip
import json
import math
import os
import random
import threading
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from veritrail.functions import stats
from veritrail.functions import text as tx
from veritrail.operators import calibrate, evidence, gates, graph, kb, labels, metrics, signal
from veritrail.plans import catalogue
from veritrail.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_weights(spark):
    w = lambda *a: value(spark, evidence.weight(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), F.lit(a[3])))
    assert w("rct", "large", True, "high") == 3.0 and w("rct", "small", False, "high") == 1.2
    assert w("observational", "large", True, "high") == w("observational", "large", False, "high")
    assert value(spark, evidence.adjusted_weight(F.lit(2.0), F.lit(False), F.lit(False))) == 0.4


def records(spark, rows):
    names = "rid long, subject string, object string, direction string, study_type string, size string, decisive boolean, confidence string, review string, trials array<string>, year int, source_id long"
    full = [(i, "s", "o", d, st, "large", dec, "high", "peer_reviewed", tr, 2000, i) for i, (d, st, dec, tr) in enumerate(rows)]
    return evidence.weighted(spark.createDataFrame(full, names))


@pytest.mark.parametrize("rows, veto", [
    ([("refute", "rct", True, [])], False),
    ([("refute", "rct", True, [])] * 2, True),
    ([("refute", "rct", True, [])] * 2 + [("support", "rct", False, [])], False),
    ([("refute", "observational", True, [])] * 2, False),
])
def test_veto(spark, rows, veto):
    got = evidence.verdicts(evidence.summary(records(spark, rows))).first()
    assert (got.verdict == "reject" and got.p == 0) == veto


def test_dedupe_keeps_the_heaviest_of_a_trial_and_disjoint_trials(spark):
    df = records(spark, [("support", "rct", True, ["N1"]), ("support", "rct", False, ["N1", "N2"]), ("refute", "meta", False, ["N3"])])
    assert sorted(r.rid for r in evidence.dedupe_trials(df).collect()) == [0, 2]
    once = evidence.dedupe_trials(df)
    assert evidence.dedupe_trials(once).count() == once.count()


def test_attenuation_is_at_most_the_sum(spark):
    df = records(spark, [("support", "rct", True, []), ("support", "trial", False, []), ("support", "review", False, [])])
    r = evidence.attenuated(df).first()
    assert math.isclose(r.attenuated, 3.0 + 1.2 / 2 + 0.5 / 4) and r.attenuated <= r.total


def test_quotes(spark):
    doc = F.lit("The drug  reduced mortality in all patients of the study, and the effect lasted for years.")
    v = lambda q: value(spark, tx.verify_quote(F.lit(q), doc))
    assert v("the drug reduced MORTALITY in all patients").how == "exact"
    assert v("the drug cured everyone that was ever ill").how == "absent" and v("the drug").how == "short" and v("").how == "empty"
    part = v("the drug reduced mortality in all patients of the world and beyond")
    assert part.how == "partial" and part.confirmed == "the drug reduced mortality in all patients of the " and part.unconfirmed == "world and beyond"
    s = lambda q: value(spark, tx.verify_structured(F.lit(q), F.lit("Drug 11.5 | Placebo 13.2 months")))
    assert [s(q) for q in ("Drug 11.5 | Placebo", "Drug 11.5, Placebo 13.2", "placebo 13.2 versus 11.5 months", "drug 99.1 and 98.2 months", "tiny")] == ["exact", "punctuation", "restated", "absent", "short"]


def test_mentions(spark):
    n = lambda d, t: value(spark, tx.names_subject(F.lit(d), F.lit(t)))
    assert not n("pramipexole", "dexpramipexole in ALS") and n("pramipexole", "dexpramipexole and pramipexole")
    assert n("erlotinib hydrochloride", "erlotinib was given") and n("", "anything") and not n("aspirin", "")


def test_reasons(spark):
    r = lambda t: value(spark, tx.failure_reason(F.lit(t)))
    assert [r(t) for t in ("Lack of efficacy", "slow accrual", "hepatotoxicity seen", "no safety concerns; sponsor decision", "comparator drug failed to meet", "NA", None)] == [
        "efficacy", "operational", "safety", "operational", "unknown", "unknown", "unknown"]
    assert value(spark, tx.certainty(F.lit("may slightly reduce"))) == "low" and value(spark, tx.certainty(F.lit("x"))) is None
    assert value(spark, tx.product_name(F.lit("VIDEX (didanosine), 25 mg"))) == "didanosine"
    assert value(spark, tx.subject_key(F.lit("Metformin Hydrochloride 500mg (oral)"))) == "metformin" and value(spark, tx.query_terms(F.lit("A (b) - c, d"))) == "A"


def test_hash_split(spark):
    import hashlib

    for name in ("Aspirin", "  two  words "):
        folded = " ".join(name.lower().split())
        assert value(spark, tx.hash_bucket(F.lit(name))) == int(hashlib.sha256(folded.encode()).hexdigest()[:8], 16) % 1000


def test_exact_tests(spark):
    f = lambda *a: value(spark, stats.fisher(*[F.lit(x) for x in a]))
    assert math.isclose(f(3, 1, 1, 3), 0.4857142857, rel_tol=1e-8) and math.isclose(f(0, 0, 0, 0), 1.0)
    assert math.isclose(value(spark, stats.mcnemar(F.lit(2), F.lit(8))), 0.109375, rel_tol=1e-9)
    assert math.isclose(value(spark, stats.binomial_at_least(F.lit(3), F.lit(5), F.lit(0.5))), 0.5, rel_tol=1e-9)
    assert math.isclose(value(spark, stats.hypergeometric_at_least(F.lit(2), F.lit(10), F.lit(4), F.lit(3))), 1 / 3, rel_tol=1e-9)
    for x in (-2.5, -0.3, 0.0, 1.0, 3.5):
        assert math.isclose(value(spark, stats.erf(F.lit(x))), math.erf(x), abs_tol=1e-9)
    assert math.isclose(stats.normal_quantile(0.975), 1.959963985, abs_tol=1e-7)
    lo, hi = stats.wilson(F.lit(7), F.lit(10))
    assert value(spark, lo) <= 0.7 <= value(spark, hi) and value(spark, stats.wilson(F.lit(0), F.lit(0))[0]) is None
    z, bar = 1.959963985, 0.3
    se0, se1 = math.sqrt(bar * 0.7 * 0.04), math.sqrt(0.2 * 0.8 / 50 + 0.4 * 0.6 / 50)
    want = 0.5 * (1 + math.erf((0.2 - z * se0) / se1 / math.sqrt(2)))
    assert math.isclose(value(spark, stats.power_two(F.lit(0.2), F.lit(0.4), F.lit(50), F.lit(50))), want, abs_tol=1e-6)


def test_ranking_and_holm(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert metrics.auroc(df, "s", "y").first().auc == 0.75
    h = {r.id: r.adjusted for r in metrics.holm(spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "id int, p double"), "p", ["id"]).collect()}
    assert all(math.isclose(h[k], v) for k, v in {1: 0.03, 2: 0.06, 3: 0.06}.items())
    areas = metrics.curve_areas(metrics.risk_coverage(df, "s", "y", ["s"])).first()
    assert areas.optimal_aurc <= areas.aurc


def test_platt_keeps_the_order(spark):
    df = spark.createDataFrame([(i / 50, int(i > 20 and i % 7 != 0)) for i in range(50)], "s double, y int")
    a, b = calibrate.fit_platt(df, "s", "y")
    assert a < 0 and math.isfinite(b)


def test_greedy_match_uses_each_once(spark):
    left = spark.createDataFrame([(1, 5), (2, 50), (3, 7)], "id long, n long")
    right = spark.createDataFrame([(10, 6), (11, 80), (12, 900)], "id long, n long")
    got = {r.id: (r.other, r.shift) for r in calibrate.greedy_match(left, right).collect()}
    assert got[1] == (10, 0) and got[2] == (11, 0) and len({o for o, _ in got.values()}) == len(got) == 3


def test_prr_is_null_without_others(spark):
    got = {(r.drug, r.event): (r.prr, r.signal) for r in signal.disproportionality(spark.createDataFrame([(1, 1)] * 3 + [(2, 2)] + [(1, 2)], "drug int, event int")).collect()}
    assert got[1, 1] == (None, False) and got[2, 2][0] is not None


def test_shared_genes_tell_zero_from_absent(spark):
    cg = spark.createDataFrame([(1, 1)], "c int, g int")
    gd = spark.createDataFrame([(1, 1), (2, 2)], "g int, d int")
    got = {(r.c, r.d): (r.status, r.shared) for r in graph.shared_genes(spark.createDataFrame([(1, 1), (1, 2), (9, 1), (1, 9)], "c int, d int"), cg, gd).collect()}
    assert got == {(1, 1): ("ok", 1), (1, 2): ("ok", 0), (9, 1): ("compound not in graph", None), (1, 9): ("disease not in graph", None)}


def test_kb_and_gates(spark):
    log = spark.createDataFrame([(1, "reject", 1, 1), (2, "revoke", 1, 1), (3, "reject", 2, 1)], "seq long, act string, subject long, object int")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "subject long, object int")
    assert {r.subject: r.answer for r in kb.consulted(asked, log).collect()} == {1: "clear", 2: "block", 3: "unknown"}
    steps = [gates.Gate("a", lambda: F.when(F.col("subject") == 2, "KILL").otherwise("PASS")), gates.Gate("b", lambda: F.lit("DONE")), gates.Gate("c", lambda: F.lit("DONE"))]
    rows = gates.trail(gates.run(asked, steps, {"c": False}), ["subject"]).collect()
    assert {(r.subject, r.gate): r.outcome for r in rows if r.subject != 3} == {(1, "a"): "PASS", (1, "b"): "DONE", (1, "c"): "SKIP", (2, "a"): "KILL", (2, "b"): "SKIP", (2, "c"): "SKIP"}
    assert value(spark, gates.screen(F.lit("RICIN as a weapon"))) == "ricin" and value(spark, gates.screen(F.lit("ricin antidote"))) is None
    assert value(spark, gates.small_molecule(F.lit("rituximab"))) is False and value(spark, gates.small_molecule(F.lit(""))) is None


@pytest.mark.parametrize("width", [64, 300, 9000])  # one word, several words, sparse
@pytest.mark.parametrize("cut", [1024, 3])
def test_similar_fingerprints(spark, monkeypatch, width, cut):
    monkeypatch.setattr(kb, "CUT", cut)
    monkeypatch.setattr(kb, "AT_ONCE", 50)
    rng = random.Random(width)
    sets = {}
    for i in range(120):
        base = set(sets[i - 1][1]) if i % 3 else set(rng.sample(range(width), rng.randint(1, 40)))
        sets[i] = rng.choice("xy") if i % 20 else None, sorted((base ^ set(rng.sample(range(width), rng.randint(0, 12)))) if i % 10 else set())
    rows = [(7 * i, *v) for i, v in sets.items()] + [(-1, "x", None), (None, "x", [1])]
    for least in (0.5, 0.8):
        got = {(r.a, r.b): r.similarity for r in kb.similar(spark.createDataFrame(rows, "id long, group string, bits array<int>"), least).collect()}
        want = {}
        for i, (g, x) in sets.items():
            for j in range(i + 1, 120):
                h, y = sets[j]
                if g and g == h and x + y and len({*x} & {*y}) / len({*x, *y}) >= least:
                    want[7 * i, 7 * j] = len({*x} & {*y}) / len({*x, *y})
        assert got == want and len(want) > 5


def test_similar_fingerprints_of_dense_bits_meet_without_joins_of_pairs(spark):
    rng = random.Random(3)
    rows = [(i, 1, sorted(rng.sample(range(64), 32))) for i in range(3000)]
    got = kb.similar(spark.createDataFrame(rows, "id long, group int, bits array<int>"), 0.5)
    assert got.count() > 10_000
    seen = []

    def walk(plan):  # the most rows of any step
        for k, metric in [(m._1(), m._2()) for m in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.metrics().toSeq())]:
            if k == "numOutputRows":
                seen.append(metric.value())
        for child in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(plan.children()):
            walk(child)
        if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(plan.executedPlan())
        elif plan.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(plan.plan())

    plan = got._jdf.queryExecution()
    n = plan.executedPlan().executeCollect().__len__()
    walk(plan.executedPlan())
    assert max(seen) <= n + 3000 * 4


def test_usable(spark):
    u = lambda *a: value(spark, labels.usable(*[F.lit(x) for x in a]))
    assert u(True, "Phase 3", 100, 12) is None and u(None, "Phase 3", 100, 12) == "not randomised" and u(True, "Phase 1", 100, 12) == "phase 1" and u(True, "Phase 2", 10, 12) == "too small"
    assert value(spark, labels.months_between(F.lit("2024-03"), F.lit("2022-12"))) == 15


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_bytes("﻿drug,n\naspirin,1\n".encode())
    assert files.read_csv(spark, str(p), ["drug"]).first().drug == "aspirin"
    with pytest.raises(files.Incomplete):
        files.read_csv(spark, str(p), ["missing"])
    out = str(tmp_path / "out")
    files.write_csv(files.read_csv(spark, str(p)), out, ["drug"])
    with pytest.raises(Exception, match="already exists"):
        files.write_csv(files.read_csv(spark, str(p)), out, ["drug"])
    with gzip.open(tmp_path / "g.tsv.gz", "wt") as f:
        f.write("Gene::1\tr\tDisease::2\nbroken\nDisease::2\tr\tGene::1\n")
    good, bad = files.read_triples(spark, str(tmp_path / "g.tsv.gz"))
    assert files.typed_edges(good, "Gene", "Disease").count() == 1 and bad.count() == 1
    assert files.parquet_state(spark, str(tmp_path / "none"), [], 1)["status"] == "missing"
    assert files.parquet_state(spark, f"{SF}/region.parquet", ["r_name"], 5)["status"] == "ok" and files.parquet_state(spark, f"{SF}/region.parquet", ["x"], 5)["status"] == "columns"
    (tmp_path / "r.json").write_text(json.dumps({"rows": [{"drug": "a", "indication": "b", "label": "TP"}], "results": {"B0": {"scores": [0.5], "verdicts": ["hold"]}}}))
    assert files.read_results(spark, str(tmp_path / "r.json")).first().verdict == "hold"
    (tmp_path / "bad.json").write_text(json.dumps({"rows": [], "results": {"B0": {"scores": [0.5], "verdicts": []}}}))
    with pytest.raises(files.Incomplete):
        files.read_results(spark, str(tmp_path / "bad.json"))
    study = {"protocolSection": {"identificationModule": {"nctId": "NCT1"}, "armsInterventionsModule": {"interventions": [{"name": "x", "type": "DRUG"}, {"name": "y", "type": "DEVICE"}]}}}
    (tmp_path / "s.json").write_text(json.dumps({"studies": [study, study]}))
    assert [(r.nct, r.drugs, r.why) for r in files.read_registry(spark, str(tmp_path / "s.json")).collect()] == [("NCT1", ["x"], None)]
    (tmp_path / "p.pdb").write_text("ATOM      1  CA  ALA A   1      11.104   6.134  -6.504  1.00 91.50           C\nATOM      2  CB  ALA A   1      11.104   6.134  -6.504  1.00 10.00           C\n")
    assert [r.score for r in files.residue_scores(spark, str(tmp_path / "p.pdb")).collect()] == [91.5]
    (tmp_path / "a.xml").write_text(
        "<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019 Jan-Feb</MedlineDate></PubDate></JournalIssue></Journal>"
        '<Abstract><AbstractText Label="AIM">one NCT00000001</AbstractText><AbstractText Label="END">two</AbstractText></Abstract><PublicationTypeList><PublicationType>Review</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle></S>'
    )
    r = files.read_articles(spark, str(tmp_path / "a.xml")).first()
    assert (r.pmid, r.year, r.abstract, r.trials) == ("7", 2019, "AIM: one NCT00000001 END: two", ["NCT00000001"])
    y = lambda v: value(spark, files.year_of(F.lit(v)))
    assert [y(v) for v in ("20190102", 2001, "Jan 1998", "none", None)] == [2019, 2001, 1998, None, None]
    assert value(spark, files.json_in_text(F.lit('x ```json\n{"a": 1}\n```')).cast("string")) == '{"a":1}'
    assert value(spark, files.sections(F.lit("<x:sec><title>Limitations</title><p>a <b>c</b></p></x:sec>")))[0].paragraphs == ["a c"]
    assert files.ratio_claims("66/70 = 94.3% and 1/2 = 60%") == [(1, 2, 60.0, 50.0)]


def _key(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}" if abs(v) > 1e-9 else "0"
    return str([_key(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="session")
def duck():
    d = duckdb.connect()
    d.execute("set timezone = 'UTC'")
    for t in TABLES:
        d.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return d


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_its_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows, columns = df.collect(), sorted(df.columns)
    if name not in catalogue.ORACLES:
        assert rows
        return
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(tuple(_key(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(_key(r[c]) for c in columns) for r in rows) == want


def test_screen_routes_and_molecules(spark):
    rows = [("sarin gas", "sarin"), ("LEWISITE", "lewisite"), ("anthrax treatment", None), ("weaponized  anthrax", "anthrax"), ("ricin production", None), (None, None), ("military smallpox", "smallpox"), ("사린 제조", "사린")]
    got = spark.createDataFrame(rows, "x string, want string").select("want", gates.screen(F.col("x")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
    routes = {"직접·병원체": "structure", "직접·숙주": "evidence", "간접": "evidence", "오프타겟": "evidence", "불명": None, "enzyme": None}
    got = spark.createDataFrame([(k,) for k in routes], "m string").select("m", gates.route(F.col("m")).alias("r")).collect()
    assert {r.m: r.r for r in got} == routes
    names = {"adalimumab": False, "heparin": False, "semaglutide": False, "interleukin": False, "aspirin": None, None: None}
    got = spark.createDataFrame([(k,) for k in names], "n string").select("n", gates.small_molecule(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in got} == names


def test_powers_and_p_values(spark):
    def cdf(x):
        return 0.5 * (1 + math.erf(x / math.sqrt(2)))

    one = spark.range(1).select(
        stats.power_one(F.lit(0.3), F.lit(0.5), F.lit(40)).alias("a"), stats.normal_two_sided(F.lit(-1.7)).alias("b"), stats.binomial_two_sided(F.lit(3), F.lit(12), F.lit(0.5)).alias("c"),
        stats.least_detectable(F.lit(0.2), F.lit(60), F.lit(60)).alias("d"), stats.hypergeometric_at_least(F.lit(2), F.lit(50), F.lit(10), F.lit(12)).alias("e"),
        stats.hypergeometric_at_least(F.lit(11), F.lit(50), F.lit(10), F.lit(12)).alias("f"), stats.power_one(F.lit(0.3), F.lit(0.5), F.lit(0)).alias("g"),
    ).first()
    se0, se1 = math.sqrt(0.21 / 40), math.sqrt(0.25 / 40)
    assert abs(one.a - cdf((0.2 - 1.959964 * se0) / se1)) < 1e-6 and one.g == 0
    assert abs(one.b - math.erfc(1.7 / math.sqrt(2))) < 1e-9
    assert abs(one.c - 2 * sum(math.comb(12, i) for i in range(4)) / 2**12) < 1e-9
    power = lambda p: cdf((abs(0.2 - p) - 1.959964 * math.sqrt((0.2 + p) / 2 * (1 - (0.2 + p) / 2) / 30)) / math.sqrt((0.16 + p * (1 - p)) / 60))
    assert abs(one.d - next(0.2 + i * 0.005 for i in range(1, 161) if power(0.2 + i * 0.005) >= 0.8)) < 1e-9
    assert abs(one.e - sum(math.comb(10, i) * math.comb(40, 12 - i) for i in range(2, 11)) / math.comb(50, 12)) < 1e-9 and one.f == 0


def test_fisher_of_a_large_table_takes_work_in_proportion(spark):
    def choose(n, k):
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    a, b, c, d = 20_000, 30_000, 40_600, 60_000
    r1, c1, n = a + b, a + c, a + b + c + d
    ln = [choose(r1, x) + choose(n - r1, c1 - x) - choose(n, c1) for x in range(r1 + 1)]
    exact = sum(math.exp(p) for p in ln if p <= ln[a] + 1e-9)
    started = time.time()
    job = spark.range(1).select(stats.fisher(*[F.lit(x) + F.col("id") * 0 for x in (a, b, c, d)])).coalesce(1)
    timer = threading.Timer(60, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = job.first()[0]
    finally:
        timer.cancel()
    assert abs(got - exact) < 1e-6 and time.time() - started < 60
