"""Queries over texts: quotes, mentions, results, certainty, reasons, tokens, splits, page sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources import tables as t


def _docs(spark, d, *columns):
    return t.table(spark, d, "documents").select("doc_id", "text", *columns)


def _quotes(spark, d):
    """Every benchmark passage as a quote, and as one whose second half is made up."""
    b = t.table(spark, d, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    return b.select("item_id", F.lit("whole").alias("kind"), F.col("text").alias("quote")).unionByName(
        b.select("item_id", F.lit("altered").alias("kind"), F.concat(F.left("text", half), F.lit(" and then something else entirely was said")).alias("quote"))
    )


def _candidates(spark, d):
    """(item, document) pairs that share the folded first 40 characters: an equi join on every 40-character start after a space would
    be the whole corpus, so the first words of the quotes are looked up in the documents' word starts."""
    q = _quotes(spark, d).withColumn("head", F.regexp_extract(tx.fold(F.col("quote")), r"^(\S+ \S+ \S+ \S+)", 1)).filter("head <> ''")
    docs = _docs(spark, d).withColumn("words", F.split(tx.fold(F.col("text")), " "))
    heads = docs.select("doc_id", F.explode(F.expr("array_distinct(transform(sequence(0, greatest(size(words) - 4, 0)), i -> array_join(slice(words, i + 1, 4), ' ')))")).alias("head"))
    pairs = heads.join(q, "head").select("item_id", "kind", "quote", "doc_id").distinct()
    return pairs.join(_docs(spark, d), "doc_id")


def q_quote_verify(spark, d):
    v = _candidates(spark, d).select("item_id", "kind", "doc_id", tx.verify_quote(F.col("quote"), F.col("text")).alias("v"))
    return v.select("item_id", "kind", "doc_id", "v.ok", "v.how", F.length("v.confirmed").alias("confirmed"), F.length("v.unconfirmed").alias("unconfirmed"))


def q_quote_prefix(spark, d):
    """Only the altered quotes: how far each is confirmed."""
    v = _candidates(spark, d).filter("kind = 'altered'").select("item_id", "doc_id", tx.verify_quote(F.col("quote"), F.col("text")).alias("v"))
    return v.filter("v.how = 'partial'").select("item_id", "doc_id", F.col("v.confirmed").alias("confirmed"))


def q_cross_contamination(spark, d):
    """Quotes of which more than one document of a source holds the whole: the sibling documents that could be confused."""
    v = _candidates(spark, d).filter("kind = 'whole'").filter(F.length(tx.fold(F.col("quote"))) >= tx.MIN_QUOTE).filter(tx.fold(F.col("text")).contains(tx.fold(F.col("quote"))))
    return v.groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc")).withColumn("contaminated", F.col("n_docs") > 1)


def q_mention_guard(spark, d):
    """Mentions of part name words behind and not behind a prefix that makes another word."""
    names = t.table(spark, d, "part").select(F.split("p_name", " ")[0].alias("needle")).distinct()
    made = names.select("needle", F.explode(F.array(F.col("needle"), F.concat(F.lit("dex"), "needle"), F.concat(F.lit("the levo"), "needle", F.lit(" and "), "needle"), F.concat(F.lit("es"), "needle"))).alias("hay"))
    return made.select("needle", "hay", tx.occurs(tx.alnum(F.col("needle")), tx.alnum(F.col("hay"))).alias("named"))


_STATEMENTS = """
SELECT doc_id, concat(regexp_replace(text, '[^ -~]', 'x', 'g'), CASE doc_id % 12
  WHEN 0 THEN ' treatment reduced mortality, hazard ratio 0.71' WHEN 1 THEN ' outcomes were measured using a scale'
  WHEN 2 THEN ' it may slightly reduce symptoms' WHEN 3 THEN ' probably improves survival' WHEN 4 THEN ' little or no difference was seen'
  WHEN 5 THEN ' terminated due to lack of efficacy' WHEN 6 THEN ' slow accrual and funding' WHEN 7 THEN ' stopped for hepatotoxicity'
  WHEN 8 THEN ' closed, no safety concerns' WHEN 9 THEN ' the comparator arm failed to show benefit' WHEN 10 THEN ' overall survival was defined from entry'
  ELSE ' nothing of note' END) AS statement FROM documents
"""


def _statements(spark, d):
    c = F.col("doc_id") % 12
    tails = [
        " treatment reduced mortality, hazard ratio 0.71", " outcomes were measured using a scale", " it may slightly reduce symptoms", " probably improves survival",
        " little or no difference was seen", " terminated due to lack of efficacy", " slow accrual and funding", " stopped for hepatotoxicity", " closed, no safety concerns",
        " the comparator arm failed to show benefit", " overall survival was defined from entry", " nothing of note",
    ]
    tail = F.element_at(F.array(*[F.lit(x) for x in tails]), (c + 1).cast("int"))
    return _docs(spark, d).select("doc_id", F.concat(F.regexp_replace("text", "[^ -~]", "x"), tail).alias("statement"))


def q_result_statement(spark, d):
    return _statements(spark, d).select("doc_id", tx.has_result(F.col("statement")).alias("prose"), tx.has_result(F.col("statement"), True).alias("structured"))


def q_grade(spark, d):
    return _statements(spark, d).select("doc_id", tx.certainty(F.col("statement")).alias("certainty"))


def q_reason_class(spark, d):
    return _statements(spark, d).groupBy(tx.failure_reason(F.col("statement")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def q_failure_mode(spark, d):
    return _statements(spark, d).groupBy(tx.failure_mode(F.col("statement"), F.col("statement")).alias("mode")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def q_stop_reason(spark, d):
    status = F.when(F.col("doc_id") % 3 == 0, "TERMINATED").when(F.col("doc_id") % 3 == 1, "Withdrawn by sponsor").otherwise("COMPLETED")
    return _statements(spark, d).select("doc_id", tx.stop_reason(status, F.col("statement")).alias("stop_reason"))


def q_structured_verify(spark, d):
    """A registry line against its own statement, restated, altered and made up."""
    s = _statements(spark, d)
    made = s.select("doc_id", F.col("statement").alias("document"), F.explode(F.array(
        F.struct(F.lit("same").alias("kind"), F.right("statement", F.lit(30)).alias("quote")),
        F.struct(F.lit("punctuation").alias("kind"), F.regexp_replace(F.right("statement", F.lit(30)), " ", ", ").alias("quote")),
        F.struct(F.lit("made up").alias("kind"), F.lit("response was 12.5 versus 99.25 percent").alias("quote")),
        F.struct(F.lit("tiny").alias("kind"), F.lit("nothing").alias("quote")),
    )).alias("q"))
    return made.select("doc_id", "q.kind", tx.verify_structured(F.col("q.quote"), F.col("document")).alias("how"))


def q_trial_ids(spark, d):
    c = t.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("see NCT"), F.lpad((F.col("turn") * 7919 % 100000000).cast("string"), 8, "0"), F.lit(" and NCT0000000"), F.lit(" NCT12345678 "), "text").alias("text"))
    return c.select("conv_id", "turn", F.array_join(tx.trial_ids(F.col("text")), ";").alias("ids"))


def q_indication_tokens(spark, d):
    p = t.table(spark, d, "part").select(F.concat_ws(" ", "p_name", F.lit("Chronic, Disease of"), "p_type").alias("name")).distinct()
    return p.select("name", F.array_join(tx.indication_tokens(F.col("name")), " ").alias("tokens"), tx.alnum(F.col("name")).alias("alnum"))


def _names(spark, d):
    p = t.table(spark, d, "part").select("p_name", "p_type")
    named = p.select(F.col("p_name").alias("name")).union(p.select(F.concat_ws(" ", "p_name", "p_type"))).distinct()
    return named.select("name", tx.indication_tokens(F.col("name")).alias("tokens"))


def q_tokens_subset_join(spark, d):
    """Pairs of names of which one's content words all stand in the other: an inverted index on the rarest word of the smaller set, then a check."""
    n = _names(spark, d).filter(F.size("tokens") > 0)
    freq = n.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    probe = n.select("name", F.explode("tokens").alias("token")).join(freq, "token").groupBy("name").agg(F.min_by("token", F.struct("f", "token")).alias("token"))
    small = n.join(probe, "name").select(F.col("name").alias("a"), F.col("tokens").alias("x"), "token")
    large = n.select(F.col("name").alias("b"), F.col("tokens").alias("y"), F.explode("tokens").alias("token"))
    met = small.join(large, "token").filter("a <> b").filter(F.size(F.array_except("x", "y")) == 0)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def q_rare_token_join(spark, d):
    """Per pair of name groups that only share words: whether a shared word is rare (at most 4000 names)."""
    n = _names(spark, d).filter(F.size("tokens") > 0)
    index = n.select("name", F.explode("tokens").alias("token"))
    freq = index.groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    rare = index.join(freq.filter("f <= 4000"), "token")
    one, two = rare.select(F.col("name").alias("a"), "token"), rare.select(F.col("name").alias("b"), "token")
    shared = one.join(two, "token").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_rare"))
    sets = n.select("name", "tokens")
    met = shared.join(sets.select(F.col("name").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("tokens").alias("y")), "b")
    same = (F.size(F.array_except("x", "y")) == 0) | (F.size(F.array_except("y", "x")) == 0)
    return met.select("a", "b", "n_rare", F.when(same, "same").otherwise("check").alias("relation"))


def q_hash_split(spark, d):
    p = t.table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return p.select("p_partkey", tx.hash_bucket(F.col("name")).alias("bucket"), (tx.hash_bucket(F.col("name")) < 300).alias("development"))


def q_html_sections(spark, d):
    """Headings, paragraphs and list items of each page's body, without scripts, styles and navigation."""
    body = F.regexp_replace(F.col("html"), r"(?is)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>", " ")
    paras = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))), lambda x: x != "")
    title = F.trim(F.regexp_replace(F.regexp_extract(body, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"\s+", " "))
    items = F.size(F.regexp_extract_all(body, F.lit(r"(?is)<li[^>]*>"), F.lit(0)))
    return t.table(spark, d, "pages").select("page_id", title.alias("title"), F.size(paras).alias("n_paragraphs"), F.array_join(paras, "\n").alias("text"), items.alias("n_items"))


def q_limit_cues(spark, d):
    """Paragraphs with a cue word, joined and cut at 4000 characters, and whether they were cut."""
    paras = F.split("text", "\n")
    cue = F.filter(paras, lambda x: tx.matches(x, "(^| )(the|das|le|el) "))
    joined = F.array_join(cue, "\n")
    return _docs(spark, d).select("doc_id", F.size(cue).alias("n_paragraphs"), F.md5(F.left(joined, F.lit(4000))).alias("digest"), (F.length(joined) > 4000).alias("truncated"))


def q_study_types(spark, d):
    """Design by the most decisive publication type, and whether a record is comparative."""
    o = t.table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("Review"), F.lit("Randomized Controlled Trial"), F.lit("PHASE3")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.array(F.lit("Clinical Trial"), F.lit("RANDOMIZED"), F.lit("PHASE1"))).when(F.col("o_orderpriority") == "3-MEDIUM", F.array(F.lit("Observational Study"))).otherwise(F.array(F.lit("Letter"))).alias("types"))
    kind = tx.study_type(F.col("types"))
    return o.groupBy(kind.alias("study_type"), tx.comparative(kind, F.col("types")).alias("comparative")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    q_quote_verify, q_quote_prefix, q_cross_contamination, q_mention_guard, q_result_statement, q_grade, q_reason_class, q_failure_mode, q_stop_reason, q_structured_verify,
    q_trial_ids, q_indication_tokens, q_tokens_subset_join, q_rare_token_join, q_hash_split, q_html_sections, q_limit_cues, q_study_types,
)}


def _q(pattern: str) -> str:
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


_FOLD = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"
_ALNUM = "regexp_replace(lower({0}), '[^a-z0-9]+', '', 'g')"
_QUOTES = f"""
quotes AS (
  SELECT item_id, 'whole' AS kind, text AS quote FROM benchmark
  UNION ALL SELECT item_id, 'altered', left(text, (length(text) // 2)::INT) || ' and then something else entirely was said' FROM benchmark
),
folded AS (SELECT item_id, kind, quote, {_FOLD.format('quote')} AS q FROM quotes),
heads AS (SELECT *, regexp_extract(q, '^(\\S+ \\S+ \\S+ \\S+)', 1) AS head FROM folded),
fdocs AS (SELECT doc_id, {_FOLD.format('text')} AS d FROM documents),
cand AS (SELECT * FROM heads JOIN fdocs ON head <> '' AND contains(' ' || d || ' ', ' ' || head || ' ')),
v AS (
  SELECT *, greatest({tx.MIN_QUOTE}, length(q) // 2)::INT AS half,
    CASE WHEN q = '' THEN 'empty' WHEN length(q) < {tx.MIN_QUOTE} THEN 'short' WHEN contains(d, q) THEN 'exact'
      WHEN contains(d, left(q, greatest({tx.MIN_QUOTE}, length(q) // 2)::INT)) THEN 'partial' ELSE 'absent' END AS how FROM cand
),
w AS (SELECT *, CASE how WHEN 'exact' THEN q WHEN 'partial' THEN left(q, list_max(list_transform(range(half, length(q) + 1), lambda i: CASE WHEN contains(d, left(q, i::INT)) THEN i ELSE 0 END))::INT) ELSE '' END AS confirmed FROM v)
"""
_S = f"s AS ({_STATEMENTS})"
_REASON = f"""
r AS (SELECT doc_id, trim(statement) AS x FROM s),
r2 AS (SELECT *, {_m('x', tx.NEGATED)} AS neg, CASE WHEN {_m('x', tx.NEGATED)} THEN regexp_replace(x, {_q(tx.NEGATED)}, ' ', 'g') ELSE x END AS rest FROM r),
r3 AS (
  SELECT doc_id, CASE WHEN x = '' OR upper(x) = 'NA' OR {_m('x', tx.COMPARATOR)} THEN 'unknown'
    WHEN neg AND NOT {_m('rest', tx.EFFICACY)} AND NOT {_m('rest', tx.SAFETY)} THEN CASE WHEN {_m('x', tx.OPERATIONAL)} THEN 'operational' ELSE 'unknown' END
    WHEN {_m('rest', tx.EFFICACY)} THEN 'efficacy' WHEN {_m('rest', tx.OPERATIONAL)} THEN 'operational' WHEN {_m('rest', tx.SAFETY)} THEN 'safety' ELSE 'unknown' END AS reason FROM r2
)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "]"
_TOKENS = f"list_sort(list_distinct(list_filter(regexp_extract_all({_FOLD}, '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))))"
_NAMES = f"""
named AS (SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_name || ' ' || p_type FROM part)),
names AS (SELECT name, {_TOKENS.format('name')} AS tokens FROM named)
"""
_NUMS = "list_transform(regexp_extract_all({0}, '-?\\d+(?:\\.\\d+)?'), lambda z: regexp_replace(z, '^-+', ''))"
_BODY = "regexp_replace(html, '(?is)<(script|style|nav|footer|head)[^>]*>.*?</(script|style|nav|footer|head)>', ' ', 'g')"

ORACLES = {
    "q_quote_verify": f"WITH {_QUOTES} SELECT item_id, kind, doc_id, how IN ('exact', 'partial') AS ok, how, length(confirmed)::INT AS confirmed, CASE how WHEN 'partial' THEN length(q) - length(confirmed) ELSE 0 END::INT AS unconfirmed FROM w",
    "q_quote_prefix": f"WITH {_QUOTES} SELECT item_id, doc_id, confirmed FROM w WHERE kind = 'altered' AND how = 'partial'",
    "q_cross_contamination": f"WITH {_QUOTES} SELECT item_id, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, count(DISTINCT doc_id) > 1 AS contaminated FROM w WHERE kind = 'whole' AND how = 'exact' GROUP BY item_id",
    "q_mention_guard": f"""WITH n AS (SELECT DISTINCT string_split(p_name, ' ')[1] AS needle FROM part),
        h AS (SELECT needle, unnest([needle, 'dex' || needle, 'the levo' || needle || ' and ' || needle, 'es' || needle]) AS hay FROM n)
        SELECT needle, hay, contains(regexp_replace({_ALNUM.format('hay')}, '(dex|levo|lev|es|ar|dl|rac)' || {_ALNUM.format('needle')}, '#', 'g'), {_ALNUM.format('needle')}) AS named FROM h""",
    "q_result_statement": f"""WITH {_S} SELECT doc_id, {_m('statement', tx.RESULT)} AND NOT ({_m('statement', tx.DESIGN)} AND NOT {_m('statement', tx.NUMBER)}) AS prose,
        (len(regexp_extract_all(statement, '{tx.NUMBER}')) >= 2) OR ({_m('statement', tx.RESULT)} AND NOT ({_m('statement', tx.DESIGN)} AND NOT {_m('statement', tx.NUMBER)})) AS structured FROM s""",
    "q_grade": f"WITH {_S} SELECT doc_id, CASE WHEN {_m('statement', tx.GRADE_HIGH)} THEN 'high' WHEN {_m('statement', tx.GRADE_LOW)} THEN 'low' WHEN {_m('statement', tx.GRADE_MODERATE)} THEN 'moderate' END AS certainty FROM s",
    "q_reason_class": f"WITH {_S}, {_REASON} SELECT reason, count(*) AS n, min(doc_id) AS first_doc FROM r3 GROUP BY reason",
    "q_failure_mode": f"""WITH {_S}, m AS (SELECT doc_id, CASE WHEN {_m('statement', tx.MODE_ADMIN)} THEN 'administrative' WHEN {_m('statement', tx.MODE_TOXIC)} AND NOT {_m('statement', tx.MODE_EFFICACY)} THEN 'safety'
        WHEN {_m('statement', tx.MODE_OTHER)} THEN 'other studies' WHEN {_m("statement || ' ' || statement", tx.MODE_EFFICACY)} THEN 'efficacy' ELSE 'undecidable' END AS mode FROM s)
        SELECT mode, count(*) AS n, min(doc_id) AS first_doc FROM m GROUP BY mode""",
    "q_stop_reason": f"""WITH {_S} SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN NULL WHEN trim(statement) = '' THEN 'unknown' WHEN {_m('statement', tx.STOP_EFFICACY)} THEN 'efficacy'
        WHEN {_m('statement', tx.OPERATIONAL)} THEN 'operational' ELSE 'unknown' END AS stop_reason FROM s""",
    "q_structured_verify": f"""WITH {_S}, m AS (SELECT doc_id, statement AS document, unnest([{{'kind': 'same', 'quote': right(statement, 30)}}, {{'kind': 'punctuation', 'quote': regexp_replace(right(statement, 30), ' ', ', ', 'g')}},
        {{'kind': 'made up', 'quote': 'response was 12.5 versus 99.25 percent'}}, {{'kind': 'tiny', 'quote': 'nothing'}}]) AS q FROM s),
        f AS (SELECT doc_id, q.kind AS kind, {_FOLD.format('q.quote')} AS q, {_FOLD.format('document')} AS d, {_NUMS.format('q.quote')} AS mine, {_NUMS.format('document')} AS theirs FROM m),
        g AS (SELECT *, regexp_extract_all(q, '[a-z]{{4,}}') AS ws FROM f)
        SELECT doc_id, kind, CASE WHEN q = '' THEN 'empty' WHEN length(q) < {tx.MIN_STRUCTURED} THEN 'short' WHEN contains(d, q) THEN 'exact'
          WHEN {_ALNUM.format('q')} <> '' AND contains({_ALNUM.format('d')}, {_ALNUM.format('q')}) THEN 'punctuation'
          WHEN len(mine) >= 2 AND len(list_filter(mine, lambda z: NOT list_contains(theirs, z))) = 0 AND coalesce(len(list_filter(ws, lambda z: contains(d, z))) / nullif(len(ws), 0)::DOUBLE, 1) >= 0.6 THEN 'restated' ELSE 'absent' END AS how FROM g""",
    "q_trial_ids": """WITH c AS (SELECT conv_id, turn, 'see NCT' || lpad((turn * 7919 % 100000000)::VARCHAR, 8, '0') || ' and NCT0000000' || ' NCT12345678 ' || text AS x FROM conversations)
        SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(x, '\\b(NCT\\d{8})\\b', 1))), ';') AS ids FROM c""",
    "q_indication_tokens": f"""WITH n AS (SELECT DISTINCT p_name || ' Chronic, Disease of ' || p_type AS name FROM part)
        SELECT name, array_to_string({_TOKENS.format('name')}, ' ') AS tokens, {_ALNUM.format('name')} AS alnum FROM n""",
    "q_tokens_subset_join": f"""WITH {_NAMES} SELECT DISTINCT least(x.name, y.name) AS a, greatest(x.name, y.name) AS b FROM names x JOIN names y ON x.name <> y.name AND len(x.tokens) > 0
        AND list_has_all(y.tokens, x.tokens)""",
    "q_rare_token_join": f"""WITH {_NAMES}, ix AS (SELECT name, unnest(tokens) AS token FROM names), rare AS (SELECT token FROM ix GROUP BY token HAVING count(*) <= 4000),
        p AS (SELECT x.name AS a, y.name AS b, count(*) AS n_rare FROM ix x JOIN rare USING (token) JOIN ix y USING (token) WHERE x.name < y.name GROUP BY ALL)
        SELECT a, b, n_rare, CASE WHEN list_has_all(y.tokens, x.tokens) OR list_has_all(x.tokens, y.tokens) THEN 'same' ELSE 'check' END AS relation FROM p JOIN names x ON x.name = a JOIN names y ON y.name = b""",
    "q_hash_split": f"""WITH p AS (SELECT p_partkey, ('0x' || left(sha256({_FOLD.format("p_name || ' ' || p_partkey")}), 8))::BIGINT % 1000 AS bucket FROM part) SELECT p_partkey, bucket, bucket < 300 AS development FROM p""",
    "q_html_sections": f"""WITH b AS (SELECT page_id, {_BODY} AS body FROM pages),
        p AS (SELECT *, list_filter(list_transform(regexp_extract_all(body, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda x: x <> '') AS paras FROM b)
        SELECT page_id, trim(regexp_replace(regexp_extract(body, '(?is)<h1[^>]*>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS title, len(paras)::INT AS n_paragraphs, array_to_string(paras, chr(10)) AS text,
          len(regexp_extract_all(body, '(?is)<li[^>]*>'))::INT AS n_items FROM p""",
    "q_limit_cues": """WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)(^| )(the|das|le|el) ')) AS cue FROM documents), j AS (SELECT *, array_to_string(cue, chr(10)) AS joined FROM c)
        SELECT doc_id, len(cue)::INT AS n_paragraphs, md5(left(joined, 4000)) AS digest, length(joined) > 4000 AS truncated FROM j""",
    "q_study_types": """SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'rct' WHEN '2-HIGH' THEN 'trial' WHEN '3-MEDIUM' THEN 'observational' END AS study_type, o_orderpriority = '1-URGENT' AS comparative, count(*) AS n FROM orders GROUP BY ALL""",
}
