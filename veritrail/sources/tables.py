"""Readers of the fixture tables and the adapter views that give them the evidence model's shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per judged record of a hypothesis (subject, object).

    rid identifies a record (line numbers repeat, so nothing in the table does); trials are the registry ids it cites.
    """
    line = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"
    ).withColumn("rid", F.monotonically_increasing_id())
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        "rid",
        F.col("l_partkey").alias("subject"),
        F.col("c_mktsegment").alias("object"),
        F.when(F.col("l_returnflag") == "R", "refute").when(F.col("l_returnflag") == "N", "support").otherwise("neutral").alias("direction"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "rct").when(F.col("o_orderpriority") == "2-HIGH", "meta").when(F.col("o_orderpriority") == "3-MEDIUM", "trial")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "observational").otherwise("review").alias("study_type"),
        F.when(F.col("l_quantity") >= 34, "large").when(F.col("l_quantity") < 17, "small").otherwise("unknown").alias("size"),
        (F.col("l_discount") >= 0.08).alias("decisive"),
        F.when(F.col("l_tax") >= 0.06, "high").when(F.col("l_tax") >= 0.03, "medium").otherwise("low").alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "peer_reviewed").otherwise("preprint").alias("review"),
        F.array(F.concat(F.lit("S"), (F.col("l_suppkey") % 40).cast("string")), F.concat(F.lit("O"), F.col("l_orderkey").cast("string"))).alias("trials"),
        F.year("l_shipdate").alias("year"),
        F.col("l_orderkey").alias("source_id"),
    )


EVIDENCE_SQL = """
evidence AS (
  SELECT l.rid, l_partkey AS subject, c_mktsegment AS object,
    CASE l_returnflag WHEN 'R' THEN 'refute' WHEN 'N' THEN 'support' ELSE 'neutral' END AS direction,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'rct' WHEN '2-HIGH' THEN 'meta' WHEN '3-MEDIUM' THEN 'trial' WHEN '4-NOT SPECIFIED' THEN 'observational' ELSE 'review' END AS study_type,
    CASE WHEN l_quantity >= 34 THEN 'large' WHEN l_quantity < 17 THEN 'small' ELSE 'unknown' END AS size,
    l_discount >= 0.08 AS decisive,
    CASE WHEN l_tax >= 0.06 THEN 'high' WHEN l_tax >= 0.03 THEN 'medium' ELSE 'low' END AS confidence,
    CASE l_linestatus WHEN 'F' THEN 'peer_reviewed' ELSE 'preprint' END AS review,
    ['S' || (l_suppkey % 40), 'O' || l_orderkey] AS trials, year(l_shipdate) AS year, l_orderkey AS source_id
  FROM (SELECT *, row_number() OVER () AS rid FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
)
"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y, two systems' scores in (0, 1), their confidences and verdicts; the scores come from ranks of document features."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"),
        F.col("quality").cast("int").alias("y"),
        (F.pmod(F.col("n_chars") * 37 + F.col("doc_id") * 11, F.lit(997)) / 997.0).alias("score_a"),
        ((F.least(F.col("n_chars"), F.lit(6000)) / 6000.0) * 0.8 + F.pmod(F.col("doc_id") * 7, F.lit(101)) / 505.0).alias("score_b"),
        "lang",
        "source",
        F.col("toxic").cast("int").alias("toxic"),
    )


SCORED_SQL = """
scored AS (
  SELECT l.doc_id AS id, quality::INT AS y, ((n_chars * 37 + l.doc_id * 11) % 997) / 997.0::DOUBLE AS score_a,
    (least(n_chars, 6000) / 6000.0::DOUBLE) * 0.8::DOUBLE + ((l.doc_id * 7) % 101) / 505.0::DOUBLE AS score_b, lang, source, toxic::INT AS toxic
  FROM labels l JOIN documents d USING (doc_id)
)
"""


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cg, gd, cd): distinct compound-gene, gene-disease and known compound-disease edges."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    nation = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    placed = line.join(nation, F.col("l_orderkey") == F.col("o_orderkey"))
    cg = line.select(F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("g")).distinct()
    gd = placed.filter("l_returnflag = 'N' and l_quantity > 48").select(F.col("l_suppkey").alias("g"), F.col("c_nationkey").alias("d")).distinct()
    cd = placed.filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("c"), F.col("c_nationkey").alias("d")).distinct()
    return cg, gd, cd


EDGES_SQL = """
placed AS (SELECT l.*, c_nationkey FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
cg AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS g FROM lineitem),
gd AS (SELECT DISTINCT l_suppkey AS g, c_nationkey AS d FROM placed WHERE l_returnflag = 'N' AND l_quantity > 48),
cd AS (SELECT DISTINCT l_partkey AS c, c_nationkey AS d FROM placed WHERE l_returnflag = 'R' AND l_quantity > 45)
"""


def event_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(drug, event) of every report."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("drug"), (event_k() % 20).alias("event"))


REPORTS_SQL = "reports AS (SELECT user_id AS drug, (props->>'$.k')::INT % 20 AS event FROM events)"


def kb_log(events: DataFrame) -> DataFrame:
    """(seq, act, subject, object) of the decision log: errors reject, sign-ups revoke."""
    return events.filter(F.col("event_type").isin("error", "signup")).select(
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "reject").otherwise("revoke").alias("act"), F.col("user_id").alias("subject"), (event_k() % 10).alias("object"), "ts"
    )


KB_SQL = """
kb AS (
  SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'reject' ELSE 'revoke' END AS act, user_id AS subject, (props->>'$.k')::INT % 10 AS object
  FROM events WHERE event_type IN ('error', 'signup')
)
"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patent, compound, field) of the compound map."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("patent"), F.col("l_partkey").alias("compound"), F.col("l_linenumber").alias("field"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(patent, entity, year) of the entity locations."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("patent"), F.col("c_nationkey").alias("entity"), F.year("o_orderdate").alias("year"))


CLAIMS_SQL = """
claims AS (SELECT l_orderkey AS patent, l_partkey AS compound, l_linenumber AS field FROM lineitem),
entities AS (SELECT o_orderkey AS patent, c_nationkey AS entity, year(o_orderdate) AS year FROM orders JOIN customer ON o_custkey = c_custkey)
"""
