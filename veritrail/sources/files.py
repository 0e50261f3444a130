"""File sources and sinks: delimited text, JSON, XML, fixed-width text, parquet, with completeness checks and status columns."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Layout of the coordinate records that hold residue scores.
ATOM, NAME, SCORE = ("ATOM", (1, 6)), ("CA", (13, 4)), (61, 6)


class Incomplete(ValueError):
    """A source lacks columns or rows."""


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A headed CSV as strings; a byte order mark before the first name is dropped. Malformed rows are kept in _corrupt_record."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return require(df, columns or []).select(*(columns or df.columns))


def write_csv(df: DataFrame, path: str, columns: list[str], force: bool = False) -> None:
    """The given columns with a header; refuses to overwrite unless forced."""
    df.select(*columns).write.mode("overwrite" if force else "errorifexists").option("header", True).csv(path)


def require(df: DataFrame, columns: list[str], min_rows: int = 0) -> DataFrame:
    """``df`` if it has the columns and at least so many rows; counting stops at the floor."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise Incomplete(f"missing columns {missing}; there are {df.columns}")
    if min_rows and df.limit(min_rows).count() < min_rows:
        raise Incomplete(f"fewer than {min_rows} rows")
    return df


def parquet_state(spark: SparkSession, path: str, columns: list[str], min_rows: int) -> dict:
    """status (ok, missing, unreadable, columns, rows), rows and columns of a parquet source; never raises for a bad source."""
    try:
        df = spark.read.parquet(path)
        names, rows = df.columns, df.count()  # from the footers
    except Exception as error:
        absent = "PATH_NOT_FOUND" in str(error)
        return {"status": "missing" if absent else "unreadable", "rows": None, "columns": None, "why": str(error).splitlines()[0]}
    if [c for c in columns if c not in names]:
        return {"status": "columns", "rows": rows, "columns": names, "why": "columns are missing"}
    return {"status": "ok" if rows >= min_rows else "rows", "rows": rows, "columns": names, "why": ""}


def semi_scan(spark: SparkSession, path: str, columns: list[str], key: str, keys: DataFrame, fold_key: bool = False) -> DataFrame:
    """The named columns of a parquet table where ``key`` (upper-cased if told) is among ``keys`` (first column). Pruned at the scan."""
    df = spark.read.parquet(path).select(*columns)
    probe = F.upper(F.col(key)) if fold_key else F.col(key)
    return df.join(keys.select(keys[keys.columns[0]].alias("_key")).distinct(), probe == F.col("_key"), "left_semi")


def sampled_groups(df: DataFrame, part: int, of: int, key: str) -> DataFrame:
    """A sample by a hash of ``key`` with a flag that says whether everything was scanned."""
    out = df if part >= of else df.filter(F.pmod(F.xxhash64(key), F.lit(of)) < part)
    return out.withColumn("scanned_all", F.lit(part >= of))


def read_triples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(edges, malformed) of a three-column graph file, plain or compressed. Node ids are Kind::id."""
    raw = spark.read.text(path).withColumn("f", F.split("value", "\t"))
    good = (F.size("f") == 3) & F.forall("f", lambda x: F.trim(x) != "")
    edges = raw.filter(good).select(F.col("f")[0].alias("head"), F.col("f")[1].alias("relation"), F.col("f")[2].alias("tail"))
    kind = lambda c: F.split(c, "::")[0]
    return edges.withColumn("head_kind", kind("head")).withColumn("tail_kind", kind("tail")), raw.filter(~good).select("value")


def typed_edges(edges: DataFrame, one: str, two: str) -> DataFrame:
    """Distinct undirected edges between two kinds, as (one, two)."""
    straight = edges.filter((F.col("head_kind") == one) & (F.col("tail_kind") == two)).select(F.col("head").alias("a"), F.col("tail").alias("b"))
    turned = edges.filter((F.col("head_kind") == two) & (F.col("tail_kind") == one)).select(F.col("tail").alias("a"), F.col("head").alias("b"))
    return straight.union(turned).distinct()


def read_delimited(spark: SparkSession, path: str, n_columns: int, min_rows: int = 1) -> tuple[DataFrame, dict]:
    """(fields as an array, state) of a headless tab-separated file: state tells missing, too narrow and too short apart."""
    try:
        raw = spark.read.text(path).withColumn("f", F.split("value", "\t"))
        n, narrow = raw.agg(F.count(F.lit(1)), F.count_if(F.size("f") < n_columns)).first()
    except Exception as error:
        return None, {"status": "missing", "why": str(error).splitlines()[0]}
    status = "columns" if narrow else "ok" if n >= min_rows else "rows"
    return raw.select("f"), {"status": status, "rows": n, "narrow": narrow}


def label_sizes(fields: DataFrame, key: int = 0, effect: int = 2) -> DataFrame:
    return fields.groupBy(F.col("f")[key].alias("key")).agg(F.count_distinct(F.col("f")[effect]).alias("n_effects"))


def label_counts(fields: DataFrame, term: str, key: int = 0) -> DataFrame:
    """How often each key's last field holds the term."""
    last = F.element_at("f", -1)
    return fields.filter(F.lower(last).contains(term.lower())).groupBy(F.col("f")[key].alias("key")).agg(F.count(F.lit(1)).alias("n"))


REGISTRY = (
    "studies array<struct<protocolSection: struct<identificationModule: struct<nctId: string, briefTitle: string>, statusModule: struct<overallStatus: string, whyStopped: string, completionDateStruct: struct<date: string>>,"
    "designModule: struct<phases: array<string>, designInfo: struct<allocation: string>, enrollmentInfo: struct<count: bigint>>, conditionsModule: struct<conditions: array<string>>,"
    "armsInterventionsModule: struct<interventions: array<struct<name: string, type: string>>>>, hasResults: boolean>>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per study of registry pages: nct, title, status, why, done, phases, allocation, enrollment, conditions, drugs, has_results.

    The schema is given, so absent parts are null and nothing is inferred; a study on several pages stays once.
    """
    s = spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.explode("studies").alias("s"))
    p = "s.protocolSection"
    return s.select(
        F.col(f"{p}.identificationModule.nctId").alias("nct"), F.col(f"{p}.identificationModule.briefTitle").alias("title"), F.col(f"{p}.statusModule.overallStatus").alias("status"),
        F.col(f"{p}.statusModule.whyStopped").alias("why"), F.col(f"{p}.statusModule.completionDateStruct.date").alias("done"), F.col(f"{p}.designModule.phases").alias("phases"),
        F.col(f"{p}.designModule.designInfo.allocation").alias("allocation"), F.col(f"{p}.designModule.enrollmentInfo.count").alias("enrollment"), F.col(f"{p}.conditionsModule.conditions").alias("conditions"),
        F.expr(f"transform(filter({p}.armsInterventionsModule.interventions, x -> x.type = 'DRUG'), x -> x.name)").alias("drugs"), F.col("s.hasResults").alias("has_results"),
    ).dropDuplicates(["nct"])


RESULTS = (
    "rows array<struct<drug: string, indication: string, label: string>>, results map<string, struct<scores: array<double>, verdicts: array<string>, leak: array<boolean>, conf: array<string>>>"
)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per (ordinal, configuration) of a result file of parallel arrays; arrays of other lengths than the rows raise."""
    raw = spark.read.schema(RESULTS).option("multiLine", True).json(path).select("rows", F.explode("results").alias("config", "r"))
    bad = raw.filter(F.size("r.scores") != F.size("rows")).select("config").limit(5).collect()
    if bad:
        raise Incomplete(f"scores and rows differ in length: {[b.config for b in bad]}")
    flat = raw.select("config", "r", F.posexplode("rows").alias("ord", "row"))
    at = lambda c: F.try_element_at(F.col(f"r.{c}"), F.col("ord") + 1)
    return flat.select("ord", "row.drug", "row.indication", "row.label", "config", at("scores").alias("score"), at("verdicts").alias("verdict"), at("leak").alias("leak"), at("conf").alias("conf"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; blank lines are ignored, broken ones kept in _corrupt_record."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def replace_partition(df: DataFrame, path: str, by: str) -> None:
    """Replaces the partitions that ``df`` holds and keeps the others: a merge by key without a table format."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merged(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win, keys that were not recomputed keep theirs."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """One row per article of an XML file: pmid, title, abstract (labelled parts as LABEL: text), types, year (null if unknown), journal, trials."""
    from ..functions import text as tx

    schema = (
        "MedlineCitation struct<PMID: string, Article: struct<ArticleTitle: string, Journal: struct<Title: string, JournalIssue: struct<PubDate: struct<Year: string, MedlineDate: string>>>,"
        "Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>, PublicationTypeList: struct<PublicationType: array<string>>>>"
    )
    raw = spark.read.format("xml").schema(schema).option("rowTag", "PubmedArticle").option("ignoreNamespace", True).load(path)
    a = "MedlineCitation.Article"
    part = F.transform(F.col(f"{a}.Abstract.AbstractText"), lambda x: F.concat(F.when(x["_Label"].isNotNull(), F.concat(x["_Label"], F.lit(": "))).otherwise(""), F.coalesce(x["_VALUE"], F.lit(""))))
    abstract = F.array_join(part, " ")
    date = F.coalesce(F.col(f"{a}.Journal.JournalIssue.PubDate.Year"), F.col(f"{a}.Journal.JournalIssue.PubDate.MedlineDate"))
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.coalesce(abstract, F.lit("")).alias("abstract"),
        F.col(f"{a}.PublicationTypeList.PublicationType").alias("types"), year_of(date).alias("year"), F.col(f"{a}.Journal.Title").alias("journal"), tx.trial_ids(abstract).alias("trials"),
    )


def year_of(c: Column) -> Column:
    """The year of a date, a YYYYMMDD number, a year or free text; null outside 1700..2100."""
    text = c.cast("string")
    year = F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.substring(text, 1, 4)), F.nullif(F.regexp_extract(text, r"(?<!\d)((?:17|18|19|20)\d{2})(?!\d)", 1), F.lit(""))).cast("int")
    return F.when(year.between(1700, 2100), year)


def residue_scores(spark: SparkSession, path: str) -> DataFrame:
    """(ord, score) of the main atoms of a fixed-width coordinate file."""
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    field = lambda at: F.trim(F.substring("value", *at))
    return raw.filter((field(ATOM[1]) == ATOM[0]) & (field(NAME[1]) == NAME[0])).select("ord", field(SCORE).try_cast("double").alias("score"))


def cross_reference_count(c: Column) -> Column:
    """Non-empty entries of a ;-separated list."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x) != ""))


def json_in_text(c: Column) -> Column:
    """The JSON of a reply with or without a code fence: its outermost array or object, as a variant; null if there is none."""
    inner = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), c)
    found = F.regexp_extract(inner, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.try_parse_json(F.nullif(found, F.lit("")))


def sections(c: Column, titles: str = r"limitation|discussion") -> Column:
    """Paragraphs of the sections of an XML full text whose titles match, as an array of struct(title, paragraphs)."""
    body = F.regexp_replace(F.coalesce(c, F.lit("")), r"<(/?)\w+:", "<$1")  # without namespaces
    secs = F.regexp_extract_all(body, F.lit(r"(?is)<sec\b[^>]*>(?:(?!<sec\b).)*?</sec>"), F.lit(0))
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]+>", " "), r"\s+", " "))
    read = F.transform(secs, lambda s: F.struct(
        clean(F.regexp_extract(s, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.filter(F.transform(F.regexp_extract_all(s, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1)), clean), lambda x: x != "").alias("paragraphs"),
    ))
    return F.filter(read, lambda s: s["title"].rlike("(?i)" + titles))


def ratio_claims(text: str) -> list[tuple[int, int, float, float]]:
    """(a, b, claimed percent, true percent) of claims like 66/70 = 94.3% that are off by more than their last digit."""
    out = []
    for a, b, p in re.findall(r"(\d+)\s*/\s*(\d+)\s*(?:=|\()\s*(\d+(?:\.\d+)?)\s*%", text):
        digits = len(p.partition(".")[2])
        if int(b) and abs(round(100 * int(a) / int(b), digits) - float(p)) > 0.5 * 10**-digits:
            out.append((int(a), int(b), float(p), 100 * int(a) / int(b)))
    return out


def probe_table(path: str) -> dict[str, int]:
    """The name-to-bucket probes of a split's definition file."""
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("rule_probe", {})
