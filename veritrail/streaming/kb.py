"""Structured Streaming forms of the knowledge base fold and of the report counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables as t


def _run(spark: SparkSession, streamed: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a bounded stream to its end and returns the table that it keeps: each batch rewrites the whole result.

    Checkpoint and table go to the shared folder of the session, or to a temporary one where none is set (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    folder = f"{base.rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/table")

    query = streamed.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{folder}/table")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def fold(log: DataFrame) -> DataFrame:
    """The last act of every key. The state of a key never expires: a revocation may come at any time."""
    return log.groupBy("subject", "object").agg(F.max_by("act", "seq").alias("act"), F.max("seq").alias("seq"))


def fold_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, fold(t.kb_log(events(spark, sf_dir))), "complete", "kb")


def reports_as_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of (drug, event), from which disproportionality follows as in batch."""
    counts = events(spark, sf_dir).select(F.col("user_id").alias("drug"), (t.event_k() % 20).alias("event")).groupBy("drug", "event").agg(F.count(F.lit(1)).alias("a"))
    return _run(spark, counts, "complete", "reports")


def windowed_counts(stream: DataFrame, watermark: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Counts by event time for sinks that append: rows later than the watermark are dropped, repeats of an id within it too."""
    live = stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return live.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
