"""Rules over Structured Streaming: a compiled rule is a stateless filter, so it runs on any stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from logsieve.functions.schema import EVENTS
from logsieve.operators import results
from logsieve.plans.model import Rule


def event_stream(spark, path: str, schema: str = EVENTS, files_per_trigger: int = 100) -> DataFrame:
    """Canonical events as they arrive in a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, event_id, event_time, log_type) of each match, in one pass for all rules."""
    return results.evaluate_all(events, rules)


def alerts_per_window(events: DataFrame, rules: list[Rule], width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(rule_id, start, stop, matches) by event time; events later than ``late`` are dropped by the watermark."""
    hits = matches(events, rules).withColumn("at", F.col("event_time").cast("timestamp")).withWatermark("at", late)
    counted = hits.groupBy("rule_id", F.window("at", width).alias("w")).agg(F.count("*").alias("matches"))
    return counted.select("rule_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "matches")


def write_matches(hits: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps each rule's matches in a folder of its own, exactly once."""
    return hits.writeStream.format("parquet").partitionBy("rule_id").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
