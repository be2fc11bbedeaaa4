"""An extension: the ledger as a stream. Batch operators stay what they are; nothing here keeps state but Spark's windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tree import LEDGER_SCHEMA


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Ledger lines (JSON) as they arrive in ``folder``."""
    return spark.readStream.schema(LEDGER_SCHEMA).json(folder).withColumn("at", F.timestamp_millis("ts_ms"))


def counts(events: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Operations by tag in event-time windows; lines later than ``late`` are left out, as the watermark says."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "op", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum("elapsed_us").alias("elapsed_us"))


def run_each(events: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]):
    """Run a batch step on every micro-batch of what has arrived."""
    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
