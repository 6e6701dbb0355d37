"""Words as they arrive: late and repeated rows count once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(stream: DataFrame, late: str = "7 days", key: str = "word_id", at: str = "loaded_at") -> DataFrame:
    """Rows of a stream by ``key``, each once while its repeats come within ``late``; the state holds no more than that."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark([key]).drop("_at")


def arrivals(stream: DataFrame, late: str = "7 days", every: str = "1 hour", at: str = "loaded_at") -> DataFrame:
    """``engine, from_time, n``: words that arrived in each window of time."""
    rows = stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", every).alias("w"), "engine").agg(F.count("*").alias("n")).select("engine", F.col("w.start").alias("from_time"), "n")
