"""Merging overlapping intervals per entity into periods, and the gaps between them (problem 4).

Two levels, so that no task ever holds all rows of a huge entity. Intervals are
clipped into time shards and merged within (entity, shard); only the merged
pieces that touch a shard's edge are stitched to those of the next shard.
Gaps are found within shards, and between the last and first piece of
neighbouring shards, which suffices as a shard is at least as long as the
longest gap that is listed.

Times are whole milliseconds. Rows with a null key, start or end, or an end
before the start, take no part; an interval of no length is a period of its own
unless another touches it. Repeated rows change nothing; an empty input gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 600_000


def to_ms(seconds: Column) -> Column:
    """Whole milliseconds; binary noise below one is rounded away."""
    return F.round(seconds * 1000).cast("long")


def _local(df: DataFrame, keys: list[str], start: str, end: str, shard_ms: int) -> DataFrame:
    """Merged pieces ``keys, shard, s, e`` within each shard."""
    rows = df.select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e")).dropna().where("s <= e")
    first, last = F.floor(F.col("s") / shard_ms), F.floor(F.greatest("s", F.col("e") - 1) / shard_ms)
    rows = rows.withColumn("shard", F.explode(F.sequence(first, last)))
    rows = rows.select(*keys, "shard", F.greatest("s", F.col("shard") * shard_ms).alias("s"), F.least("e", (F.col("shard") + 1) * shard_ms).alias("e"))
    # Equal pieces fold before the exchange.
    rows = rows.groupBy(*keys, "shard", "s").agg(F.max("e").alias("e"))
    w = Window.partitionBy(*keys, "shard").orderBy("s", "e")
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(before >= F.col("s"), 0).otherwise(1)).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "shard", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, end: str, max_gap_ms: int | None = None, shard_ms: int = SHARD_MS) -> DataFrame:
    """``keys, kind ('period' or 'gap'), from_ms, to_ms``; only gaps shorter than ``max_gap_ms`` are listed."""
    if max_gap_ms is not None:
        shard_ms = max(shard_ms, max_gap_ms)
    w = Window.partitionBy(*keys, "shard").orderBy("s")
    local = _local(df, keys, start, end, shard_ms)
    local = local.withColumns({
        "next": F.lead("s").over(w),
        "at_left": F.col("s") == F.col("shard") * shard_ms,
        "at_right": F.col("e") == (F.col("shard") + 1) * shard_ms,
    })
    inside = local.where("next is not null").select(*keys, F.col("e").alias("from_ms"), F.col("next").alias("to_ms"))
    # Shard summaries, one row a shard, follow each other in the entity's order of shards.
    over = Window.partitionBy(*keys).orderBy("shard")
    shards = local.groupBy(*keys, "shard").agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("next", F.lead("s").over(over))
    across = shards.where("next > e").select(*keys, F.col("e").alias("from_ms"), F.col("next").alias("to_ms"))
    gaps = inside.unionByName(across)
    if max_gap_ms is not None:
        gaps = gaps.where(F.col("to_ms") - F.col("from_ms") < max_gap_ms)
    whole = local.where("not at_left and not at_right").select(*keys, F.col("s").alias("from_ms"), F.col("e").alias("to_ms"))
    chain = Window.partitionBy(*keys).orderBy("shard", "s", "e")
    edge = local.where("at_left or at_right").withColumn("joins", F.col("at_left") & (F.lag("e").over(chain) == F.col("s")))
    edge = edge.withColumn("run", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    stitched = edge.groupBy(*keys, "run").agg(F.min("s").alias("from_ms"), F.max("e").alias("to_ms")).drop("run")
    periods = whole.unionByName(stitched)
    out = [*keys, "kind", "from_ms", "to_ms"]
    return periods.withColumn("kind", F.lit("period")).select(out).unionByName(gaps.withColumn("kind", F.lit("gap")).select(out))


def speaker_label(label: Column) -> Column:
    """SPEAKER_NN from any case and outer blanks."""
    return F.upper(F.trim(label))


def speaking_periods(segments: DataFrame, max_gap_ms: int = 300_000) -> DataFrame:
    """Periods and gaps of each speaker per recording and engine, from ``segments``."""
    ms = [F.when(~F.isnan(c), to_ms(F.col(c))).alias(c) for c in ("start_sec", "end_sec")]
    rows = segments.select("rec_id", "engine", speaker_label(F.col("speaker")).alias("speaker"), *ms)
    return periods_and_gaps(rows, ["rec_id", "engine", "speaker"], "start_sec", "end_sec", max_gap_ms)
