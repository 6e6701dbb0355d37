"""Speakers of segments from labelled time spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.operators import sequence

BIN_S = 60


def assign(segments: DataFrame, spans: DataFrame) -> DataFrame:
    """``segments`` (rec_id, engine, seg_id, seg_idx, start_sec, end_sec) with ``label`` of the span they overlap most.

    Of equal overlaps the span of least start is taken, then of least end, then of least label. The join is on
    recording and time bin, so a long recording is split. No overlap: null.
    """
    s = segments.where("start_sec <= end_sec").select("rec_id", "engine", "seg_id", "start_sec", "end_sec")
    s = s.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_sec") / BIN_S), F.floor(F.col("end_sec") / BIN_S))))
    p = spans.where("start_sec < end_sec and label is not null").select("rec_id", F.col("start_sec").alias("p_start"), F.col("end_sec").alias("p_end"), "label")
    p = p.withColumn("bin", F.explode(F.sequence(F.floor(F.col("p_start") / BIN_S), F.floor(F.col("p_end") / BIN_S))))
    overlap = F.least("end_sec", "p_end") - F.greatest("start_sec", "p_start")
    met = s.join(p, ["rec_id", "bin"]).withColumn("overlap", overlap).where("overlap > 0")
    best = met.groupBy("rec_id", "engine", "seg_id").agg(F.max(F.struct("overlap", (-F.col("p_start")).alias("a"), (-F.col("p_end")).alias("b"), "label")).alias("m"), F.min("label").alias("_l"))
    return segments.join(best.select("rec_id", "engine", "seg_id", F.col("m.label").alias("label")), ["rec_id", "engine", "seg_id"], "left")


def renumber(labelled: DataFrame) -> DataFrame:
    """``speaker``: SPEAKER_NN by the order in which labels first appear in each transcript."""
    first = labelled.where("label is not null").groupBy("rec_id", "engine", "label").agg(F.min(F.struct("seg_idx", "seg_id")).alias("at"))
    n = F.row_number().over(Window.partitionBy("rec_id", "engine").orderBy("at"))
    names = first.select("rec_id", "engine", "label", F.format_string("SPEAKER_%02d", n - 1).alias("speaker"))
    return labelled.join(names, ["rec_id", "engine", "label"], "left")


def _sharded(df: DataFrame, shard: int) -> DataFrame:
    return df.withColumn("_shard", F.floor(F.coalesce("seg_idx", F.lit(0)) / shard))


def backfill(labelled: DataFrame, shard: int = 1000) -> DataFrame:
    """Null speakers from the nearest segment before that has one, else the nearest after."""
    return sequence.filled(_sharded(labelled, shard), ["rec_id", "engine"], "_shard", ["seg_idx", "seg_id"], "speaker").drop("_shard")


def islands(labelled: DataFrame, shard: int = 1000) -> DataFrame:
    """Spans of consecutive segments of one label: ``rec_id, engine, label, start_sec, end_sec``."""
    keys = ["rec_id", "engine"]
    rows = sequence.runs(_sharded(labelled.where("label is not null"), shard), keys, "_shard", ["seg_idx", "seg_id"], "label")
    first = F.min_by("start_sec", F.struct("seg_idx", "seg_id"))
    return rows.groupBy(*keys, "run_shard", "run", "label").agg(first.alias("start_sec"), F.max("end_sec").alias("end_sec")).drop("run_shard", "run")


def speaker_counts(labelled: DataFrame) -> DataFrame:
    """Distinct labels assigned in each transcript."""
    return labelled.groupBy("rec_id", "engine").agg(F.count_distinct("label").alias("speakers"))


def most_detailed(segments: DataFrame) -> DataFrame:
    """The transcript of each recording with most segments, the first engine of equals."""
    n = segments.groupBy("rec_id", "engine").agg(F.count("*").alias("segments"))
    w = Window.partitionBy("rec_id").orderBy(F.desc("segments"), "engine")
    return n.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
