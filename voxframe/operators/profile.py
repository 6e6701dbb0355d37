"""Risks of a recording for a recogniser, and how long it will take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions import text as X

# Real-time factor and load time in seconds of each backend and diarizer.
RTF = {"faster-whisper": 0.9, "mlx-whisper": 0.20, "whisper-cpp": 0.16}
LOAD = {"faster-whisper": 8.0, "mlx-whisper": 6.0, "whisper-cpp": 5.0}
DIARIZE_RTF, DIARIZE_LOAD = {"pyannote": 0.12, "resemblyzer": 0.05}, {"pyannote": 25.0, "resemblyzer": 8.0}
PREFERRED = ["whisper-cpp", "faster-whisper", "mlx-whisper"]


def silence(gaps: DataFrame, least: float = 5.0) -> DataFrame:
    """``rec_id, count, total_seconds, max_seconds`` of silences of at least ``least`` seconds, from ``rec_id, seconds``."""
    long = gaps.where(F.col("seconds") >= least).groupBy("rec_id")
    return long.agg(F.count("*").alias("count"), F.bround(F.sum("seconds"), 1).alias("total_seconds"), F.bround(F.max("seconds"), 1).alias("max_seconds"))


def silence_lines(log: DataFrame) -> DataFrame:
    """``rec_id, seconds`` from the lines of a silence detector's log (``rec_id, line``)."""
    seconds = F.regexp_extract("line", r"silence_duration:\s*([0-9.]+)", 1).try_cast("double")
    return log.select("rec_id", seconds.alias("seconds")).where("seconds is not null")


def risks(df: DataFrame) -> DataFrame:
    """``warnings`` and ``no_condition`` from duration, max_silence, total_silence, sample_rate, bitrate_kbps, mean_db."""
    minutes = F.col("duration") / 60
    ratio = F.when(F.col("duration") > 0, F.coalesce("total_silence", F.lit(0.0)) / F.col("duration")).otherwise(0.0)
    tests = [
        ("very_long", minutes >= 150), ("long", (minutes >= 90) & (minutes < 150)), ("long_silence_block", F.col("max_silence") >= 30), ("high_silence_ratio", ratio > 0.10),
        ("low_sample_rate", (F.col("sample_rate") > 0) & (F.col("sample_rate") <= 8000)), ("low_bitrate", (F.col("bitrate_kbps") > 0) & (F.col("bitrate_kbps") < 64)), ("quiet_audio", F.col("mean_db") < -30),
    ]
    df = df.withColumn("warnings", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests))))
    return df.withColumn("no_condition", F.arrays_overlap("warnings", F.array(F.lit("long_silence_block"), F.lit("high_silence_ratio"))))


def backend(available: Column) -> Column:
    """The preferred one of the available backends, or null."""
    return F.try_element_at(F.array_intersect(F.array(*map(F.lit, PREFERRED)), available), F.lit(1))


def with_backend(df: DataFrame) -> DataFrame:
    """``df`` (available, warnings) with ``backend``, and a warning where only one without beam search is there."""
    df = df.withColumn("backend", backend(F.col("available")))
    only = F.when(F.col("backend") == "mlx-whisper", F.array(F.lit("mlx_only_no_beam"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("warnings", F.concat("warnings", only))


def estimates(recordings: DataFrame, diarizer: str | None = None, backends: list[str] | None = None) -> DataFrame:
    """``rec_id, backend, estimate_seconds, estimate`` for each recording of known length and each backend."""
    extra_load, extra = (DIARIZE_LOAD[diarizer], DIARIZE_RTF[diarizer]) if diarizer else (0.0, 0.0)
    options = F.array(*(F.struct(F.lit(b).alias("backend"), F.lit(RTF[b]).alias("rtf"), F.lit(LOAD[b]).alias("load")) for b in backends or PREFERRED))
    rows = recordings.where("duration is not null").select("rec_id", "duration", F.explode(options).alias("o"))
    seconds = F.col("o.load") + F.col("duration") * F.col("o.rtf") + F.lit(extra_load) + F.col("duration") * extra
    return rows.select("rec_id", F.col("o.backend").alias("backend"), F.bround(seconds, 1).alias("estimate_seconds"), X.estimate(seconds).alias("estimate"))


def embeddable(segments: DataFrame, least: float = 0.6, samples: float = 0.4, rate: int = 16000) -> DataFrame:
    """Segments long enough for a voice embedding."""
    length = F.floor(F.col("end_sec") * rate) - F.floor(F.col("start_sec") * rate)
    return segments.where((F.col("end_sec") - F.col("start_sec") >= least) & (length >= int(samples * rate)))


# The one preset, its model, beam and description.
PRESETS = {"quality": ("large-v3", 5, "Максимальное качество (large-v3, beam=5)")}
ORDER = ["whisper-cpp", "faster-whisper", "mlx-whisper"]


def estimate_report(recordings: DataFrame, diarizer: str | None = None) -> DataFrame:
    """``rec_id, duration_hms, backend, preset, model, beam_size, estimate_seconds, estimate, description``.

    One row for each backend of ``available`` and each preset, but for whisper-cpp without the preset's model among ``models``.
    """
    presets = F.array(*(F.struct(F.lit(p).alias("preset"), F.lit(m).alias("model"), F.lit(b).alias("beam_size"), F.lit(t).alias("description")) for p, (m, b, t) in PRESETS.items()))
    rows = estimates(recordings, diarizer, ORDER).join(recordings.select("rec_id", "duration", "available", "models"), "rec_id")
    rows = rows.where(F.array_contains("available", F.col("backend"))).withColumn("p", F.explode(presets))
    rows = rows.where((F.col("backend") != "whisper-cpp") | F.coalesce(F.array_contains("models", F.col("p.model")), F.lit(False)))
    return rows.select("rec_id", X.clock(F.col("duration")).alias("duration_hms"), "backend", "p.preset", "p.model", "p.beam_size", "estimate_seconds", "estimate", "p.description")


def diarizer(df: DataFrame) -> DataFrame:
    """``df`` (requested, pyannote, hf_token, resemblyzer) with ``diarizer`` and, where what is requested can't be had, ``error``."""
    asked, ready = F.col("requested"), F.col("pyannote") & F.col("hf_token")
    chosen = (
        F.when((asked == "pyannote") & ready, "pyannote").when((asked == "resemblyzer") & F.col("resemblyzer"), "resemblyzer")
        .when((asked == "auto") & ready, "pyannote").when((asked == "auto") & F.col("resemblyzer"), "resemblyzer")
    )
    error = F.when((asked == "pyannote") & F.col("pyannote"), "token_missing").otherwise("not_installed")
    return df.withColumns({"diarizer": chosen, "error": F.when(chosen.isNull() & (asked != "none"), error)})
