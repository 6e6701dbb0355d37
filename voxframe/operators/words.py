"""Words of transcripts: one row per word, with time, source and segment bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import text as X


def finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows delivered twice count once: the first loaded."""
    w = Window.partitionBy(key).orderBy("loaded_at")
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def with_key(df: DataFrame, text: str = "text", out: str = "key") -> DataFrame:
    """``df`` with the token key of ``text``; only rows that NFKC may change pass through Python."""
    special = F.coalesce(X.needs_nfkc(F.col(text)), F.lit(False))
    plain = df.where(~special).withColumn(out, X.token_key(F.col(text)))
    return plain.unionByName(df.where(special).withColumn(out, X.token_key(X.nfkc(F.col(text)))))


def timed(words: DataFrame) -> DataFrame:
    """Words with a key, a start and an end not before it."""
    ok = finite(F.col("start_sec")) & finite(F.coalesce("end_sec", "start_sec")) & (F.col("start_sec") >= 0)
    rows = words.where(ok & F.col("text").isNotNull()).withColumn("end_sec", F.coalesce("end_sec", "start_sec")).where("end_sec >= start_sec")
    return with_key(rows).where("key <> ''")


def evenly_spaced(segments: DataFrame) -> DataFrame:
    """Words of segments without timed ones: tokens that share the segment's span equally and carry its bounds."""
    rows = segments.where(finite(F.col("start_sec")) & F.col("text").isNotNull()).withColumn("end_sec", F.coalesce("end_sec", "start_sec"))
    rows = rows.withColumn("tokens", F.regexp_extract_all("text", F.lit(r"([\p{L}\p{N}_-]+)"), F.lit(1))).where("size(tokens) > 0")
    step = F.greatest(F.lit(0.001), F.col("end_sec") - F.col("start_sec")) / F.size("tokens")
    rows = rows.withColumn("step", step)
    out = rows.select("*", F.posexplode("tokens").alias("word_idx", "token"))
    return out.select(
        "rec_id", "engine", "seg_id", "word_idx",
        (F.col("start_sec") + F.col("word_idx") * F.col("step")).alias("w_start"), (F.col("start_sec") + (F.col("word_idx") + 1) * F.col("step")).alias("w_end"),
        F.col("token").alias("text"), F.col("start_sec").alias("seg_start"), F.col("end_sec").alias("seg_end"),
    ).withColumnsRenamed({"w_start": "start_sec", "w_end": "end_sec"})


def transcript_words(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Timed words of each segment, or its evenly spaced tokens where it has none; ``seg_start`` tells the latter."""
    t = timed(once(words, "word_id"))
    have = t.select("seg_id").distinct()
    bare = with_key(evenly_spaced(once(segments, "seg_id").join(have, "seg_id", "left_anti")))
    cols = ["rec_id", "engine", "seg_id", "word_idx", "start_sec", "end_sec", "text", "key"]
    none = F.lit(None).cast("double")
    return t.select(*cols, none.alias("seg_start"), none.alias("seg_end")).unionByName(bare.select(*cols, "seg_start", "seg_end"))


def said(segments: DataFrame, words: DataFrame) -> DataFrame:
    """Every word with text: ``rec_id, engine, word_id, seg_id, pos, start_sec, text, conf``, timed or not.

    A word without a start takes its segment's; a segment without words gives the pieces of its text, with its start and confidence.
    """
    bounds = segments.select("seg_id", F.col("start_sec").alias("_start"))
    own = words.where("text is not null").join(bounds, "seg_id", "left")
    own = own.select("rec_id", "engine", "word_id", "seg_id", F.col("word_idx").alias("pos"), F.coalesce("start_sec", "_start").alias("start_sec"), "text", "conf")
    bare = segments.where("text is not null").join(words.select("seg_id").distinct(), "seg_id", "left_anti")
    bare = bare.select("rec_id", "engine", F.lit(None).cast("long").alias("word_id"), "seg_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("pos", "piece"), "start_sec", "conf")
    return own.unionByName(bare.withColumnRenamed("piece", "text"))


def between(words: DataFrame, start: Column, end: Column) -> DataFrame:
    """Words whose midpoint lies in the closed interval."""
    return words.where(((F.col("start_sec") + F.col("end_sec")) / 2).between(start, end))


def in_windows(words: DataFrame, durations: DataFrame, window: float = 20.0, overlap: float = 3.0) -> DataFrame:
    """Each word in the overlapping windows ``win`` of its recording that hold its midpoint.

    ``durations``: rec_id, duration. A word whose midpoint lies beyond the duration is in none.
    """
    rows = words.join(durations, "rec_id").withColumn("mid", (F.col("start_sec") + F.col("end_sec")) / 2)
    rows = rows.where("mid between 0 and duration").withColumn("n_win", F.greatest(F.lit(1), F.ceil(F.col("duration") / window)))
    first = F.greatest(F.lit(0), F.ceil((F.col("mid") - window - overlap) / window))
    last = F.least(F.col("n_win") - 1, F.floor((F.col("mid") + overlap) / window))
    return rows.where(first <= last).withColumn("win", F.explode(F.sequence(first, last))).drop("n_win")


def durations(recordings: DataFrame, words: DataFrame) -> DataFrame:
    """``rec_id, duration``: the recording's, or the last word's end where it has none."""
    known = recordings.groupBy("rec_id").agg(F.max("duration_sec").alias("known"))
    last = words.groupBy("rec_id").agg(F.max("end_sec").alias("last"))
    return last.join(known, "rec_id", "left").select("rec_id", F.when(F.col("known") > 0, F.col("known")).otherwise(F.col("last")).alias("duration"))
