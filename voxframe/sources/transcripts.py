"""Scans of transcript artifacts, lexicons, word lists, reviews and recogniser output; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxframe.operators import sequence
from voxframe.operators.words import finite

TRANSCRIPT = (
    "metadata map<string,string>, segments array<struct<start:double,end:double,text:string,speaker:string,conf:double,"
    "words:array<struct<start:double,end:double,word:string,conf:double>>>>"
)
LEXICON = "version int, terms array<struct<canonical:string,policy:string,ru_stems:array<string>,ru_exact:array<string>,latin_variants:array<string>,latin_suggest:array<string>>>"
TOKENS = "transcription array<struct<text:string,offsets:struct<from:bigint,to:bigint>,tokens:array<struct<text:string,offsets:struct<from:bigint,to:bigint>,p:double>>>>"


def transcripts(spark: SparkSession, path: str, engine: str) -> DataFrame:
    """``file, engine, metadata, segments``: one document a file; a file that is no JSON fails the scan."""
    rows = spark.read.schema(TRANSCRIPT).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.input_file_name().alias("file"), F.lit(engine).alias("engine"), "metadata", "segments")


def segments_of(documents: DataFrame, lenient: bool = False) -> DataFrame:
    """``file, engine, seg_idx, start_sec, end_sec, text, speaker, conf, words``; lenient: missing times and text get defaults."""
    rows = documents.select("file", "engine", F.posexplode("segments").alias("seg_idx", "s"))
    start, end, text = F.col("s.start"), F.col("s.end"), F.col("s.text")
    if lenient:
        start, text = F.coalesce(start, F.lit(0.0)), F.coalesce(text, F.lit(""))
        end = F.coalesce(end, start)
    return rows.select("file", "engine", "seg_idx", start.alias("start_sec"), end.alias("end_sec"), text.alias("text"), F.col("s.speaker").alias("speaker"), F.col("s.conf").alias("conf"), F.col("s.words").alias("words"))


def words_of(segments: DataFrame) -> DataFrame:
    """``file, engine, seg_idx, word_idx, start_sec, end_sec, text, conf``; a missing start is the segment's."""
    rows = segments.select("file", "engine", "seg_idx", "start_sec", F.posexplode("words").alias("word_idx", "w"))
    start = F.coalesce("w.start", "start_sec")
    return rows.select("file", "engine", "seg_idx", "word_idx", start.alias("start_sec"), F.coalesce("w.end", start).alias("end_sec"), F.trim("w.word").alias("text"), F.col("w.conf").alias("conf"))


def _broken(rows: DataFrame, keys: list[str], tests: list) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("rule"))


def structural_violations(documents: DataFrame) -> DataFrame:
    """``file, engine, seg_idx, rule``: no segments, and the rules of ``segment_violations``."""
    bare = documents.where("segments is null").select("file", "engine", F.lit(None).cast("int").alias("seg_idx"), F.lit("no_segments").alias("rule"))
    return bare.unionByName(segment_violations(segments_of(documents), ["file", "engine"]))


def segment_violations(segments: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, seg_idx, rule``: times that are no numbers, bad intervals, segments out of order."""
    s = sequence.previous(segments.withColumn("_shard", F.floor(F.col("seg_idx") / 1000)), keys, "_shard", ["seg_idx"], "start_sec", "before")
    number = finite(F.col("start_sec")) & finite(F.col("end_sec"))
    late = F.coalesce(F.col("start_sec") < F.col("before"), F.lit(False))
    tests = [("not_finite", ~number), ("interval", number & ((F.col("start_sec") < 0) | (F.col("end_sec") < F.col("start_sec")))), ("order", number & late)]
    return _broken(s, [*keys, "seg_idx"], tests)


def word_violations(words: DataFrame, keys: list[str], limit: Column | None = None) -> DataFrame:
    """``keys, word_idx, rule`` within each segment: times that are no numbers, bad or backward intervals, ends beyond ``limit``."""
    before = F.lag("start_sec").over(Window.partitionBy(*keys).orderBy("word_idx"))
    w = words.withColumn("before", before)
    number = finite(F.col("start_sec")) & finite(F.col("end_sec"))
    bad = (F.col("start_sec") < 0) | (F.col("end_sec") < F.col("start_sec")) | F.coalesce(F.col("start_sec") < F.col("before"), F.lit(False))
    beyond = F.lit(False) if limit is None else F.coalesce(F.col("end_sec") > limit, F.lit(False))
    return _broken(w, [*keys, "word_idx"], [("word_not_finite", ~number), ("word_interval", number & bad), ("word_end", number & beyond)])


def content_violations(documents: DataFrame, sources: DataFrame, require_words: bool = False) -> DataFrame:
    """``file, engine, seg_idx, word_idx, rule`` against ``sources`` (file, source_name, duration).

    Another source name (only where one is given), ends beyond the duration and its tolerance, spoken segments
    without words if these are required, and word intervals that are bad, out of order or beyond the recording.
    """
    d = documents.join(sources, "file")
    limit = F.col("duration") + F.greatest(F.lit(2.0), F.col("duration") * 0.001)
    none = F.lit(None).cast("int")
    name = F.nullif(F.col("metadata")["source_file"], F.lit(""))
    other = d.where(name != F.col("source_name")).select("file", "engine", none.alias("seg_idx"), none.alias("word_idx"), F.lit("source_file").alias("rule"))
    s = segments_of(documents).join(sources, "file")
    spoken = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}\p{N}]+", "") != ""
    tests = [("segment_end", (F.col("duration") > 0) & (F.col("end_sec") > limit)), ("words_missing", F.lit(require_words) & spoken & (F.coalesce(F.size("words"), F.lit(0)) <= 0))]
    segs = _broken(s, ["file", "engine", "seg_idx"], tests).select("file", "engine", "seg_idx", none.alias("word_idx"), "rule")
    w = words_of(segments_of(documents)).join(sources, "file")
    ws = word_violations(w, ["file", "engine", "seg_idx"], F.when(F.col("duration") > 0, limit))
    return other.unionByName(segs).unionByName(ws)


def lexicon_file(spark: SparkSession, path: str) -> DataFrame:
    """``ord, canonical, policy, ru_stems, ru_exact, latin_variants, latin_suggest`` in the file's order."""
    rows = spark.read.schema(LEXICON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.posexplode("terms").alias("ord", "t")).select("ord", "t.*")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words of a text file, none where it can't be read."""
    try:
        return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()
    except Exception:
        return spark.createDataFrame([], "word string")


def recogniser_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``file, seg_idx, tok_idx, text, p, from_ms, to_ms`` of a recogniser's full JSON; blank segments are left out."""
    rows = spark.read.schema(TOKENS).option("multiLine", True).json(path)
    s = rows.select(F.input_file_name().alias("file"), F.posexplode("transcription").alias("seg_idx", "s")).where("trim(s.text) <> ''")
    t = s.select("file", "seg_idx", F.posexplode("s.tokens").alias("tok_idx", "t"))
    return t.select("file", "seg_idx", "tok_idx", F.col("t.text").alias("text"), F.col("t.p").alias("p"), F.col("t.offsets.from").alias("from_ms"), F.col("t.offsets.to").alias("to_ms"))


def recogniser_segments(spark: SparkSession, path: str) -> DataFrame:
    """``file, seg_idx, start_sec, end_sec, text`` in seconds; blank segments are left out."""
    rows = spark.read.schema(TOKENS).option("multiLine", True).json(path)
    s = rows.select(F.input_file_name().alias("file"), F.posexplode("transcription").alias("seg_idx", "s")).where("trim(s.text) <> ''")
    return s.select("file", "seg_idx", (F.col("s.offsets.from") / 1000.0).alias("start_sec"), (F.col("s.offsets.to") / 1000.0).alias("end_sec"), F.trim("s.text").alias("text"))


def tidy_segments(segments: DataFrame) -> DataFrame:
    """Recogniser segments with text, times to the millisecond and confidence to four places."""
    rows = segments.where("trim(text) <> ''")
    return rows.withColumns({"start_sec": F.round("start_sec", 3), "end_sec": F.round("end_sec", 3), "text": F.trim("text"), "conf": F.round("conf", 4)})


def reviews(spark: SparkSession, path: str) -> DataFrame:
    """``file, review, comparison``: each review as JSON text and the path of its comparison, seen from the review's folder."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("review"))
    ref = F.get_json_object("review", "$.comparison_file")
    folder = F.regexp_replace("file", r"[^/]*$", "")
    return rows.withColumn("comparison", F.when(ref.rlike("^(/|[a-z]+:)"), ref).otherwise(F.concat(folder, ref)))


def decisions_of(reviews_: DataFrame) -> DataFrame:
    """``file, ord, decision``: each decision as JSON text."""
    items = F.from_json(F.get_json_object("review", "$.decisions"), "array<string>")
    return reviews_.select("file", F.posexplode(items).alias("ord", "decision"))
