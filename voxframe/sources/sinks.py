"""Artifacts of transcripts and reviews, as one text per recording."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import text as X

EXTENSIONS = ("json", "md", "srt")


def _ordered(df: DataFrame, keys: list[str], order: list[str], line: Column, separator: str, out: str) -> DataFrame:
    """One text for each group: its lines in order."""
    rows = df.select(*keys, F.struct(*order, line.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.array_join(lines, separator).alias(out))


def srt(segments: DataFrame, keys: list[str], speakers: bool = True) -> DataFrame:
    """``keys, srt``: numbered subtitles, with the speaker before the text where there is one."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("seg_idx"))
    prefix = F.when(F.coalesce(F.col("speaker"), F.lit("")) != "", F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise("") if speakers else F.lit("")
    rows = segments.withColumn("n", n)
    line = F.concat(F.col("n").cast("string"), F.lit("\n"), X.clock_srt(F.col("start_sec")), F.lit(" --> "), X.clock_srt(F.col("end_sec")), F.lit("\n"), prefix, F.trim("text"), F.lit("\n"))
    return _ordered(rows, keys, ["n"], line, "\n", "srt")


def markdown(segments: DataFrame, keys: list[str], header: Column | None = None) -> DataFrame:
    """``keys, md``: a timed line for each segment, and the speaker's name where it changes."""
    w = Window.partitionBy(*keys).orderBy("seg_idx")
    last = F.last(F.nullif(F.col("speaker"), F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = F.nullif(F.col("speaker"), F.lit(""))
    rows = segments.withColumn("turn", F.coalesce(own.isNotNull() & (last.isNull() | (last != own)), F.lit(False)))
    name = F.when(F.col("turn"), F.concat(F.lit("\n**"), "speaker", F.lit("**\n"))).otherwise("")
    line = F.concat(name, F.lit("["), X.clock(F.col("start_sec")), F.lit("] "), F.trim("text"))
    body = _ordered(rows, keys, ["seg_idx"], line, "\n", "body")
    top = F.concat(header, F.lit("\n\n---\n\n")) if header is not None else F.lit("")
    return body.select(*keys, F.concat(F.trim(F.concat(top, F.regexp_replace("body", r"^\n", ""))), F.lit("\n")).alias("md"))


def transcript_json(segments: DataFrame, keys: list[str], metadata: DataFrame) -> DataFrame:
    """``keys, json``: metadata and segments as one document; null fields are kept out."""
    one = F.struct("seg_idx", F.struct(F.round("start_sec", 3).alias("start"), F.round("end_sec", 3).alias("end"), "text", "speaker", "conf").alias("s"))
    rows = segments.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("segments"))
    return rows.join(metadata, keys).select(*keys, F.to_json(F.struct("metadata", "segments")).alias("json"))


def comparison_json(candidates: DataFrame, header: DataFrame) -> DataFrame:
    """``rec_id, json``: the comparison of a recording; a number that is none fails the query rather than reach the file."""
    ok = ~(F.isnan("start_seconds") | F.isnan("end_seconds"))
    rows = candidates.withColumn("_ok", F.assert_true(ok, F.lit("a candidate's time is no number"))).where("_ok is null")
    interval = F.struct(F.lit("source_audio").alias("basis"), "start_seconds", "end_seconds", F.col("from_time").alias("from"), F.col("to_time").alias("to"), "precision")
    one = F.struct("nth", F.struct(
        "id", interval.alias("interval"), F.struct(F.col("version_gigaam").alias("gigaam"), F.col("version_whisper").alias("whisper")).alias("versions"),
        F.struct(F.col("changed_gigaam").alias("gigaam"), F.col("changed_whisper").alias("whisper")).alias("changed_words"), F.col("signals").alias("machine_signals"), "priority_hint",
    ).alias("c"))
    body = rows.groupBy("rec_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["c"]).alias("candidates"), F.first("precision").alias("precision"))
    policy = F.struct(F.lit("llm_semantic_review").alias("comparison"), F.lit("human_only").alias("resolution"), F.lit("original_recording_interval").alias("audio_evidence"))
    summary = F.struct(F.size("candidates").alias("candidate_count"), F.col("precision").alias("word_timing_precision"))
    return header.join(body, "rec_id").select("rec_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), "source_audio", policy.alias("policy"), summary.alias("summary"), "candidates")).alias("json"))


def review_template(comparisons: DataFrame) -> DataFrame:
    """``rec_id, json``: an empty review of each comparison (``rec_id, comparison_file``)."""
    body = F.struct(F.lit(1).alias("schema_version"), "comparison_file", F.array().cast("array<string>").alias("decisions"))
    return comparisons.select("rec_id", F.to_json(body).alias("json"))


# The report's words for severities, and its sentences.
_LABELS = {"critical": "критическое", "substantive": "существенное", "minor": "незначительное"}
_TITLE = "# Расхождения транскрипции"
_NOTE = "Порядок версий не означает, что одна модель предпочтительнее. Правильный вариант определяется только после прослушивания исходной записи."
_NONE = "Смысловых расхождений для проверки не найдено."


def _evidence(listed: DataFrame, candidates: DataFrame) -> DataFrame:
    c = candidates.select("rec_id", F.col("id").alias("candidate_id"), "from_time", "to_time", "precision", "version_gigaam", "version_whisper")
    return listed.join(c, ["rec_id", "candidate_id"])


def disagreements_md(listed: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``rec_id, md``: how many were reviewed (``counts``: rec_id, source, reviewed and each severity), then each discrepancy with interval, both versions and reason."""
    absent = F.lit("— фрагмент отсутствует")
    label = F.element_at(F.create_map(*(F.lit(x) for pair in _LABELS.items() for x in pair)), F.col("priority"))
    note = F.when(F.col("precision") == "segment", " (приблизительно: доступны только границы ASR-сегмента)").otherwise("")
    line = F.concat(
        F.lit("## "), "candidate_id", F.lit(" — "), F.coalesce(label, F.lit("")), F.lit(": "), F.array_join("categories", ", "), F.lit("\n\n- Интервал в исходной записи: `"), "from_time", F.lit("–"), "to_time", F.lit("`"), note,
        F.lit("\n\n**GigaAM**\n\n> "), F.coalesce("version_gigaam", absent), F.lit("\n\n**Whisper**\n\n> "), F.coalesce("version_whisper", absent), F.lit("\n\n**Почему нужно проверить:** "), "review_reason", F.lit("\n"),
    )
    body = _ordered(_evidence(listed, candidates), ["rec_id"], ["place"], line, "\n", "body")
    selected = F.col("critical") + F.col("substantive") + F.col("minor")
    top = F.concat(
        F.lit(f"{_TITLE}\n\n- Исходная запись: `"), "source", F.lit("`\n- Проверено кандидатов: "), F.col("reviewed").cast("string"), F.lit("\n- Требуют проверки человеком: "), selected.cast("string"),
        F.lit(" (критических: "), F.col("critical").cast("string"), F.lit(", существенных: "), F.col("substantive").cast("string"), F.lit(", незначительных: "), F.col("minor").cast("string"), F.lit(f")\n\n{_NOTE}\n\n"),
    )
    return counts.join(body, "rec_id", "left").select("rec_id", F.concat(top, F.coalesce("body", F.lit(_NONE + "\n"))).alias("md"))


def disagreements_json(listed: DataFrame, candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``rec_id, json``: the same as one document, each discrepancy pending a human's decision."""
    interval = F.struct("start_seconds", "end_seconds", F.col("from_time").alias("from"), F.col("to_time").alias("to"), "precision")
    versions = F.struct(F.col("version_gigaam").alias("gigaam"), F.col("version_whisper").alias("whisper"))
    one = F.struct("place", F.struct(F.col("candidate_id").alias("id"), "status", "priority", "categories", interval.alias("interval"), versions.alias("versions"), "review_reason").alias("d"))
    body = _evidence(listed, candidates).groupBy("rec_id").agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["d"]).alias("discrepancies"))
    by = F.struct("critical", "substantive", "minor")
    document = F.struct(F.lit(1).alias("schema_version"), "source", F.col("reviewed").alias("reviewed_candidates"), by.alias("counts"), "discrepancies")
    return counts.join(body, "rec_id", "left").select("rec_id", F.to_json(document).alias("json"))


def normalised_json(segments: DataFrame, keys: list[str], events: DataFrame, version: int = 1, key: str = "seg_id") -> DataFrame:
    """``keys, json``: transcripts of normalised texts, with the lexicon's version and how often it replaced and suggested."""
    of = F.col("kind")
    counts = events.join(segments.select(*keys, key), key).groupBy(*keys).agg(F.count_if(of == "replace").alias("replacements"), F.count_if(of == "suggest").alias("suggestions"))
    every = segments.select(*keys).distinct().join(counts, keys, "left").na.fill(0, ["replacements", "suggestions"])
    normalised = F.struct(F.lit(version).alias("lexicon_version"), "replacements", "suggestions")
    return transcript_json(segments, keys, every.select(*keys, F.struct(normalised.alias("normalized")).alias("metadata")))


def output_paths(review: str, output: str | None = None) -> tuple[str, str]:
    """Names of the JSON and Markdown that a review becomes."""
    if output:
        base = output[: -len(Path(output).suffix)] if Path(output).suffix in (".json", ".md") else output
    else:
        name = Path(review).name
        name = name.removesuffix(".review.json") if name.endswith(".review.json") else name.removesuffix(".json")
        base = str(Path(review).parent / f"{name}.disagreements")
    return base + ".json", base + ".md"


def normalised_path(source: str) -> str:
    """Name of the normalised sibling; the source is never overwritten."""
    p = Path(source)
    return str(p.parent / (p.stem + ".normalized.json"))


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """One file per row in a folder of its own under ``path``, written by the executors."""
    df.select(F.col(name).cast("string").alias(name), F.col(text).alias("value")).write.partitionBy(name).mode("errorifexists").text(path)
