"""Queries of scans, documents, publication and settings: tables are written as files of each kind to the shared folder and read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import text as X
from voxframe.operators import intervals, lexicon, profile, rank, releases, review, words
from voxframe.operators.storage import materialise, shared_dir
from voxframe.plans import core, sql_artifacts
from voxframe.sources import publication, sinks, transcripts
from voxframe.sources.tables import table

KEYS = ["rec_id", "engine"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"


def _files(spark: SparkSession, df: DataFrame, kind: str) -> str:
    """Folder with one file for each row (``name``, ``value``)."""
    path = _folder(spark, kind)
    sinks.write_texts(df, path, "name", "value")
    return path


def _part(file: str, n: int) -> Column:
    """Part ``n`` of a file's name, which was made of a recording's id and an engine."""
    return F.split(F.regexp_extract(file, r"name=([^/]+)", 1), r"\.")[n]


def _source() -> Column:
    """The name that a transcript gives for its recording, wrong for every fifth."""
    return F.when(F.col("rec_id") % 5 == 0, F.concat(F.lit("other-"), "source_file")).otherwise(F.col("source_file"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts scanned from files, with the recording and engine of each."""
    s = core._segments(spark, d).where("text is not null")
    r = table(spark, d, "recordings").select("rec_id", F.struct(_source().alias("source_file")).alias("metadata"))
    json = sinks.transcript_json(s, KEYS, s.select(*KEYS).distinct().join(r, "rec_id"))
    path = _files(spark, json.select(F.concat_ws(".", "rec_id", "engine").alias("name"), F.col("json").alias("value")), "transcripts")
    return transcripts.transcripts(spark, path, "").withColumn("engine", _part("file", 1))


def scan_transcripts(spark: SparkSession, d: str) -> DataFrame:
    s = transcripts.segments_of(_documents(spark, d))
    return s.select(_part("file", 0).cast("long").alias("rec_id"), "engine", "seg_idx", "start_sec", "end_sec", "text", "speaker", "conf")


def scan_lenient(spark: SparkSession, d: str) -> DataFrame:
    s = transcripts.segments_of(_documents(spark, d), lenient=True)
    return s.select(_part("file", 0).cast("long").alias("rec_id"), "engine", "seg_idx", "start_sec", "end_sec")


def scan_structural_violations(spark: SparkSession, d: str) -> DataFrame:
    v = transcripts.structural_violations(_documents(spark, d))
    return v.select(_part("file", 0).cast("long").alias("rec_id"), "engine", "seg_idx", "rule")


def scan_content_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = materialise(_documents(spark, d), "documents_scanned")
    r = table(spark, d, "recordings").select(F.col("rec_id").alias("_rec"), F.col("source_file").alias("source_name"), F.col("duration_sec").alias("duration"))
    sources = docs.select("file").distinct().join(r, _part("file", 0).cast("long") == F.col("_rec")).drop("_rec")
    v = transcripts.content_violations(docs, sources, require_words=True)
    return v.select(_part("file", 0).cast("long").alias("rec_id"), "engine", "seg_idx", "rule")


def _recogniser(spark: SparkSession, d: str) -> str:
    """Full recogniser output of the whisper segments: each with its text as one token."""
    s = core._segments(spark, d).where("engine = 'whisper' and text is not null and start_sec is not null and end_sec is not null")
    times = F.struct(intervals.to_ms(F.col("start_sec")).alias("from"), intervals.to_ms(F.col("end_sec")).alias("to"))
    token = F.struct(F.concat(F.lit(" "), "text").alias("text"), times.alias("offsets"), F.lit(0.5).alias("p"))
    one = F.struct("seg_idx", F.struct("text", times.alias("offsets"), F.array(token).alias("tokens")).alias("s"))
    docs = s.groupBy("rec_id").agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["s"]).alias("transcription"))).alias("value"))
    return _files(spark, docs.select(F.col("rec_id").cast("string").alias("name"), "value"), "recogniser")


def scan_recogniser_segments(spark: SparkSession, d: str) -> DataFrame:
    s = transcripts.tidy_segments(transcripts.recogniser_segments(spark, _recogniser(spark, d)).withColumn("conf", F.lit(None).cast("double")))
    return s.select(_part("file", 0).cast("long").alias("rec_id"), "seg_idx", "start_sec", "end_sec", "text")


def scan_recogniser_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = transcripts.recogniser_tokens(spark, _recogniser(spark, d))
    return t.select(_part("file", 0).cast("long").alias("rec_id"), "seg_idx", "tok_idx", "text", "p", "from_ms", "to_ms")


def scan_lexicon(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "terms")
    fields = ["canonical", "policy", "ru_stems", "ru_exact", "latin_variants", "latin_suggest"]
    document = F.to_json(F.struct(F.lit(1).alias("version"), F.sort_array(F.collect_list(F.struct(*fields))).alias("terms")))
    path = _files(spark, t.agg(document.alias("value")).withColumn("name", F.lit("lexicon")), "lexicon")
    return lexicon.rules(transcripts.lexicon_file(spark, path)).select("kind", "key", "canonical")


def scan_word_list(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "word_list")
    spoken = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("w")).distinct()
    spoken.select(F.concat(F.lit(" "), "w").alias("value")).write.text(path)
    return transcripts.word_list(spark, path)


def scan_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the heads of reviews made up from the recordings, each sixth broken in its own way."""
    n = F.col("rec_id") % 6
    decisions = F.when(n == 3, "{}").otherwise('[{"candidate_id":"D001"},{"candidate_id":"D002"}]')
    head = F.concat(F.lit('{"schema_version":'), F.when(n == 2, "2").otherwise("1"), F.lit(',"comparison_file":"c.json","decisions":'), decisions, F.when(n == 1, ',"note":"x"').otherwise(""), F.lit("}"))
    r = table(spark, d, "recordings").select(F.col("rec_id").cast("string").alias("name"), F.when(n == 4, "[]").otherwise(head).alias("value"))
    read = materialise(transcripts.reviews(spark, _files(spark, r, "reviews")), "reviews_scanned")
    rec = _part("file", 0).cast("long")
    heads = read.select(rec.alias("rec_id"), "review", F.when(rec % 6 == 5, 2).otherwise(1).alias("comparison_version"))
    listed = transcripts.decisions_of(read).select(rec.alias("rec_id"), F.concat(F.lit("decision "), F.col("ord").cast("string"), F.lit(" "), F.get_json_object("decision", "$.candidate_id")).alias("rule"))
    return review.header_violations(heads).unionByName(listed)


# ---- documents


def review_templates(spark: SparkSession, d: str) -> DataFrame:
    return sinks.review_template(table(spark, d, "recordings").select("rec_id", F.concat("rec_id", F.lit(".comparison.json")).alias("comparison_file")))


_CANDIDATE = "struct<id:string,interval:struct<start_seconds:double,from:string>,versions:struct<gigaam:string,whisper:string>,priority_hint:string>"


def comparison_documents(spark: SparkSession, d: str) -> DataFrame:
    """Candidates read back from the comparison documents."""
    c = materialise(core._candidates(spark, d), "candidates")
    docs = sinks.comparison_json(c, c.select("rec_id", F.struct(F.concat("rec_id", F.lit(".wav")).alias("ref")).alias("source_audio")).distinct())
    kind = f"struct<summary:struct<candidate_count:int,word_timing_precision:string>,candidates:array<{_CANDIDATE}>>"
    rows = docs.select("rec_id", F.from_json("json", kind).alias("j")).select("rec_id", "j.summary.*", F.explode("j.candidates").alias("c"))
    return rows.select("rec_id", "candidate_count", "word_timing_precision", "c.id", "c.interval.*", "c.versions.*", "c.priority_hint")


def _reported(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c, decisions = core._decided(spark, d)
    counts = review.severity_counts(decisions, c).withColumn("source", F.concat("rec_id", F.lit(".wav")))
    return review.disagreements(decisions, c), c, counts


def disagreement_reports(spark: SparkSession, d: str) -> DataFrame:
    return sinks.disagreements_md(*_reported(spark, d))


def disagreement_documents(spark: SparkSession, d: str) -> DataFrame:
    """Discrepancies read back from their documents."""
    kind = "struct<reviewed_candidates:int,counts:struct<critical:int,substantive:int,minor:int>,discrepancies:array<struct<id:string,status:string,priority:string,interval:struct<start_seconds:double,from:string>>>>"
    rows = sinks.disagreements_json(*_reported(spark, d)).select("rec_id", F.from_json("json", kind).alias("j"))
    rows = rows.select("rec_id", "j.reviewed_candidates", "j.counts.*", F.explode_outer("j.discrepancies").alias("x"))
    return rows.select("rec_id", "reviewed_candidates", "critical", "substantive", "minor", "x.id", "x.status", "x.priority", "x.interval.*")


def normalised_documents(spark: SparkSession, d: str) -> DataFrame:
    """Counters and texts read back from the normalised siblings of the transcripts."""
    s, rules = core._segments(spark, d).where("text is not null"), core._rules(spark, d)
    texts = lexicon.normalise(s, rules)
    docs = sinks.normalised_json(s.drop("text").join(texts, "seg_id"), KEYS, lexicon.events(s, rules))
    kind = "struct<metadata:struct<normalized:struct<lexicon_version:int,replacements:long,suggestions:long>>,segments:array<struct<text:string>>>"
    rows = docs.select(*KEYS, F.from_json("json", kind).alias("j"))
    return rows.select(*KEYS, "j.metadata.normalized.*", F.array_join(F.transform("j.segments", lambda x: x["text"]), "|").alias("texts"))


def plain_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles and texts of transcripts without speakers."""
    s = core._segments(spark, d).where("start_sec is not null and end_sec is not null and text is not null").withColumn("speaker", F.lit(None).cast("string"))
    return sinks.srt(s, KEYS, speakers=False).join(sinks.markdown(s, KEYS), KEYS)


def published_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Subtitles published as files, and these read back."""
    path = _folder(spark, "published")
    srt = core.srt_artifacts(spark, d).select(F.concat_ws(".", "rec_id", "engine", F.lit("srt")).alias("name"), F.col("srt").alias("value"))
    publication.publish(srt, path)
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), "value")


# ---- settings and profiles


def diarizers(spark: SparkSession, d: str) -> DataFrame:
    """Each thing that can be asked for, in environments made up from the recordings' ids."""
    asked = F.explode(F.array(*map(F.lit, ("auto", "pyannote", "resemblyzer", "none")))).alias("requested")
    rows = table(spark, d, "recordings").select("rec_id", asked, *((F.col("rec_id").bitwiseAND(1 << i) > 0).alias(c) for i, c in enumerate(("pyannote", "hf_token", "resemblyzer"))))
    return profile.diarizer(rows).select("rec_id", "requested", "diarizer", "error")


def estimate_reports(spark: SparkSession, d: str) -> DataFrame:
    models = F.when(F.col("rec_id") % 4 == 0, F.array(F.lit("small"))).otherwise(F.array(F.lit("large-v3")))
    return profile.estimate_report(table(spark, d, "recordings").select("rec_id", F.col("duration_sec").alias("duration"), core.available().alias("available"), models.alias("models")), "resemblyzer")


def silence_logs(spark: SparkSession, d: str) -> DataFrame:
    """Silences from the lines of a detector's log, made up from the segments' lengths."""
    s = core._segments(spark, d).where("start_sec is not null and end_sec is not null")
    lines = s.select("rec_id", F.concat(F.lit("[silencedetect] silence_end: 1 | silence_duration: "), F.format_string("%.3f", F.col("end_sec") - F.col("start_sec"))).alias("line"))
    return profile.silence(profile.silence_lines(lines))


def release_summaries(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    r = table(spark, d, "documents").select(
        n.alias("release_id"), F.when(n % 3 != 0, F.concat(F.lit("v1."), n)).alias("tag_name"), F.when(n % 2 == 0, F.concat(F.lit("Release "), n)).otherwise("").alias("name"), F.when(n % 5 == 0, F.concat(F.lit("https://example.org/"), n)).alias("html_url"), F.col("text").alias("body")
    )
    return releases.summaries(r, "https://example.org/releases").withColumn("notes", F.array_join("notes", "|"))


def update_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether a check for updates is switched off, and whether the last one is fresh, for settings made up from the recordings' ids."""
    n = F.col("rec_id")
    setting = F.element_at(F.array(*map(F.lit, ("", "0", " No ", "off", "1", "yes", "FALSE"))), (n % 7 + 1).cast("int"))
    last = F.when(n % 5 == 0, "never").otherwise((F.lit(1_000_000) - n * 9000 + 20000).cast("string"))
    return table(spark, d, "recordings").select("rec_id", X.switched_off(setting).alias("off"), X.fresh(last, F.lit(1_000_000)).alias("fresh"))


def filler_words(spark: SparkSession, d: str) -> DataFrame:
    """How often each filler of speech was said."""
    core_ = X.lower_ru(X.core(F.col("text")))
    w = words.said(core._segments(spark, d), core._words(spark, d)).select(*KEYS, core_.alias("filler"))
    return w.where(F.col("filler").isin(rank.FILLERS)).groupBy(*KEYS, "filler").agg(F.count("*").alias("n"))


_ALL = [
    scan_transcripts, scan_lenient, scan_structural_violations, scan_content_violations, scan_recogniser_segments, scan_recogniser_tokens, scan_lexicon, scan_word_list, scan_reviews, review_templates, comparison_documents,
    disagreement_reports, disagreement_documents, normalised_documents, plain_artifacts, published_artifacts, diarizers, estimate_reports, silence_logs, release_summaries, update_checks, filler_words,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(sql_artifacts.SQL)
