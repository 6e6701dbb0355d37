"""Queries of the core operators, each over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions import text as X
from voxframe.operators import chunks, clustering, diff, intervals, lexicon, profile, rank, releases, review, speakers, tokens, words
from voxframe.operators.storage import materialise
from voxframe.plans import sql, sql_compare
from voxframe.sources import sinks, transcripts
from voxframe.sources.tables import table

KEYS = ["rec_id", "engine"]


def entry(spark: SparkSession, d: str) -> DataFrame:
    """Flagship query: review candidates of all recordings."""
    return diff_candidates(spark, d)


def _words(spark: SparkSession, d: str) -> DataFrame:
    return words.once(table(spark, d, "words"), "word_id")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments once, with tidy labels."""
    s = words.once(table(spark, d, "segments"), "seg_id")
    return s.withColumn("speaker", intervals.speaker_label(F.col("speaker")))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.rules(lexicon.numbered(table(spark, d, "terms")))


# ---- words and windows


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return intervals.speaking_periods(table(spark, d, "segments"))


def words_timed(spark: SparkSession, d: str) -> DataFrame:
    return words.timed(_words(spark, d)).select("word_id", "rec_id", "engine", "start_sec", "end_sec", "key")


def words_spaced(spark: SparkSession, d: str) -> DataFrame:
    s = words.evenly_spaced(words.once(table(spark, d, "segments"), "seg_id"))
    return s.groupBy("rec_id", "engine", "seg_id").agg(F.count("*").alias("n"), F.round(F.max("end_sec"), 3).alias("last_end"))


def words_between(spark: SparkSession, d: str) -> DataFrame:
    rows = words.between(words.timed(_words(spark, d)), F.lit(30.0), F.lit(60.0))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.min("word_id").alias("first_id"))


def words_windows(spark: SparkSession, d: str) -> DataFrame:
    w = words.timed(_words(spark, d))
    rows = words.in_windows(w, words.durations(table(spark, d, "recordings"), w))
    return rows.groupBy(*KEYS, "win").agg(F.count("*").alias("n"), F.sum("word_id").alias("ids"))


def word_shapes(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "words").where("text is not null").select("text").distinct()
    left, core, right = X.edges(F.col("text"))
    rows = t.select("text", left.alias("left_edge"), core.alias("core"), right.alias("right_edge"))
    return rows.select("*", X.consonants(F.col("core")).alias("skeleton"), X.lower_ru(F.col("core")).alias("low"), X.mixes_alphabets(F.col("core")).alias("mixed"))


def segment_words_joined(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d).where("text is not null").groupBy("seg_id").agg(F.sort_array(F.collect_list(F.struct("word_idx", "word_id", "text"))).alias("w"))
    return w.select("seg_id", X.join_words(F.transform("w", lambda x: x["text"])).alias("joined"))


def word_total(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(\S+)"), F.lit(1)))
    return _segments(spark, d).groupBy(*KEYS).agg(F.sum(n).alias("words"), F.max(F.col("conf").isNotNull()).alias("has_confidence"))


def clock_formats(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null")
    return s.select("seg_id", X.clock_from(F.col("start_sec")).alias("t_from"), X.clock_to(F.col("end_sec")).alias("t_to"), X.clock(F.col("start_sec")).alias("t_round"), X.clock_srt(F.col("end_sec")).alias("t_srt"))


# ---- validation


def segment_violations(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.segment_violations(_segments(spark, d), KEYS)


def word_violations(spark: SparkSession, d: str) -> DataFrame:
    return transcripts.word_violations(_words(spark, d), ["rec_id", "engine", "seg_id"])


# ---- comparison and review


def diff_raw(spark: SparkSession, d: str) -> DataFrame:
    w = words.transcript_words(table(spark, d, "segments"), table(spark, d, "words"))
    raw = diff.changed_signals(diff.raw_differences(words.in_windows(w, words.durations(table(spark, d, "recordings"), w))))
    return raw.select("rec_id", "start", "end", F.array_join("a_text", " ").alias("a"), F.array_join("b_text", " ").alias("b"), F.array_join("signals", ",").alias("signals"))


def diff_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).withColumn("signals", F.array_join("signals", ","))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return diff.compare(*(table(spark, d, t) for t in ("recordings", "segments", "words")))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Candidates, and a decision for each but every seventh. Some are made up to break a rule, each rule by its own cases."""
    c = materialise(_candidates(spark, d), "candidates")
    kept = c.where(F.col("nth") % 7 != 0).withColumn("q", F.col("nth") % 23)
    n, q = F.col("nth"), F.col("q")
    texts = F.array().cast("array<string>")
    verdict = F.when(q == 1, "unsure").when(q.isin(2, 3, 14) | (n % 3 == 2), "same_meaning").otherwise("discrepancy")
    differs = (verdict == "discrepancy") | q.isin(2, 3)  # these two say too much of what they call the same
    severity = F.when(q == 4, "grave").otherwise(F.element_at(F.array(*map(F.lit, review.SEVERITIES)), (n % 3 + 1).cast("int")))
    categories = F.when(q == 5, texts).when(q == 6, F.array(F.lit("decision"), F.lit("decision"))).when(q == 7, F.array(F.lit("opinion"))).otherwise(F.array(F.lit("other_semantic")))
    reason = F.when(q == 8, "  ").otherwise(" heard otherwise ")
    one = F.to_json(F.struct(
        F.when(q == 9, F.concat(F.lit("X"), "id")).otherwise(F.col("id")).alias("candidate_id"), verdict.alias("verdict"), F.when(differs, severity).alias("severity"), F.when(differs, categories).alias("categories"),
        reason.alias("review_reason"), F.when(q == 11, "more").alias("comment"),
    ))
    again = F.to_json(F.struct(F.col("id").alias("candidate_id"), F.lit("same_meaning").alias("verdict"), F.lit("again").alias("review_reason")))
    raw = kept.select("rec_id", n.alias("ord"), one.alias("decision")).unionByName(kept.where(q == 10).select("rec_id", (n + 1000000).alias("ord"), again.alias("decision")))
    return c, review.parse_decisions(raw)


def review_violations(spark: SparkSession, d: str) -> DataFrame:
    c, decisions = _decided(spark, d)
    return review.violations(decisions, c)


def review_first_violation(spark: SparkSession, d: str) -> DataFrame:
    return review.first_violation(review_violations(spark, d))


def review_disagreements(spark: SparkSession, d: str) -> DataFrame:
    c, decisions = _decided(spark, d)
    return review.disagreements(decisions, c).withColumn("categories", F.array_join("categories", ","))


def review_severities(spark: SparkSession, d: str) -> DataFrame:
    c, decisions = _decided(spark, d)
    return review.severity_counts(decisions, c)


# ---- lexicon and ranking


def lexicon_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).select("kind", "key", "canonical")


def lexicon_matches(spark: SparkSession, d: str) -> DataFrame:
    cores = table(spark, d, "words").where("text is not null").select(X.core(F.col("text")).alias("core"))
    return lexicon.match(cores, _rules(spark, d))


def lexicon_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    """Matches with the canonical forms and everyday words of the documents as word list."""
    cores = table(spark, d, "words").where("text is not null").select(X.core(F.col("text")).alias("core"))
    spoken = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    return lexicon.match(cores, _rules(spark, d), spoken.distinct()).where("reason like 'fuzzy%'")


def lexicon_events(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.events(_segments(spark, d), _rules(spark, d))


def lexicon_text(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.normalise(_segments(spark, d), _rules(spark, d))


def lexicon_frequent(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.frequent(lexicon_events(spark, d))


def lexicon_suggestions(spark: SparkSession, d: str) -> DataFrame:
    e = lexicon_events(spark, d).where("kind = 'suggest'").join(_segments(spark, d).select("seg_id", "rec_id", "start_sec"), "seg_id")
    return e.groupBy("rec_id", "from", "to").agg(F.min("start_sec").alias("first_at"))


def confidence_cuts(spark: SparkSession, d: str) -> DataFrame:
    return rank.cuts(_words(spark, d), KEYS)


def variant_clusters(spark: SparkSession, d: str) -> DataFrame:
    w = _words(spark, d).where("text is not null").withColumn("core", X.core(F.col("text")))
    return rank.variants(w, KEYS).select(*KEYS, "skeleton", F.array_join("variants", " ").alias("variants"))


def suspicious_words(spark: SparkSession, d: str) -> DataFrame:
    w = materialise(words.said(_segments(spark, d), _words(spark, d)).withColumn("core", X.core(F.col("text"))), "said_words")
    rows = rank.suspicious(w, lexicon.match(w.select("core"), _rules(spark, d)))
    return rows.withColumns({"signals": F.array_join("signals", ","), "variants": F.array_join("variants", " ")})


# ---- speakers, tokens, chunks


def _spans(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("engine = 'gigaam' and speaker is not null and start_sec is not null and end_sec is not null")
    return s.select("rec_id", "start_sec", "end_sec", F.col("speaker").alias("label"))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null")
    return speakers.renumber(speakers.assign(s.select("rec_id", "engine", "seg_id", "seg_idx", "start_sec", "end_sec"), _spans(spark, d)))


def speaker_assigned(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("seg_id", "label", "speaker")


def speaker_backfilled(spark: SparkSession, d: str) -> DataFrame:
    return speakers.backfill(_assigned(spark, d)).select("seg_id", "speaker")


def speaker_islands(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null").withColumnRenamed("speaker", "label")
    return speakers.islands(s)


def speaker_counts(spark: SparkSession, d: str) -> DataFrame:
    return speakers.speaker_counts(_assigned(spark, d))


def most_detailed(spark: SparkSession, d: str) -> DataFrame:
    return speakers.most_detailed(_segments(spark, d))


def token_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of sub-word tokens: each word of the table cut after its third letter, with whole times on the first part."""
    w = _words(spark, d).where("text is not null and start_sec is not null and end_sec is not null")
    cut = F.array(F.concat(F.lit(" "), F.substring("text", 1, 3)), F.substring("text", F.lit(4), F.length("text")))
    rows = w.select("seg_id", "word_idx", "word_id", F.col("conf").alias("p"), F.posexplode(cut).alias("half", "text"), intervals.to_ms(F.col("start_sec")).alias("from_ms"), intervals.to_ms(F.col("end_sec")).alias("to_ms"))
    t = rows.where("text <> ''").select("seg_id", (F.col("word_id") * 2 + F.col("half")).alias("tok_idx"), "text", "p", "from_ms", "to_ms")
    return tokens.words_of_tokens(t, ["seg_id"])


def speech_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).join(table(spark, d, "recordings").select("rec_id", F.col("duration_sec").alias("total")), "rec_id", "left")
    return chunks.speech_chunks(s.select("rec_id", "start_sec", "end_sec", "total"))


# ---- profile, clusters, notes, artifacts


def _silences(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").select("rec_id", *(intervals.to_ms(F.col(c)).alias(c) for c in ("start_sec", "end_sec")))
    gaps = intervals.periods_and_gaps(s, ["rec_id"], "start_sec", "end_sec").where("kind = 'gap'")
    return profile.silence(gaps.select("rec_id", ((F.col("to_ms") - F.col("from_ms")) / 1000.0).alias("seconds")))


def available() -> Column:
    """Backends that are there, made up from a recording's id."""
    n = F.col("rec_id") % 7
    return F.filter(F.array(F.when(n != 1, "mlx-whisper"), F.when(n % 2 == 0, "whisper-cpp"), F.when(n % 3 == 0, "faster-whisper")), lambda x: x.isNotNull())


def recording_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risks of each recording; the bit rate is that of the samples at 4 bits, the volume is made up from the id."""
    made_up = [(F.col("sample_rate") * 4 / 1000).cast("int").alias("bitrate_kbps"), (F.col("rec_id") % 10 - 35).cast("double").alias("mean_db")]
    r = table(spark, d, "recordings").select("rec_id", F.col("duration_sec").alias("duration"), "sample_rate", *made_up)
    s = _silences(spark, d).select("rec_id", F.col("total_seconds").alias("total_silence"), F.col("max_seconds").alias("max_silence"))
    rows = profile.with_backend(profile.risks(r.join(s, "rec_id", "left")).withColumn("available", available()))
    return rows.select("rec_id", F.array_join("warnings", ",").alias("warnings"), F.coalesce("no_condition", F.lit(False)).alias("no_condition"), "backend")


def recording_estimates(spark: SparkSession, d: str) -> DataFrame:
    return profile.estimates(table(spark, d, "recordings").select("rec_id", F.col("duration_sec").alias("duration")), "pyannote")


def embeddable_segments(spark: SparkSession, d: str) -> DataFrame:
    return profile.embeddable(_segments(spark, d)).select("seg_id")


def embedding_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.clusters(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


def release_notes(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "documents").select(F.col("doc_id").alias("release_id"), F.col("text").alias("body"))
    return releases.notes(r).select("release_id", F.array_join("notes", "|").alias("notes"))


def version_newer(spark: SparkSession, d: str) -> DataFrame:
    """Pairs "version A vs. version B" of the documents, by which is newer."""
    t = table(spark, d, "documents").withColumn("a", F.regexp_extract("text", r"version (\d+(?:\.\d+)*) vs\. version \d", 1)).withColumn("b", F.regexp_extract("text", r"vs\. version (\d+(?:\.\d+)*)", 1))
    return t.where("a <> '' and b <> ''").select("doc_id", "a", "b", X.is_newer(F.col("a"), F.col("b")).alias("newer"))


def srt_artifacts(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null and text is not null")
    return sinks.srt(s, KEYS)


def markdown_artifacts(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).where("start_sec is not null and end_sec is not null and text is not null")
    return sinks.markdown(s, KEYS)


_ALL = [
    p4_found, words_timed, words_spaced, words_between, words_windows, word_shapes, segment_words_joined, word_total, clock_formats, segment_violations, word_violations, diff_raw, diff_candidates,
    review_violations, review_first_violation, review_disagreements, review_severities, lexicon_rules, lexicon_matches, lexicon_fuzzy, lexicon_events, lexicon_text, lexicon_frequent, lexicon_suggestions,
    confidence_cuts, variant_clusters, suspicious_words, speaker_assigned, speaker_backfilled, speaker_islands, speaker_counts, most_detailed, token_words, speech_chunks, recording_risks, recording_estimates,
    embeddable_segments, embedding_clusters, release_notes, version_newer, srt_artifacts, markdown_artifacts,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return sql.SQL | sql_compare.SQL
