"""Speakers, tokens, chunks, profiles, clusters, reviews, notes, sources and sinks on known cases."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import text as X
from voxframe.operators import chunks, clustering, profile, releases, review, speakers, tokens
from voxframe.sources import publication, sinks, transcripts

SEG = "rec_id long, engine string, seg_id long, seg_idx int, start_sec double, end_sec double"
SPAN = "rec_id long, start_sec double, end_sec double, label string"


def assigned(spark, segments, spans, fill=False):
    s = spark.createDataFrame([(1, "g", i, i, a, b) for i, (a, b) in enumerate(segments)], SEG)
    p = spark.createDataFrame([(1, a, b, x) for a, b, x in spans], SPAN)
    df = speakers.renumber(speakers.assign(s, p))
    df = speakers.backfill(df) if fill else df
    return [r.speaker for r in df.orderBy("seg_idx").collect()]


def test_speakers(spark):
    s = [(0.0, 2.0), (2.0, 4.0), (4.0, 6.0)]
    assert assigned(spark, s, [(0.0, 3.5, "A"), (3.5, 6.0, "B")]) == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_01"]
    assert assigned(spark, s, [(3.5, 6.0, "B"), (0.0, 3.5, "A")]) == ["SPEAKER_00", "SPEAKER_00", "SPEAKER_01"]
    assert assigned(spark, [(0.0, 1.0), (5.0, 6.0)], [(5.0, 6.0, "A")]) == [None, "SPEAKER_00"]
    assert assigned(spark, [(0.0, 1.0), (5.0, 6.0), (9.0, 9.5)], [(5.0, 6.0, "A")], True) == ["SPEAKER_00"] * 3
    # equal overlaps: the span that begins first; no length: no overlap
    assert assigned(spark, [(0.0, 2.0), (1.0, 1.0)], [(1.0, 9.0, "late"), (-9.0, 1.0, "early")]) == ["SPEAKER_00", None]
    long = assigned(spark, [(0.0, 500.0)], [(float(i), i + 0.5, "x") for i in range(0, 400, 7)] + [(400.0, 500.0, "y")])
    assert long == ["SPEAKER_00"]


def test_islands(spark):
    df = spark.createDataFrame([(1, "g", i, i, 2.0 * i, 2.0 * i + 2, x) for i, x in enumerate(["7", "7", "3", None, "3"])], SEG + ", label string")
    got = sorted(tuple(r) for r in speakers.islands(df).select("start_sec", "end_sec", "label").collect())
    assert got == [(0.0, 4.0, "7"), (4.0, 10.0, "3")]


TOK = "seg long, tok_idx int, text string, p double, from_ms long, to_ms long"


def words_of(spark, toks):
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(toks)], TOK)
    return [(r.word, r.start_ms, r.end_ms, r.conf) for r in tokens.words_of_tokens(df, ["seg"]).orderBy("word_idx").collect()]


def test_tokens(spark):
    got = words_of(spark, [("[_BEG_]", 0.5, 0, 0), (" При", 0.6, 1000, 1200), ("вет", 0.8, 1200, 1400), (" мир", None, 1400, 1700), ("[_TT_120]", None, 0, 0)])
    assert got == [("Привет", 1000, 1400, 0.7), ("мир", 1400, 1700, None)]


def test_tokens_against_fold(spark):
    r = random.Random(1)
    toks = [(r.choice([" а", "б", " "]), 0.5, r.randrange(0, 500), r.randrange(0, 500)) for _ in range(300)]
    expected, cur, s, e = [], "", None, None

    def commit():
        if cur.strip():
            start = max(s, expected[-1][2]) if expected else s
            expected.append((cur.strip(), start, max(e, start)))

    for text, _, a, b in toks:
        if text.startswith(" ") and cur:
            commit()
            cur, s = "", None
        s = a if s is None else s
        e, cur = b, cur + text
    commit()
    assert [x[:3] for x in words_of(spark, toks)] == expected


def test_chunks_against_fold(spark):
    r = random.Random(2)
    data, t = [], 0.0
    for _ in range(300):
        t += r.choice([0.0, 0.3, 2.0, 30.0])
        n = r.choice([0.05, 1.0, 6.0, 70.0])
        data.append((t, t + n))
        t += n
    out, held, start, end = [], 0.0, 0.0, 0.0

    def close():
        k = int(held / 30.0) + 1 if held > 30.0 else 1
        out.extend((start + i * held / k, end if k == 1 else start + (i + 1) * held / k) for i in range(k))

    for s, e in data:
        if held == 0.0:
            start = s
        elif held > 0.2 and (held + (e - end) > 22.0 or held > 15.0):
            close()
            start = s
        end, held = e, e - start
    if held > 0.2:
        close()
    df = spark.createDataFrame([(7, a, b, None) for a, b in data] + [(8, 0.0, 0.1, None), (9, 5.0, 40.0, 36.0)], "rec_id long, start_sec double, end_sec double, total double")
    got = chunks.speech_chunks(df).orderBy("rec_id", "chunk").collect()
    assert [(round(r.start_sec, 6), round(r.end_sec, 6)) for r in got if r.rec_id == 7] == [(round(a, 6), round(b, 6)) for a, b in out]
    assert not [r for r in got if r.rec_id == 8]  # a last piece too short to keep
    assert [(r.start_sec, r.end_sec) for r in got if r.rec_id == 9] == [(5.0, 20.5), (20.5, 36.0)]


def test_profile(spark):
    kind = "rec_id int, duration double, total_silence double, max_silence double, sample_rate int, bitrate_kbps int, mean_db double, available array<string>"
    df = spark.createDataFrame([(1, 60.0, 0.0, 0.0, 16000, 128, -20.0, ["faster-whisper", "whisper-cpp"]), (2, 14400.0, 1800.0, 60.0, 8000, 32, -35.0, ["mlx-whisper"]), (3, 6000.0, None, None, None, None, None, [])], kind)
    got = {r.rec_id: r for r in profile.with_backend(profile.risks(df)).collect()}
    assert got[1].warnings == [] and got[1].backend == "whisper-cpp" and not got[1].no_condition
    assert got[2].warnings == ["very_long", "long_silence_block", "high_silence_ratio", "low_sample_rate", "low_bitrate", "quiet_audio", "mlx_only_no_beam"] and got[2].no_condition
    assert got[3].warnings == ["long"] and got[3].backend is None
    e = profile.estimates(df.where("rec_id = 1").withColumn("duration", F.lit(600.0)), backends=["whisper-cpp"]).collect()
    assert [(r.backend, r.estimate_seconds, r.estimate) for r in e] == [("whisper-cpp", 101.0, "~1.7 мин")]
    log = spark.createDataFrame([(1, "x silence_duration: 12.5"), (1, "silence_duration: bad"), (1, "silence_duration: 3.0")], "rec_id int, line string")
    assert [tuple(r) for r in profile.silence(profile.silence_lines(log)).collect()] == [(1, 1, 12.5, 12.5)]


def test_clusters(spark):
    rng = np.random.default_rng(0)
    centre = np.eye(8)[:3]
    x = np.concatenate([c + rng.normal(0, 0.05, (20, 8)) for c in centre])
    labels = clustering.choose(x)
    assert len(set(labels)) == 3 and all(len(set(labels[i * 20 : i * 20 + 20])) == 1 for i in range(3))
    assert set(clustering.choose(np.ones((10, 4)))) == {0}  # nothing to separate
    assert len(set(clustering.choose(x, k=2))) == 2 and list(clustering.choose(x[:1])) == [0]
    # average linkage against a plain version
    d = clustering.distances(rng.normal(size=(14, 5)))
    groups = [[i] for i in range(14)]
    while len(groups) > 4:
        a, b = min(((i, j) for i in range(len(groups)) for j in range(i)), key=lambda p: np.mean([d[u, v] for u in groups[p[0]] for v in groups[p[1]]]))
        groups[b] += groups.pop(a)
    got = clustering.average_linkage(d, {4})[4]
    assert {frozenset(g) for g in groups} == {frozenset(np.flatnonzero(got == k)) for k in set(got)}


def test_clusters_without_distances():
    rng = np.random.default_rng(4)
    for n, d, spread in [(2, 3, 1.0), (3, 2, 1.0), (60, 8, 0.2), (90, 5, 1.0), (200, 16, 0.4)]:
        x = np.eye(d)[rng.integers(0, min(d, 4), n)] + rng.normal(0, spread, (n, d))
        if n > 50:
            x[7], x[20:24] = 0.0, x[3]  # one without direction, some alike
        unit, full = clustering.units(x), clustering.distances(x)
        ks = set(range(1, min(n, 9) + 1))
        by_sums, plain = clustering.average_linkage_of_sums(unit, ks), clustering.average_linkage(full, ks)
        for k in ks:
            assert by_sums[k].tolist() == plain[k].tolist()
            if k > 1:
                assert clustering.silhouette_of_sums(unit, plain[k]) == pytest.approx(clustering.silhouette(full, plain[k]), abs=1e-9)
        assert clustering.choose(x, held=0).tolist() == clustering.choose(x).tolist()
        assert clustering.choose(x, k=2, held=0).tolist() == clustering.choose(x, k=2).tolist()
    assert set(clustering.choose(np.ones((10, 4)), held=0)) == {0}


def test_clusters_of_a_large_group(spark):
    n = clustering.MAX_GROUP + 200
    rng = np.random.default_rng(1)
    x = np.eye(4)[np.arange(n) % 3] + rng.normal(0, 0.05, (n, 4))
    rows = [(5, i, v.tolist()) for i, v in enumerate(x)] + [(6, n, [1.0, 0.0, 0.0, 0.0])]
    got = clustering.clusters(spark.createDataFrame(rows, "label long, vec_id long, embedding array<double>"), "label", "vec_id", "embedding").collect()
    assert {r.vec_id: r.cluster for r in got} == {i: i % 3 for i in range(n)} | {n: 0}


def decide(spark, *decisions):
    raw = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(decisions)], "rec_id long, ord int, decision string")
    c = spark.createDataFrame([(1, "D001", 5.0, 6.0), (1, "D002", 1.0, 2.0)], "rec_id long, id string, start_seconds double, end_seconds double")
    d = review.parse_decisions(raw)
    return sorted((r.candidate_id, r.rule) for r in review.violations(d, c).collect()), d, c


def differs(i, **more):
    return {"candidate_id": i, "verdict": "discrepancy", "severity": "minor", "categories": ["decision"], "review_reason": " why "} | more


def test_review(spark):
    same = {"candidate_id": "D002", "verdict": "same_meaning", "review_reason": "same"}
    broken, d, c = decide(spark, differs("D001"), same)
    assert broken == []
    r = review.disagreements(d, c).collect()
    assert [(x.candidate_id, x.status, x.priority, x.review_reason, x.start_seconds) for x in r] == [("D001", "pending_human_review", "minor", "why", 5.0)]
    assert tuple(review.severity_counts(d, c).first()) == (1, 2, 0, 0, 1)
    order = review.disagreements(*decide(spark, differs("D001"), differs("D002", severity="critical"))[1:]).orderBy("place").collect()
    assert [x.candidate_id for x in order] == ["D002", "D001"]
    for bad, rule in (
        (differs("D001", verdict="perhaps"), "verdict"), (differs("D001", final_text="x"), "unexpected_fields"), (differs("D001", severity="grave"), "severity"), (differs("D001", categories=[]), "categories"),
        (differs("D001", categories=["decision", "decision"]), "categories"), (differs("D001", categories=["name_or_term"]), "categories"), (differs("D001", review_reason="  "), "review_reason"), (same | {"candidate_id": "D001", "severity": "minor"}, "unexpected_fields"),
    ):
        assert decide(spark, bad, same)[0] == [("D001", rule)], bad
    assert decide(spark, differs("D999"), differs("D001"), same)[0] == [("D999", "unknown_candidate")]
    assert decide(spark, differs("D001"), differs("D001"), same)[0] == [("D001", "repeated_candidate")]
    assert decide(spark, same)[0] == [("D001", "uncovered_candidate")]
    assert review.first_violation(review.violations(decide(spark, differs("D999"), same)[1], c)).first().rule == "unknown_candidate"
    heads = [(1, json.dumps({"schema_version": 1, "comparison_file": "c", "decisions": []}), 1), (2, json.dumps({"schema_version": 2, "decisions": {}, "x": 1}), None), (3, "[]", 1)]
    got = {(r.rec_id, r.rule) for r in review.header_violations(spark.createDataFrame(heads, "rec_id int, review string, comparison_version int")).collect()}
    assert got == {(2, "unexpected_review_fields"), (2, "review_version"), (2, "comparison_version"), (2, "decisions_are_no_array"), (3, "review_is_no_object")}


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in "abcdef"[: len(values)])).select(column).first()[0]


def test_versions_and_notes(spark):
    for a, b, newer in (("0.2.0", "0.1.9", True), ("v1.0", "0.9.9", True), ("0.1.0", "0.1.0", False), ("0.1.0", "0.1.0.1", False), ("0.1", "0.1.0", False), (None, "1", False), ("1", "latest", False), ("1.10", "1.9-rc1", True)):
        assert one(spark, X.is_newer(F.col("a"), F.col("b")), a, b) is newer, (a, b)
    body = "Intro\n- **One** [link](http://x) `code`\n  wrapped line\n## Head\n* two\nplain\n+ three\n- " + "x" * 200 + "\n" + "\n".join(f"- n{i}" for i in range(20))
    df = spark.createDataFrame([(1, "v1.2", None, None, body), (2, None, "R", "u", None), (3, None, None, None, "- x")], "release_id int, tag_name string, name string, html_url string, body string")
    got = {r.release_id: r for r in releases.summaries(df, "page").collect()}
    assert got[1].notes[:3] == ["One link code wrapped line", "two", "three"] and len(got[1].notes) == 5 and len(got[1].notes[3]) == 120 and got[1].notes[3].endswith("…")
    assert (got[1].version, got[1].name, got[1].url) == ("1.2", "v1.2", "page") and (got[2].version, got[2].notes, got[2].url) == ("R", [], "u") and 3 not in got
    assert one(spark, X.switched_off(F.col("a")), " NO ") is False and one(spark, X.switched_off(F.col("a")), "1") is True
    assert one(spark, X.fresh(F.col("a"), F.lit(1000.0)), "900") is True and one(spark, X.fresh(F.col("a"), F.lit(1000.0)), "1100") is False and one(spark, X.fresh(F.col("a"), F.lit(1.0)), "x") is False


def test_clocks(spark):
    def at(f, x):
        return spark.range(1).select(f(F.lit(x))).first()[0]

    assert at(X.clock_from, 59.9) == "00:00:59" and at(X.clock_to, 59.1) == "00:01:00" and at(X.clock_from, -3.0) == "00:00:00"
    assert at(X.clock, 2.5) == "00:00:02" and at(X.clock, 3.5) == "00:00:04" and at(X.clock_srt, 59.9996) == "00:01:00,000" and at(X.clock_srt, 3661.25) == "01:01:01,250"
    assert at(X.estimate, 59.9) == "~59 сек" and at(X.estimate, 90.0) == "~1.5 мин" and at(X.estimate, 6000.0) == "~100 мин"


def test_sources(spark, tmp_path):
    doc = {"metadata": {"source_file": "a.wav"}, "segments": [{"start": 1.0, "end": 2.0, "text": "раз два", "words": [{"start": 1.0, "end": 1.5, "word": " раз "}]}, {"start": 0.5, "end": 0.1, "text": "x"}, {"start": 30.0, "end": 31.0, "text": ""}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(doc, ensure_ascii=False))
    docs = transcripts.transcripts(spark, str(path), "gigaam")
    assert [r.text for r in transcripts.words_of(transcripts.segments_of(docs)).collect()] == ["раз"]
    assert sorted((r.seg_idx, r.rule) for r in transcripts.structural_violations(docs).collect()) == [(1, "interval"), (1, "order")]
    name = docs.first().file
    src = spark.createDataFrame([(name, "b.wav", 10.0)], "file string, source_name string, duration double")
    assert sorted(r.rule for r in transcripts.content_violations(docs, src, require_words=True).collect()) == ["segment_end", "source_file", "words_missing"]
    lex = tmp_path / "l.json"
    lex.write_text(json.dumps({"version": 1, "terms": [{"canonical": "a", "policy": "auto", "ru_stems": ["б"]}]}, ensure_ascii=False))
    assert transcripts.lexicon_file(spark, str(lex)).first().ord == 0
    assert transcripts.word_list(spark, str(tmp_path / "absent")).count() == 0
    raw = tmp_path / "w.json"
    raw.write_text(json.dumps({"transcription": [{"text": " да", "offsets": {"from": 10, "to": 1500}, "tokens": [{"text": " да", "offsets": {"from": 10, "to": 900}, "p": 0.5}]}, {"text": "  ", "offsets": {"from": 0, "to": 1}}]}, ensure_ascii=False))
    assert tuple(transcripts.recogniser_segments(spark, str(raw)).select("start_sec", "end_sec", "text").first()) == (0.01, 1.5, "да") and transcripts.recogniser_tokens(spark, str(raw)).count() == 1
    rev = tmp_path / "r.review.json"
    rev.write_text(json.dumps({"schema_version": 1, "comparison_file": "c.json", "decisions": [{"verdict": "same_meaning"}]}))
    found = transcripts.reviews(spark, str(rev))
    assert found.first().comparison.endswith(f"{tmp_path.name}/c.json") and transcripts.decisions_of(found).first().decision == '{"verdict":"same_meaning"}'


def test_sinks(spark, tmp_path):
    kind = "rec_id int, seg_idx int, start_sec double, end_sec double, text string, speaker string, conf double"
    df = spark.createDataFrame([(1, 0, 0.0, 1.5, " a ", "S0", 0.5), (1, 1, 2.0, 3.0, "b", "S0", None), (1, 2, 3.0, 4.0, "c", None, None), (1, 3, 4.0, 5.0, "d", "S1", None)], kind)
    assert sinks.srt(df, ["rec_id"]).first().srt == "1\n00:00:00,000 --> 00:00:01,500\n[S0] a\n\n2\n00:00:02,000 --> 00:00:03,000\n[S0] b\n\n3\n00:00:03,000 --> 00:00:04,000\nc\n\n4\n00:00:04,000 --> 00:00:05,000\n[S1] d\n"
    assert sinks.markdown(df, ["rec_id"]).first().md == "**S0**\n[00:00:00] a\n[00:00:02] b\n[00:00:03] c\n\n**S1**\n[00:00:04] d\n"
    meta = spark.createDataFrame([(1, {"model": "m"})], "rec_id int, metadata map<string,string>")
    made = json.loads(sinks.transcript_json(df, ["rec_id"], meta).first().json)
    assert made["metadata"] == {"model": "m"} and [s["text"] for s in made["segments"]] == [" a ", "b", "c", "d"]
    sinks.write_texts(sinks.srt(df, ["rec_id"]), str(tmp_path / "out"), "rec_id", "srt")
    assert (tmp_path / "out" / "rec_id=1").exists()
    assert json.loads(sinks.review_template(spark.createDataFrame([(1, "c.json")], "rec_id int, comparison_file string")).first().json) == {"schema_version": 1, "comparison_file": "c.json", "decisions": []}
    assert sinks.output_paths("/x/a.review.json") == ("/x/a.disagreements.json", "/x/a.disagreements.md") and sinks.output_paths("/x/a.json", "/y/b.md") == ("/y/b.json", "/y/b.md")
    assert sinks.normalised_path("/x/a.transcript.json") == "/x/a.transcript.normalized.json"


def test_publish_is_all_or_nothing(spark, tmp_path, monkeypatch):
    def files():
        return {p.name: p.read_text() for p in tmp_path.iterdir()}

    old = {f"f{i}": f"old{i}" for i in range(0, 8, 2)}
    for name, text in old.items():
        (tmp_path / name).write_text(text)
    df = spark.createDataFrame([(f"f{i}", f"new{i}", 1) for i in range(8)], "name string, value string, extra int").repartition(3)
    for bad in (df.unionByName(df.limit(1)), df.withColumn("name", F.concat(F.lit("../"), "name")), df.withColumn("value", F.expr("if(name = 'f7', raise_error('broken'), value)"))):
        with pytest.raises(Exception, match="one name|no file name|broken"):
            publication.publish(bad, str(tmp_path))
        assert files() == old
    writer = publication.ArtifactWriter(str(tmp_path))
    staged = []
    for i in range(5):
        (writer.staging / str(i)).write_text(f"new{i}")
        staged.append((str(writer.staging / str(i)), f"f{i}"))
    with pytest.raises(FileNotFoundError):
        writer.commit([publication.Written([*staged, (str(writer.staging / "absent"), "f5")]), None])
    assert files() == old
    publication.publish(df, str(tmp_path))
    assert files() == {f"f{i}": f"new{i}" for i in range(8)}
    publication.publish(df.where("false"), str(tmp_path))
    assert len(files()) == 8


def test_join_words(spark):
    df = spark.createDataFrame([(1, ["Стоит", " 0", "10", "2", "33", ",", "4", "(", "да", ")", "", "."]), (2, []), (3, ["  "])], "i int, w array<string>")
    assert {r.i: r.t for r in df.select("i", X.join_words(F.col("w")).alias("t")).collect()} == {1: "Стоит 0 10 2 33, 4 (да).", 2: None, 3: None}
