"""The SQL (DuckDB) of the queries on scans, documents, publication and settings."""

from __future__ import annotations

from voxframe.operators import rank, review
from voxframe.plans.sql import _HMS, _LOW, _S, _W, _core
from voxframe.plans.sql import SQL as CORE
from voxframe.plans.sql_compare import _CANDIDATES, _DECIDED, _EVENTS, _list
from voxframe.sources.sinks import _LABELS, _NONE, _NOTE, _TITLE

# Segments as a scan numbers them.
_N = f"{_S}, n as (select *, row_number() over (partition by rec_id, engine order by seg_idx) - 1 as i, round(start_sec, 3) as a, round(end_sec, 3) as b from s where text is not null)"
_T = "t as (select *, cast(round(start_sec * 1000) as bigint) as f, cast(round(end_sec * 1000) as bigint) as e, row_number() over (partition by rec_id order by seg_idx) - 1 as i from s where engine = 'whisper' and text is not null and start_sec is not null and end_sec is not null)"
_PLAIN = CORE["srt_artifacts"].replace("upper(trim(speaker, ' ')) as speaker", "null::varchar as speaker")
_PLAIN_MD = CORE["markdown_artifacts"].replace("upper(trim(speaker, ' ')) as speaker", "null::varchar as speaker")
_SEVERITIES = f"""sev as (select rec_id, reviewed, coalesce(critical, 0) as critical, coalesce(substantive, 0) as substantive, coalesce(minor, 0) as minor from (select rec_id, count(*) as reviewed from cand group by rec_id)
  left join (select rec_id, {", ".join(f"count(*) filter (severity = '{x}') as {x}" for x in review.SEVERITIES)} from dec where verdict = 'discrepancy' group by rec_id) using (rec_id)),
  dis as (select dec.rec_id, row_number() over (partition by dec.rec_id order by coalesce(list_position({_list(review.SEVERITIES)}, severity), 0), start_seconds, ord) as place, candidate_id, severity, array_to_string(categories, ', ') as categories,
    start_seconds, from_time, to_time, "precision", version_gigaam, version_whisper, trim(review_reason, ' ') as review_reason from dec join cand on cand.rec_id = dec.rec_id and cand.id = dec.candidate_id where verdict = 'discrepancy')"""
_NL = "chr(10)"

SQL: dict[str, str] = {
    "scan_transcripts": f"with {_N} select rec_id, engine, i as seg_idx, a as start_sec, b as end_sec, text, speaker, conf from n",
    "scan_lenient": f"with {_N} select rec_id, engine, i as seg_idx, coalesce(a, 0) as start_sec, coalesce(b, a, 0) as end_sec from n",
    "scan_structural_violations": f"""with {_N}, k as (select *, lag(a) over (partition by rec_id, engine order by i) as before from n)
select rec_id, engine, i as seg_idx, 'not_finite' as rule from k where a is null or b is null union all select rec_id, engine, i, 'interval' from k where a < 0 or b < a union all select rec_id, engine, i, 'order' from k where b is not null and a < before""",
    "scan_content_violations": f"""with {_N}, r as (select rec_id, source_file, duration_sec as d from recordings)
select distinct rec_id, engine, null as seg_idx, 'source_file' as rule from n where rec_id % 5 = 0 and rec_id in (select rec_id from r where source_file is not null)
union all select n.rec_id, engine, i, 'segment_end' from n join r using (rec_id) where d > 0 and b > d + greatest(2.0, d * 0.001)
union all select n.rec_id, engine, i, 'words_missing' from n join r using (rec_id) where regexp_matches(text, '[\\p{{L}}\\p{{N}}]')""",
    "scan_recogniser_segments": f"with {_S}, {_T} select rec_id, i as seg_idx, f / 1000.0 as start_sec, e / 1000.0 as end_sec, trim(text, ' ') as text from t where trim(text, ' ') <> ''",
    "scan_recogniser_tokens": f"with {_S}, {_T} select rec_id, i as seg_idx, 0 as tok_idx, ' ' || text as text, 0.5 as p, f as from_ms, e as to_ms from t where trim(text, ' ') <> ''",
    "scan_lexicon": CORE["lexicon_rules"],
    "scan_word_list": "select distinct lower(w) as word from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as w from documents)",
    "scan_reviews": """select rec_id, case rec_id % 6 when 1 then 'unexpected_review_fields' when 2 then 'review_version' when 3 then 'decisions_are_no_array' when 4 then 'review_is_no_object' else 'comparison_version' end as rule from recordings where rec_id % 6 <> 0
union all select rec_id, unnest(['decision 0 D001', 'decision 1 D002']) from recordings where rec_id % 6 not in (3, 4)""",
    "review_templates": """select rec_id, '{"schema_version":1,"comparison_file":"' || rec_id || '.comparison.json","decisions":[]}' as json from recordings""",
    "comparison_documents": f"""{_CANDIDATES} select rec_id, count(*) over (partition by rec_id) as candidate_count, "precision" as word_timing_precision, id, start_seconds, from_time as "from", version_gigaam as gigaam, version_whisper as whisper, priority_hint from cand""",
    "disagreement_reports": f"""{_DECIDED}, {_SEVERITIES},
  body as (select rec_id, string_agg('## ' || candidate_id || ' — ' || coalesce(case severity {" ".join(f"when '{k}' then '{v}'" for k, v in _LABELS.items())} end, '') || ': ' || categories || {_NL} || {_NL} || '- Интервал в исходной записи: `' || from_time || '–' || to_time || '`'
      || case when "precision" = 'segment' then ' (приблизительно: доступны только границы ASR-сегмента)' else '' end || {_NL} || {_NL} || '**GigaAM**' || {_NL} || {_NL} || '> ' || coalesce(version_gigaam, '— фрагмент отсутствует')
      || {_NL} || {_NL} || '**Whisper**' || {_NL} || {_NL} || '> ' || coalesce(version_whisper, '— фрагмент отсутствует') || {_NL} || {_NL} || '**Почему нужно проверить:** ' || review_reason || {_NL}, {_NL} order by place) as body from dis group by rec_id)
select rec_id, '{_TITLE}' || {_NL} || {_NL} || '- Исходная запись: `' || rec_id || '.wav`' || {_NL} || '- Проверено кандидатов: ' || reviewed || {_NL} || '- Требуют проверки человеком: ' || (critical + substantive + minor) || ' (критических: ' || critical
  || ', существенных: ' || substantive || ', незначительных: ' || minor || ')' || {_NL} || {_NL} || '{_NOTE}' || {_NL} || {_NL} || coalesce(body, '{_NONE}' || {_NL}) as md from sev left join body using (rec_id)""",
    "disagreement_documents": f"""{_DECIDED}, {_SEVERITIES} select rec_id, reviewed as reviewed_candidates, critical, substantive, minor, candidate_id as id, case when candidate_id is not null then 'pending_human_review' end as status, severity as priority, start_seconds, from_time as "from"
  from sev left join dis using (rec_id)""",
    "normalised_documents": f"""{_EVENTS}, rp as (select tk.*, case when known."to" is not null then lft || known."to" || substring(piece, length(lft) + length(tk.core) + 1) else piece end as nw from tk left join known on known.core = tk.core and known.kind = 'replace' and tk.core <> ''),
  tx as (select seg_id, string_agg(nw, '' order by pos) as text from rp group by seg_id),
  cn as (select rec_id, engine, count(*) filter (kind = 'replace') as replacements, count(*) filter (kind = 'suggest') as suggestions from ev join s using (seg_id) group by rec_id, engine),
  dc as (select rec_id, engine, string_agg(tx.text, '|' order by seg_idx) as texts from s join tx using (seg_id) group by rec_id, engine)
select rec_id, engine, 1 as lexicon_version, coalesce(replacements, 0) as replacements, coalesce(suggestions, 0) as suggestions, texts from dc left join cn using (rec_id, engine)""",
    "plain_artifacts": f"select a.rec_id, a.engine, a.srt, b.md from ({_PLAIN}) a join ({_PLAIN_MD}) b on a.rec_id = b.rec_id and a.engine = b.engine",
    "published_artifacts": f"select rec_id || '.' || engine || '.srt' as name, srt as value from ({CORE['srt_artifacts']})",
    "diarizers": """with e as (select rec_id, (rec_id & 1) > 0 as p, (rec_id & 2) > 0 as t, (rec_id & 4) > 0 as z, unnest(['auto', 'pyannote', 'resemblyzer', 'none']) as requested from recordings),
  c as (select *, case when requested in ('auto', 'pyannote') and p and t then 'pyannote' when requested in ('auto', 'resemblyzer') and z then 'resemblyzer' end as diarizer from e)
select rec_id, requested, diarizer, case when diarizer is null and requested <> 'none' then case when requested = 'pyannote' and p then 'token_missing' else 'not_installed' end end as error from c""",
    "estimate_reports": f"""with o as (select * from (values ('whisper-cpp', 0.16, 5.0), ('faster-whisper', 0.9, 8.0), ('mlx-whisper', 0.20, 6.0)) v(backend, rtf, load)),
  x as (select rec_id, duration_sec as d, backend, cast(load as double) + duration_sec * cast(rtf as double) + 8.0 + duration_sec * cast(0.05 as double) as e from recordings, o where duration_sec is not null and case backend when 'mlx-whisper' then rec_id % 7 <> 1
    when 'whisper-cpp' then (rec_id % 7) % 2 = 0 and rec_id % 4 <> 0 else (rec_id % 7) % 3 = 0 end)
select rec_id, {_HMS.format("cast(round_even(d, 0) as bigint)")} as duration_hms, backend, 'quality' as preset, 'large-v3' as model, 5 as beam_size, round_even(e, 1) as estimate_seconds,
  case when e < 60 then '~' || cast(cast(floor(e) as bigint) as varchar) || ' сек' when e / 60 < 10 then '~' || printf('%.1f', e / 60) || ' мин' else '~' || cast(cast(round_even(e / 60, 0) as bigint) as varchar) || ' мин' end as estimate, 'Максимальное качество (large-v3, beam=5)' as description from x""",
    "silence_logs": f"""with {_S}, k as (select rec_id, cast(printf('%.3f', end_sec - start_sec) as double) as d from s where start_sec is not null and end_sec is not null and end_sec >= start_sec)
select rec_id, count(*) as count, round_even(sum(d), 1) as total_seconds, round_even(max(d), 1) as max_seconds from k where d >= 5 group by rec_id""",
    "release_summaries": f"""with nt as ({CORE["release_notes"]}), r as (select doc_id as release_id, case when doc_id % 3 <> 0 then 'v1.' || doc_id when doc_id % 2 = 0 then 'Release ' || doc_id end as tag, case when doc_id % 2 = 0 then 'Release ' || doc_id end as name, doc_id from documents)
select release_id, regexp_replace(tag, '^v+', '') as version, tag, coalesce(name, tag) as name, case when doc_id % 5 = 0 then 'https://example.org/' || doc_id else 'https://example.org/releases' end as url, coalesce(notes, '') as notes from r left join nt using (release_id) where tag is not null""",
    "update_checks": """with k as (select rec_id, (['', '0', ' No ', 'off', '1', 'yes', 'FALSE'])[rec_id % 7 + 1] as setting, rec_id * 9000 - 20000 as age from recordings)
select rec_id, setting in ('1', 'yes') as off, rec_id % 5 <> 0 and age >= 0 and age < 86400 as fresh from k""",
    "filler_words": f"""with {_S}, {_W}, a as (select rec_id, engine, text from w where text is not null
    union all select rec_id, engine, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) from s where text is not null and seg_id not in (select seg_id from w where seg_id is not null)),
  c as (select rec_id, engine, {_LOW.format(_core("text"))} as filler from a) select rec_id, engine, filler, count(*) as n from c where list_contains({_list(rank.FILLERS)}, filler) group by rec_id, engine, filler""",
}

