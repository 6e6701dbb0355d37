"""The SQL (DuckDB) of the core queries, over the same tables."""

from __future__ import annotations

_W = "w as (select distinct word_id, rec_id, engine, seg_id, word_idx, start_sec, end_sec, text, conf from words)"
_S = "s as (select distinct seg_id, rec_id, engine, seg_idx, start_sec, end_sec, text, upper(trim(speaker, ' ')) as speaker, conf from segments)"
_FOLD = "list_aggregate(list_transform(str_split({0}, ''), lambda c: case when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248) else c end), 'string_agg', '')"
_KEY = "regexp_replace(replace(lower(nfc_normalize(" + _FOLD.format("text") + ")), 'ё', 'е'), '[^\\p{L}\\p{N}]+', '', 'g')"
_TIMED = (
    "t as (select word_id, rec_id, engine, seg_id, word_idx, start_sec, coalesce(end_sec, start_sec) as end_sec, text, " + _KEY + " as key from w "
    "where start_sec >= 0 and text is not null and coalesce(end_sec, start_sec) >= start_sec)"
)
_EDGE = "[«»\"''()\\[\\]{}.,;:!?…\\-—–]*"


def _core(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_EDGE}', ''), '{_EDGE}$', '')"


_LOW = "replace(lower({0}), 'ё', 'е')"
_HMS = "printf('%02d:%02d:%02d', {0} // 3600, ({0} // 60) % 60, {0} % 60)"
_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, ({0} // 60000) % 60, ({0} // 1000) % 60, {0} % 1000)"
_RULES = """n as (select *, row_number() over (order by canonical) as ord from terms),
  a as (select 'suggest' as kind, lower(unnest(latin_suggest)) as key, canonical, ord from n
    union all select case when coalesce(policy, 'auto') = 'auto' then 'exact' else 'suggest' end, replace(lower(unnest(ru_exact)), 'ё', 'е'), canonical, ord from n
    union all select 'stem', replace(lower(unnest(ru_stems)), 'ё', 'е'), canonical, ord from n where coalesce(policy, 'auto') = 'auto'
    union all select 'latin', lower(unnest(latin_variants)), canonical, ord from n where coalesce(policy, 'auto') = 'auto'
    union all select 'fuzzy', lower(canonical), canonical, ord from n where coalesce(policy, 'auto') = 'auto' and regexp_matches(canonical, '[A-Za-z]')),
  r as (select kind, key, canonical, ord from a where key <> '' qualify row_number() over (partition by kind, key order by case when kind in ('stem', 'fuzzy') then ord else -ord end) = 1)"""
_SPANS = "p as (select rec_id, start_sec as ps, end_sec as pe, speaker as label from s where engine = 'gigaam' and speaker is not null and start_sec < end_sec)"
_ASSIGNED = (
    _SPANS
    + """, q as (select * from s where start_sec <= end_sec or (start_sec is not null and end_sec is not null)),
  m as (select q.seg_id, p.label, least(q.end_sec, pe) - greatest(q.start_sec, ps) as o, ps, pe from q join p on q.rec_id = p.rec_id and q.start_sec < pe and ps < q.end_sec),
  b as (select seg_id, label from m where o > 0 qualify row_number() over (partition by seg_id order by o desc, ps, pe, label desc) = 1),
  l as (select q.*, b.label from q left join b using (seg_id)),
  f as (select rec_id, engine, label, row_number() over (partition by rec_id, engine order by min(seg_idx), min(seg_id)) - 1 as n from l where label is not null group by rec_id, engine, label),
  z as (select l.*, printf('SPEAKER_%02d', f.n) as new_speaker from l left join f on l.rec_id = f.rec_id and l.engine = f.engine and l.label = f.label)"""
)

SQL: dict[str, str] = {
    "p4_found": """
with s as (select rec_id, engine, upper(trim(speaker)) as speaker, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e
           from segments where rec_id is not null and engine is not null and speaker is not null and start_sec is not null and end_sec is not null),
     t as (select *, max(e) over (partition by rec_id, engine, speaker order by s, e rows between unbounded preceding and 1 preceding) as p from s where s <= e),
     r as (select *, sum(case when p >= s then 0 else 1 end) over (partition by rec_id, engine, speaker order by s, e rows unbounded preceding) as run from t),
     m as (select rec_id, engine, speaker, min(s) as from_ms, max(e) as to_ms from r group by rec_id, engine, speaker, run),
     g as (select *, lead(from_ms) over (partition by rec_id, engine, speaker order by from_ms) as nxt from m)
select rec_id, engine, speaker, 'period' as kind, from_ms, to_ms from m
union all select rec_id, engine, speaker, 'gap', to_ms, nxt from g where nxt - to_ms < 300000
""",
    "words_timed": f"with {_W}, {_TIMED} select word_id, rec_id, engine, start_sec, end_sec, key from t where key <> ''",
    "words_spaced": f"""with {_S}, k as (select rec_id, engine, seg_id, start_sec, coalesce(end_sec, start_sec) as e, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+')) as n from s where start_sec is not null and text is not null)
select rec_id, engine, seg_id, n, round(start_sec + n * (greatest(0.001, e - start_sec) / n), 3) as last_end from k where n > 0""",
    "words_between": f"with {_W}, {_TIMED} select rec_id, engine, count(*) as n, min(word_id) as first_id from t where key <> '' and (start_sec + end_sec) / 2 between 30 and 60 group by rec_id, engine",
    "words_windows": f"""with {_W}, {_TIMED}, u as (select * from t where key <> ''), k as (select rec_id, max(end_sec) as last from u group by rec_id),
  d as (select k.rec_id, case when r.duration_sec > 0 then r.duration_sec else k.last end as duration from k left join (select rec_id, max(duration_sec) as duration_sec from recordings group by rec_id) r on k.rec_id = r.rec_id),
  x as (select u.*, (start_sec + end_sec) / 2 as mid, greatest(1, cast(ceil(duration / 20) as bigint)) as k, duration from u join d using (rec_id)),
  y as (select *, unnest(range(greatest(0, cast(ceil((mid - 23) / 20) as bigint)), least(k - 1, cast(floor((mid + 3) / 20) as bigint)) + 1)) as win from x where mid between 0 and duration)
select rec_id, engine, win, count(*) as n, cast(sum(word_id) as bigint) as ids from y group by rec_id, engine, win""",
    "word_shapes": f"""with t as (select distinct text, regexp_extract(text, '^({_EDGE})', 1) as left_edge, {_core("text")} as core from words where text is not null)
select text, left_edge, core, substring(text, length(left_edge) + length(core) + 1) as right_edge, regexp_replace({_LOW.format("core")}, '[аеиоуыэюяaeiouy]|[^\\p{{L}}\\p{{N}}]', '', 'g') as skeleton, {_LOW.format("core")} as low,
  len(list_filter(regexp_split_to_array(core, '[-–—]'), lambda p: regexp_matches(p, '[а-яёА-ЯЁ]') and regexp_matches(p, '[A-Za-z]'))) > 0 as mixed from t""",
    "segment_words_joined": f"""with {_W}, k as (select seg_id, string_agg(trim(text, ' '), ' ' order by word_idx, word_id) filter (trim(text, ' ') <> '') as t from w where text is not null group by seg_id)
select seg_id, nullif(trim(regexp_replace(regexp_replace(coalesce(t, ''), '\\s+([,.;:!?%)\\]»])', '\\1', 'g'), '([(\\[«])\\s+', '\\1', 'g'), ' '), '') as joined from k""",
    "word_total": f"with {_S} select rec_id, engine, cast(sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0b\\f\\r]+'))) as bigint) as words, bool_or(conf is not null) as has_confidence from s group by rec_id, engine",
    "clock_formats": f"""with {_S}, k as (select seg_id, cast(floor(start_sec) as bigint) as a, cast(ceil(end_sec) as bigint) as b, cast(round_even(start_sec, 0) as bigint) as c, cast(round_even(end_sec * 1000, 0) as bigint) as m from s where start_sec is not null and end_sec is not null)
select seg_id, {_HMS.format("a")} as t_from, {_HMS.format("b")} as t_to, {_HMS.format("c")} as t_round, {_SRT.format("m")} as t_srt from k""",
    "segment_violations": f"""with {_S}, k as (select *, lag(start_sec) over (partition by rec_id, engine order by seg_idx) as before from s)
select rec_id, engine, seg_idx, 'not_finite' as rule from k where start_sec is null or end_sec is null
union all select rec_id, engine, seg_idx, 'interval' from k where start_sec < 0 or end_sec < start_sec
union all select rec_id, engine, seg_idx, 'order' from k where end_sec is not null and start_sec < before""",
    "word_violations": f"""with {_W}, k as (select *, lag(start_sec) over (partition by rec_id, engine, seg_id order by word_idx) as before from w)
select rec_id, engine, seg_id, word_idx, 'word_not_finite' as rule from k where start_sec is null or end_sec is null
union all select rec_id, engine, seg_id, word_idx, 'word_interval' from k where end_sec is not null and start_sec is not null and (start_sec < 0 or end_sec < start_sec or coalesce(start_sec < before, false))""",
    "lexicon_rules": f"with {_RULES} select kind, key, canonical from r",
    "lexicon_matches": f"""with {_RULES}, c as (select distinct {_core("text")} as core from words where text is not null), k as (select core, {_LOW.format("core")} as key from c where core <> ''),
  st as (select k.core, arg_min(r.canonical, (-length(r.key), r.ord)) as stem from k join r on r.kind = 'stem' and starts_with(k.key, r.key) and regexp_full_match(substring(k.key, length(r.key) + 1), '[а-яё]{{0,4}}')
         where regexp_matches(k.core, '[а-яёА-ЯЁ]') group by k.core),
  j as (select k.core, g.canonical as suggest, e.canonical as exact, v.canonical as latin, st.stem, regexp_matches(k.core, '[а-яёА-ЯЁ]') as cyr, regexp_matches(k.core, '[A-Za-z]') as lat from k
        left join r g on g.kind = 'suggest' and g.key = k.key left join r e on e.kind = 'exact' and e.key = k.key left join r v on v.kind = 'latin' and v.key = k.key left join st on st.core = k.core)
select core, case when suggest is not null then null when exact is not null then exact when cyr then stem when lat then latin end as canonical,
  case when suggest is not null then 'suggest:' || suggest when exact is not null then 'exact' when cyr then case when stem is not null then 'stem' else '' end when lat and latin is not null then 'latin' else '' end as reason from j""",
    "confidence_cuts": f"""with {_W}, k as (select rec_id, engine, list_sort(list(conf)) as c from w where conf is not null group by rec_id, engine)
select rec_id, engine, c[cast(floor(len(c) * 0.15) as bigint) + 1] as low_cut, c[cast(floor(len(c) * 0.05) as bigint) + 1] as very_low_cut from k""",
    "variant_clusters": f"""with {_W}, c as (select rec_id, engine, {_core("text")} as core from w where text is not null),
  k as (select distinct rec_id, engine, regexp_replace({_LOW.format("core")}, '[аеиоуыэюяaeiouy]|[^\\p{{L}}\\p{{N}}]', '', 'g') as skeleton, {_LOW.format("core")} as v from c where length(core) >= 5)
select rec_id, engine, skeleton, string_agg(v, ' ' order by v) as variants from k group by rec_id, engine, skeleton having count(*) > 1""",
    "speaker_assigned": f"with {_S}, {_ASSIGNED} select seg_id, label, new_speaker as speaker from z",
    "speaker_backfilled": f"""with {_S}, {_ASSIGNED} select seg_id, coalesce(last_value(new_speaker ignore nulls) over (partition by rec_id, engine order by seg_idx, seg_id rows between unbounded preceding and current row),
  first_value(new_speaker ignore nulls) over (partition by rec_id, engine order by seg_idx, seg_id rows between current row and unbounded following)) as speaker from z""",
    "speaker_islands": f"""with {_S}, k as (select *, case when lag(speaker) over (partition by rec_id, engine order by seg_idx, seg_id) = speaker then 0 else 1 end as new from s where start_sec is not null and end_sec is not null and speaker is not null),
  r as (select *, sum(new) over (partition by rec_id, engine order by seg_idx, seg_id rows unbounded preceding) as run from k)
select rec_id, engine, speaker as label, arg_min(start_sec, seg_idx) as start_sec, max(end_sec) as end_sec from r group by rec_id, engine, run, speaker""",
    "speaker_counts": f"with {_S}, {_ASSIGNED} select rec_id, engine, count(distinct label) as speakers from z group by rec_id, engine",
    "most_detailed": f"with {_S}, k as (select rec_id, engine, count(*) as segments from s group by rec_id, engine) select rec_id, engine, segments from k qualify row_number() over (partition by rec_id order by segments desc, engine) = 1",
    "token_words": f"""with {_W}, k as (select seg_id, word_id, trim(text, ' ') as word, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e, conf from w
    where text is not null and start_sec is not null and end_sec is not null and trim(text, ' ') <> ''),
  m as (select *, max(greatest(s, e)) over (partition by seg_id order by word_id rows unbounded preceding) as end_ms from k)
select seg_id, row_number() over (partition by seg_id order by word_id) - 1 as word_idx, greatest(s, coalesce(lag(end_ms) over (partition by seg_id order by word_id), s)) as start_ms, end_ms, word, round_even(conf, 4) as conf from m""",
    "recording_risks": """
with i as (select rec_id, cast(round(start_sec * 1000) as bigint) as s, cast(round(end_sec * 1000) as bigint) as e from segments where start_sec is not null and end_sec is not null),
  t as (select *, max(e) over (partition by rec_id order by s, e rows between unbounded preceding and 1 preceding) as p from i where s <= e),
  g as (select rec_id, (s - p) / 1000.0 as sec from t where s > p and s - p >= 5000),
  h as (select rec_id, round_even(sum(sec), 1) as total, round_even(max(sec), 1) as most from g group by rec_id),
  x as (select r.rec_id, r.duration_sec as d, r.sample_rate as sr, cast(floor(r.sample_rate * 4 / 1000.0) as int) as br, r.rec_id % 10 - 35 as db, case when (r.rec_id % 7) % 2 = 0 then 'whisper-cpp' when (r.rec_id % 7) % 3 = 0 then 'faster-whisper' when r.rec_id % 7 <> 1 then 'mlx-whisper' end as backend, h.total, h.most from recordings r left join h using (rec_id)),
  y as (select rec_id, coalesce(most >= 30, false) as block, coalesce(total / nullif(d, 0) > 0.10, false) as ratio, coalesce(d >= 9000, false) as vl, coalesce(d >= 5400 and d < 9000, false) as lg, coalesce(sr > 0 and sr <= 8000, false) as low, coalesce(br > 0 and br < 64, false) as lb, coalesce(db < -30, false) as quiet, backend from x)
select rec_id, concat_ws(',', case when vl then 'very_long' end, case when lg then 'long' end, case when block then 'long_silence_block' end, case when ratio then 'high_silence_ratio' end, case when low then 'low_sample_rate' end, case when lb then 'low_bitrate' end, case when quiet then 'quiet_audio' end, case when backend = 'mlx-whisper' then 'mlx_only_no_beam' end) as warnings,
  block or ratio as no_condition, backend from y""",
    "recording_estimates": """
with o as (select * from (values ('whisper-cpp', 0.16, 5.0), ('faster-whisper', 0.9, 8.0), ('mlx-whisper', 0.20, 6.0)) v(backend, rtf, load)),
  x as (select rec_id, backend, cast(load as double) + duration_sec * cast(rtf as double) + 25.0 + duration_sec * cast(0.12 as double) as e from recordings, o where duration_sec is not null)
select rec_id, backend, round_even(e, 1) as estimate_seconds, case when e < 60 then '~' || cast(cast(floor(e) as bigint) as varchar) || ' сек' when e / 60 < 10 then '~' || printf('%.1f', e / 60) || ' мин' else '~' || cast(cast(round_even(e / 60, 0) as bigint) as varchar) || ' мин' end as estimate from x""",
    "embeddable_segments": f"with {_S} select seg_id from s where end_sec - start_sec >= 0.6 and floor(end_sec * 16000) - floor(start_sec * 16000) >= 6400",
    "release_notes": """
with l as (select doc_id as release_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r')) as line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\n|\\r'), 1) as pos from documents),
  f as (select *, regexp_matches(trim(line, ' '), '^[-*+]\\s+\\S') as bullet from l),
  g as (select *, not bullet and trim(line, ' ') <> '' and regexp_matches(line, '^\\s') as goes_on from f),
  p as (select *, sum(case when goes_on then 0 else 1 end) over (partition by release_id order by pos rows unbounded preceding) as part from g),
  b as (select release_id, part, string_agg(trim(line, ' '), ' ' order by pos) as raw from p group by release_id, part having bool_or(bullet)),
  n as (select release_id, part, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw, ' '), '^[-*+]\\s+', ''), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '`|\\*\\*', '', 'g'), '\\s+', ' ', 'g'), ' ') as note from b),
  c as (select release_id, part, case when length(note) > 120 then rtrim(substring(note, 1, 119), ' ') || '…' else note end as note from n where note <> ''),
  r as (select *, row_number() over (partition by release_id order by part) as k from c)
select release_id, string_agg(note, '|' order by part) as notes from r where k <= 5 group by release_id""",
    "version_newer": """
with t as (select doc_id, regexp_extract(text, 'version (\\d+(?:\\.\\d+)*) vs\\. version \\d', 1) as a, regexp_extract(text, 'vs\\. version (\\d+(?:\\.\\d+)*)', 1) as b from documents),
  v as (select doc_id, a, b, list_transform(str_split(a, '.'), lambda x: cast(x as bigint)) as va, list_transform(str_split(b, '.'), lambda x: cast(x as bigint)) as vb from t where a <> '' and b <> '')
select doc_id, a, b, list_resize(va, greatest(len(va), len(vb)), 0) > list_resize(vb, greatest(len(va), len(vb)), 0) as newer from v""",
    "srt_artifacts": f"""with {_S}, k as (select *, row_number() over (partition by rec_id, engine order by seg_idx) as n, cast(round_even(start_sec * 1000, 0) as bigint) as a, cast(round_even(end_sec * 1000, 0) as bigint) as b from s
  where start_sec is not null and end_sec is not null and text is not null)
select rec_id, engine, string_agg(n || chr(10) || {_SRT.format("a")} || ' --> ' || {_SRT.format("b")} || chr(10) || case when coalesce(speaker, '') <> '' then '[' || speaker || '] ' else '' end || trim(text, ' ') || chr(10), chr(10) order by n) as srt from k group by rec_id, engine""",
    "markdown_artifacts": f"""with {_S}, k as (select *, last_value(nullif(speaker, '') ignore nulls) over (partition by rec_id, engine order by seg_idx rows between unbounded preceding and 1 preceding) as before, cast(round_even(start_sec, 0) as bigint) as c from s
  where start_sec is not null and end_sec is not null and text is not null),
  l as (select rec_id, engine, seg_idx, case when coalesce(speaker, '') <> '' and (before is null or before <> speaker) then chr(10) || '**' || speaker || '**' || chr(10) else '' end || '[' || {_HMS.format("c")} || '] ' || trim(text, ' ') as line from k)
select rec_id, engine, trim(regexp_replace(string_agg(line, chr(10) order by seg_idx), '^\\n', ''), ' ') || chr(10) as md from l group by rec_id, engine""",
}
