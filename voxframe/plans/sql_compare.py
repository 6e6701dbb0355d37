"""The SQL (DuckDB) of the queries on comparisons, reviews, lexicon texts, suspicious words and speech chunks."""

from __future__ import annotations

from voxframe.operators import diff, rank, review
from voxframe.plans.sql import _HMS, _KEY, _LOW, _RULES, _S, _TIMED, _W, _core


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _joined(words: str) -> str:
    """What ``join_words`` makes of a list."""
    text = f"array_to_string(list_filter(list_transform({words}, lambda x: trim(x, ' ')), lambda x: x <> ''), ' ')"
    return f"nullif(trim(regexp_replace(regexp_replace({text}, '\\s+([,.;:!?%)\\]»])', '\\1', 'g'), '([(\\[«])\\s+', '\\1', 'g'), ' '), '')"


# Words of both transcripts in windows; e has each difference, with the words of either side.
_DIFF = f"""with recursive {_S}, {_W}, {_TIMED}, u as (select * from t where key <> ''),
  bare as (select s.*, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_-]+') as toks, coalesce(end_sec, start_sec) as e from s where start_sec is not null and text is not null and seg_id not in (select seg_id from u)),
  spread as (select rec_id, engine, seg_id, start_sec as ss, e as se, greatest(0.001, e - start_sec) / len(toks) as step, unnest(toks) as text, generate_subscripts(toks, 1) - 1 as word_idx from bare where len(toks) > 0),
  aw as (select rec_id, engine, seg_id, word_idx, start_sec, end_sec, text, key, null::double as ss, null::double as se from u
    union all select rec_id, engine, seg_id, word_idx, ss + word_idx * step, ss + (word_idx + 1) * step, text, {_KEY} as key, ss, se from spread),
  dur as (select k.rec_id, case when r.d > 0 then r.d else k.last end as duration from (select rec_id, max(end_sec) as last from aw group by rec_id) k left join (select rec_id, max(duration_sec) as d from recordings group by rec_id) r using (rec_id)),
  mw as (select aw.*, (start_sec + end_sec) / 2 as mid, duration, greatest(1, cast(ceil(duration / 20) as bigint)) as k from aw join dur using (rec_id)),
  ww as (select *, unnest(range(greatest(0, cast(ceil((mid - 23) / 20) as bigint)), least(k - 1, cast(floor((mid + 3) / 20) as bigint)) + 1)) as win from mw where mid between 0 and duration),
  p as (select *, row_number() over (partition by rec_id, win, engine order by start_sec, end_sec, seg_id, word_idx) - 1 as i from ww where engine in ('gigaam', 'whisper')),
  n as (select rec_id, win, max(duration) as duration, count(*) filter (engine = 'gigaam') as na, count(*) filter (engine = 'whisper') as nb from p group by rec_id, win),
  m0 as (select a.rec_id, a.win, a.i, b.i as j from p a join p b on a.rec_id = b.rec_id and a.win = b.win and a.key = b.key and a.engine = 'gigaam' and b.engine = 'whisper'),
  m1 as (select *, i - row_number() over (partition by rec_id, win, i - j order by i) as run from m0),
  m as (select rec_id, win, i, j, row_number() over (partition by rec_id, win, i - j, run order by i desc) as len from m1),
  rect(rec_id, win, al, ah, bl, bh, bi, bj, bn) as (
    select rec_id, win, 0::bigint, na, 0::bigint, nb, null::bigint, null::bigint, null::bigint from n
    union all
    select rec_id, win, case when side = 0 then al else i + c end, case when side = 0 then i else ah end, case when side = 0 then bl else j + c end, case when side = 0 then j else bh end, i, j, c
    from (select r.rec_id, r.win, r.al, r.ah, r.bl, r.bh, arg_max({{'i': m.i, 'j': m.j, 'c': least(m.len, r.ah - m.i, r.bh - m.j)}}, least(m.len, r.ah - m.i, r.bh - m.j) * 1000000000000 - m.i * 1000000 - m.j) as b
          from rect r join m on m.rec_id = r.rec_id and m.win = r.win and m.i >= r.al and m.i < r.ah and m.j >= r.bl and m.j < r.bh group by all) q, lateral (select b.i as i, b.j as j, b.c as c) z, (values (0), (1)) v(side)),
  blocks as (select distinct rec_id, win, bi as i, bj as j, bn as c from rect where bi is not null union all select rec_id, win, na, nb, 0 from n),
  gaps as (select rec_id, win, lag(i + c, 1, 0) over w as a0, i as a1, lag(j + c, 1, 0) over w as b0, j as b1 from blocks window w as (partition by rec_id, win order by i, j, c)),
  g as (select gaps.*, n.duration, win * 20.0 as core, least(n.duration, win * 20.0 + 20) as until from gaps join n using (rec_id, win) where a0 < a1 or b0 < b1),
  c as (select g.*, p.engine, p.i, p.start_sec, p.end_sec, p.text, p.key, p.ss, p.se from g join p on p.rec_id = g.rec_id and p.win = g.win and ((p.engine = 'gigaam' and p.i >= a0 and p.i < a1) or (p.engine = 'whisper' and p.i >= b0 and p.i < b1))),
  e00 as (select rec_id, win, a0, a1, b0, b1, core, until, duration, min(start_sec) as lo, max(end_sec) as hi,
      coalesce(list(text order by i) filter (engine = 'gigaam'), []) as a_text, coalesce(list(text order by i) filter (engine = 'whisper'), []) as b_text,
      coalesce(list(key order by i) filter (engine = 'gigaam'), []) as a_key, coalesce(list(key order by i) filter (engine = 'whisper'), []) as b_key, min(ss) as c0, max(se) as c1 from c group by all),
  e0 as (select *, greatest(0.0, core - 3, lo) as s, least(duration, until + 3, hi) as f from e00),
  e1 as (select *, (s + f) / 2 as middle from e0),
  e as (select rec_id, s as "start", greatest(f, s + 0.2) as "end", a_text, b_text, c0, c1, list_filter([
      case when len(list_filter(list_concat(a_key, b_key), lambda x: list_contains({_list(diff.TIME_WORDS)}, x))) > 0 then 'date_or_deadline' end,
      case when len(list_filter(list_concat(a_key, b_key), lambda x: regexp_matches(x, '^(?:{"|".join(diff.DECISION_STEMS)})'))) > 0 then 'decision_or_commitment' end,
      case when len(a_key) = 0 or len(b_key) = 0 then 'meaningful_omission' end,
      case when len(list_filter(list_concat(a_text, b_text), lambda x: regexp_matches(x, '[A-Za-zА-ЯЁ].*[A-ZА-ЯЁ]|[A-Za-z]'))) > 0 then 'name_or_term' end,
      case when list_filter(a_key, lambda x: list_contains({_list(diff.NEGATIONS)}, x)) <> list_filter(b_key, lambda x: list_contains({_list(diff.NEGATIONS)}, x)) and array_to_string(a_key, '') <> array_to_string(b_key, '') then 'negation_or_polarity' end,
      case when list_filter(a_key, lambda x: regexp_matches(x, '^\\d+(?:[.,]\\d+)?$')) <> list_filter(b_key, lambda x: regexp_matches(x, '^\\d+(?:[.,]\\d+)?$')) then 'number_or_unit' end], lambda x: x is not null) as signals
    from e1 where middle >= core and (middle < until or (until = duration and middle = until)))"""

# cand has the candidates, from the differences merged in order.
_CANDIDATES = f"""{_DIFF},
  o as (select *, row_number() over (partition by rec_id order by "start", "end", a_text, b_text) as n from e),
  f(rec_id, n, gs, ge, g) as (select rec_id, n, "start", "end", 1 from o where n = 1
    union all select o.rec_id, o.n, case when k then gs else o."start" end, case when k then greatest(ge, o."end") else o."end" end, case when k then g else g + 1 end
    from f join o on o.rec_id = f.rec_id and o.n = f.n + 1, lateral (select o."start" <= f.ge + 4 and greatest(f.ge, o."end") - f.gs <= 30 as k) z),
  d as (select rec_id, g, min("start") as s, max("end") as e, flatten(list(a_text order by n)) as a, flatten(list(b_text order by n)) as b, list_sort(list_distinct(flatten(list(signals)))) as signals, min(c0) as c0, max(c1) as c1 from o join f using (rec_id, n) group by rec_id, g),
  x0 as (select d.*, duration, greatest(0.0, coalesce(c0, s) - 3) as cs, coalesce(c1, e) + 3 as ce0, row_number() over (partition by rec_id order by s, e, a, b) as nth from d join dur using (rec_id)),
  x as (select *, greatest(case when duration > 0 then least(duration, ce0) else ce0 end, cs + 1) as ce from x0),
  v as (select x.rec_id, x.nth, aw.engine, list(aw.text order by aw.start_sec, aw.end_sec, aw.seg_id, aw.word_idx, aw.text) as said from x join aw on aw.rec_id = x.rec_id and (aw.start_sec + aw.end_sec) / 2 between cs and ce group by all),
  pr as (select rec_id, case when bool_or(ss is not null) then 'segment' else 'word' end as "precision" from aw group by rec_id),
  cand as (select x.rec_id, x.nth, printf('D%03d', x.nth) as id, round(cs, 3) as start_seconds, round(ce, 3) as end_seconds, {_HMS.format("cast(floor(cs) as bigint)")} as from_time, {_HMS.format("cast(ceil(ce) as bigint)")} as to_time, "precision",
      {_joined("va.said")} as version_gigaam, {_joined("vb.said")} as version_whisper, {_joined("a")} as changed_gigaam, {_joined("b")} as changed_whisper, array_to_string(signals, ',') as signals,
      case when list_has_any(signals, {_list(diff.CRITICAL)}) then 'critical' else 'review' end as priority_hint
    from x left join v va on va.rec_id = x.rec_id and va.nth = x.nth and va.engine = 'gigaam' left join v vb on vb.rec_id = x.rec_id and vb.nth = x.nth and vb.engine = 'whisper' left join pr on pr.rec_id = x.rec_id)"""

# dec has the decisions that the review queries make up of the candidates, by their numbers.
_DECIDED = f"""{_CANDIDATES},
  k as (select *, nth % 23 as q from cand where nth % 7 <> 0),
  dec as (select rec_id, nth as ord, case when q = 9 then 'X' || id else id end as candidate_id, case when q = 1 then 'unsure' when q in (2, 3, 14) or nth % 3 = 2 then 'same_meaning' else 'discrepancy' end as verdict,
      case when q = 4 then 'grave' else {_list(review.SEVERITIES)}[nth % 3 + 1] end as severity,
      case q when 5 then [] when 6 then ['decision', 'decision'] when 7 then ['opinion'] else ['other_semantic'] end as categories, case when q = 8 then '  ' else ' heard otherwise ' end as review_reason, q from k
    union all select rec_id, 1000000 + nth, id, 'same_meaning', null, null, 'again', -1 from k where q = 10),
  rows_ as (select dec.*, known.id is not null as known, row_number() over (partition by dec.rec_id, dec.candidate_id order by ord) as again from dec left join (select rec_id, id from cand) known on known.rec_id = dec.rec_id and known.id = dec.candidate_id),
  vio as (select rec_id, ord, candidate_id, unnest(list_filter([
      case when verdict = 'unsure' then 'verdict' end, case when (verdict = 'same_meaning' and q in (2, 3)) or q = 11 then 'unexpected_fields' end, case when not known then 'unknown_candidate' end,
      case when known and again > 1 then 'repeated_candidate' end, case when trim(review_reason, ' ') = '' then 'review_reason' end, case when verdict = 'discrepancy' and severity = 'grave' then 'severity' end,
      case when verdict = 'discrepancy' and q in (5, 6, 7) then 'categories' end], lambda x: x is not null)) as rule from rows_
    union all select rec_id, null, id, 'uncovered_candidate' from cand where not exists (select 1 from dec where dec.rec_id = cand.rec_id and dec.candidate_id = cand.id))"""


def _matched(cores: str) -> str:
    """CTEs that end with ``mt (core, canonical, reason)`` of the distinct cores of ``cores``."""
    return f"""kk as (select core, {_LOW.format("core")} as key from (select distinct core from {cores}) where core <> ''),
  st as (select kk.core, arg_min(r.canonical, (-length(r.key), r.ord)) as stem from kk join r on r.kind = 'stem' and starts_with(kk.key, r.key) and regexp_full_match(substring(kk.key, length(r.key) + 1), '[а-яё]{{0,4}}')
         where regexp_matches(kk.core, '[а-яёА-ЯЁ]') group by kk.core),
  jj as (select kk.core, g.canonical as suggest, e.canonical as exact, v.canonical as latin, st.stem, regexp_matches(kk.core, '[а-яёА-ЯЁ]') as cyr, regexp_matches(kk.core, '[A-Za-z]') as lat from kk
        left join r g on g.kind = 'suggest' and g.key = kk.key left join r e on e.kind = 'exact' and e.key = kk.key left join r v on v.kind = 'latin' and v.key = kk.key left join st on st.core = kk.core),
  mt as (select core, case when suggest is not null then null when exact is not null then exact when cyr then stem when lat then latin end as canonical,
    case when suggest is not null then 'suggest:' || suggest when exact is not null then 'exact' when cyr then case when stem is not null then 'stem' else '' end when lat and latin is not null then 'latin' else '' end as reason from jj)"""


def _cased(core: str) -> str:
    return (
        f"case when reason in ('stem', 'exact') and substring({core}, 1, 1) <> lower(substring({core}, 1, 1)) and substring(canonical, 1, 1) <> upper(substring(canonical, 1, 1)) "
        f"then upper(substring(canonical, 1, 1)) || substring(canonical, 2) else canonical end"
    )


# ev has the events, tk the tokens of all segments.
_EVENTS = f"""with {_S}, {_RULES},
  pc as (select seg_id, regexp_extract_all(text, '[ \\t\\n\\x0b\\f\\r]+|[^ \\t\\n\\x0b\\f\\r]+') as ps from s where text is not null),
  pp as (select seg_id, unnest(ps) as piece, generate_subscripts(ps, 1) - 1 as pos from pc),
  tk as (select seg_id, pos, piece, regexp_extract(piece, '^([«»\"''()\\[\\]{{}}.,;:!?…\\-—–]*)', 1) as lft, case when trim(piece) = '' then '' else {_core("piece")} end as core from pp),
  hy as (select core, unnest(str_split(core, '-')) as part, generate_subscripts(str_split(core, '-'), 1) - 1 as pos from (select distinct core from tk where contains(core, '-'))),
  al as (select core from tk union all select part from hy), {_matched("al")},
  whole as (select core, 'suggest' as kind, substring(reason, 9) as "to", reason from mt where starts_with(reason, 'suggest:')
    union all select core, 'replace', {_cased("core")}, reason from mt where canonical is not null and {_LOW.format("canonical")} <> {_LOW.format("core")}),
  sub as (select hy.core, hy.part, hy.pos, mt.canonical, mt.reason, coalesce(mt.canonical is not null and {_LOW.format("mt.canonical")} <> {_LOW.format("hy.part")}, false) as hit
    from hy join mt open on open.core = hy.core and open.canonical is null and open.reason = '' left join mt on mt.core = hy.part),
  comp as (select core, 'replace' as kind, string_agg(case when hit then {_cased("part")} else part end, '-' order by pos) as "to", 'compound/' || arg_max(reason, pos) filter (hit) as reason from sub group by core having bool_or(hit)),
  known as (select * from whole where core in (select core from tk) union all select * from comp),
  ev as (select seg_id, pos, kind, tk.core as "from", "to", reason from tk join known on known.core = tk.core where tk.core <> '')"""

_VARIANTS = f"""skel as (select distinct rec_id, engine, regexp_replace({_LOW.format("core")}, '[аеиоуыэюяaeiouy]|[^\\p{{L}}\\p{{N}}]', '', 'g') as skeleton, {_LOW.format("core")} as v from ac where length(core) >= 5),
  va as (select rec_id, engine, skeleton, list_sort(list(v)) as variants from skel group by rec_id, engine, skeleton having count(*) > 1)"""

SQL: dict[str, str] = {
    "diff_raw": f"""{_DIFF} select rec_id, "start", "end", array_to_string(a_text, ' ') as a, array_to_string(b_text, ' ') as b, array_to_string(signals, ',') as signals from e""",
    "diff_candidates": f"{_CANDIDATES} select * from cand",
    "review_violations": f"{_DECIDED} select * from vio",
    "review_first_violation": f"{_DECIDED} select * from vio qualify row_number() over (partition by rec_id order by ord nulls last, candidate_id, rule) = 1",
    "review_disagreements": f"""{_DECIDED} select dec.rec_id, row_number() over (partition by dec.rec_id order by coalesce(list_position({_list(review.SEVERITIES)}, severity), 0), start_seconds, ord) as place, candidate_id, 'pending_human_review' as status,
  severity as priority, array_to_string(categories, ',') as categories, start_seconds, end_seconds, trim(review_reason, ' ') as review_reason from dec join cand on cand.rec_id = dec.rec_id and cand.id = dec.candidate_id where verdict = 'discrepancy'""",
    "review_severities": f"""{_DECIDED} select rec_id, reviewed, coalesce(critical, 0) as critical, coalesce(substantive, 0) as substantive, coalesce(minor, 0) as minor from (select rec_id, count(*) as reviewed from cand group by rec_id)
  left join (select rec_id, {", ".join(f"count(*) filter (severity = '{x}') as {x}" for x in review.SEVERITIES)} from dec where verdict = 'discrepancy' group by rec_id) using (rec_id)""",
    "lexicon_events": f"""{_EVENTS} select * from ev""",
    "lexicon_text": f"""{_EVENTS}, rp as (select tk.*, case when known."to" is not null then lft || known."to" || substring(piece, length(lft) + length(tk.core) + 1) else piece end as nw from tk left join known on known.core = tk.core and known.kind = 'replace' and tk.core <> '')
  select seg_id, string_agg(nw, '' order by pos) as text from rp group by seg_id""",
    "lexicon_frequent": f"""{_EVENTS} select "from", "to", count(*) as n from ev where kind = 'replace' group by "from", "to" order by n desc, "from", "to" limit 25""",
    "lexicon_suggestions": f"""{_EVENTS} select s.rec_id, ev."from", ev."to", min(s.start_sec) as first_at from ev join s using (seg_id) where ev.kind = 'suggest' group by all""",
    "suspicious_words": f"""with {_S}, {_W}, {_RULES},
  sp as (select rec_id, engine, seg_id, start_sec, conf, regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+') as ps from s where text is not null and seg_id not in (select seg_id from w where seg_id is not null)),
  aw as (select w.rec_id, w.engine, w.word_id, w.seg_id, w.word_idx as pos, coalesce(w.start_sec, s.start_sec) as start_sec, w.text, w.conf from w left join s using (seg_id) where w.text is not null
    union all select rec_id, engine, null, seg_id, generate_subscripts(ps, 1) - 1, start_sec, unnest(ps), conf from sp),
  ac as (select *, {_core("text")} as core from aw), {_matched("ac")}, {_VARIANTS},
  cu as (select rec_id, engine, c[cast(floor(len(c) * 0.15) as bigint) + 1] as low_cut, c[cast(floor(len(c) * 0.05) as bigint) + 1] as very_low_cut from (select rec_id, engine, list_sort(list(conf)) as c from aw where conf is not null group by rec_id, engine)),
  q0 as (select ac.*, {_LOW.format("ac.core")} as low, mt.canonical, coalesce(mt.reason, '') as reason, low_cut, very_low_cut, list_filter(regexp_split_to_array(ac.core, '[-–—]'), lambda x: x <> '') as parts from ac left join mt on mt.core = ac.core
    left join cu on cu.rec_id = ac.rec_id and cu.engine = ac.engine where ac.core <> ''),
  q1 as (select *, regexp_matches(core, '[а-яёА-ЯЁ]') and regexp_matches(core, '[A-Za-z]') as mixed, len(list_filter(parts, lambda x: regexp_matches(x, '[а-яёА-ЯЁ]') and regexp_matches(x, '[A-Za-z]'))) > 0 as twin,
      len(list_filter(parts, lambda x: regexp_full_match(x, '[A-Za-z]+') and not list_contains({_list(rank.LATIN_OK)}, lower(x)))) > 0 as acronym, starts_with(reason, 'suggest:') as suggest,
      coalesce(conf <= very_low_cut, false) as very, coalesce(conf <= low_cut, false) as weak from q0),
  q2 as (select *, not mixed and regexp_full_match(core, '[A-Za-z][A-Za-z.-]*') and not list_contains({_list(rank.LATIN_OK)}, low) as latin,
      list_contains({_list(rank.FILLERS)}, low) or length(core) < 4 or (canonical is not null and not suggest) as skipped from q1),
  q3 as (select *, list_filter([case when mixed and twin then 'M' end, case when mixed and not twin and acronym then 'M-' end, case when latin then 'L' end, case when latin then 'L+' end, case when suggest then 'S' end, case when very then 'C' end,
      case when weak and not very then 'C-' end, case when weak and regexp_matches(core, '\\d') then 'N' end], lambda x: x is not null) as sig from q2 where not skipped),
  q4 as (select *, cast(list_sum(list_transform(sig, lambda x: case x when 'M' then 4 when 'S' then 3 when 'M-' then 2 when 'L' then 2 when 'C' then 2 else 1 end)) as int) as sc, regexp_replace(low, '[аеиоуыэюяaeiouy]|[^\\p{{L}}\\p{{N}}]', '', 'g') as skeleton from q3 where len(sig) > 0),
  q5 as (select q4.*, sc + case when variants is not null then 3 else 0 end as score, case when variants is not null then list_append(sig, 'V') else sig end as signals, coalesce(variants, []) as variants from q4 left join va using (rec_id, engine, skeleton)),
  q6 as (select rec_id, engine, low as key, arg_min({{'s': start_sec, 'w': core, 'c': conf, 'k': score, 'g': signals, 'v': variants}}, {{'a': coalesce(start_sec, -1e300), 'b': coalesce(word_id, -1), 'c': seg_id, 'd': pos}}) as x, count(*) as count from q5 group by rec_id, engine, low),
  q7 as (select rec_id, engine, key, x, count, row_number() over (partition by rec_id, engine order by x.k desc, count desc, x.s nulls first, key) as rank from q6)
select rec_id, engine, rank, {_HMS.format("cast(round_even(x.s, 0) as bigint)")} as at, x.s as start_sec, x.w as word, x.c as conf, x.k as score, array_to_string(x.g, ',') as signals, array_to_string(x.v, ' ') as variants, count from q7 where rank <= 40""",
    "lexicon_fuzzy": f"""with recursive {_RULES}, cs as (select {_core("text")} as core from words where text is not null), {_matched("cs")},
  en as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from documents),
  fm as (select key as form, canonical, ord from r where kind = 'fuzzy'),
  lf as (select jj.core, kk.key from jj join kk using (core) where not cyr and lat and suggest is null and exact is null and latin is null and length(kk.key) >= 5 and kk.key not in (select w from en where w is not null) and kk.key not in (select form from fm)),
  pr as (select core, key, form, canonical, ord, length(key) as la, length(form) as lb from lf join fm on substring(key, 1, 1) = substring(form, 1, 1) where 2 * least(length(key), length(form)) >= 0.82 * (length(key) + length(form)) and not starts_with(key, form) and not starts_with(form, key)),
  ca as (select core, form, generate_subscripts(str_split(key, ''), 1) - 1 as i, unnest(str_split(key, '')) as ch from pr),
  cb as (select core, form, generate_subscripts(str_split(form, ''), 1) - 1 as j, unnest(str_split(form, '')) as ch from pr),
  m0 as (select core, form, i, j, i - row_number() over (partition by core, form, i - j order by i) as run from ca join cb using (core, form, ch)),
  m as (select core, form, i, j, row_number() over (partition by core, form, i - j, run order by i desc) as len from m0),
  rect(core, form, al, ah, bl, bh, bi, bj, bn) as (
    select core, form, 0::bigint, la, 0::bigint, lb, null::bigint, null::bigint, null::bigint from pr
    union all
    select core, form, case when side = 0 then al else b.i + b.c end, case when side = 0 then b.i else ah end, case when side = 0 then bl else b.j + b.c end, case when side = 0 then b.j else bh end, b.i, b.j, b.c
    from (select r.core, r.form, r.al, r.ah, r.bl, r.bh, arg_max({{'i': m.i, 'j': m.j, 'c': least(m.len, r.ah - m.i, r.bh - m.j)}}, least(m.len, r.ah - m.i, r.bh - m.j) * 1000000000000 - m.i * 1000000 - m.j) as b
          from rect r join m on m.core = r.core and m.form = r.form and m.i >= r.al and m.i < r.ah and m.j >= r.bl and m.j < r.bh group by all) q, (values (0), (1)) v(side)),
  sm as (select core, form, sum(bn) as n from (select distinct core, form, bi, bj, bn from rect where bi is not null) group by core, form),
  rt as (select pr.*, 2.0 * sm.n / (la + lb) as ratio from pr join sm using (core, form) where 2.0 * sm.n / (la + lb) >= 0.82)
select core, arg_min(canonical, {{'a': -ratio, 'b': ord}}) as canonical, 'fuzzy:' || printf('%.2f', max(ratio)) as reason from rt group by core""",
    "speech_chunks": """with recursive s as (select distinct seg_id, rec_id, engine, start_sec, end_sec from segments),
  i as (select s.rec_id, greatest(0.0, start_sec) as s, least(end_sec, coalesce(duration_sec, end_sec)) as e from s left join recordings r on r.rec_id = s.rec_id where start_sec is not null and end_sec is not null),
  o as (select *, row_number() over (partition by rec_id order by s, e) as n from i),
  f(rec_id, n, a, e, held, g) as (select rec_id, n, s, e, e - s, 1 from o where n = 1
    union all select o.rec_id, o.n, case when k then o.s else f.a end, o.e, o.e - case when k then o.s else f.a end, case when k then g + 1 else g end
    from f join o on o.rec_id = f.rec_id and o.n = f.n + 1, lateral (select f.held = 0 or (f.held > 0.2 and (f.held + (o.e - f.e) > 22 or f.held > 15)) as k) z),
  c as (select rec_id, g, arg_max(a, n) as a, arg_max(e, n) as e from f group by rec_id, g),
  h as (select *, e - a as held from c where e - a > 0.2), k as (select *, case when held > 30 then cast(floor(held / 30) as bigint) + 1 else 1 end as k from h),
  p as (select rec_id, a, e, held, k, unnest(range(k)) as i from k),
  q as (select rec_id, a + i * (held / k) as start_sec, case when k = 1 then e else a + (i + 1) * (held / k) end as end_sec from p)
select rec_id, row_number() over (partition by rec_id order by start_sec, end_sec) - 1 as chunk, start_sec, end_sec from q""",
}
