"""The SQL (DuckDB) of the queries in this package that SQL can express."""

from __future__ import annotations

import unicodedata

from voxframe.llm import textform


def _plain(x: str) -> str:
    """Text without what can't be seen, with plain blanks, hyphens and widths, accents composed."""
    shown = f"regexp_replace(regexp_replace(regexp_replace({x}, '[\\p{{Cf}}\\x{{FE00}}-\\x{{FE0F}}\\x{{34F}}]', '', 'g'), '\\p{{Zs}}', ' ', 'g'), '[\\x{{2010}}\\x{{2011}}\\x{{FE63}}\\x{{FF0D}}]', '-', 'g')"
    return f"nfc_normalize(list_aggregate(list_transform(str_split({shown}, ''), lambda c: case when unicode(c) between 65281 and 65374 then chr(unicode(c) - 65248) else c end), 'string_agg', ''))"


def _alike(x: str) -> str:
    """A key that is equal for words that are equal in the one form: letters that look alike are Latin, case counts for nothing."""
    twins = {a.lower(): b.lower() for a, b in (textform.CYRILLIC_TO_LATIN | textform.GREEK_TO_LATIN | {"ё": "ë"}).items()}
    return f"nfc_normalize(translate(lower({_plain(x)}), '{''.join(twins)}', '{''.join(twins.values())}'))"


def _latin_with_marks() -> str:
    """Letters composed of a Latin letter that has a Cyrillic twin, and a mark."""
    letters = map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])
    return "".join(c for c in letters if len(n := unicodedata.normalize("NFD", c)) > 1 and n[0] in textform.LATIN_TO_CYRILLIC)


def _kinds(piece: str) -> str:
    """A piece of a word as digits: 1 Latin, 2 Cyrillic, 3 Greek letters with a twin, 6 such Latin ones with a mark, 4 other Latin, 5 other Cyrillic, 7 other letters."""
    sets = ("".join(textform.LATIN_TO_CYRILLIC), "".join(textform.CYRILLIC_TO_LATIN), "".join(textform.GREEK_TO_LATIN), _latin_with_marks())
    coded = f"translate({piece}, '{''.join(sets)}', '{''.join(d * len(x) for d, x in zip('1236', sets, strict=True))}')"
    for of, digit in ((r"[\x{400}-\x{4FF}]", "5"), (r"[A-Za-z\x{AA}\x{BA}\x{C0}-\x{24F}\x{1E00}-\x{1EFF}]", "4"), (r"\p{M}", ""), (r"\p{L}", "7")):
        coded = f"regexp_replace({coded}, '{of}', '{digit}', 'g')"
    return coded


# A piece beside letters of one alphabet: some letter is of the other.
_STRANGE = "'5[1236]*[136][1236]*5|^[1236]*[136][1236]*5|5[1236]*[136][1236]*$|4[1236]*[23][1236]*4|^[1236]*[23][1236]*4|4[1236]*[23][1236]*$|3'"
_CHANGED = f"""p as (select kind, row_id, lang, text, {_plain("text")} as plain from t),
  ws as (select kind, row_id, lang, unnest(regexp_extract_all(plain, '[\\p{{L}}\\p{{M}}]+(?:-[\\p{{L}}\\p{{M}}]+)*')) as word from p),
  ks as (select distinct lang, word, {_kinds("word")} as k from ws),
  pc as (select lang, word, k, unnest(str_split(k, '-')) as z from ks),
  tl as (select *, regexp_extract(k, '(?:^|-)([1237]*[456][1-7]*)', 1) as first from pc),
  ch as (select lang, word, bool_or(case when contains(z, '7') then false when contains(z, '5') and contains(z, '4') then regexp_matches(z, {_STRANGE}) when contains(z, '5') then regexp_matches(z, '[136]')
      when regexp_matches(z, '[46]') then regexp_matches(z, '[23]') when first <> '' and regexp_full_match(z, '1+|2+') then false
      when case when first <> '' then contains(first, '5') else lang = 'ru' end then regexp_matches(z, '[13]') else regexp_matches(z, '[23]') end) as changes from tl group by lang, word)"""

_WORDS = "regexp_extract_all(k, '[\\p{L}\\p{N}]+')"

SQL: dict[str, str] = {
    "p2_found": f"""with r as (select rec_id, min(lang) as lang from recordings group by rec_id),
  t as (select 'word' as kind, word_id as row_id, coalesce(lang, '') as lang, text from words left join r using (rec_id) where text is not null union all select 'segment', seg_id, coalesce(lang, ''), text from segments left join r using (rec_id) where text is not null),
  {_CHANGED}
select distinct kind, row_id from p where plain <> text union select distinct kind, row_id from ws join ch using (lang, word) where changes""",
    "p3_found": f"""with w as (select distinct word_id, rec_id, engine, start_sec, text from words where word_id is not null and start_sec is not null and text is not null and rec_id is not null),
  k as (select word_id, rec_id, engine, start_sec, regexp_replace(regexp_replace({_alike("text")}, '^[^\\p{{L}}\\p{{N}}]+', ''), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+$', '') as said from w),
  m as (select a.word_id as a, b.word_id as b, round(abs(a.start_sec - b.start_sec), 6) as d from k a join k b on a.rec_id = b.rec_id and a.said = b.said and a.engine = 'gigaam' and b.engine = 'whisper' and abs(a.start_sec - b.start_sec) < 0.41 where a.said <> ''),
  n as (select a, b from m where d <= 0.4 qualify row_number() over (partition by a order by d, b) = 1)
select distinct least(a, b) as word_id_a, greatest(a, b) as word_id_b from n""",
    "p7_found": f"""with d as (select distinct doc_id, {_alike("text")} as k from documents where doc_id is not null and text is not null), i as (select distinct item_id, {_alike("text")} as k from eval_items where item_id is not null and text is not null),
  dw as (select doc_id, {_WORDS} as w from d), iw as (select item_id, {_WORDS} as w from i), n as (select item_id, w, least(12, len(w)) as n from iw where len(w) > 0),
  ir as (select distinct item_id, n, array_to_string(w[a : a + n - 1], ' ') as run from (select *, unnest(range(1, len(w) - n + 2)) as a from n)),
  s as (select distinct n from n),
  dr as (select distinct doc_id, n, array_to_string(w[a : a + n - 1], ' ') as run from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as a from dw, s where len(w) >= n))
select distinct doc_id, item_id from dr join ir using (n, run)""",
}
