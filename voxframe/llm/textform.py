"""Bringing text to one form, so that what looks equal is equal (problem 2).

In the form there are no invisible characters, every blank is U+0020 and every
hyphen U+002D, full-width characters are plain, an accent is composed with its
letter where such a letter exists, and each word's letters belong to one
alphabet. Pieces of a word in different alphabets ("QR-код") keep them.

Most text is already in this form. A quick check runs inside the JVM and passes such
rows by. It goes by properties of the characters, taken by rule from the Unicode
database: a character is unstable if it has no place in the form (normalisation
quick check "no", or folded here), may compose with what comes before it (quick
check "maybe"), may change places with it (a combining class), or has a twin in
another alphabet; so are neighbours of two alphabets and words of twins alone.

The others go to an Arrow-batched function. It isolates the segments that hold
something unstable, each up to the next normalisation boundaries (characters that
neither compose nor belong to a word), normalises those and splices them into the
unchanged rest.

Null text stays null, empty text stays empty; repeated rows are treated alike.
"""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxframe.functions.arrow import map_batches

# Letters that look alike. Cyrillic letter -> Latin letter.
CYRILLIC_TO_LATIN = dict(zip("аеорсухАВЕКМНОРСТХУіѕјІЅЈ", "aeopcyxABEKMHOPCTXYisjISJ", strict=True))
# Greek letter -> Latin letter.
GREEK_TO_LATIN = dict(zip("οαρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "oapyABEZHIKMNOPTYX", strict=True))
# Letters of other alphabets and of phonetic writing -> Latin letter; a word with more letters of such an alphabet keeps them.
OTHER_TO_LATIN = dict(zip("ԁԛԝһӏԜԚҺӀօսհոցɡɑ", "dqwhlWQHIouhngga", strict=True))
#: Latin letters that stand for a Cyrillic one; i, s and j never do in Russian words.
LATIN_TO_CYRILLIC = {v: k for k, v in CYRILLIC_TO_LATIN.items() if v not in "isjISJ"}
TO_LATIN = str.maketrans(CYRILLIC_TO_LATIN | GREEK_TO_LATIN)
TO_CYRILLIC = str.maketrans(LATIN_TO_CYRILLIC | {k: LATIN_TO_CYRILLIC[v] for k, v in GREEK_TO_LATIN.items() if v in LATIN_TO_CYRILLIC})
_OTHERS, _FROM_OTHERS = frozenset(OTHER_TO_LATIN), str.maketrans(OTHER_TO_LATIN)

_WEAK_LATIN = "".join(LATIN_TO_CYRILLIC)
_WEAK_CYRILLIC = "".join(CYRILLIC_TO_LATIN)
_WEAK = _WEAK_LATIN + _WEAK_CYRILLIC + "".join(GREEK_TO_LATIN)
def _folding() -> dict[int, str | None]:
    """Blanks, hyphens, full-width and invisible characters, by rule from the Unicode database."""
    fold: dict[int, str | None] = {}
    for cp in [*range(0x7F, 0x3100), *range(0xFE00, 0x10000), *range(0xE0000, 0xE01F0)]:
        ch = chr(cp)
        if unicodedata.category(ch) == "Zs":
            fold[cp] = " "
        elif unicodedata.category(ch) == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp or cp == 0x34F:
            fold[cp] = None
        elif unicodedata.decomposition(ch).startswith("<wide>"):
            fold[cp] = unicodedata.normalize("NFKC", ch)
    return fold | dict.fromkeys((0x2010, 0x2011, 0xFE63, 0xFF0D), "-")


_FOLD = _folding()


def unstable() -> str:
    """Ranges of the characters that may not be in the form where they stand, for a character class."""
    second = {ord(n[-1]) for n in (unicodedata.normalize("NFD", chr(cp)) for cp in range(0xA0, 0x20000)) if len(n) > 1}  # what composes with something before it
    second |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}
    foreign = {ord(c) for c in [*GREEK_TO_LATIN, *OTHER_TO_LATIN, *CYRILLIC_TO_LATIN] if not "А" <= c <= "я"}
    own = [*range(0x7F, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]
    found = [cp for cp in own if cp in _FOLD or cp in second or cp in foreign or unicodedata.combining(chr(cp)) or unicodedata.normalize("NFC", chr(cp)) != chr(cp)]
    ranges: list[list[int]] = []
    for cp in found:
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in ranges)


# Stable characters that most text consists of; they are passed by before the longer class is tried.
_PLAIN = r"\x20-\x7E\n\r\tÀ-ÖØ-öø-ÿА-Яа-яЁё«»“”„‘’…–—№°§©"
# The same patterns hold in Java and in Python's regex.
_OTHER = rf"[^{_PLAIN}](?<=[{unstable()}])"
_MIXED = r"\p{IsLatin}\p{IsCyrillic}|\p{IsCyrillic}\p{IsLatin}"
_LOOKALIKE_LATIN = rf"(?<![\p{{L}}\p{{M}}])[{_WEAK_LATIN}]+(?![\p{{L}}\p{{M}}])"
_LOOKALIKE_CYRILLIC = rf"(?<![\p{{L}}\p{{M}}])[{_WEAK_CYRILLIC}]+(?![\p{{L}}\p{{M}}])"
_SUSPECT_RU = regex.compile(f"{_OTHER}|{_MIXED}|{_LOOKALIKE_LATIN}")
_SUSPECT_ANY = regex.compile(f"{_OTHER}|{_MIXED}|{_LOOKALIKE_CYRILLIC}")
# Up to what neither composes nor belongs to a word: letters, marks and hyphens, what is unstable, and what stands before that.
_SEGMENT = regex.compile(rf"(?:[\p{{L}}\p{{M}}\-]|{_OTHER}|.(?={_OTHER}))+")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:-[\p{L}\p{M}]+)*")
_MARK = regex.compile(r"\p{M}+")


def fold(text: str) -> str:
    """Plain blanks, hyphens and widths, and nothing invisible; letters and accents as they were."""
    return text.translate(_FOLD)


def _script(ch: str) -> str:
    """c or l: a letter of that alphabet alone; w: one with a twin; o: any other letter."""
    if ch in _WEAK:
        return "w"
    if "Ѐ" <= ch <= "ӿ":
        return "c"
    if ch < "ɐ":
        return "l"
    return "o"


def _own(ch: str) -> str:
    return "c" if "Ѐ" <= ch <= "ӿ" else "l" if ch < "Ͱ" else "g"


def _kinds(piece: str) -> set[str]:
    """Scripts of a decomposed piece's letters; x: a Latin letter with a mark, which a Cyrillic word may hold by mistake."""
    out = set()
    for i, c in enumerate(piece):
        if unicodedata.combining(c):
            continue
        kind = _script(c)
        if kind == "w" and i + 1 < len(piece) and unicodedata.combining(piece[i + 1]) and len(unicodedata.normalize("NFC", piece[i : i + 2])) == 1:
            kind = "c" if _own(c) == "c" else "x"
        out.add(kind)
    return out


def _piece(piece: str, otherwise: str) -> str:
    """The letters of one piece in the alphabets their neighbours tell; otherwise: of a piece that doesn't tell."""
    kinds = _kinds(piece)
    if "o" in kinds:
        return piece
    if "c" in kinds and "l" in kinds:
        return _joined(piece)
    script = "c" if "c" in kinds else "l" if kinds & {"l", "x"} else otherwise
    return piece.translate(TO_CYRILLIC if script == "c" else TO_LATIN)


def _joined(piece: str) -> str:
    """A piece such as "GPUшный": a look-alike letter between letters of one alphabet belongs to it."""
    strong = [(i, s) for i, c in enumerate(piece) if (s := _script(c)) in "cl" and not unicodedata.combining(c)]
    out, at, left = list(piece), 0, None
    for i, c in enumerate(piece):
        while at < len(strong) and strong[at][0] <= i:
            left, at = strong[at][1], at + 1
        if _script(c) == "w":
            right = strong[at][1] if at < len(strong) else None
            if left == right or left is None or right is None:
                script = left or right
            else:
                script = _own(c) if _own(c) != "g" else left
            out[i] = c.translate(TO_CYRILLIC if script == "c" else TO_LATIN)
    return "".join(out)


def _from_others(piece: str) -> str:
    """A piece whose other letters are Latin, or have twins there, in Latin letters alone."""
    if _OTHERS.isdisjoint(piece):
        return piece
    rest = [c for c in piece if c not in _OTHERS and not unicodedata.combining(c)]
    latin = any(_own(c) == "l" for c in rest) and all(_own(c) == "l" or c in _WEAK for c in rest)
    return piece.translate(_FROM_OTHERS) if latin else piece


def one_word(word: str, ru: bool) -> str:
    if word.isascii() and not ru:
        return word
    pieces = [_from_others(p) for p in word.split("-")]
    kinds = [_kinds(p) for p in pieces]
    told = next(("c" if "c" in k else "l" for k in kinds if k & {"c", "l", "x"}), None)
    out = []
    for p, k in zip(pieces, kinds, strict=True):
        own = {_own(c) for c in p if not unicodedata.combining(c)}
        if told and k == {"w"} and own in ({"c"}, {"l"}):
            out.append(p)  # a piece of its own beside one of the other alphabet
        else:
            out.append(_piece(p, told or ("c" if ru else "l")))
    return "-".join(out)


@functools.lru_cache(1 << 16)
def _segment(segment: str, ru: bool) -> str:
    plain = unicodedata.normalize("NFD", segment.translate(_FOLD))
    return unicodedata.normalize("NFC", _WORD.sub(lambda m: one_word(m[0], ru), plain))


def canonical(text: str | None, lang: str | None) -> str | None:
    """``text`` in the one form; ``lang`` reads words made only of look-alike letters."""
    if text is None:
        return None
    ru = lang == "ru"
    suspect = (_SUSPECT_RU if ru else _SUSPECT_ANY).search
    if not suspect(text):
        return text
    return _SEGMENT.sub(lambda m: _segment(m[0], ru) if suspect(m[0]) else m[0], text)


def suspect(text: Column, lang: Column | None = None) -> Column:
    """JVM quick check: true where ``text`` may not be in the form (without ``lang``, for any language)."""
    common = text.rlike(f"{_OTHER}|{_MIXED}")
    latin, cyrillic = text.rlike(_LOOKALIKE_LATIN), text.rlike(_LOOKALIKE_CYRILLIC)
    if lang is None:
        return common | latin | cyrillic
    return common | F.when(lang == "ru", latin).otherwise(cyrillic)


def canonical_column(df: DataFrame, text: str, lang: str, out: str) -> DataFrame:
    """Rows of ``df`` with column ``out``, the form of ``text``; Python sees every row given."""
    kept = [f for f in df.schema.fields if f.name != out]

    def run(b: pa.RecordBatch) -> dict:
        form = [canonical(x, y) for x, y in zip(b.column(text).to_pylist(), b.column(lang).to_pylist(), strict=True)]
        return {f.name: b.column(f.name) for f in kept} | {out: form}

    return map_batches(df, run, T.StructType([*kept, T.StructField(out, T.StringType())]))


def with_lang(df: DataFrame, recordings: DataFrame, lang: str) -> DataFrame:
    """Left join of each row's recording language; Spark broadcasts it only under its size threshold."""
    r = recordings.groupBy(F.col("rec_id").alias("_rec")).agg(F.min("lang").alias(lang))
    return df.join(r, df["rec_id"] == r["_rec"], "left").drop("_rec")


def one_form(df: DataFrame, recordings: DataFrame, text: str = "text", out: str = "form") -> DataFrame:
    """``df`` (with ``rec_id``) with column ``out``; only rows that fail the quick check leave the JVM."""
    if out in df.columns:
        df = df.drop(out)
    fails = F.coalesce(suspect(F.col(text)), F.lit(False))
    stable = df.where(~fails).withColumn(out, F.col(text))
    return stable.unionByName(canonical_column(with_lang(df.where(fails), recordings, "_lang"), text, "_lang", out).drop("_lang"))


def changed(df: DataFrame, recordings: DataFrame, kind: str, key: str) -> DataFrame:
    """kind and row_id, once for each row of ``df`` whose text differs from its one form; null text never does."""
    flagged = with_lang(df.select(F.col(key).alias("row_id"), "rec_id", "text").where(suspect(F.col("text"))), recordings, "_lang")
    flagged = flagged.where(suspect(F.col("text"), F.coalesce(F.col("_lang"), F.lit(""))))
    done = canonical_column(flagged.select("row_id", "text", "_lang"), "text", "_lang", "_form")
    return done.where(F.col("_form") != F.col("text")).select(F.lit(kind).alias("kind"), "row_id").distinct()
