"""Column functions on words, times and versions; all stay in the JVM but for NFKC of unusual characters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Punctuation taken off the ends of a token.
EDGE = "«»\"'()[]{}.,;:!?…-—–"
_EDGE_CLASS = "[" + "".join("\\" + c if c in "[]\\-" else c for c in EDGE) + "]*"
CYRILLIC, LATIN = "[а-яёА-ЯЁ]", "[A-Za-z]"


def lower_ru(x: Column) -> Column:
    """Lower case with е for ё."""
    return F.translate(F.lower(x), "ё", "е")


def token_key(x: Column) -> Column:
    """A token by its letters and digits alone, lower case, е for ё; for text in which NFKC changes nothing."""
    return F.regexp_replace(lower_ru(x), r"[^\p{L}\p{N}]+", "")


@pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def needs_nfkc(x: Column) -> Column:
    """True where NFKC might change the text: anything but ASCII, Russian letters and Latin-1 letters."""
    return x.rlike(r"[^\x00-\x7FА-Яа-яЁёÀ-ÖØ-öø-ÿ«»–—]")


def nfkc(x: Column) -> Column:
    """NFKC in an Arrow-batched function; apply it to rows that ``needs_nfkc`` alone."""
    return _nfkc(x)


def edges(x: Column) -> tuple[Column, Column, Column]:
    """Left punctuation, core and right punctuation of a token."""
    left = F.regexp_extract(x, f"^({_EDGE_CLASS})", 1)
    rest = F.substring(x, F.length(left) + 1, F.length(x))
    right = F.regexp_extract(rest, f"({_EDGE_CLASS})$", 1)
    return left, F.substring(rest, F.lit(1), F.length(rest) - F.length(right)), right


def core(x: Column) -> Column:
    """A token without the punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(x, f"^{_EDGE_CLASS}", ""), f"{_EDGE_CLASS}$", "")


def pieces(x: Column) -> Column:
    """Words and the white space between them, in order; nothing is lost."""
    return F.regexp_extract_all(x, F.lit(r"(\s+|\S+)"), F.lit(1))


def join_words(words: Column) -> Column:
    """Words joined by blanks, none before closing and after opening punctuation; null for none."""
    text = F.array_join(F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: w != ""), " ")
    text = F.regexp_replace(text, r"\s+([,.;:!?%)\]»])", "$1")
    return F.nullif(F.trim(F.regexp_replace(text, r"([(\[«])\s+", "$1")), F.lit(""))


def consonants(x: Column) -> Column:
    """Letters and digits of a word but vowels."""
    return F.regexp_replace(lower_ru(x), r"[аеиоуыэюяaeiouy]|[^\p{L}\p{N}]", "")


def mixes_alphabets(x: Column) -> Column:
    """True where one hyphenated part of a word has letters of both alphabets."""
    return F.exists(F.split(x, "[-–—]"), lambda p: p.rlike(CYRILLIC) & p.rlike(LATIN))


def _hms(seconds: Column) -> Column:
    s = F.greatest(seconds.cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def clock_from(seconds: Column) -> Column:
    """HH:MM:SS, rounded down."""
    return _hms(F.floor(seconds))


def clock_to(seconds: Column) -> Column:
    """HH:MM:SS, rounded up."""
    return _hms(F.ceil(seconds))


def clock(seconds: Column) -> Column:
    """HH:MM:SS, rounded half to even."""
    return _hms(F.bround(seconds, 0))


def clock_srt(seconds: Column) -> Column:
    """HH:MM:SS,mmm from whole milliseconds."""
    ms = F.greatest(F.bround(seconds * 1000, 0).cast("long"), F.lit(0))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def estimate(seconds: Column) -> Column:
    """A duration for people: seconds, minutes with a decimal below ten, whole minutes."""
    minutes = seconds / 60
    return (
        F.when(seconds < 60, F.format_string("~%d сек", seconds.cast("long")))
        .when(minutes < 10, F.concat(F.lit("~"), F.format_string("%.1f", minutes), F.lit(" мин")))
        .otherwise(F.format_string("~%d мин", F.bround(minutes, 0).cast("long")))
    )


def version_parts(x: Column) -> Column:
    """``v1.2.3`` as [1, 2, 3]; null where it doesn't begin with a version."""
    found = F.nullif(F.regexp_extract(x, r"^\s*v?(\d+(?:\.\d+)*)", 1), F.lit(""))
    return F.transform(F.split(found, r"\."), lambda p: p.cast("long"))


def is_newer(remote: Column, local: Column) -> Column:
    """True where ``remote`` is a later version; shorter ones are padded with zeros, unreadable ones never newer."""
    a, b = version_parts(remote), version_parts(local)
    n = F.greatest(F.size(a), F.size(b))

    def pad(p: Column) -> Column:
        return F.concat(p, F.array_repeat(F.lit(0).cast("long"), n - F.size(p)))

    return F.coalesce(pad(a) > pad(b), F.lit(False))


def clean_note(x: Column, most: int = 120) -> Column:
    """A bullet as a line for people: without mark, links and emphasis, at most ``most`` characters."""
    note = F.regexp_replace(F.trim(x), r"^[-*+]\s+", "")
    note = F.regexp_replace(note, r"\[([^\]]+)\]\([^)]+\)", "$1")
    note = F.trim(F.regexp_replace(F.regexp_replace(note, r"`|\*\*", ""), r"\s+", " "))
    return F.when(F.length(note) > most, F.concat(F.rtrim(F.substring(note, 1, most - 1)), F.lit("…"))).otherwise(note)


def switched_off(x: Column) -> Column:
    """True for a setting that is given and is no form of "no"."""
    return ~F.coalesce(F.lower(F.trim(x)), F.lit("")).isin("", "0", "false", "no", "off")


def fresh(last: Column, now: Column, interval: float = 86400) -> Column:
    """True where ``last`` lies less than ``interval`` seconds before ``now`` and not after it."""
    age = now - last.try_cast("double")
    return F.coalesce((age >= 0) & (age < interval), F.lit(False))
