"""The one text form."""

from __future__ import annotations

import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.llm import textform
from voxframe.llm.textform import canonical


@pytest.mark.parametrize(
    ("text", "lang", "form"),
    [
        ("к​урс﻿а", "ru", "курса"), ("зим нам", "ru", "зим нам"), ("из‑за", "ru", "из-за"), ("ｂｏｔｈ ４６！", "en", "both 46!"), ("внешней", "ru", "внешней"), ("für", "de", "für"),
        ("за́мок", "ru", "за́мок"), ("cтaжёpы", "ru", "стажёры"), ("Whitеboаrd", "ru", "Whiteboard"), ("οдин", "ru", "один"), ("Τhe οld", "en", "The old"), ("QR-код Wi-Fi-сеть", "ru", "QR-код Wi-Fi-сеть"),
        ("GPUшный VРNить", "ru", "GPUшный VPNить"), ("c", "ru", "с"), ("с", "en", "c"), ("а", None, "a"), ("ѕіe", "de", "sie"), ("IТ-отдел", "ru", "IT-отдел"), ("кoе-кaк", "ru", "кое-как"), ("plain… text — «ok»", "en", "plain… text — «ok»"),
        ("", "ru", ""), (None, "ru", None), ("λόγος", "en", "λόγος"), ("її", "uk", "її"),
    ],
)
def test_cases(text, lang, form):
    assert canonical(text, lang) == form


ALPHABET = st.sampled_from(list("abceopxyABCEHKMOPTXасеорхуАВСЕбджийщ ё-.​­ ́̈ａｂ１‐οΤіѕ1\n"))


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=40), st.sampled_from(["ru", "en", None]))
def test_form_is_stable(text, lang):
    form = canonical(text, lang)
    assert canonical(form, lang) == form
    assert unicodedata.normalize("NFC", form) == form
    assert not any(unicodedata.category(c) == "Cf" for c in form)
    # the quick check passes by only what the whole normalisation leaves alone
    whole = textform._SEGMENT.sub(lambda m: textform._segment(m[0], lang == "ru"), text)
    assert form == whole


def test_plan_agrees_with_function(spark):
    texts = ["cтaжёp", "plain", "c", "c и c", "ｆ", "за́мок", "", None, "QR-код", "а", "x" * 100_000 + "е"]
    rows = [(i, 1 + i % 2, t, "clash") for i, t in enumerate(texts)] + [(0, 1, texts[0], "clash"), (99, 7, "с", "clash"), (98, None, "с", "clash")]
    df = spark.createDataFrame(rows, "word_id long, rec_id long, text string, form string")
    rec = spark.createDataFrame([(1, "ru"), (2, "en"), (2, "en")], "rec_id long, lang string")
    lang = {1: "ru", 2: "en"}
    got = [(r.word_id, r.form) for r in textform.one_form(df, rec).collect()]
    assert sorted(got, key=str) == sorted([(i, canonical(t, lang.get(k))) for i, k, t, _ in rows], key=str)
    found = sorted(r.row_id for r in textform.changed(df, rec, "word", "word_id").collect())
    assert found == sorted({i for i, k, t, _ in rows if t is not None and canonical(t, lang.get(k)) != t})
    assert textform.changed(df.where("false"), rec, "word", "word_id").count() == 0
    assert textform.changed(df, rec.where("false"), "word", "word_id").count() > 0


_ALPHABET = "abcxyzABKpo абвгеорсхАВЕКМН ёйїіѕј éüñçő οαρυβγ ԁԛӏɡ 0123.,-!()=\n ــ가각각 かが゙がﾊﾟ ạ̃̈́̀" + "̸़ֿ̧́̈​‍﻿­  ‑‐Ａｂ１％ﬁ①Ⅷ"


def random_texts(n):
    r = random.Random(17)
    return ["".join(r.choices(_ALPHABET, k=r.randrange(0, 25))) for _ in range(n)]


def whole(text, lang):
    """The form of a text without any quick check: all of it is normalised."""
    plain = unicodedata.normalize("NFD", textform.fold(text))
    return unicodedata.normalize("NFC", textform._WORD.sub(lambda m: textform.one_word(m[0], lang == "ru"), plain))


def test_quick_check_and_splicing_lose_nothing():
    for text in random_texts(20_000):
        for lang in ("ru", "en"):
            got = textform.canonical(text, lang)
            assert got == whole(text, lang), (ascii(text), lang)
            assert textform.canonical(got, lang) == got, (ascii(text), lang)


def test_quick_check_holds_in_the_jvm(spark):
    texts = [t for t in random_texts(4000) if t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    for lang in ("ru", "en"):
        flagged = {r.i for r in df.where(textform.suspect(F.col("text"), F.lit(lang))).collect()}
        assert {i for i, t in enumerate(texts) if whole(t, lang) != t} <= flagged
        assert len(flagged) < len(texts)


def test_plain_characters_are_stable():
    import regex

    assert not regex.search(f"[{textform.unstable()}]", "".join(chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100), *range(0x410, 0x450)]) + "Ёё«»“”„‘’…–—№°§©日本語ไทยदेवनागरी".translate({0x93f: None}))
    assert regex.search(f"[{textform.unstable()}]", "́") and regex.search(f"[{textform.unstable()}]", "Ａ") and regex.search(f"[{textform.unstable()}]", "Å") and regex.search(f"[{textform.unstable()}]", "ο")


def test_letters_of_other_alphabets():
    assert textform.canonical("ɡood ԁata ӏast", "en") == "good data last" and textform.canonical("һәм ӏаьржа", "ru") == "һәм ӏаьржа" and textform.canonical("օղակ", "en") == "օղակ"
