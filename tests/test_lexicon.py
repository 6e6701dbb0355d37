"""Lexicon matching, replacement and ranking on known cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxframe.functions import text as X
from voxframe.operators import lexicon, rank, words

T = "ord int, canonical string, policy string, ru_stems array<string>, ru_exact array<string>, latin_variants array<string>, latin_suggest array<string>"
TERMS = [
    (0, "prompt", "auto", ["промт", "пронт"], [], ["promt"], None),
    (1, "guardrail", "auto", ["гард", "гардрейл"], None, [], []),
    (2, "Guardrail", "auto", [], [], [], ["guard"]),
    (3, "app", "suggest", ["апп"], ["аппы"], ["aps"], None),
    (4, "tool", "auto", [], [], [], None),
]


@pytest.fixture(scope="module")
def rules(spark):
    return lexicon.rules(spark.createDataFrame(TERMS, T))


def found(spark, rules, cores, english=None):
    df = lexicon.match(spark.createDataFrame([(c,) for c in cores], "core string"), rules, english)
    return {r.core: (r.canonical, r.reason) for r in df.collect()}


def test_stems(spark, rules):
    got = found(spark, rules, ["промт", "промта", "промтом", "промтами", "пронте", "промтуализация", "гардрейлы", "ПРОМТ"])
    assert all(got[w] == ("prompt", "stem") for w in ("промт", "промта", "промтом", "промтами", "пронте", "ПРОМТ"))
    assert got["промтуализация"] == (None, "") and got["гардрейлы"] == ("guardrail", "stem")


def test_suggest_and_latin(spark, rules):
    got = found(spark, rules, ["аппы", "Promt", "aps", "guard", "Guar"])
    assert got["аппы"] == (None, "suggest:app") and got["Promt"] == ("prompt", "latin") and got["guard"] == (None, "suggest:Guardrail")
    assert got["aps"] == (None, "") and got["Guar"] == (None, "")


def test_fuzzy_needs_a_word_list(spark, rules):
    english = spark.createDataFrame([("guard",), ("guardian",)], "w string")
    assert found(spark, rules, ["Guardrale"])["Guardrale"] == (None, "")
    got = found(spark, rules, ["Guardrale", "guardian", "tooling"], english)
    assert got["Guardrale"][1].startswith("fuzzy:0.8") and got["guardian"] == (None, "") and got["tooling"] == (None, "")
    assert found(spark, rules, ["Guardrale"], english.where("false"))["Guardrale"] == (None, "")


def test_texts(spark, rules):
    texts = [(1, "Это  «промт», да."), (2, "Промт важен"), (3, "промт-инъекция"), (4, "аппы сломались"), (5, "ничего\tтут"), (6, ""), (7, None)]
    df = spark.createDataFrame(texts, "seg_id long, text string")
    got = {r.seg_id: r.text for r in lexicon.normalise(df, rules).collect()}
    assert got == {1: "Это  «prompt», да.", 2: "Prompt важен", 3: "prompt-инъекция", 4: "аппы сломались", 5: "ничего\tтут"}
    trail = {(r.seg_id, r.kind, r["from"], r.to, r.reason) for r in lexicon.events(df, rules).collect()}
    assert trail == {(1, "replace", "промт", "prompt", "stem"), (2, "replace", "Промт", "Prompt", "stem"), (3, "replace", "промт-инъекция", "prompt-инъекция", "compound/stem"), (4, "suggest", "аппы", "app", "suggest:app")}


def test_cuts_take_the_ranked_value(spark):
    df = spark.createDataFrame([(1, "g", i / 20) for i in range(1, 21)] + [(1, "g", None)], "rec_id long, engine string, conf double")
    r = rank.cuts(df, ["rec_id", "engine"]).first()
    assert (r.low_cut, r.very_low_cut) == (0.2, 0.1)


def test_ranking(spark):
    words = [(1, "g", 1, 1.0, "имaдж", 0.9), (1, "g", 2, 2.0, "имaдж", 0.1), (1, "g", 3, 3.0, "Kubernetis", 0.9), (1, "g", 4, 4.0, "слово", 0.9), (1, "g", 5, 5.0, "слава", 0.9), (1, "g", 6, 6.0, "MCP-сервер", 0.9), (1, "g", 7, 7.0, "NSF-контент", 0.9), (1, "g", 8, 8.0, "ну", 0.0)]
    df = spark.createDataFrame(words, "rec_id long, engine string, word_id long, start_sec double, text string, conf double")
    df = df.withColumns({"seg_id": F.lit(1), "pos": F.col("word_id"), "core": X.core(F.col("text"))})
    none = spark.createDataFrame([], "core string, canonical string, reason string")
    got = {r.word: (r["rank"], r.score, r.signals, r["count"]) for r in rank.suspicious(df, none).collect()}
    assert got["имaдж"][1:] == (4, ["M"], 2) and got["Kubernetis"][1:] == (3, ["L", "L+"], 1) and got["NSF-контент"][1:] == (2, ["M-"], 1)
    assert "MCP-сервер" not in got and "слово" not in got and "ну" not in got
    assert [w for w, _ in sorted(got.items(), key=lambda x: x[1][0])] == ["имaдж", "Kubernetis", "NSF-контент"]
    assert rank.suspicious(df, none, budget=1).count() == 1
    listed = {r.word: r.signals for r in rank.suspicious(df, none, english=spark.createDataFrame([("kubernetis",)], "w string")).collect()}
    assert listed["Kubernetis"] == ["L"] and listed["имaдж"] == ["M"]


def test_words_said(spark):
    s = spark.createDataFrame([(1, 5, "g", 2.0, "a b", 0.5), (1, 6, "g", 3.0, "c  d", 0.6), (1, 7, "g", 4.0, None, None)], "rec_id long, seg_id long, engine string, start_sec double, text string, conf double")
    w = spark.createDataFrame([(1, "g", 9, 5, 0, None, "a", 0.1), (1, "g", 10, 5, 1, 2.5, "b", 0.2), (1, "g", 11, 5, 2, 2.6, None, 0.2)], "rec_id long, engine string, word_id long, seg_id long, word_idx int, start_sec double, text string, conf double")
    assert {(r.seg_id, r.pos, r.start_sec, r.text, r.conf) for r in words.said(s, w).collect()} == {(5, 0, 2.0, "a", 0.1), (5, 1, 2.5, "b", 0.2), (6, 0, 3.0, "c", 0.6), (6, 1, 3.0, "d", 0.6)}
