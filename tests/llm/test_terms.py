"""Mentions onto a lexicon."""

from __future__ import annotations

import pytest

from voxframe.llm import terms

T = "canonical string, policy string, ru_stems array<string>, ru_exact array<string>, latin_variants array<string>, latin_suggest array<string>, extra int"
TERMS = [
    ("whiteboard", "auto", ["вайтборд"], None, ["whidebuard"], None, 1), ("manifest", "auto", ["манифест"], [], [], None, 1), ("token", "auto", [], ["такены"], [], None, 1),
    ("tokenizer", "auto", ["токенайзер"], [], [], None, 1), ("scheduler", "suggest", [], ["шеддулера"], None, ["shceduler"], 1), ("Dropout", "auto", ["дропаут"], [], ["trout"], None, 1), ("whiteboard", "auto", ["вайтборд"], None, [None, ""], None, 1),
]
CASES = {
    "whiteboard": "whiteboard", "тот самый вайттборты": "whiteboard", "  vhidebard. ": "whiteboard", "вайтбордах-система": "whiteboard", "«вайт-борд»": "whiteboard", "WHITEBOARD": "whiteboard", "whіteboard": "whiteboard",
    "manifold": "", "manyfest": "manifest", "manifest": "manifest", "такенов": "token", "токенайзера": "tokenizer", "tokenizer": "tokenizer", "шедулером": "scheduler", "trout": "Dropout", "дропаудами": "Dropout",
    "кринолин": "", "gondola": "", "": "", "  ": "", "-": "", "да": "", "токамак": "", "wh​iteboard": "whiteboard",
}


@pytest.fixture(scope="module")
def lexicon():
    names = [c.split()[0] for c in T.split(", ")]
    return terms.Lexicon(dict(zip(names, t)) for t in TERMS)


@pytest.mark.parametrize(("heard", "name"), CASES.items())
def test_cases(lexicon, heard, name):
    assert terms.best(lexicon, heard)[0] == name


def test_automaton_returns_all_within(lexicon):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    every = {e for e in lexicon.within("", 99)}
    assert len(every) > 10
    for word in ("vatapart", "takan", "x", ""):
        for most in range(4):
            assert set(lexicon.within(word, most)) == {e for e in every if distance(terms.code(e[0]), word) <= most}


def test_plan(spark, lexicon):
    heard = [*CASES, None, "x" * 50_000, "whiteboard"]
    df = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(heard)] + [(0, heard[0], "clash")], "mention_id long, heard string, canonical string")
    lex = spark.createDataFrame(TERMS, T)
    got = {r.mention_id: r.canonical for r in terms.match_mentions(df, lex).collect()}
    assert got == {i: terms.best(lexicon, h)[0] if h else "" for i, h in enumerate(heard)}
    assert {r.canonical for r in terms.match_mentions(df, lex.where("false")).collect()} == {""}
    assert terms.match_mentions(df.where("false"), lex).count() == 0


def test_entries_of_several_words_and_of_two_letters():
    lexicon = terms.Lexicon({"canonical": c, "ru_exact": r} for c, r in [("blue teaming", ["блю тиминг"]), ("New York City", None), ("AI", ["ИИ"]), ("blue", None), ("red-teaming", None), ("Go", None)])
    cases = {
        "blue teaming": "blue teaming", "«блю тимингом»": "blue teaming", "blueteaming": "blue teaming", "blue teaming-report": "blue teaming", "in new york city today": "New York City",
        "new-york city": "New York City", "blue": "blue", "a blue one": "blue", "red teaming": "red-teaming", "AI": "AI", "the ai.": "AI", "ИИ": "AI", "go": "Go", "ei": "", "ga": "", "goo": "", "to": "", "new city": "",
    }
    assert {h: terms.best(lexicon, h)[0] for h in cases} == cases
    alone = terms.Lexicon([{"canonical": "blue teaming"}])
    assert terms.best(alone, "the Blue  Teeming.")[0] == "blue teaming" and terms.best(alone, "blue")[0] == terms.best(alone, "teaming")[0] == ""


def test_entries_of_one_letter():
    lexicon = terms.Lexicon([{"canonical": "R"}, {"canonical": "regression"}])
    assert [terms.best(lexicon, h)[0] for h in ("R", " r. ", "r model", "regression in R", "s", "")] == ["R", "R", "", "regression", "", ""]


def test_blocks_change_nothing(spark, lexicon):
    df = spark.createDataFrame(list(enumerate([*CASES, "blue teaming", "ai"])), "mention_id long, heard string")
    lex = spark.createDataFrame([*TERMS, ("blue teaming", None, None, None, None, None, 1), ("AI", None, None, None, None, None, 1)], T)
    whole, parts = ({r.mention_id: r.canonical for r in terms.match_mentions(df, lex, block=b).collect()} for b in (terms.BLOCK_CHARS, 150))
    assert whole == parts and "blue teaming" in whole.values() and "AI" in whole.values()
