"""Nearest-in-time pairing against brute force."""

from __future__ import annotations

import random

from voxframe.llm import nearest

KIND = "id long, t double, k string, extra string"


def brute(left, right, tolerance):
    out = set()
    for i, t, k, _ in left:
        near = [(round(abs(t - u), 6), j) for j, u, q, _ in right if q == k and k is not None and u is not None and t is not None]
        if near and min(near)[0] <= tolerance:
            out.add((i, min(near)[1]))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    left = [(i, r.choice([round(r.uniform(-3, 60), 3), r.randrange(0, 60) + 0.4, None]), r.choice(["a", "b", "hot", "hot", "hot", None]), "x") for i in range(600)]
    right = [(i, r.choice([round(r.uniform(-3, 60), 3), float(r.randrange(0, 60)), None]), r.choice(["a", "b", "hot", "hot", None]), "x") for i in range(1000, 1500)]
    left, right = left + left[:20], right + right[:20]
    a, b = spark.createDataFrame(left, KIND), spark.createDataFrame(right, KIND)
    for tolerance, first in ((0.4, None), (0.4, 0.4), (0.05, 0.001), (5.0, 0.3)):
        got = {(x.left_id, x.right_id) for x in nearest.nearest(a, b, ["k"], tolerance, first).collect()}
        assert got == brute(left, right, tolerance), (tolerance, first)


def test_edges(spark):
    a = spark.createDataFrame([(1, 10.0, "w", ""), (2, 10.4, "w", ""), (3, 10.400001, "v", "")], KIND)
    b = spark.createDataFrame([(11, 10.4, "w", ""), (12, 10.0, "v", ""), (13, 9.6, "w", "")], KIND)
    got = {(x.left_id, x.right_id) for x in nearest.nearest(a, b, ["k"], 0.4).collect()}
    assert got == {(1, 11), (2, 11)}  # a tie goes to the smaller id, exactly 0.4 counts, more doesn't
    assert nearest.nearest(a.where("false"), b, ["k"], 0.4).count() == 0
    assert nearest.nearest(a, b.where("false"), ["k"], 0.4).count() == 0


def test_words(spark):
    kind = "word_id long, rec_id long, engine string, seg_id long, start_sec double, text string"
    rows = [
        (5, 1, "gigaam", 1, 1.0, "Ёлка,"), (3, 1, "whisper", 1, 1.3, " ёлка"), (4, 1, "whisper", 1, 1.2, "ёлкa"), (6, 1, "gigaam", 1, 1.0, "…"), (7, 1, "whisper", 1, 1.0, "..."),
        (8, 1, "gigaam", 1, 5.0, None), (9, 1, "gigaam", 1, None, "да"), (10, 2, "whisper", 1, 1.0, "ёлка"), (5, 1, "gigaam", 1, 1.0, "Ёлка,"), (11, 1, "other", 1, 1.0, "ёлка"),
    ]
    got = nearest.word_pairs(spark.createDataFrame(rows, kind), spark.createDataFrame([(1, "ru"), (2, "ru")], "rec_id long, lang string"))
    assert [tuple(r) for r in got.collect()] == [(4, 5)]
