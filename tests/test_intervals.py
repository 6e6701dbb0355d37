"""Interval merging against a brute-force sweep."""

from __future__ import annotations

import random

from voxframe.operators import intervals


def brute(rows, most):
    out, by = [], {}
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and s <= e:
            by.setdefault(k, []).append((s, e))
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:]) if most is None or b[0] - a[1] < most]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(3)
    data = []
    for _ in range(1500):
        s = r.randrange(0, 60_000)
        data.append((r.choice("abc"), s, s + r.choice([0, 1, 7, 40, 700, 9000])))
    data += [("hot", 100 * i, 100 * i + 100) for i in range(700)]  # touches across every shard edge
    data += [("n", None, 5), (None, 1, 2), ("n", 5, None), ("n", 9, 3), data[0], data[0]]
    df = spark.createDataFrame(data, "k string, s long, e long")
    for most in (None, 300, 5000):
        got = intervals.periods_and_gaps(df, ["k"], "s", "e", most, shard_ms=1000)
        assert sorted(map(tuple, got.collect())) == brute(data, most)


def test_long_gap_without_limit_spans_empty_shards(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 50_000, 50_010)], "k string, s long, e long")
    assert ("a", "gap", 10, 50_000) in {tuple(r) for r in intervals.periods_and_gaps(df, ["k"], "s", "e", None, shard_ms=1000).collect()}


def test_labels_times_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, "g", " Speaker_01", 0.0, 1.00000012, "x"), (1, "g", "SPEAKER_01", 1.0, 2.0, "x"), (1, "g", None, 0.0, 9.0, "x"), (1, "g", "SPEAKER_01", float("nan"), 3.0, "x"), (1, "g", "SPEAKER_01", 302.0, 303.0, "x")],
        "rec_id long, engine string, speaker string, start_sec double, end_sec double, kind string",
    )
    assert sorted(map(tuple, intervals.speaking_periods(df).collect())) == [(1, "g", "SPEAKER_01", "period", 0, 2000), (1, "g", "SPEAKER_01", "period", 302_000, 303_000)]
    assert intervals.speaking_periods(df.where("false")).count() == 0
