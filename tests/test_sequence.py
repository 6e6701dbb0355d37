"""Filling and runs in shards against plain walks."""

from __future__ import annotations

import random

import numpy as np

from voxframe.operators import rank, sequence, speakers


def test_against_walks(spark):
    r = random.Random(8)
    rows = [(rec, "g", 1000 * rec + i, i, float(i), i + 0.5, r.choice(["a", "a", "b", None, None, None])) for rec in (1, 2) for i in range(150)]
    rows += [(3, "g", 9000 + i, i, float(i), i + 0.5, None) for i in range(30)] + [(4, "g", 9500 + i, i, float(i), i + 0.5, "x") for i in range(60)]
    df = spark.createDataFrame(rows, "rec_id long, engine string, seg_id long, seg_idx int, start_sec double, end_sec double, speaker string")
    filled, spans = {}, []
    for rec in (1, 2, 3, 4):
        own = [x for x in rows if x[0] == rec]
        for i, x in enumerate(own):
            near = [own[j][6] for j in [*range(i, -1, -1), *range(i + 1, len(own))] if own[j][6]]
            filled[x[2]] = near[0] if near else None
        for x in own:
            if x[6] is None:
                continue
            if spans and spans[-1][0] == rec and spans[-1][1] == x[6]:
                spans[-1][3] = x[5]
            else:
                spans.append([rec, x[6], x[4], x[5]])
    for shard in (7, 1000):
        assert {x.seg_id: x.speaker for x in speakers.backfill(df, shard).collect()} == filled
        got = speakers.islands(df.withColumnRenamed("speaker", "label"), shard).select("rec_id", "label", "start_sec", "end_sec").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, spans))


def test_numbers_and_neighbours_across_shards(spark):
    # One group of 100 times the rows of the others.
    rows = [(1 + (i % 101 == 0), i, i // 13) for i in range(3000)] + [(9, 5, 0)]
    df = spark.createDataFrame(rows, "k int, i int, shard int")
    want, before = {}, {}
    for k in (1, 2, 9):
        own = sorted(x[1] for x in rows if x[0] == k)
        want |= {(k, i): n for n, i in enumerate(own, 1)}
        before |= {(k, i): j for i, j in zip(own, [None, *own])}
    assert {(r.k, r.i): r.n for r in sequence.numbered(df, ["k"], "shard", ["i"], "n").collect()} == want
    assert {(r.k, r.i): r.b for r in sequence.previous(df, ["k"], "shard", ["i"], "i", "b").collect()} == before
    assert sequence.numbered(df.where("false"), ["k"], "shard", ["i"], "n").count() == 0


def test_no_window_runs_over_a_whole_group_of_rows(spark):
    df = spark.createDataFrame([(1, 1, 0, 0.5)], "k int, i int, shard int, conf double")
    for plan in (sequence.numbered(df, ["k"], "shard", ["i"], "n"), sequence.previous(df, ["k"], "shard", ["i"], "i", "b"), rank.cuts(df, ["k"])):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        for line in text.splitlines():
            if "Window [" in line and "row_number" in line:
                assert "shard" in line.split("],")[1]


def test_heads_against_a_walk():
    r = random.Random(3)
    for _ in range(50):
        n = r.randrange(0, 200)
        x = [r.random() for _ in range(n)]
        looked = []

        def breaks(head, a, b):
            looked.append(b - a)
            return np.array([x[j] + (j - head) / 40 > 1 for j in range(a, b)])

        want, head = [], 0
        for j in range(n):
            if j == 0 or x[j] + (j - head) / 40 > 1:
                want.append(j)
                head = j
        assert sequence.heads(n, breaks) == want
