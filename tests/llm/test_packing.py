"""Packing of texts into sequences."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from voxframe.llm import packing


def test_differencing_is_a_partition_and_even():
    r = random.Random(2)
    for n, k in ((1, 3), (5, 2), (40, 7), (300, 25), (10, 10)):
        sizes = [r.randrange(1, 900) for _ in range(n)]
        windows = packing.differencing(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) <= k
        sums = [sum(sizes[i] for i in w) for w in windows]
        if n >= 10 * k:
            assert max(sums) - min(sums) < max(sizes) / 5
    assert packing.differencing([], 3) == []
    sums = [sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]  # the textbook example of differencing


def test_pack_keeps_capacity():
    r = random.Random(3)
    for low, high, n in ((1, 300, 400), (500, 2047, 150), (2047, 2047, 9), (1030, 1040, 50), (1, 1, 5000)):
        sizes = [r.randint(low, high) for _ in range(n)]
        windows = packing.pack(sizes, 2048)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert max(sum(sizes[i] for i in w) for w in windows) <= 2048
        full, left = packing.pack_full(sizes, 2048)
        assert sorted([i for w in full for i in w] + left) == list(range(n))
        assert max((sum(sizes[i] for i in w) for w in full), default=0) <= 2048
    sizes = [r.randint(20, 400) for _ in range(1000)]
    assert len(packing.pack(sizes, 2048)) <= -(-sum(sizes) // 2048) + 1


def test_plan(spark):
    pytest.importorskip("tiktoken")
    r = random.Random(4)
    words = "раз two три vier cinq 六 ".split(" ")
    texts = [" ".join(r.choices(words, k=r.choice([3, 40, 200]))) for _ in range(300)] + ["", None, "слово " * 3000, "a"]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash"), (None, "x", "clash")]
    df = spark.createDataFrame(rows, "doc_id long, text string, seq_id string")
    counts = {x.doc_id: x.n_tokens for x in packing.token_counts(df).collect()}
    assert set(counts) == {i for i, t in enumerate(texts) if t}
    for bins in (4, 128):
        got = packing.sequences(df, capacity=512, bin_windows=bins).collect()
        per, pieces = defaultdict(int), defaultdict(list)
        for x in got:
            per[x.seq_id] += x.n_tokens
            pieces[x.doc_id].append((x.first_token, x.n_tokens))
        assert max(per.values()) <= 512 and {d: sum(n for _, n in p) for d, p in pieces.items()} == counts
        for d, p in pieces.items():
            assert len(p) == -(-counts[d] // 512) and sorted(p) == [(512 * i, min(512, counts[d] - 512 * i)) for i in range(len(p))]
        least = -(-sum(counts.values()) // 512)
        assert len(per) <= least * (1.04 if bins > 4 else 1.2) + 1
    stats = packing.unused_space(packing.sequences(df, capacity=512), 512).first()
    assert stats.fullest <= 512 and stats.least_possible == least
    assert packing.sequences(df.where("false")).count() == 0


def test_repair_looks_at_all_windows():
    # Only the fullest of 200 windows with room can take part in the one swap that fits.
    windows = [[0, 1]] + [[2 + i] for i in range(200)]
    sizes = [1000, 1100, *[2040] * 199, 990]
    assert packing.repair(sizes, windows, 2048 + 20) and max(sum(sizes[i] for i in w) for w in windows) <= 2068
