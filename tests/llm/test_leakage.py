"""Leaks of evaluation items against brute force."""

from __future__ import annotations

import random

import numpy as np

from voxframe.llm import leakage

VOCABULARY = [f"слово{i}" for i in range(150)] + [f"word{i}" for i in range(150)] + ["с", "у", "Wi-Fi", "ёлка"]


def runs(text, n):
    w = [leakage._key(x) for x in leakage.words_of(text)]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, run=12):
    out = set()
    for i, item in items:
        n = min(run, len(leakage.words_of(item or "")))
        if n:
            own = runs(item, n)
            out |= {(d, i) for d, t in docs if d is not None and t and own & runs(t, n)}
    return out


def test_words():
    assert [leakage._key(w) for w in leakage.words_of("Wi‑Fi зв​ук, ＡＢ зaмок für GPUшный 3,5 _x")] == ["wi", "fi", "звук", "ab", "замок", "für", "gpuшный", "3", "5", "x"]
    assert leakage._key("с") == leakage._key("C") and leakage.word_hashes(None) == [] and leakage.word_hashes("Да") == leakage.word_hashes("дa")


def test_each_run_holds_a_window_on_the_grid():
    for n in range(1, 40):
        width, step = leakage.shape(n, 12)
        run = min(12, n)
        for a in range(50):
            assert any(s % step == 0 for s in range(a, a + run - width + 1))


def test_index_against_all_pairs():
    r = np.random.default_rng(2)
    for cosine in (0.5, 0.85, 0.95):
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (r.standard_normal((400, 5)), r.standard_normal((300, 5))))
        i, j = leakage.Index(y, cosine).near(x.astype(np.float32))
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in np.argwhere(x @ y.T >= cosine).tolist()}


def test_common_subsequence():
    r = random.Random(1)
    for _ in range(80):
        a, b = ([r.randrange(5) for _ in range(r.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage.common_subsequence(a, b) == t[-1][-1]


def sample():
    r = random.Random(9)
    items = [(i, " ".join(r.choices(VOCABULARY, k=r.choice([3, 8, 11, 12, 13, 40, 120])))) for i in range(40)] + [(90, ""), (91, None), (92, "..."), (0, None)]
    docs = []
    for d in range(300):
        words = r.choices(VOCABULARY, k=r.choice([5, 60, 400]))
        if d % 3 == 0:
            item = r.choice(items[:40])[1].split()
            n = r.choice([8, 11, 12, 13, len(item)])
            a = r.randrange(0, max(1, len(item) - n + 1))
            at = r.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if d % 2 else w.replace("о", "o") for w in item[a : a + n]]
        docs.append((d, " ".join(words)))
    return docs + [(400, None), (401, ""), (402, items[5][1]), (402, items[5][1]), (None, items[5][1]), (403, " ".join([items[6][1]] * 300))], items


def test_against_brute_force(spark):
    docs, items = sample()
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, item_id string").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    rows = leakage.leaks(df, it).collect()
    assert len(rows) == len(set(rows)) and {tuple(r) for r in rows} == brute(docs, items)
    assert leakage.leaks(df.where("false"), it).count() == 0 and leakage.leaks(df, it.where("false")).count() == 0


def test_latent_vectors_follow_the_singular_ones(spark):
    docs, _ = sample()
    df = leakage.hashed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    _, v = leakage.fit(df)
    # Dense TF-IDF of the same passages; the leading subspace must agree in what it explains.
    rows = [np.array(r.words, dtype=np.int32) for r in df.collect()]
    passages = [leakage._buckets(w[i : i + leakage.PASSAGE]) for w in rows for i in range(0, len(w), leakage.PASSAGE)]
    used = np.unique(np.concatenate(passages))
    a = np.zeros((len(passages), len(used)))
    for i, p in enumerate(passages):
        np.add.at(a[i], np.searchsorted(used, p), 1)
    idf = np.log((len(a) + 1) / ((a > 0).sum(axis=0) + 1)) + 1
    a = a * idf
    a /= np.array([np.sqrt((idf[np.searchsorted(used, p)] ** 2).sum()) for p in passages])[:, None]
    best = (np.linalg.svd(a, compute_uv=False)[: leakage.DIMENSIONS] ** 2).sum()
    w = v[used] / idf[:, None]
    assert np.linalg.norm(w.T @ w - np.eye(leakage.DIMENSIONS)) < 1e-2
    assert np.linalg.norm(a @ w) ** 2 > 0.85 * best


def changed(words, share, r):
    out = list(words)
    for i in r.sample(range(len(out)), round(share * len(out))):
        out[i] = r.choice(VOCABULARY)
    return out


def topics(r, n, size):
    """Texts of one of ten topics each, whose words keep together."""
    return [(t, r.choices([f"тема{t}слово{i}" for i in range(60)] + VOCABULARY[:20], k=size)) for t in (r.randrange(10) for _ in range(n))]


def test_planted_paraphrases_are_found_and_random_vectors_lose_them(spark, monkeypatch):
    r = random.Random(11)
    items = [(i, " ".join(w)) for i, (_, w) in enumerate(topics(r, 60, 30))]
    docs = [(d, " ".join(w)) for d, (_, w) in enumerate(topics(r, 400, 80))]
    planted = {}
    for share in (0.1, 0.2, 0.3):
        for i, text in items:
            host = r.choice(docs)[1].split()
            at = r.randrange(len(host))
            docs.append((len(docs), " ".join(host[:at] + changed(text.split(), share, r) + host[at:])))
            planted[len(docs) - 1, i] = share
    df, it = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))

    def recall():
        got = {(x.doc_id, x.item_id) for x in leakage.paraphrases(df, it).collect()}
        return [sum(p in got for p, s in planted.items() if s == share) / len(items) for share in (0.1, 0.2, 0.3)]

    fitted, fit = recall(), leakage.fit
    assert min(fitted) >= 0.9

    def at_random(docs):
        idf, v = fit(docs)
        return idf, (np.random.default_rng(1).standard_normal(v.shape) * idf[:, None]).astype(np.float32)

    monkeypatch.setattr(leakage, "fit", at_random)
    assert sum(recall()) < sum(fitted) - 0.2


def test_paraphrases_hold_the_item_in_order_and_its_answers(spark):
    item = [f"имя{i}" if i % 4 == 0 else f"слово{i}" for i in range(40)]
    near = [w for i, w in enumerate(item) if i % 9 != 5]
    docs = [(1, VOCABULARY[:50] + near + VOCABULARY[60:90]), (2, VOCABULARY[::3]), (3, item), (4, item[::-1]), (5, item[:12] + VOCABULARY[:80])]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs] + [(6, None), (7, "")], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(item)), (8, ""), (9, None)], "item_id long, text string")
    got = {r.doc_id: r for r in leakage.paraphrases(df, it).collect()}
    assert set(got) == {1, 3} and got[3].common == 1.0 and got[3].answers == 1.0 and got[1].common == len(near) / 40
    assert leakage.paraphrases(df, it.where("false")).count() == 0 and leakage.paraphrases(df.where("false"), it).count() == 0


def test_best_stretch_against_all():
    r = random.Random(4)
    for _ in range(300):
        doc, text = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        text = text[:8]
        length = min(2 * len(text), len(doc))
        begins = np.array(sorted(r.sample(range(len(doc) - length + 1), r.randrange(1, len(doc) - length + 2))))
        own = np.r_[0, np.cumsum(np.isin(doc, text))]
        want = max(leakage.common_subsequence(text, doc[b : b + length]) for b in begins.tolist())
        got = leakage._best_stretch(doc, own, begins, leakage._places(text), len(text), 2)
        assert got[0] == (want if want >= 2 else 0)
        assert got[1] < 0 or leakage.common_subsequence(text, doc[got[1] : got[1] + length]) == want


def test_answers(spark):
    docs = leakage.hashed(spark.createDataFrame([(1, "a b c d e f 12"), (2, "a b c d e f"), (3, "a b c")], "doc_id long, text string"), "doc_id", "text")
    items = spark.createDataFrame([(1, "a b c d 12 77 gone")], "item_id long, text string")
    (own,) = leakage._answers(docs, leakage._numbers(items), [np.array(leakage.word_hashes("a b c d 12 77 gone"), dtype=np.int32)])
    assert set(own.tolist()) == set(leakage.word_hashes("12 d a"))


def test_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = sample()
    df, it = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (items, "item_id")))
    monkeypatch.setattr(leakage, "PIECE_WORDS", 30)
    assert {tuple(r) for r in leakage.leaks(df, it, block=700).collect()} == brute(docs, items)


def test_ladder():
    assert [leakage.ladder(n) for n in (1, 2, 3, 4, 5, 9, 11, 40, 41, 100, 120)] == [1, 2, 3, 4, 4, 8, 12, 32, 48, 96, 128]
