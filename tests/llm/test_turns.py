"""Speaker turns: parsing, labels, and the plan against a plain walk."""

from __future__ import annotations

import itertools
import random

from voxframe.llm import turns

ROSTER = [(0, "Олег Лорлавных"), (1, "Прохор Федкульских"), (2, "Эльвира Лордодских")]


def test_noise():
    assert turns.strip_noise("[00:12] Мы э-э... нашли (смеётся) ответ <00:00:01.5> 00:01:02,003 --> 00:01:03,000 ♪ *кашель* хм, да мм.") == "Мы нашли ответ да."
    assert turns.strip_noise("мм… (пауза) хм.") == "" and turns.strip_noise("умм домм э-экран") == "умм домм э-экран"


def test_long_sounds_go_and_spoken_parentheses_stay():
    assert turns.strip_noise("Да. [long applause from the whole hall, and then again, and again, for a minute] Нет (see the appendix).") == "Да. Нет (see the appendix)."
    assert turns.strip_noise("Ну (laughs out loud for quite some time, so that nobody hears the speaker at all) вот (вздыхает) (ok)") == "Ну вот"


def said(text, label=None):
    return [(p[1], p[2]) for p in turns.parse(text, label)]


def test_parts():
    assert said("Раз два.", "Speaker_01") == [("#1", True)]
    assert said("Раз. Олег: два. - Спикер 2: три", "ＳＰＥＡＫＥＲ＿00") == [("#0", True), ("олег", True), ("#2", True)]
    assert said("Тут хм… пишет Олег: всё готово.", "x")[0] == ("x", False)  # a candidate of three words, which names nobody
    assert said("[00:11] >> О. Лорлавных: да") == [(None, False), ("о лорлавных", True)]
    assert said("хм... (пауза)", "SPEAKER_00") == [("#0", False)] and said(None, "a") == [] and said("", "a") == [("a", False)]
    assert said("в 12:30 пришёл", "a") == [("a", True)]


def test_labels():
    labels = ["#0", "#7", "олег", "прохор", "prohor", "лордодских э", "э лордодских", "прохор федкульсикх", "oleg lorlavnyh", "лорлавных", "unknown", "итог", "тут пишет олег", "л", "elvira"]
    got = turns.match_labels(labels, ROSTER)
    assert got == {"#0": 0, "олег": 0, "прохор": 1, "prohor": 1, "лордодских э": 2, "э лордодских": 2, "прохор федкульсикх": 1, "oleg lorlavnyh": 0, "лорлавных": 0, "elvira": 2}
    # one name for two entries: those are assigned, the one nobody else names first
    assert turns.match_labels(["зоя", "зоя карп"], [(0, "Зоя Карп"), (1, "Зоя Линь")]) == {"зоя карп": 0, "зоя": 1}
    assert turns.match_labels(["олег"], []) == {}
    # more open labels than entries: all are assigned at once, evenly
    got = turns.match_labels(["а карп", "карп", "карп а", "karp", "карп л"], [(0, "Анна Карп"), (1, "Лев Карп")])
    assert got["а карп"] == got["карп а"] == 0 and got["карп л"] == 1 and len(got) == 5 and got["карп"] != got["karp"] or got["карп"] == got["karp"] == 1


def test_rows_without_a_start_come_last_in_shards(spark):
    rows = [(1, i, None if i > 2 else 5.0 - i, None, "Да.", "SPEAKER_00" if i % 2500 < 1250 else "SPEAKER_01") for i in range(5000)]
    df = spark.createDataFrame(rows, "rec_id long, seg_idx int, start_sec double, end_sec double, text string, speaker string")
    got = sorted(tuple(r) for r in turns.turns(df, spark.createDataFrame([(1, *e) for e in ROSTER], "rec_id long, speaker_no int, display_name string"), text=False).collect())
    assert sorted(x[1:] for x in got) == sorted([(0, 2, 1249), (1, 1250, 2499), (0, 2500, 3749), (1, 3750, 4999)])


def test_assignment_is_optimal():
    r = random.Random(1)
    for _ in range(60):
        n, m = r.randrange(1, 5), 5
        cost = [[r.randrange(20) for _ in range(m)] for _ in range(n)]
        got = turns.assign(cost)
        assert len(set(got)) == n
        assert sum(c[j] for c, j in zip(cost, got)) == min(sum(c[j] for c, j in zip(cost, p)) for p in itertools.permutations(range(m), n))


def walk(rows):
    out = []
    for rec in sorted({r[0] for r in rows}):
        own = sorted({(r[2] is None, r[2] or 0, r[1], r[4], r[5]) for r in rows if r[0] == rec}, key=lambda x: x[:3])
        names = turns.match_labels(sorted({p[1] for x in own for p in turns.parse(x[3], x[4]) if p[1]}), ROSTER)
        now, turn = None, None
        for _, _, idx, text, label in own:
            who = None
            for p in turns.parse(text, label):
                known = names.get(p[1]) if p[1] else None
                speech = p[2] or (p[0] > 0 and known is None)
                who = known if p[0] == 0 or known is not None else who
                if speech and (who is not None or now is not None):
                    now = who if who is not None else now
                    if turn and turn[1] == now:
                        turn[3] = idx
                    else:
                        turn = [rec, now, idx, idx]
                        out.append(turn)
    return sorted(map(tuple, out))


def test_plan_against_walk(spark):
    r = random.Random(6)
    texts = ["Да.", "Раз. Олег: два.", "хм", "(смех)", "Эльвира: Итог: вот.", "Тут пишет Олег: всё.", None, "", "Прохор: (пауза)", "SPEAKER_02: да"]
    labels = ["SPEAKER_00", "speaker 1", "Эльвира", "unknown", None, "?", "Prohor", "SPEAKER_09"]
    rows = [(1 + (i % 5 == 0), i, None if i in (33, 34) else float(r.randrange(0, 3000)), 1.0, r.choice(texts), r.choice(labels), "x") for i in range(400)]
    rows += rows[:30]
    df = spark.createDataFrame(rows, "rec_id long, seg_idx int, start_sec double, end_sec double, text string, speaker string, part string")
    sp = spark.createDataFrame([(k, *e) for k in (1, 2) for e in ROSTER], "rec_id long, speaker_no int, display_name string")
    for shard in (40, 600, 10**6):
        got = turns.turns(df, sp, shard, text=False)
        assert sorted(map(tuple, got.collect())) == walk(rows), shard
    full = turns.turns(df, sp, 40)
    assert full.count() == len(walk(rows)) and full.where("text = ''").count() == 0
    assert turns.turns(df.where("false"), sp).count() == 0 and turns.turns(df, sp.where("false")).count() == 0
