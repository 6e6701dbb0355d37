"""Streams of words."""

from __future__ import annotations

import datetime as dt

from voxframe.streaming import words


def test_repeats_count_once(spark, tmp_path):
    day = dt.datetime(2026, 1, 5, 8)
    kind = "word_id long, engine string, loaded_at timestamp"
    spark.createDataFrame([(1, "gigaam", day), (2, "gigaam", day), (1, "gigaam", day + dt.timedelta(days=2))], kind).coalesce(1).write.parquet(str(tmp_path / "a"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "a"))
    q = words.once(stream).writeStream.format("memory").queryName("once_words").start()
    try:
        q.processAllAvailable()
        assert sorted(r.word_id for r in spark.table("once_words").collect()) == [1, 2]
    finally:
        q.stop()
    q = words.arrivals(stream).writeStream.outputMode("complete").format("memory").queryName("arrived_words").start()
    try:
        q.processAllAvailable()
        assert sorted(r.n for r in spark.table("arrived_words").collect()) == [1, 2]
    finally:
        q.stop()
