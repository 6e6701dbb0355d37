"""Pairing each record with the nearest record in time of the same key (problem 3).

Expanding rings. In a ring of half-width w, time is cut into buckets of 2w; a
right row stands in the one or two adjacent buckets that hold some time within
w of it, a left row in its own. So every right row within w of a left row meets
it, and a match at a distance of at most w is provably the nearest: it is
accepted. Left rows without one go on to the ring of doubled width, up to the
tolerance. A hot key or a huge recording is split by its time buckets; the only
exchange of a ring is on (key, bucket), and the best match is taken within it.

Rows with a null key or time take no part. Of equally near right rows the
smaller id is taken. Repeated rows (same id) count once. A left row without a
right row within the tolerance has no row in the result.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.llm import textform
from voxframe.operators.storage import materialise


def nearest(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float, first: float | None = None) -> DataFrame:
    """``left_id, right_id, distance`` for inputs with ``id, t`` and ``keys``; first: half-width of the first ring.

    Distances are rounded to the microsecond, so that binary noise makes no ties and breaks none.
    """
    cols = ["id", "t", *keys]
    left, right = (d.select(cols).dropna() for d in (left, right))
    width = min(first or tolerance / 4, tolerance)
    found = []
    while True:
        last = width >= tolerance
        slack = width + 1e-6  # a pair at exactly w must meet although times carry binary noise
        l_ = left.select(F.col("id").alias("left_id"), F.col("t").alias("lt"), *keys, F.floor(F.col("t") / (2 * slack)).alias("bucket"))
        buckets = F.sequence(F.floor((F.col("t") - slack) / (2 * slack)), F.floor((F.col("t") + slack) / (2 * slack)))
        r_ = right.select(F.col("id").alias("right_id"), F.col("t").alias("rt"), *keys, F.explode(buckets).alias("bucket"))
        met = l_.join(r_.hint("merge"), [*keys, "bucket"], "inner" if last else "left")
        distance = F.round(F.abs(F.col("lt") - F.col("rt")), 6)
        best = F.min(F.when(distance <= round(width, 6), F.struct(distance.alias("distance"), "right_id"))).alias("m")
        ring = met.groupBy(*keys, "bucket", "left_id", "lt").agg(best).select("left_id", "lt", *keys, "m.right_id", "m.distance")
        if last:
            found.append(ring.where("right_id is not null").select("left_id", "right_id", "distance"))
            return functools.reduce(DataFrame.unionAll, found)
        ring = materialise(ring, "ring")
        found.append(ring.where("right_id is not null").select("left_id", "right_id", "distance"))
        left = ring.where("right_id is null").select(F.col("left_id").alias("id"), F.col("lt").alias("t"), *keys)
        width = min(width * 2, tolerance)


def word_keys(words: DataFrame, recordings: DataFrame) -> DataFrame:
    """``id, t, rec_id, said, engine``: words by what was said, in one form without case or outer punctuation."""
    w = words.select(F.col("word_id").alias("id"), F.col("start_sec").alias("t"), "rec_id", "engine", "text")
    w = w.where("id is not null and t is not null and not isnan(t) and text is not null and rec_id is not null")
    said = F.regexp_replace(F.lower("form"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}\p{M}]+$", "")
    return textform.one_form(w, recordings).select("id", "t", "rec_id", "engine", said.alias("said")).where("said <> ''")


def word_pairs(words: DataFrame, recordings: DataFrame, tolerance: float = 0.4, left: str = "gigaam", right: str = "whisper") -> DataFrame:
    """``word_id_a, word_id_b``: each left-engine word with its nearest right-engine word, smaller id first."""
    w = materialise(word_keys(words.where(F.col("engine").isin(left, right)), recordings), "word_keys")
    pairs = nearest(w.where(F.col("engine") == left), w.where(F.col("engine") == right), ["rec_id", "said"], tolerance)
    return pairs.select(F.least("left_id", "right_id").alias("word_id_a"), F.greatest("left_id", "right_id").alias("word_id_b")).distinct()
