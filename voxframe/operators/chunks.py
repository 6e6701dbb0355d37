"""Speech spans gathered into chunks that a recogniser can take."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from voxframe.operators import sequence

SHARD_S = 600


def _heads(longest: float, enough: float, least: float):
    """Where chunks begin among the spans of a part, by their starts and ends in order."""

    @pandas_udf("array<int>")
    def run(starts: pd.Series, ends: pd.Series) -> pd.Series:
        def of(s: np.ndarray, e: np.ndarray) -> list[int]:
            def breaks(head: int, a: int, b: int) -> np.ndarray:
                before, after = e[a - 1 : b - 1] - s[head], e[a:b] - s[head]
                return (before == 0) | ((before > least) & ((after > longest) | (before > enough)))

            return sequence.heads(len(s), breaks)

        return pd.Series([of(s, e) for s, e in zip(starts, ends, strict=True)])

    return run


def speech_chunks(spans: DataFrame, longest: float = 22.0, enough: float = 15.0, strict: float = 30.0, least: float = 0.2) -> DataFrame:
    """``rec_id, chunk, start_sec, end_sec`` from ``rec_id, start_sec, end_sec, total`` (``total``: length, or null).

    Spans are taken in order of start. A chunk longer than ``least`` ends before a span that would carry it beyond
    ``longest``, or once it is longer than ``enough``; one beyond ``strict`` is cut evenly; those of at most ``least``
    are dropped. Where a span of more than ``least`` is followed by one that ends more than ``longest`` after it
    began, no chunk can cross; recordings are cut there, and each part is gathered on its own.
    """
    rows = spans.where("start_sec is not null and end_sec is not null").select(
        "rec_id", F.greatest(F.lit(0.0), "start_sec").alias("s"), F.least("end_sec", F.coalesce("total", "end_sec")).alias("e")
    )
    rows = rows.withColumns({"shard": F.floor(F.col("s") / SHARD_S), "own": F.struct("s", "e")})
    rows = sequence.previous(rows, ["rec_id"], "shard", ["s", "e"], "own", "before")
    cut = F.col("before").isNull() | ((F.col("e") - F.col("before.s") > longest) & (F.col("before.e") - F.col("before.s") > least))
    rows = sequence.filled(rows.withColumn("part", F.when(cut, F.col("own"))), ["rec_id"], "shard", ["s", "e"], "part")
    parts = rows.groupBy("rec_id", "part").agg(F.sort_array(F.collect_list("own")).alias("x"))
    parts = parts.withColumn("heads", _heads(longest, enough, least)("x.s", "x.e")).select("rec_id", "x", "heads", F.posexplode("heads").alias("nth", "head"))
    last = F.coalesce(F.try_element_at("heads", F.col("nth") + 2), F.size("x"))
    whole = parts.select("rec_id", F.element_at("x", F.col("head") + 1)["s"].alias("start_sec"), F.element_at("x", last)["e"].alias("end_sec"))
    held = F.col("end_sec") - F.col("start_sec")
    whole = whole.where(held > least).withColumn("k", F.when(held > strict, F.floor(held / strict) + 1).otherwise(1))
    cuts = whole.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int")))).withColumn("step", held / F.col("k"))
    ends = F.when(F.col("k") == 1, F.col("end_sec")).otherwise(F.col("start_sec") + (F.col("i") + 1) * F.col("step"))
    out = cuts.select("rec_id", (F.col("start_sec") + F.col("i") * F.col("step")).alias("from_sec"), ends.alias("end_sec")).withColumnRenamed("from_sec", "start_sec")
    out = sequence.numbered(out.withColumn("shard", F.floor(F.col("start_sec") / SHARD_S)), ["rec_id"], "shard", ["start_sec", "end_sec"], "chunk")
    return out.select("rec_id", (F.col("chunk") - 1).alias("chunk"), "start_sec", "end_sec")
