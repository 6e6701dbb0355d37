"""Filling, numbering and grouping along an order, in shards, so that no task holds all rows of a huge group.

``shard`` is a column that never falls along the order (such as index div 1000).
Windows run within (keys, shard); what passes from shard to shard comes from
summaries of one or two rows a shard.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def filled(df: DataFrame, keys: list[str], shard: str, order: list[str], value: str) -> DataFrame:
    """``df`` with nulls of ``value`` from the nearest row before that has one, else the nearest after."""
    here = Window.partitionBy(*keys, shard).orderBy(*order)
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*keys, shard).agg(F.max_by(value, F.struct(*order)).alias("_last"), F.min_by(value, F.struct(*order)).alias("_first"))
    shards = df.select(*keys, shard).distinct().join(ends, [*keys, shard], "left")
    over = Window.partitionBy(*keys).orderBy(shard)
    carried = shards.select(
        *keys, shard, F.last("_last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"), F.first("_first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("_after")
    )
    before = F.last(value, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(here.rowsBetween(0, Window.unboundedFollowing))
    rows = df.withColumns({"_b": before, "_a": after}).join(carried, [*keys, shard], "left")
    return rows.withColumn(value, F.coalesce("_b", "_before", "_a", "_after")).drop("_b", "_a", "_before", "_after")


def runs(df: DataFrame, keys: list[str], shard: str, order: list[str], label: str) -> DataFrame:
    """``df`` with ``run_shard, run``: equal for rows of one run of equal ``label`` in order."""
    here = Window.partitionBy(*keys, shard).orderBy(*order)
    rows = df.withColumn("_new", F.when(F.lag(label).over(here) == F.col(label), 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    each = rows.groupBy(*keys, shard, "_run").agg(F.first(label).alias("_label"))
    last = each.groupBy(*keys, shard).agg(F.max("_run").alias("_last"))
    edges = each.join(last, [*keys, shard]).where("_run = 1 or _run = _last")
    chain = Window.partitionBy(*keys).orderBy(shard, "_run")
    joins = (F.col("_run") == 1) & (F.lag("_label").over(chain) == F.col("_label")) & (F.lag(shard).over(chain) != F.col(shard))
    edges = edges.withColumn("_joins", F.coalesce(joins, F.lit(False)))
    head = F.last(F.when(~F.col("_joins"), F.struct(F.col(shard).alias("run_shard"), F.col("_run").alias("run"))), ignorenulls=True)
    heads = edges.withColumn("_head", head.over(chain.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, shard, "_run", "_head.*")
    out = rows.join(heads, [*keys, shard, "_run"], "left")
    return out.withColumns({"run_shard": F.coalesce("run_shard", F.col(shard)), "run": F.coalesce("run", "_run")}).drop("_run")


def previous(df: DataFrame, keys: list[str], shard: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: ``value`` of the row before in order, null for a group's first."""
    here = Window.partitionBy(*keys, shard).orderBy(*order)
    last = df.groupBy(*keys, shard).agg(F.max_by(value, F.struct(*order)).alias("_end"))
    carried = last.select(*keys, shard, F.lag("_end").over(Window.partitionBy(*keys).orderBy(shard)).alias("_before"))
    rows = df.withColumns({"_nth": F.row_number().over(here), out: F.lag(value).over(here)}).join(carried, [*keys, shard], "left")
    return rows.withColumn(out, F.when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col(out))).drop("_nth", "_before")


def numbered(df: DataFrame, keys: list[str], shard: str, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, 3 and so on within ``keys`` in order."""
    here = Window.partitionBy(*keys, shard).orderBy(*order)
    size = df.groupBy(*keys, shard).agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(*keys).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn(out, F.row_number().over(here)).join(size.select(*keys, shard, F.coalesce(before, F.lit(0)).alias("_before")), [*keys, shard])
    return rows.withColumn(out, (F.col(out) + F.col("_before")).cast("int")).drop("_before")


def heads(n: int, breaks: Callable[[int, int, int], np.ndarray]) -> list[int]:
    """Where groups begin, each at the first break after the one before.

    ``breaks(head, a, b)`` tells for rows ``a`` to ``b`` whether a group that began at ``head`` ends before them;
    what lies beyond the next break is never looked at, in steps that double.
    """
    out, head = [], 0
    while head < n:
        out.append(head)
        a, step = head + 1, 16
        head = n
        while a < n:
            found = np.flatnonzero(breaks(out[-1], a, min(n, a + step)))
            if len(found):
                head = a + int(found[0])
                break
            a, step = a + step, 2 * step
    return out
