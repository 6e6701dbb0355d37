"""Words from a recogniser's sub-word tokens, with repaired times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def words_of_tokens(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, word_idx, start_ms, end_ms, word, conf`` from ``keys, tok_idx, text, p, from_ms, to_ms``.

    A token that begins with a blank begins a word; markers such as [_BEG_] are skipped. A word begins no
    earlier than the one before it ends and ends no earlier than it begins; confidence is the mean of its tokens'.
    """
    w = Window.partitionBy(*keys).orderBy("tok_idx")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = tokens.where("text is not null").where(~(F.col("text").startswith("[_") & F.col("text").endswith("]")))
    rows = rows.withColumn("word_no", F.sum(F.when(F.col("text").startswith(" "), 1).otherwise(0)).over(upto))
    raw = rows.groupBy(*keys, "word_no").agg(
        F.trim(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("tok_idx", "text"))), lambda t: t["text"]), "")).alias("word"),
        F.coalesce(F.min_by("from_ms", "tok_idx"), F.lit(0).cast("long")).alias("s"), F.max_by("to_ms", F.when(F.col("to_ms").isNotNull(), F.col("tok_idx"))).alias("e"), F.bround(F.avg("p"), 4).alias("conf"),
    ).where("word <> ''").withColumn("e", F.coalesce("e", "s"))
    order = Window.partitionBy(*keys).orderBy("word_no")
    end = F.max(F.greatest("s", "e")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    raw = raw.withColumn("end_ms", end)
    raw = raw.withColumn("start_ms", F.greatest("s", F.coalesce(F.lag("end_ms").over(order), F.col("s"))))
    return raw.select(*keys, (F.row_number().over(order) - 1).alias("word_idx"), "start_ms", "end_ms", "word", "conf")
