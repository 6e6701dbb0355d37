"""The queries of the operators in this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxframe.llm import leakage, nearest, packing, sentences, terms, textform, turns
from voxframe.llm.sql import SQL
from voxframe.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "raw_segments"), table(spark, d, "speakers"), text=False)


def p1_turns(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns(table(spark, d, "raw_segments"), table(spark, d, "speakers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    recordings = table(spark, d, "recordings")
    words = textform.changed(table(spark, d, "words"), recordings, "word", "word_id")
    return words.unionByName(textform.changed(table(spark, d, "segments"), recordings, "segment", "seg_id"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.word_pairs(table(spark, d, "words"), table(spark, d, "recordings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return terms.match_mentions(table(spark, d, "mentions"), table(spark, d, "terms"))


def p6_sequences(spark: SparkSession, d: str) -> DataFrame:
    return packing.sequences(table(spark, d, "documents"))


def p6_unused(spark: SparkSession, d: str) -> DataFrame:
    return packing.unused_space(packing.sequences(table(spark, d, "documents")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    return leakage.paraphrases(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_turns": p1_turns, "p2_found": p2_found, "p3_found": p3_found, "p5_found": p5_found, "p6_sequences": p6_sequences, "p6_unused": p6_unused, "p7_found": p7_found, "p7_paraphrases": p7_paraphrases, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
