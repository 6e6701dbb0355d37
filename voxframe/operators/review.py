"""Checking a reviewer's decisions on candidates, and the report of what is left to a human.

Each rule gives a named violation with the place of its decision; nothing is
reported while there is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Severities in order, and categories.
SEVERITIES = ["critical", "substantive", "minor"]
CATEGORIES = [
    "commitment_or_action", "condition_or_scope", "date_or_deadline", "decision", "meaningful_omission", "name_or_entity", "negation_or_polarity",
    "number_or_unit", "other_semantic", "risk_or_compliance", "technical_term",
]
_FIELDS = {"discrepancy": ["candidate_id", "verdict", "severity", "categories", "review_reason"], "same_meaning": ["candidate_id", "verdict", "review_reason"]}
REVIEW_FIELDS = ["schema_version", "comparison_file", "decisions"]


def parse_decisions(raw: DataFrame) -> DataFrame:
    """``rec_id, ord`` and the fields of each decision from its JSON text (``rec_id, ord, decision``)."""
    kind = "struct<candidate_id:string,verdict:string,severity:string,categories:array<string>,review_reason:string>"
    return raw.select("rec_id", "ord", F.json_object_keys("decision").alias("fields"), F.from_json("decision", kind).alias("d")).select("rec_id", "ord", "fields", "d.*")


def header_violations(reviews: DataFrame) -> DataFrame:
    """``rec_id, rule`` of whole reviews (``rec_id, review`` as JSON text, ``comparison_version``)."""
    keys = F.json_object_keys("review")
    version = F.get_json_object("review", "$.schema_version").try_cast("int")
    decisions = F.get_json_object("review", "$.decisions")
    tests = [
        ("review_is_no_object", keys.isNull()), ("unexpected_review_fields", F.size(F.array_except(keys, F.array(*map(F.lit, REVIEW_FIELDS)))) > 0),
        ("review_version", F.coalesce(version != 1, keys.isNotNull())), ("comparison_version", F.coalesce(F.col("comparison_version") != 1, F.lit(True))),
        ("decisions_are_no_array", keys.isNotNull() & ~F.coalesce(F.trim(decisions).startswith("["), F.lit(False))),
    ]
    return reviews.select("rec_id", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("rule"))


def violations(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rec_id, ord, candidate_id, rule`` of every broken rule; ``ord`` is null for a candidate without decision."""
    known = candidates.select("rec_id", F.col("id").alias("candidate_id"), F.lit(True).alias("known")).distinct()
    rows = decisions.join(known, ["rec_id", "candidate_id"], "left")
    nth = F.row_number().over(Window.partitionBy("rec_id", "candidate_id").orderBy("ord"))
    rows = rows.withColumn("nth", nth)
    verdict = F.coalesce("verdict", F.lit(""))
    allowed = F.when(verdict == "discrepancy", F.array(*map(F.lit, _FIELDS["discrepancy"]))).otherwise(F.array(*map(F.lit, _FIELDS["same_meaning"])))
    differs, c = verdict == "discrepancy", F.col("categories")
    good = F.coalesce((F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c)) & (F.size(F.array_except(c, F.array(*map(F.lit, CATEGORIES)))) == 0), F.lit(False))
    tests = [
        ("verdict", ~verdict.isin(*_FIELDS)), ("unexpected_fields", verdict.isin(*_FIELDS) & (F.size(F.array_except("fields", allowed)) > 0)), ("unknown_candidate", F.col("known").isNull()),
        ("repeated_candidate", F.col("known").isNotNull() & (F.col("nth") > 1)), ("review_reason", F.coalesce(F.trim("review_reason") == "", F.lit(True))),
        ("severity", differs & ~F.coalesce(F.col("severity").isin(SEVERITIES), F.lit(False))), ("categories", differs & ~good),
    ]
    broken = rows.select("rec_id", "ord", "candidate_id", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests)))).alias("rule"))
    missing = known.join(decisions, ["rec_id", "candidate_id"], "left_anti").select("rec_id", F.lit(None).cast("int").alias("ord"), "candidate_id", F.lit("uncovered_candidate").alias("rule"))
    return broken.unionByName(missing)


def first_violation(broken: DataFrame) -> DataFrame:
    """The one of each review that a reader in order meets first."""
    w = Window.partitionBy("rec_id").orderBy(F.col("ord").asc_nulls_last(), "candidate_id", "rule")
    return broken.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def disagreements(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """What a human has to hear: discrepancies with the candidate's own interval and versions, by severity and time."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    rows = decisions.where("verdict = 'discrepancy'").join(candidates.withColumnRenamed("id", "candidate_id"), ["rec_id", "candidate_id"])
    nth = F.row_number().over(Window.partitionBy("rec_id").orderBy(rank, "start_seconds", "ord"))
    return rows.select("rec_id", nth.alias("place"), "candidate_id", F.lit("pending_human_review").alias("status"), F.col("severity").alias("priority"), "categories", "start_seconds", "end_seconds", F.trim("review_reason").alias("review_reason"))


def severity_counts(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """``rec_id, reviewed, critical, substantive, minor``."""
    n = candidates.groupBy("rec_id").agg(F.count("*").alias("reviewed"))
    by = decisions.where("verdict = 'discrepancy'").groupBy("rec_id").agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))
    return n.join(by, "rec_id", "left").na.fill(0, SEVERITIES)
