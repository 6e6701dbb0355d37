"""Release notes and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import text as X


def notes(releases: DataFrame, most: int = 5) -> DataFrame:
    """``release_id, notes``: the first bullets of each body, with their indented lines joined to them."""
    lines = releases.select("release_id", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n|\n|\r")).alias("pos", "line"))
    bullet = F.trim("line").rlike(r"^[-*+]\s+\S")
    goes_on = ~bullet & (F.trim("line") != "") & F.col("line").rlike(r"^\s")
    w = Window.partitionBy("release_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # A line that neither begins nor continues a bullet closes it.
    lines = lines.withColumns({"part": F.sum(F.when(goes_on, 0).otherwise(1)).over(w), "bullet": bullet})
    parts = lines.groupBy("release_id", "part").agg(F.max("bullet").alias("bullet"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: F.trim(x["line"])), " ").alias("raw")).where("bullet")
    parts = parts.withColumn("note", X.clean_note(F.col("raw"))).where("note <> ''")
    return parts.groupBy("release_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("part", "note"))), lambda x: x["note"]), 1, most).alias("notes"))


def summaries(releases: DataFrame, page: str) -> DataFrame:
    """``release_id, version, tag, name, url, notes`` of releases with a tag or a name."""
    tag = F.coalesce(F.nullif("tag_name", F.lit("")), F.nullif("name", F.lit("")))
    rows = releases.withColumn("tag", tag).where("tag is not null").join(notes(releases), "release_id", "left")
    return rows.select(
        "release_id", F.regexp_replace("tag", "^v+", "").alias("version"), "tag", F.coalesce(F.nullif("name", F.lit("")), "tag").alias("name"), F.coalesce(F.nullif("html_url", F.lit("")), F.lit(page)).alias("url"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes"),
    )
