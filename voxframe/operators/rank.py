"""Ranking the words of each recording that a recogniser most likely got wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions import text as X

# Latin words that are right as they stand, and fillers of speech.
LATIN_OK = [
    "llm", "gpt", "mcp", "http", "https", "api", "ai", "rag", "ci", "cd", "ui", "ux", "sql", "json", "yaml", "xml", "html", "css", "js", "ts", "url", "pdf", "csv",
    "gpu", "cpu", "ram", "sdk", "ide", "os", "vpn", "dns", "ssh", "tls", "jwt", "gigachat", "github", "openai", "docker", "kubernetes", "python", "java", "go", "react",
    "typescript", "linux", "windows", "macos", "ios", "android", "aws",
]
FILLERS = [
    "ну", "вот", "это", "как", "бы", "типа", "щас", "че", "чё", "ага", "угу", "мм", "хмм", "нда", "э", "эм", "а", "и", "но", "да", "нет", "так", "там", "то",
]


def cuts(words: DataFrame, by: list[str], low: float = 0.15, very_low: float = 0.05) -> DataFrame:
    """``by, low_cut, very_low_cut``: confidences at ranks ``int(n * share)`` of the sorted ones.

    Counted per distinct confidence first; those are summed up in hundredths of the scale and across these.
    """
    n = words.where("conf is not null").groupBy(*by, "conf").agg(F.count("*").alias("n")).withColumn("shard", F.floor(F.col("conf") * 100))
    shards = n.groupBy(*by, "shard").agg(F.sum("n").alias("own"))
    every = Window.partitionBy(*by)
    before = F.coalesce(F.sum("own").over(every.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select(*by, "shard", before.alias("before"), F.sum("own").over(every).alias("total"))
    within = F.sum("n").over(Window.partitionBy(*by, "shard").orderBy("conf").rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("within", within).join(shards, [*by, "shard"]).withColumn("upto", F.col("before") + F.col("within"))

    def at(share: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor(F.col("total") * share), F.col("conf")))

    return n.groupBy(*by).agg(at(low).alias("low_cut"), at(very_low).alias("very_low_cut"))


def variants(words: DataFrame, by: list[str]) -> DataFrame:
    """``by, skeleton, variants``: spellings that share consonants, where there are several."""
    long = words.where("length(core) >= 5").select(*by, X.consonants(F.col("core")).alias("skeleton"), X.lower_ru(F.col("core")).alias("v"))
    return long.groupBy(*by, "skeleton").agg(F.sort_array(F.collect_set("v")).alias("variants")).where("size(variants) > 1")


def signals(words: DataFrame) -> DataFrame:
    """``words`` (core, conf, canonical, reason, low_cut, very_low_cut; ``listed``: in a word list, if there is one) with ``score`` and ``signals``; 0 and none where unsuspicious."""
    core, low = F.col("core"), X.lower_ru(F.col("core"))
    suggest = F.col("reason").startswith("suggest:")
    skipped = low.isin(FILLERS) | (F.length(core) < 4) | (F.col("canonical").isNotNull() & ~suggest)
    mixed = core.rlike(X.CYRILLIC) & core.rlike(X.LATIN)
    parts = F.filter(F.split(core, "[-–—]"), lambda p: p != "")
    acronym = F.exists(parts, lambda p: p.rlike("^[A-Za-z]+$") & ~X.lower_ru(p).isin(LATIN_OK))
    latin = ~mixed & core.rlike(r"^[A-Za-z][A-Za-z.-]*$") & ~low.isin(LATIN_OK)
    unlisted = latin & ~F.col("listed") if "listed" in words.columns else latin
    homoglyph = mixed & X.mixes_alphabets(core)
    very = F.coalesce(F.col("conf") <= F.col("very_low_cut"), F.lit(False))
    weak = F.coalesce(F.col("conf") <= F.col("low_cut"), F.lit(False))
    tests = [("M", 4, homoglyph), ("M-", 2, mixed & ~homoglyph & acronym), ("L", 2, latin), ("L+", 1, unlisted), ("S", 3, suggest), ("C", 2, very), ("C-", 1, weak & ~very), ("N", 1, weak & core.rlike(r"\d"))]
    score = sum((F.when(t, n).otherwise(0) for _, n, t in tests), F.lit(0))
    found = F.array_compact(F.array(*(F.when(t, F.lit(s)) for s, _, t in tests)))
    empty = F.array().cast("array<string>")
    return words.withColumns({"score": F.when(skipped, 0).otherwise(score), "signals": F.when(skipped, empty).otherwise(found)})


def suspicious(words: DataFrame, matches: DataFrame, budget: int = 40, english: DataFrame | None = None) -> DataFrame:
    """The ``budget`` most suspicious spellings of each transcript.

    ``words``: rec_id, engine, word_id, seg_id, pos, start_sec, text, conf, core; ``matches``: core, canonical, reason of the
    lexicon; ``english``: word, a word list. A spelling keeps its first word's score; more counts, then the earlier start,
    come first among equals.
    """
    by = ["rec_id", "engine"]
    rows = words.where("core <> ''").join(matches, "core", "left").withColumn("reason", F.coalesce("reason", F.lit("")))
    if english is not None:
        listed = english.select(F.lower(F.trim(english.columns[0])).alias("_low")).distinct().withColumn("listed", F.lit(True))
        rows = rows.withColumn("_low", X.lower_ru(F.col("core"))).join(listed, "_low", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    rows = signals(rows.join(cuts(words, by), by, "left")).where("score > 0").withColumn("skeleton", X.consonants(F.col("core")))
    rows = rows.join(variants(words, by), [*by, "skeleton"], "left")
    rows = rows.withColumns({
        "score": F.col("score") + F.when(F.col("variants").isNotNull(), 3).otherwise(0),
        "signals": F.when(F.col("variants").isNotNull(), F.concat("signals", F.array(F.lit("V")))).otherwise(F.col("signals")),
        "variants": F.coalesce("variants", F.array().cast("array<string>")),
        "key": X.lower_ru(F.col("core")),
    })
    first = F.min_by(F.struct("start_sec", "core", "conf", "score", "signals", "variants"), F.struct("start_sec", "word_id", "seg_id", "pos"))
    each = rows.groupBy(*by, "key").agg(first.alias("f"), F.count("*").alias("count")).select(*by, "key", "f.*", "count")
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("count"), "start_sec", "key")
    ranked = each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= budget)
    return ranked.select(*by, "rank", X.clock(F.col("start_sec")).alias("at"), "start_sec", F.col("core").alias("word"), "conf", "score", "signals", "variants", "count")
