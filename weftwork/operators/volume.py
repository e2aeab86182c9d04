"""Progress and volume: counts by project and file, repetitions, words by match band."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import norm_lang, tokens
from weftwork.operators.memory import lookup, plain
from weftwork.session import salted_join

DONE = ("translated", "approved")


def located(segments: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Segments with their project and its base languages."""
    langs = projects.select(F.col("id").alias("project_id"), norm_lang(F.col("src_lang")).alias("src_lang"), norm_lang(F.col("tgt_lang")).alias("tgt_lang"))
    places = files.select(F.col("id").alias("file_id"), "project_id").join(langs, "project_id")
    return segments.join(places, "file_id")


def project_progress(projects: DataFrame, files: DataFrame, segments: DataFrame) -> DataFrame:
    """Files, segments and finished segments of every project, also of those that have none."""
    per_file = segments.groupBy("file_id").agg(F.count("*").alias("segments"), F.count_if(F.col("state").isin(*DONE)).alias("done"))
    per = files.join(per_file, files.id == per_file.file_id, "left").groupBy("project_id").agg(F.count("*").alias("files"), F.sum("segments").alias("segments"), F.sum("done").alias("done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = projects.join(per, projects.id == per.project_id, "left")
    name = F.when(F.trim(F.coalesce(projects["name"], F.lit(""))) == "", "Untitled").otherwise(projects["name"])
    return out.select(projects.id, name.alias("name"), zero("files"), zero("segments"), zero("done"))


def file_progress(files: DataFrame, segments: DataFrame) -> DataFrame:
    per = segments.groupBy("file_id").agg(F.count("*").alias("segments"), F.count_if(F.col("state").isin(*DONE)).alias("done"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.join(per, files.id == per.file_id, "left").select(files.id, files.project_id, files["name"], zero("segments"), zero("done"))


def repeated(segments: DataFrame) -> DataFrame:
    """Segments of located() with their words and whether their words stood in the project before, by file and place.

    A project's repeats of one text meet in one task only in number, as first places: the text's first occurrence is an
    aggregate, not a window, so a text that makes a third of all rows is no burden.
    """
    words = segments.withColumn("toks", tokens(F.col("source"))).withColumn("words", F.size("toks").cast("long"))
    words = words.withColumn("text_key", F.array_join("toks", " "))
    place = F.struct("file_id", "seq", "id")
    again = words.groupBy("project_id", "text_key").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = salted_join(words, again, ["project_id", "text_key"], ["id"], "left")
    return both.withColumn("repetition", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


def volume_bands(segments: DataFrame, memory: DataFrame, mode: str = "prefix") -> DataFrame:
    """Words of each project by band: exact, fuzzy_75_99, fuzzy_50_74, new, repetition; each new text is looked up once."""
    rows = repeated(segments)
    fresh = rows.where(~F.col("repetition") & (F.col("words") > 0)).withColumn("plain", plain(F.col("source")))
    asked = fresh.select("src_lang", "tgt_lang", "plain", "toks").distinct()
    best = lookup(asked, memory, 0.5, 1, mode).select("src_lang", "tgt_lang", "plain", "percent")
    p = F.col("percent")
    band = F.when(p >= 100, "exact").when(p >= 75, "fuzzy_75_99").when(p >= 50, "fuzzy_50_74").otherwise("new")
    matched = fresh.join(best, ["src_lang", "tgt_lang", "plain"], "left").select("project_id", band.alias("band"), "words")
    again = rows.where("repetition").select("project_id", F.lit("repetition").alias("band"), "words")
    return matched.unionByName(again).groupBy("project_id", "band").agg(F.sum("words").alias("words"), F.count("*").alias("segments"))
