"""Suggestions: exact match, repaired match, fuzzy match or gloss, the first that there is; and pre-translation with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import tokens_of_plain
from weftwork.operators.lexicon import gloss, repair
from weftwork.operators.memory import lookup, plain

# Who made a suggestion.
EXACT, REPAIRED, MACHINE, FUZZY, GLOSS = "TM (exact)", "TM + lexicon repair", "Argos Translate (local NMT)", "TM (fuzzy)", "Lexicon gloss (rough draft)"
KEYS = ["src_lang", "tgt_lang", "plain"]


def suggestions(asked: DataFrame, memory: DataFrame, lexicon: DataFrame, mode: str = "prefix", translated: DataFrame | None = None) -> DataFrame:
    """(src_lang, tgt_lang, plain, text, provider, percent) of each text for which something is known.

    ``asked`` has base languages and plain texts. ``translated``, if given, has machine translations (src_lang, tgt_lang, plain,
    text), which stand between repaired and fuzzy matches.
    """
    asked = asked.select(*KEYS).where("plain <> ''").distinct().withColumn("toks", tokens_of_plain(F.col("plain")))
    best = lookup(asked, memory, 0.6, 1, mode)
    fixed = repair(best.where("percent < 100"), lexicon).select(*KEYS, "repaired")
    drafts = gloss(asked, lexicon)
    all_of = asked.select(*KEYS).join(best.select(*KEYS, "target", F.col("percent").alias("match")), KEYS, "left").join(fixed, KEYS, "left").join(drafts, KEYS, "left")
    if translated is None:
        all_of = all_of.withColumn("machine", F.lit(None).cast("string"))
    else:
        all_of = all_of.join(translated.select(*KEYS, F.col("text").alias("machine")).dropDuplicates(KEYS), KEYS, "left")
    option = lambda text, provider, percent: F.struct(text.alias("text"), F.lit(provider).alias("provider"), percent.cast("int").alias("percent"))
    match, target = F.col("match"), F.col("target")
    chosen = (
        F.when(match >= 100, option(target, EXACT, F.lit(100)))
        .when(F.col("repaired").isNotNull(), option(F.col("repaired"), REPAIRED, F.least(F.lit(99), match + 5)))
        .when(F.col("machine").isNotNull(), option(F.col("machine"), MACHINE, F.lit(85)))
        .when(match.isNotNull(), option(target, FUZZY, match))
        .when(F.col("gloss").isNotNull(), option(F.col("gloss"), GLOSS, F.lit(30)))
    )
    return all_of.withColumn("best", chosen).where("best is not null").select(*KEYS, "best.text", "best.provider", "best.percent")


def pretranslated(segments: DataFrame, memory: DataFrame, lexicon: DataFrame, least: int = 50, mode: str = "prefix") -> DataFrame:
    """(id, target, state): new segments without a target that a suggestion of at least ``least`` percent fills, as drafts."""
    empty = segments.where((F.col("state") == "new") & (F.coalesce("target", F.lit("")) == "")).withColumn("plain", plain(F.col("source")))
    found = suggestions(empty, memory, lexicon, mode).where(F.col("percent") >= least)
    return empty.join(found, KEYS).select("id", F.col("text").alias("target"), F.lit("draft").alias("state"))
