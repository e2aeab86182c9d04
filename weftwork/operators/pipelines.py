"""What users do in one go: imports into the memory, the suggestion panel, deletion with all that belongs, guards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import collapse, norm_lang
from weftwork.operators import align, lexicon, memory, suggest
from weftwork.sources import tmx

# Language pairs that are offered unless others are given, and states of a segment.
PAIRS = {("en", "ru"), ("ru", "en"), ("en", "nl"), ("nl", "en")}
STATES = {"new", "draft", "translated", "approved", "rejected"}


def check_pair(src: str, tgt: str, pairs: set[tuple[str, str]] | None = None) -> tuple[str, str]:
    """Base languages of a pair that is offered; else an error, before anything is planned."""
    pair = tmx.base(src), tmx.base(tgt)
    if pair not in (PAIRS if pairs is None else pairs):
        raise ValueError(f"language pair {pair[0]}-{pair[1]} is not offered")
    return pair


def check_state(state: str) -> str:
    if state not in STATES:
        raise ValueError(f"no such state: {state}")
    return state


def _as_units(pairs: DataFrame, origin: str) -> DataFrame:
    """Pairs as units; their ids come from their text, so that a repeated import gives the same."""
    key = F.abs(F.xxhash64("src_lang", "tgt_lang", "source", "target"))
    return pairs.select(key.alias("id"), "src_lang", "tgt_lang", "source", "target", F.lit(origin).alias("origin"), F.lit(0).cast("long").alias("use_count"), F.lit(None).cast("timestamp").alias("updated_at"))


def imported(units: DataFrame, pairs: DataFrame, origin: str) -> DataFrame:
    """The memory with new pairs: those that are known gain uses, in a table that keeps the ids of what was there."""
    known = units.select("id", "src_lang", "tgt_lang", "source", "target", "origin", "use_count", "updated_at", F.lit(0).alias("later"))
    both = known.unionByName(_as_units(pairs, origin).withColumn("later", F.lit(1)))
    clean = both.withColumns({"src_lang": norm_lang(F.col("src_lang")), "tgt_lang": norm_lang(F.col("tgt_lang")), "source": collapse(F.col("source")), "target": collapse(F.col("target"))}).where("source <> '' and target <> ''")
    first = F.min(F.struct("later", "id", "origin"))
    out = clean.groupBy("src_lang", "tgt_lang", "source", "target").agg(first.alias("first"), (F.sum("use_count") + F.count("*") - 1).cast("long").alias("use_count"), F.max("updated_at").alias("updated_at"))
    return out.select("first.id", "src_lang", "tgt_lang", "source", "target", "first.origin", "use_count", "updated_at")


def import_tmx(units: DataFrame, documents: DataFrame, both_directions: bool = True) -> DataFrame:
    """The memory with the pairs of TMX documents (doc_id, content, src_lang, tgt_lang), by default both ways round."""
    return imported(units, tmx.pairs(documents, both_directions), "tmx")


def import_documents(units: DataFrame, documents: DataFrame, train: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """The memory with what document pairs (pair_id, src_lang, tgt_lang, s_text, t_text) align to, and a lexicon trained on it."""
    langs = documents.select("pair_id", norm_lang(F.col("src_lang")).alias("src_lang"), norm_lang(F.col("tgt_lang")).alias("tgt_lang"))
    pairs = align.aligned(documents).join(langs, "pair_id")
    out = imported(units, pairs, "corpus")
    return out, lexicon.train(out) if train else None


def panel(segments: DataFrame, units: DataFrame, words: DataFrame, mode: str = "prefix") -> DataFrame:
    """(id, matches, suggestion, terms) of segments with base languages: the best four matches, a suggestion, known words."""
    asked = memory.queries_of(segments, "id")
    found = memory.lookup(asked, units, 0.5, 4, mode)
    keys = ["src_lang", "tgt_lang", "plain"]
    match = F.struct("rank", F.col("id").alias("tm_id"), "percent", "target")
    matches = found.groupBy(*keys).agg(F.array_sort(F.collect_list(match)).alias("matches"))
    best = suggest.suggestions(asked, units, words, mode).select(*keys, F.struct("text", "provider", "percent").alias("suggestion"))
    known = lexicon.terms(segments.select("id", "src_lang", "tgt_lang", "source"), words).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("src_word", "translations"))).alias("terms"))
    rows = segments.select("id", "src_lang", "tgt_lang", memory.plain(F.col("source")).alias("plain"))
    return rows.join(matches, keys, "left").join(best, keys, "left").join(known, "id", "left").select("id", "matches", "suggestion", "terms")


def without_project(project_id: int, projects: DataFrame, files: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a project and all that belongs to it."""
    gone = files.where(F.col("project_id") == project_id).select(F.col("id").alias("file_id"))
    keep = F.coalesce(F.col("project_id") != project_id, F.lit(True))
    return projects.where(F.col("id") != project_id), files.where(keep), segments.join(gone, "file_id", "left_anti").select(*segments.columns)


def with_terms(glossary: DataFrame, terms: DataFrame) -> DataFrame:
    """The glossary with new terms (src_lang, tgt_lang, src_term, tgt_term); those that it holds are passed over."""
    keys = ["src_lang", "tgt_lang", "src_term", "tgt_term"]
    clean = terms.select(norm_lang(F.col("src_lang")).alias("src_lang"), norm_lang(F.col("tgt_lang")).alias("tgt_lang"), F.trim("src_term").alias("src_term"), F.trim("tgt_term").alias("tgt_term")).where("src_term <> '' and tgt_term <> ''").distinct()
    new = clean.join(glossary.select(*keys), keys, "left_anti").withColumn("id", F.abs(F.xxhash64(*keys)))
    return glossary.select("id", *keys).unionByName(new.select("id", *keys))


def import_counts(pairs: DataFrame) -> DataFrame:
    """(pairs_found, added): pairs of an import, and those with text on both sides, repeated ones as well; what an import reports."""
    whole = (collapse(F.col("source")) != "") & (collapse(F.col("target")) != "")
    return pairs.agg(F.count("*").alias("pairs_found"), F.count_if(whole).alias("added"))


def filled_counts(segments: DataFrame, filled: DataFrame) -> DataFrame:
    """(file_id, open, filled): new segments without a target of each file, and how many of them a pre-translation fills."""
    empty = segments.where((F.col("state") == "new") & (F.coalesce("target", F.lit("")) == "")).select("id", "file_id")
    both = empty.join(filled.select("id", F.lit(1).alias("one")), "id", "left")
    return both.groupBy("file_id").agg(F.count("*").alias("open"), F.count("one").alias("filled"))
