"""Every query of the library's operators by name, and the SQL it is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.functions import text as X
from weftwork.operators import align, learn, lexicon, memory, pipelines, quality, suggest, volume
from weftwork.plans import oracles
from weftwork.sources import plain, tmx, xliff
from weftwork.sources.tables import table as t

Query = Callable[[SparkSession, str], DataFrame]


def _memory(s: SparkSession, d: str) -> DataFrame:
    return memory.upsert_units(t(s, d, "tm_units"))


def _located(s: SparkSession, d: str) -> DataFrame:
    return volume.located(t(s, d, "segments"), t(s, d, "files"), t(s, d, "projects"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return memory.queries_of(_located(s, d), "id")


def _asked_by_all(s: SparkSession, d: str) -> DataFrame:
    """What segments and the memory's own units ask for."""
    texts = _located(s, d).select("src_lang", "tgt_lang", "source").unionByName(_units(s, d).select("src_lang", "tgt_lang", "source"))
    return memory.queries_of(texts, "id")


def _lexicon(s: SparkSession, d: str) -> DataFrame:
    """The lexicon, and the words that units of the memory keep as they are."""
    both = F.array_intersect(X.tokens(F.col("source")), X.tokens(F.col("target")))
    kept = _memory(s, d).select("src_lang", "tgt_lang", F.explode(both).alias("src_word")).distinct()
    return t(s, d, "lexicon").unionByName(kept.select("src_lang", "tgt_lang", "src_word", F.col("src_word").alias("tgt_word"), F.lit(1.0).alias("prob"))).distinct()


def _units(s: SparkSession, d: str) -> DataFrame:
    """Units as pairs for the quality checks."""
    return t(s, d, "tm_units").select("id", "source", "target", X.norm_lang(F.col("src_lang")).alias("src_lang"), X.norm_lang(F.col("tgt_lang")).alias("tgt_lang"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """All segments as pairs for the quality checks."""
    return _located(s, d).select("id", "source", "target", "src_lang", "tgt_lang")


def _token_counts(s: SparkSession, d: str) -> DataFrame:
    words = t(s, d, "segments").select(F.explode(X.tokens(F.col("source"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def _languages(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").groupBy(X.norm_lang(F.col("lang")).alias("lang")).agg(F.count("*").alias("documents"), F.sum(F.char_length("text")).alias("characters"))


def _plain_lengths(s: SparkSession, d: str) -> DataFrame:
    c = X.collapse(X.strip_tags(F.col("source")))
    return t(s, d, "segments").select("id", F.char_length(c).alias("plain_length"), F.size(X.tokens(F.col("source"))).alias("words"))


def _sentences(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return plain.sentences(docs).select(F.col("id").alias("doc_id"), "seq", "source")


def _repetitions(s: SparkSession, d: str) -> DataFrame:
    rows = volume.repeated(_located(s, d)).where("repetition")
    return rows.groupBy("project_id").agg(F.count("*").alias("segments"), F.sum("words").alias("words"))


def _lookup(mode: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = memory.lookup(_asked(s, d), _memory(s, d), 0.5, 5, mode)
        return found.select("src_lang", "tgt_lang", "plain", "rank", "id", "percent")

    return run


def _exact(s: SparkSession, d: str) -> DataFrame:
    return memory.exact_matches(_asked_by_all(s, d), _memory(s, d))


def _bm25(s: SparkSession, d: str) -> DataFrame:
    asked = memory.keyed(_asked(s, d))
    best = memory.bm25_candidates(asked, _memory(s, d))
    return best.select("src_lang", "tgt_lang", "plain", "id", F.round("bm25", 6).alias("bm25"), "place")


def _bands(mode: str) -> Query:
    return lambda s, d: volume.volume_bands(_located(s, d), _memory(s, d), mode)


def _documents(s: SparkSession, d: str, apart: str) -> DataFrame:
    """Each file's finished segments as a source and a target document; with a line for each the file's name comes first."""
    done = t(s, d, "segments").where(F.col("state").isin("translated", "approved") & ~X.is_blank(F.col("source")) & ~X.is_blank(F.col("target")))
    line = lambda c: X.strip_space(F.regexp_replace(c, r"[\r\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+", " "))
    part = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("seq", "id", line(c).alias("x")))), lambda r: r["x"])
    texts = done.groupBy("file_id").agg(F.array_join(part(F.col("source")), apart).alias("s"), F.array_join(part(F.col("target")), apart).alias("t"))
    title = F.concat(line(F.concat(F.lit("File "), F.coalesce("name", F.lit("?")))), F.lit(apart)) if apart == "\n" else F.lit("")
    names = t(s, d, "files").select(F.col("id").alias("file_id"), title.alias("title"))
    return texts.join(names, "file_id").select(F.col("file_id").alias("pair_id"), F.concat("title", "s").alias("s_text"), F.concat("title", "t").alias("t_text"))


def _aligned_lines(s: SparkSession, d: str) -> DataFrame:
    langs = _located(s, d).select(F.col("file_id").alias("pair_id"), "src_lang", "tgt_lang").distinct()
    return align.aligned(_documents(s, d, "\n")).join(langs, "pair_id")


def _without_article(s: SparkSession, d: str) -> DataFrame:
    """All pairs, with the Dutch article "de" in two wordings that the Dutch rules object to."""
    both = _units(s, d).unionByName(_pairs(s, d).withColumn("id", -F.col("id")))
    return both.withColumn("target", F.regexp_replace(F.regexp_replace("target", "(^| )de ", "$1u heeft "), "(^| )het ", "$1Komma  Splitsing "))


def _tmx_round(s: SparkSession, d: str) -> DataFrame:
    """Units as documents of one tu each, and read again."""
    lines = tmx.unit_lines(_memory(s, d))
    docs = lines.select(F.col("id").alias("doc_id"), F.concat(F.lit(tmx.head("en", "20240101T000000Z")), "line", F.lit(tmx.FOOT)).alias("content"), "src_lang", "tgt_lang")
    return tmx.pairs(docs).select("doc_id", "src_lang", "tgt_lang", "source", "target")


def _xliff_round(s: SparkSession, d: str) -> DataFrame:
    """XLIFF files with their segments written in, and read again."""
    content = xliff.written(t(s, d, "files"), t(s, d, "segments"), t(s, d, "projects"))
    return xliff.units(content.select(F.col("file_id").alias("id"), F.col("content").alias("original"))).select("file_id", "unit_id", "target", "state")


def _deleted(s: SparkSession, d: str) -> DataFrame:
    """Rows that are left of each table without project 1."""
    tables = pipelines.without_project(1, t(s, d, "projects"), t(s, d, "files"), t(s, d, "segments"))
    counts = [x.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, x in zip(("projects", "files", "segments"), tables)]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])


def _terms_added(s: SparkSession, d: str) -> DataFrame:
    """The glossary with the lexicon's pairs of words added."""
    new = t(s, d, "lexicon").select("src_lang", "tgt_lang", F.col("src_word").alias("src_term"), F.col("tgt_word").alias("tgt_term"))
    return pipelines.with_terms(t(s, d, "glossary"), new).drop("id")


def _tmx_import(s: SparkSession, d: str) -> DataFrame:
    """The memory with itself imported from TMX, both ways round."""
    lines = tmx.unit_lines(_memory(s, d))
    docs = lines.select(F.col("id").alias("doc_id"), F.concat(F.lit(tmx.head("en", "20240101T000000Z")), "line", F.lit(tmx.FOOT)).alias("content"), "src_lang", "tgt_lang")
    return pipelines.import_tmx(_memory(s, d), docs).select("src_lang", "tgt_lang", "source", "target", "origin", "use_count")


def _pair_import(s: SparkSession, d: str) -> DataFrame:
    """The memory with each file's finished segments, aligned again as two documents."""
    langs = _located(s, d).select(F.col("file_id").alias("pair_id"), "src_lang", "tgt_lang").distinct()
    # the lexicon is trained by lexicon_ibm1
    units, _ = pipelines.import_documents(_memory(s, d), _documents(s, d, "\n").join(langs, "pair_id"), train=False)
    return units.select("src_lang", "tgt_lang", "source", "target", "origin", "use_count")


def _panel(s: SparkSession, d: str) -> DataFrame:
    rows = pipelines.panel(_located(s, d), _memory(s, d), _lexicon(s, d))
    best = F.get("matches", F.lit(0))
    return rows.select(
        "id", F.size(F.coalesce("matches", F.array())).alias("matches"), best["tm_id"].alias("tm_id"), best["percent"].alias("tm_percent"), "suggestion.text", "suggestion.provider", "suggestion.percent",
        F.coalesce(F.size("terms"), F.lit(0)).alias("terms"),
    )


def _stream(s: SparkSession, d: str, shape: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a stream over the table's files holds once all are read."""
    import uuid

    from weftwork.session import ensure_checkpoint_dir
    from weftwork.streaming import learning

    folder = f"{ensure_checkpoint_dir(s)}/stream-{uuid.uuid4().hex}"
    events = learning.events_stream(s, d, "confirm_events.parquet")
    return learning.run_once(shape(events), folder, mode)


def _stream_counts(s: SparkSession, d: str) -> DataFrame:
    from weftwork.streaming.learning import counted

    return _stream(s, d, lambda e: counted(e, "3650 days"), "complete")


def _stream_once(s: SparkSession, d: str) -> DataFrame:
    from weftwork.streaming.learning import once

    return _stream(s, d, lambda e: once(e, "3650 days").select("event_id", "segment_id", "state"), "append")


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "tm_stats": lambda s, d: memory.stats(t(s, d, "tm_units")),
        "tm_upsert": lambda s, d: _memory(s, d).withColumn("updated_us", F.unix_micros("updated_at")).drop("updated_at"),
        "tm_exact": _exact,
        "tm_bm25_top80": _bm25,
        "tm_lookup_top5": _lookup("bm25"),
        "tm_lookup_prefix": _lookup("prefix"),
        "concordance": lambda s, d: memory.concordance(_memory(s, d), "Sensor", "en", "ru").select("id", "source", "target", "use_count"),
        "concordance_wildcard": lambda s, d: memory.concordance(_memory(s, d), "tighten%if", "en", "nl").select("id", "source", "target", "use_count"),
        "tm_export": lambda s, d: _memory(s, d).where("src_lang = 'en' and tgt_lang = 'ru'").select("id", "source", "target").orderBy("id"),
        "project_progress": lambda s, d: volume.project_progress(t(s, d, "projects"), t(s, d, "files"), t(s, d, "segments")),
        "file_progress": lambda s, d: volume.file_progress(t(s, d, "files"), t(s, d, "segments")),
        "tokenize_counts": _token_counts,
        "norm_lang": _languages,
        "strip_tags_len": _plain_lengths,
        "segment_sentences": _sentences,
        "repetitions": _repetitions,
        "volume_bands": _bands("prefix"),
        "volume_bands_bm25": _bands("bm25"),
        "qa_report": lambda s, d: quality.report(_pairs(s, d), t(s, d, "glossary")),
        "qa_report_units": lambda s, d: quality.report(_units(s, d)),
        "qa_glossary": lambda s, d: quality.glossary_issues(_pairs(s, d), t(s, d, "glossary")),
        "qa_omission": lambda s, d: quality.omissions(_pairs(s, d), t(s, d, "lexicon")),
        "lexicon_ibm1": lambda s, d: lexicon.train(_memory(s, d)),
        "lexicon_terms": lambda s, d: lexicon.terms(_located(s, d).select("id", "src_lang", "tgt_lang", "source"), t(s, d, "lexicon")),
        "gloss": lambda s, d: lexicon.gloss(_asked(s, d), t(s, d, "lexicon")),
        "repair": lambda s, d: lexicon.repair(memory.lookup(memory.queries_of(_memory(s, d), "id"), _memory(s, d), 0.6, 3).where("percent < 100"), _lexicon(s, d)),
        "suggest": lambda s, d: suggest.suggestions(_asked(s, d), _memory(s, d), _lexicon(s, d)),
        "pretranslate": lambda s, d: suggest.pretranslated(_located(s, d), _memory(s, d), _lexicon(s, d)),
        "pretranslate_counts": lambda s, d: pipelines.filled_counts(_located(s, d), suggest.pretranslated(_located(s, d), _memory(s, d), _lexicon(s, d))),
        "align_lines": lambda s, d: align.aligned(_documents(s, d, "\n")),
        "align_lengths": lambda s, d: align.aligned(_documents(s, d, " ")),
        "pair_import_counts": lambda s, d: pipelines.import_counts(_aligned_lines(s, d)),
        "export_txt_parts": lambda s, d: plain.exported_parts(t(s, d, "segments"), 5),
        "export_txt": lambda s, d: plain.exported(t(s, d, "segments")),
        "tmx_lines": lambda s, d: tmx.unit_lines(_memory(s, d)),
        "tmx_documents": lambda s, d: tmx.documents(_memory(s, d), "20240101T000000Z"),
        "tmx_round_trip": _tmx_round,
        "xliff_units": lambda s, d: xliff.units(t(s, d, "files").where("kind = 'xliff'")),
        "xliff_round_trip": _xliff_round,
        "learn_settled": lambda s, d: learn.settled(t(s, d, "confirm_events"), _located(s, d)).select("segment_id", "target", "state"),
        "learn_taught": lambda s, d: learn.taught(t(s, d, "confirm_events"), _located(s, d)).drop("updated_at"),
        "learn_merged": lambda s, d: learn.merged(_memory(s, d), learn.taught(t(s, d, "confirm_events"), _located(s, d))).select("src_lang", "tgt_lang", "source", "target", "origin", "use_count"),
        "project_deleted": _deleted,
        "glossary_added": _terms_added,
        "tmx_import": _tmx_import,
        "pair_import": _pair_import,
        "panel": _panel,
        "stream_confirm_counts": _stream_counts,
        "stream_confirm_once": _stream_once,
    }
    for code in quality.CODES:
        if code in ("nl_compound", "nl_style"):
            found[f"qa_{code}"] = lambda s, d, c=code: quality.issues(_without_article(s, d), [c]).select("id", "severity")
            continue
        found[f"qa_{code}"] = lambda s, d, c=code: quality.issues(_units(s, d).unionByName(_pairs(s, d).withColumn("id", -F.col("id"))), [c]).select("id", "severity")
    return found


def oracle_sql() -> dict[str, str]:
    return oracles.all_sql()
