"""Quality checks of source and target pairs: a code, a severity and a detail for each issue.

Input columns: id, source, target, src_lang, tgt_lang with base languages. A blank target is one issue and no other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import SPACE, is_blank, numbers, strip_space, tag_names, tokens



def S() -> Column:
    return F.col("source")


def T() -> Column:
    return F.col("target")


#: Fixed value: marks that end a segment.
_END_MARKS = ".!?:;…"


def _ends_marked(c: Column) -> Column:
    """A text without any character counts as marked, as its last character is in any set."""
    last = F.substring(F.regexp_replace(c, SPACE + "+$", ""), -1, 1)
    return F.when(last == "", F.lit(True)).otherwise(F.instr(F.lit(_END_MARKS), last) > 0)


def _first_repeat(words: Column) -> Column:
    at = F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda i: (F.get(words, i - 1) == F.get(words, i - 2)) & (F.length(F.get(words, i - 1)) > 1))
    return F.get(words, F.get(at, F.lit(0)) - 1)


def _number_detail() -> Column:
    a, b = F.col("s_numbers"), F.col("t_numbers")
    missing, added = F.filter(a, lambda x: ~F.array_contains(b, x)), F.filter(b, lambda x: ~F.array_contains(a, x))
    part = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(name + " "), F.array_join(F.slice(xs, 1, 5), ", ")))
    return F.concat_ws("; ", part("missing", missing), part("added", added))


def _ratio() -> Column:
    return F.char_length(T()) / F.greatest(F.lit(1), F.char_length(S()))


def _capital(c: Column) -> Column:
    return c.rlike(r"^\p{IsUppercase}")



def _words_in_both() -> Column:
    return (F.size("s_words") > 0) & (F.size("t_words") > 0)


#: (code, severity, language of the target or None, condition, detail), in the order of reports.
RULES: list[tuple[str, str, str | None, Callable[[], Column], Callable[[], Column]]] = [
    ("untranslated", "warning", None, lambda: (strip_space(S()) == strip_space(T())) & (F.col("src_lang") != F.col("tgt_lang")) & (F.size("s_words") > 2), lambda: F.lit("")),
    ("tags", "error", None, lambda: tag_names(S()) != tag_names(T()), lambda: F.concat_ws(" / ", F.size(tag_names(S())).cast("string"), F.size(tag_names(T())).cast("string"))),
    ("numbers", "error", None, lambda: F.col("s_numbers") != F.col("t_numbers"), _number_detail),
    ("whitespace", "warning", None, lambda: strip_space(T()) != T(), lambda: F.lit("")),
    ("double_space", "warning", None, lambda: F.instr(T(), "  ") > 0, lambda: F.lit("")),
    ("punct_end", "warning", None, lambda: _ends_marked(S()) != _ends_marked(T()), lambda: F.lit("")),
    ("length", "warning", None, lambda: _words_in_both() & ((_ratio() > 2.6) | (_ratio() < 0.35)), lambda: F.format_string("%.1f", _ratio())),
    ("repeated_word", "warning", None, lambda: _first_repeat(F.col("t_words")).isNotNull(), lambda: _first_repeat(F.col("t_words"))),
    ("capitalization", "warning", None, lambda: S().rlike(r"^\p{L}") & T().rlike(r"^\p{L}") & (_capital(S()) != _capital(T())), lambda: F.lit("")),
    ("ru_quotes", "warning", "ru", lambda: T().rlike('"[^"]+"'), lambda: F.lit("")),
    ("ru_dash", "warning", "ru", lambda: T().rlike(f"{SPACE}-{SPACE}"), lambda: F.lit("")),
    ("ru_mixed_script", "error", "ru", lambda: T().rlike("[а-яА-ЯёЁ][a-zA-Z]|[a-zA-Z][а-яА-ЯёЁ]"), lambda: F.lit("")),
    ("nl_compound", "warning", "nl", lambda: T().rlike(rf"(?iU)\bkomma{SPACE}+splitsing\b"), lambda: F.lit("")),
    ("nl_style", "warning", "nl", lambda: T().rlike(rf"(?iU)\bu{SPACE}+heeft\b"), lambda: F.lit("")),
]
CODES = ["empty", *[r[0] for r in RULES]]


def _prepared(pairs: DataFrame) -> DataFrame:
    """Null texts are empty ones."""
    texts = pairs.withColumns({"source": F.coalesce("source", F.lit("")), "target": F.coalesce("target", F.lit(""))})
    return texts.withColumns({"s_words": tokens(S()), "t_words": tokens(T()), "s_numbers": numbers(S()), "t_numbers": numbers(T())})


def issues(pairs: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """(id, place, code, severity, detail): all issues of each pair, ``place`` in the order of reports."""
    wanted = set(codes or CODES)
    blank = is_blank(T())

    def issue(place: int, code: str, severity: str, hit: Column, detail: Column) -> Column:
        fields = [F.lit(place).alias("place"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), detail.alias("detail")]
        return F.when(hit, F.struct(*fields))

    found = [issue(0, "empty", "error", blank, F.lit(""))] if "empty" in wanted else []
    for place, (code, severity, lang, hit, detail) in enumerate(RULES, 1):
        if code in wanted:
            when = ~blank & hit() & (F.lit(True) if lang is None else F.col("tgt_lang") == lang)
            found.append(issue(place, code, severity, when, detail()))
    return _prepared(pairs).select("id", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull())))


def glossary_issues(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """(id, src_term, tgt_term): terms of the source whose translation the target lacks.

    Terms meet segments by their first word, so only segments that hold it are tested for the whole term.
    """
    texts = pairs.select("id", "src_lang", "tgt_lang", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target")).where(~is_blank(T()))
    first = lambda c: F.regexp_extract(F.lower(c), r"[\p{L}\p{N}_]+", 0)
    terms = glossary.select("src_lang", "tgt_lang", "src_term", "tgt_term", first(F.col("src_term")).alias("word")).where("word <> ''").distinct()
    words = texts.withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("source"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))))
    quoted = lambda c: F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    whole = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted(F.col("src_term")), F.lit(r"(?![\p{L}\p{N}_])"))
    met = words.join(terms, ["src_lang", "tgt_lang", "word"])
    return met.where(F.rlike(F.col("source"), whole) & (F.instr(F.lower("target"), F.lower("tgt_term")) == 0)).select("id", "src_term", "tgt_term").distinct()


def omissions(pairs: DataFrame, lexicon: DataFrame, least: float = 0.5, most: int = 3) -> DataFrame:
    """(id, words): up to ``most`` source words, in order, that are sure of a translation and have none of theirs in the target."""
    texts = pairs.select("id", "src_lang", "tgt_lang", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("target", F.lit("")).alias("target")).where(~is_blank(T()))
    places = texts.select("id", "src_lang", "tgt_lang", F.posexplode(tokens(S())).alias("place", "src_word"))
    known = lexicon.where(F.col("prob") >= least).groupBy("src_lang", "tgt_lang", "src_word").agg(F.collect_set("tgt_word").alias("trans"))
    # only words that the lexicon knows go on, and meet the targets' words by the pair's id
    asked = places.join(known, ["src_lang", "tgt_lang", "src_word"]).groupBy("id", "src_word").agg(F.min("place").alias("place"), F.first("trans").alias("trans"))
    lost = asked.join(texts.select("id", tokens(T()).alias("t_words")), "id").where(~F.arrays_overlap("trans", "t_words"))
    listed = F.slice(F.array_sort(F.collect_list(F.struct("place", "src_word"))), 1, most)
    return lost.groupBy("id").agg(F.array_join(F.transform(listed, lambda x: x["src_word"]), ", ").alias("words"))


def report(pairs: DataFrame, glossary: DataFrame | None = None) -> DataFrame:
    """(id, errors, warnings, codes) of the pairs that have issues; with a glossary a warning for each term that is not kept."""
    found = issues(pairs).select("id", "place", "code", "severity")
    if glossary is not None:
        terms = glossary_issues(pairs, glossary).select("id", F.lit(len(RULES) + 1).alias("place"), F.lit("glossary").alias("code"), F.lit("warning").alias("severity"))
        found = found.unionByName(terms)
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), ",")
    return found.groupBy("id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), codes.alias("codes"))
