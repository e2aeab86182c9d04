"""Lexical primitives as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the code points that count as white space.
SPACE = r"[\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Fixed value: an inline tag.
TAG = r"<[^<>]+>"
#: Fixed value: a word for matching and scoring.
WORD = r"[\p{L}\p{N}_]+"
#: A longest run of letters and digits.
ALNUM = r"[\p{L}\p{N}]+"


def norm_lang(c: Column) -> Column:
    """Base subtag of a language code; null gives ''."""
    return F.split_part(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, " ")


def collapse(c: Column) -> Column:
    """White space runs become one space, none at either end."""
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(strip_tags(c)), F.lit(WORD), F.lit(0))


def tokens_of_plain(c: Column) -> Column:
    """Like tokens, for text without tags."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def alnum_words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(ALNUM), F.lit(0))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(f"[^{SPACE[1:]}"), F.lit(True))


#: Abbreviations that do not end a sentence when a full stop follows; any single letter is one as well.
ABBREVIATIONS = (
    "mr mrs ms dr prof sr jr st vs etc e.g i.e no vol fig approx "
    "dhr mevr drs ir bv nl o.a d.w.z bijv evt ca "
    "т.е т.д т.п и.о г гг ул им др проф акад стр рис"
).split()
_ABBREVIATION = "|".join(a.replace(".", r"\.") for a in sorted(ABBREVIATIONS, key=len, reverse=True))
#: A run of end marks before white space that ends a sentence: no abbreviation before it, no small letter after it.
SENTENCE_END = rf"(?<!(?<![\p{{L}}\p{{N}}_.])(?iu:{_ABBREVIATION}|\p{{L}}))(?<![.!?…])([.!?…]+) (?!\p{{IsLowercase}})"


def split_plain_sentences(c: Column) -> Column:
    """Sentences of a text without line breaks and with single spaces."""
    return F.split(F.regexp_replace(c, SENTENCE_END, "$1\x01"), "\x01")


def paragraphs(c: Column) -> Column:
    """What blank lines keep apart, each with collapsed white space; blank ones left out."""
    parts = F.split(c, rf"\n{SPACE}*\n|\r\n{SPACE}*\r\n")
    return F.filter(F.transform(parts, collapse), lambda p: p != "")


def numbers(c: Column) -> Column:
    """Numbers in order of value as text, decimal commas as points; repeats stay."""
    found = F.regexp_extract_all(c, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("."))))


def tag_names(c: Column) -> Column:
    """Names of inline tags in order, a slash before closing ones; attributes do not count."""
    found = F.regexp_extract_all(c, F.lit(r"<(/?[\p{L}\p{N}_:.-]+)[^<>]*>"), F.lit(1))
    return F.array_sort(found)


def words_as_symbols(words: Column, vocabulary: Column) -> Column:
    """Each word as one character: its place in ``vocabulary``, or one common character if it is not there.

    Edit distance over the characters is edit distance over the words, as long as one side is all in the vocabulary.
    """
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 255), 4, "0")), "UTF-16BE")), "")


def words_as_hashed_symbols(words: Column) -> Column:
    """Each word as one of 2^20 characters by its hash, without regard to another text.

    Edit distance over these is never more than over the words, and equal to it unless different words share a character.
    """
    symbol = lambda w: F.lpad(F.hex(F.xxhash64(w).bitwiseAND(F.lit(0xFFFFF)) + 0x10000), 8, "0")
    return F.decode(F.unhex(F.array_join(F.transform(words, symbol), "")), "UTF-32")
