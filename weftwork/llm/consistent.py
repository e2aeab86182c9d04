"""Problem 6: text that looks the same is brought to one form.

Full-width letters and digits become plain ones, a mark set apart joins its character, invisible characters go, every
space becomes U+0020. Then script-aware repair as named: in a token that mixes Latin, Cyrillic and Greek, letters foreign to
its dominant script are replaced by their look-alikes, if the resulting word occurs in the corpus vocabulary; else the next
script is tried, and a token no vocabulary word explains stays as it is, and is still named.

A test by table over whole Arrow batches finds the few rows that need a closer look. Cases: a null field gives a null text and no kinds; an empty
text stays empty; tables are read by name of column, others are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.llm.folding import code_points
from weftwork.session import cut

KINDS = ("full_width", "mark", "invisible", "space", "look_alike")

# Letters that look alike, at the same place of each pair of strings.
LATIN_CYRILLIC = ("ABCEHIJKMOPSTXYaceijopsxyÏï", "АВСЕНІЈКМОРЅТХУасеіјорѕхуЇї")
LATIN_GREEK = ("ABEHIKMNOPTXYZaiknopuvxy", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖαικηορυνχγ")
CYRILLIC_GREEK = ("АВГЕНІКМОПРТФХакоруф", "ΑΒΓΕΗΙΚΜΟΠΡΤΦΧακορυφ")
#: Spaces other than U+0020, and invisible characters that are not of category Cf.
OTHER_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
OTHER_INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Format characters that are seen.
SEEN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2"


def _pairs() -> dict[tuple[str, str], dict[str, str]]:
    out: dict[tuple[str, str], dict[str, str]] = {}
    for a, b, (x, y) in (("L", "C", LATIN_CYRILLIC), ("L", "G", LATIN_GREEK), ("C", "G", CYRILLIC_GREEK)):
        out[a, b], out[b, a] = dict(zip(x, y)), dict(zip(y, x))
    return out


LOOK = _pairs()
_COMPOSED = [d.split() for d in (unicodedata.decomposition(chr(c)) for c in range(0xC0, 0x11940) if not 0xAC00 <= c <= 0xD7A3) if d and d[0] != "<" and " " in d]
#: Marks that end some character's canonical decomposition.
JOINING = "".join(sorted({chr(int(d[-1], 16)) for d in _COMPOSED if unicodedata.category(chr(int(d[-1], 16)))[0] == "M"}))
INVISIBLE = "".join(chr(c) for c in [*range(0x10000), *range(0xE0000, 0xE0080)] if unicodedata.category(chr(c)) == "Cf" and chr(c) not in SEEN_FORMAT) + OTHER_INVISIBLE
_INVISIBLE = frozenset(INVISIBLE)
_WIDE = {c: c - 0xFEE0 for r in ((0xFF10, 0xFF1A), (0xFF21, 0xFF3B), (0xFF41, 0xFF5B)) for c in range(*r)}


def _script(ch: str) -> str:
    """L, C, G, or '' for anything else."""
    c = ord(ch)
    if c < 0x250 or 0x1E00 <= c < 0x1F00 or 0x250 <= c < 0x2B0:
        return "L" if ch.isalpha() and c not in (0xAA, 0xB5, 0xBA) else ""
    if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000:
        return "G" if ch.isalpha() and c not in (0x37E, 0x387) else ""
    if 0x400 <= c < 0x530 or 0x1C80 <= c < 0x1C90 or 0x2DE0 <= c < 0x2E00 or 0xA640 <= c < 0xA6A0:
        return "C" if ch.isalpha() else ""
    return ""


#: A word of the vocabulary.
_WORDS = re.compile("[A-Za-z\\xc0-\\u02af\\u0370-\\u052f\\u1c80-\\u1c8f\\u1e00-\\u1fff][0-9A-Za-z\\xc0-\\u02af\\u0300-\\u052f\\u1c80-\\u1c8f\\u1e00-\\u1fff]*")
# What a code point is to the test of a batch: odd by itself; nothing, when letters are compared; a letter of a script.
_ODD, _PASS, _SCRIPTS = 1, 2, {"L": 4, "C": 8, "G": 16}


@lru_cache(1)
def _codes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in map(ord, JOINING + INVISIBLE + OTHER_SPACES):
        out[c] = _ODD
    for c in _WIDE:
        out[c] = _ODD | (_SCRIPTS["L"] if chr(c).isalpha() else _PASS)
    for c in range(0x3000):
        ch = chr(c)
        if s := _script(ch):
            out[c] |= _SCRIPTS[s]
        elif ch.isdigit() or unicodedata.category(ch)[0] == "M" or ch in _INVISIBLE:
            out[c] |= _PASS
    return out


def suspects(column: pa.Array) -> np.ndarray:
    """Which rows hold an odd character, or letters of two of the three scripts with nothing but digits or marks between."""
    cps, starts = code_points(column)
    n = len(starts) - 1
    codes = _codes()[cps]
    out = np.zeros(n, bool)
    odd = np.flatnonzero(codes & _ODD)
    out[np.searchsorted(starts, odd, "right") - 1] = True
    rest = np.flatnonzero((codes & _PASS) == 0)
    kinds = codes[rest] & 28
    meet = np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0))
    if len(meet):
        a, b = (np.searchsorted(starts, rest[meet + k], "right") - 1 for k in (0, 1))
        out[a[a == b]] = True
    return out


#: A longest run of Latin, Cyrillic and Greek letters, digits and marks: letters of other scripts part tokens.
_TOKEN = re.compile("[0-9A-Za-z\\xaa\\xb5\\xba\\xc0-\\u02af\\u0300-\\u052f\\u1c80-\\u1c8f\\u1e00-\\u1fff\\u2de0-\\u2dff\\ua640-\\ua69f]+")


def _joined(text: str) -> str:
    """``text`` with each mark joined to its character where the pair has a single form; nothing else composes."""
    if not any(c in _JOINING for c in text):
        return text
    out: list[str] = []
    i, n = 0, len(text)
    while i < n:
        j = i + 1
        while j < n and unicodedata.category(text[j])[0] == "M":
            j += 1
        cluster = text[i:j]
        if j > i + 1:
            one = unicodedata.normalize("NFC", cluster)
            cluster = one if len(one) < len(cluster) else cluster
        out.append(cluster)
        i = j
    return "".join(out)


_JOINING = frozenset(JOINING)
_DROP = dict.fromkeys(map(ord, INVISIBLE))
_SPACES = dict.fromkeys(map(ord, OTHER_SPACES), " ")


def mixed_tokens(text: str) -> list[tuple[str, list[str]]]:
    """Tokens in which letters of different scripts of the three meet, with the words they may stand for, likeliest first."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m[0]
        if token.isascii():
            continue
        scripts = [_script(c) for c in token]
        present = {s for s in scripts if s}
        if len(present) < 2:
            continue
        candidates = []
        for to in sorted(present, key=lambda s: (-scripts.count(s), s)):
            letters = [c if s in ("", to) else LOOK[s, to].get(c) for c, s in zip(token, scripts)]
            if None not in letters:
                candidates.append("".join(letters))
        out.append((token, candidates))
    return out


def plain_form(text: str) -> tuple[str, list[str]]:
    """All but the look-alikes: the text, and the kinds of what was changed."""
    kinds = []
    for kind, new in (("full_width", lambda t: t.translate(_WIDE)), ("invisible", lambda t: t.translate(_DROP)), ("mark", _joined), ("space", lambda t: t.translate(_SPACES))):
        changed = new(text)
        if changed != text:
            kinds.append(kind)
            text = changed
    return text, kinds


def _inspect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        x = x.filter(pa.array(suspects(x["text"])))
        forms = [plain_form(t) for t in x["text"].to_pylist()]
        mixed = [dict(mixed_tokens(t)) for t, _ in forms]
        kinds = [k + ["look_alike"] * bool(m) for (_, k), m in zip(forms, mixed)]
        at = pa.array([k for k, found in enumerate(kinds) if found], pa.int64())
        columns = [
            pa.array([t for t, _ in forms], pa.string()),
            pa.array(kinds, pa.list_(pa.string())),
            pa.array([[{"token": t, "words": w} for t, w in m.items()] for m in mixed], pa.list_(pa.struct([("token", pa.string()), ("words", pa.list_(pa.string()))]))),
        ]
        yield pa.RecordBatch.from_arrays([x[c].take(at) for c in ("rec_table", "rec_id", "field")] + [c.take(at) for c in columns], names=["rec_table", "rec_id", "field", "plain", "kinds", "mixed"])


def _in_form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that need nothing, as they are."""
    for x in batches:
        at = [k for k, (t, odd) in enumerate(zip(x["text"].to_pylist(), suspects(x["text"]))) if not odd or (f := plain_form(t))[1] == [] and not mixed_tokens(f[0])]
        yield x.take(pa.array(at, pa.int64()))


def _unmixed_words(text: str) -> list[str]:
    """Words of a suspect text's plain form, in small letters, without those that mix scripts."""
    text, _ = plain_form(text)
    mixed = {token for token, _ in mixed_tokens(text)}
    if mixed:
        text = _TOKEN.sub(lambda m: " " if m[0] in mixed else m[0], text)
    return [w for w in _WORDS.findall(text.lower()) if w.isascii() or len({*map(_script, w)} - {""}) < 2]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for x in batches:
        for t, odd in zip(x["text"].to_pylist(), suspects(x["text"])):
            if t:
                seen.update(_unmixed_words(t) if odd else _WORDS.findall(t.lower()))
        if len(seen) > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])
            seen = set()
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string())], names=["word"])


def _substitute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        out = []
        for text, mixed, known in zip(x.plain, x.mixed, x.known):
            have = set(known if known is not None else ())
            for m in mixed:
                word = next((w for w in m["words"] if w.lower() in have), None)
                if word:
                    text = _TOKEN.sub(lambda x, m=m, w=word: w if x[0] == m["token"] else x[0], text)
            out.append(text)
        x["text"] = out
        yield x[["rec_table", "rec_id", "field", "text", "kinds"]]


def fields_of(segments: DataFrame, units: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, text) of every field that is to be brought in form."""
    a = segments.select(F.lit("segments").alias("rec_table"), F.col("id").alias("rec_id"), F.lit("target").alias("field"), F.col("target").alias("text"))
    b = units.select(F.lit("tm_units").alias("rec_table"), F.col("id").alias("rec_id"), F.explode(F.create_map(F.lit("source"), F.col("source"), F.lit("target"), F.col("target"))).alias("field", "text"))
    return a.unionByName(b)


def vocabulary(fields: DataFrame) -> DataFrame:
    """Words of all fields, in small letters, those that mix scripts left out; a word may come several times."""
    return fields.select("rec_table", "rec_id", "field", "text").where("text is not null").mapInArrow(_vocabulary, "word string")


def consistent_form(fields: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field, text, kinds): each field in its one form, and the kinds of what was not."""
    fields = fields.select("rec_table", "rec_id", "field", "text")
    kept = "rec_table string, rec_id long, field string"
    given = fields.where("text is not null")
    odd = cut(given.mapInArrow(_inspect, f"{kept}, plain string, kinds array<string>, mixed array<struct<token:string,words:array<string>>>"))
    odd = odd.withColumn("row", F.monotonically_increasing_id())
    asked = odd.select("row", F.explode(F.flatten(F.transform("mixed", lambda m: m["words"]))).alias("w")).select("row", F.lower("w").alias("word"))
    known = asked.select("word").distinct().join(vocabulary(fields), "word", "left_semi")
    found = asked.distinct().join(known, "word").groupBy("row").agg(F.collect_list("word").alias("known"))
    repaired = odd.join(found, "row", "left").mapInPandas(_substitute, f"{kept}, text string, kinds array<string>")
    none = F.array().cast("array<string>").alias("kinds")
    plain = given.mapInArrow(_in_form, f"{kept}, text string").unionByName(fields.where("text is null")).select("rec_table", "rec_id", "field", "text", none)
    return plain.unionByName(repaired)


def out_of_form(segments: DataFrame, units: DataFrame) -> DataFrame:
    """(rec_table, rec_id, field): the fields that were not in their one form."""
    return consistent_form(fields_of(segments, units)).where("size(kinds) > 0").select("rec_table", "rec_id", "field")
