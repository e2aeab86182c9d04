"""The translation memory: upsert, exact and fuzzy matches, concordance, statistics.

Columns of a memory: id, src_lang, tgt_lang, source, target, origin, use_count, updated_at.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftwork.functions.text import collapse, norm_lang, strip_tags, tokens_of_plain, words_as_hashed_symbols, words_as_symbols
from weftwork.operators import fulltext
from weftwork.operators.fulltext import CANDIDATES, TERMS
from weftwork.session import cut, release

#: Slots in which words are counted to order them by rarity: the table that is broadcast has a byte each.
SLOTS = 1 << 20
#: Common words make one of SHARE or more of all words of the memory and stand there COMMON times at least, so they are SHARE at most.
SHARE, COMMON = 8192, 64
#: Words that fill a slot no more than this (see words_of) are few enough to meet by alone; 49 is 64 times.
FEW = 49
#: Texts of under twice so many words have one class of words in the search for candidates, of under four times so many two.
ONE_CLASS = 16
_MASK = (1 << 64) - 1
#: Terms of a full-text search are common from COMMON_DF units on, and from a share of 1 / COMMON_SHARE.
COMMON_DF, COMMON_SHARE = 256, 256
#: Units and questions that meet in one task at most; so few questions are one part.
BLOCK, PART, PART_LEAST = 1 << 18, 1 << 16, 1 << 11
#: Questions of a task that are searched at once.
AT_ONCE = 1 << 12


def upsert_units(units: DataFrame) -> DataFrame:
    """One unit for each language pair, source and target, white space collapsed and blank sides dropped.

    The first keeps its id and origin; each repeat adds one use, besides the uses a row brings; the latest time counts.
    """
    clean = units.select(
        "id",
        norm_lang(F.col("src_lang")).alias("src_lang"),
        norm_lang(F.col("tgt_lang")).alias("tgt_lang"),
        collapse(F.col("source")).alias("source"),
        collapse(F.col("target")).alias("target"),
        "origin",
        F.coalesce("use_count", F.lit(0)).alias("use_count"),
        "updated_at",
    ).where("source <> '' and target <> ''")
    out = clean.groupBy("src_lang", "tgt_lang", "source", "target").agg(
        F.min("id").alias("id"),
        F.min(F.struct("id", "origin")).alias("first"),
        (F.sum("use_count") + F.count("*") - 1).cast("long").alias("use_count"),
        F.max("updated_at").alias("updated_at"),
    )
    return out.select("id", "src_lang", "tgt_lang", "source", "target", F.col("first.origin").alias("origin"), "use_count", "updated_at")


def stats(memory: DataFrame) -> DataFrame:
    """Units of each language pair."""
    return memory.groupBy(norm_lang(F.col("src_lang")).alias("src_lang"), norm_lang(F.col("tgt_lang")).alias("tgt_lang")).agg(F.count("*").alias("units"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def concordance(memory: DataFrame, query: str, src: str, tgt: str, limit: int = 30) -> DataFrame:
    """Units of a pair whose source or target is LIKE %query%: case counts beyond ASCII, % and _ stay wildcards."""
    fold = lambda c: F.translate(c, _UPPER, _LOWER)
    pattern = "%" + query.translate(str.maketrans(_UPPER, _LOWER)) + "%"
    hit = F.expr("false")
    for side in ("source", "target"):
        hit = hit | F.like(fold(F.col(side)), F.lit(pattern), F.lit("\x01"))
    pair = (norm_lang(F.col("src_lang")) == src) & (norm_lang(F.col("tgt_lang")) == tgt)
    return memory.where(pair & hit).orderBy(F.desc("use_count"), F.desc_nulls_last("updated_at"), "id").limit(limit)


def plain(c: Column) -> Column:
    """What a segment is looked up by."""
    return collapse(strip_tags(c))


def queries_of(segments: DataFrame, key: str, text: str = "source") -> DataFrame:
    """Distinct (src_lang, tgt_lang, plain, toks) that segments with base languages ask for."""
    return segments.select("src_lang", "tgt_lang", plain(F.col(text)).alias("plain")).where("plain <> ''").distinct().withColumn("toks", tokens_of_plain(F.col("plain")))


def exact_matches(asked: DataFrame, memory: DataFrame) -> DataFrame:
    """(src_lang, tgt_lang, plain, id): units whose source is just that."""
    return asked.select("src_lang", "tgt_lang", "plain").join(memory.select("src_lang", "tgt_lang", F.col("source").alias("plain"), "id"), ["src_lang", "tgt_lang", "plain"])


def similarity(a: Column, b: Column) -> Column:
    """1 - word edit distance / longer length, 1 for two empty sides."""
    longest = F.greatest(F.size(a), F.size(b))
    vocabulary = F.array_distinct(a)
    distance = F.levenshtein(words_as_symbols(a, vocabulary), words_as_symbols(b, vocabulary))
    return F.when(longest == 0, F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(1 - distance / longest)


def percent(score: Column) -> Column:
    return F.bround(F.bround(score, 4) * 100).cast("int")


def numbered(words: Column) -> Column:
    """Words with repeats told apart, so that the array is a set."""
    repeats = F.transform(words, lambda w, i: F.concat_ws("\t", w, F.size(F.filter(F.slice(words, F.lit(1), i + 1), lambda x: x == w)).cast("string")))
    return F.when(F.size(F.array_distinct(words)) == F.size(words), F.transform(words, lambda w: F.concat(w, F.lit("\t1")))).otherwise(repeats)


class Words:
    """What is known of a memory's words: how full their hash slots are, and the common ones, numbered by rising count."""

    def __init__(self, fill: bytes, common: list[int]):
        self.fill, self.common = fill, {h: k for k, h in enumerate(common)}


def word_hashes(toks: str = "toks") -> Column:
    """A hash of each word with its language pair."""
    return F.transform(toks, lambda w: F.xxhash64("src_lang", "tgt_lang", w))


def words_of(texts: DataFrame) -> Words:
    """Counts of the words in ``texts``: SLOTS bytes, in logarithmic steps, and SHARE common words at most."""
    counts = cut(texts.select(F.explode(word_hashes()).alias("h")).groupBy("h").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = counts.groupBy(F.pmod("h", F.lit(SLOTS)).cast("int").alias("slot")).agg(F.sum("n").alias("n")).toArrow()  # SLOTS rows at most
    fill = np.zeros(SLOTS, np.uint8)
    fill[slots["slot"].to_numpy()] = np.minimum(255, 1 + 8 * np.log2(np.maximum(1, slots["n"].to_numpy())))
    common = counts.where(F.col("n") >= max(COMMON, total / SHARE)).toArrow().to_pydict()
    return Words(fill.tobytes(), [h for _, h in sorted(zip(common["n"], common["h"]))])


def _needed(n: int, least: float) -> int:
    return math.ceil(least * n - 1e-9)


def _classes(n: int, least: float) -> set[int]:
    """Numbers of classes of words, a power of two that goes by the shorter text's length, for all lengths that may meet ``n``."""
    return {1 << max(0, (m // ONE_CLASS).bit_length() - 1) for m in range(max(1, _needed(n, least)), n + 1)}


def _pair_cell(x: int, y: int, k: int) -> int:
    return (x * 0x9E3779B97F4A7C15 + (y ^ x >> 29) * 0xC2B2AE3D27D4EB4F + k) & _MASK


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _met_by(order: list[tuple[int, int]], before: int, n: int, least: float, seed: int, classes: set[int]) -> set[int]:
    """Cells by two words of one class, from (hash, nth of its kind) in order of rarity; ``before`` rarer words meet elsewhere."""
    out: set[int] = set()
    for k in classes:
        members: dict[int, list[int]] = {}
        for h, c in order[: max(0, n - _needed(n, least) + k + 1 - before)]:
            members.setdefault(h % k, []).append((h * 31 + c) & _MASK)
        for own in members.values():
            out.update(_pair_cell(x, y, seed + k) for x, y in combinations(own, 2))
    return out


def text_marks(hashes: list[int], words: Words, least: float) -> tuple[str, int, list[int]]:
    """(shape, bits, cells) of a text of these words.

    The shape has the common words as characters and one character for every other word. Two texts that share no rare word are as
    like as their shapes, if two rare words count as different there. All others of a similarity of ``least`` meet in a cell: they
    share ``ceil(least * longer)`` words, of which the rarest two stand among the rarest ``n - ceil(least * n) + 2`` of either. If
    the rarest is in few texts it is a cell by itself, else it is one with each that comes after it. Long texts part their words
    into classes, by which the cells grow with the words and not with their square: of the rarest ``n - ceil(least * n) + k + 1``
    they share k + 1, so two of these fall into one of k classes. ``bits``: a bit for each word, by hash.
    """
    n, fill, common = len(hashes), words.fill, words.common
    seen: dict[int, int] = {}
    order, bits = [], 0
    for h in hashes:
        seen[h] = seen.get(h, 0) + 1  # repeats count as words of their own
        bits |= 1 << (h & 63)
        order.append((h in common, fill[h % SLOTS], h & _MASK, seen[h]))
    order.sort()
    alone, out = n - _needed(n, least) + 1, set()
    few = 0
    for c, f, h, nth in order:
        if c or f > FEW:
            break
        if f and few < alone and nth == 1:  # an empty slot has no word of the memory
            out.add((h * 0x9E3779B97F4A7C15) & _MASK)
        few += 1
    rest = [(h, nth) for _, _, h, nth in order[few:]]
    rare = sum(not c for c, _, _, _ in order[few:])
    if rare:
        classes = _classes(n, least)
        if 1 in classes:  # only cells of a rare word: what meets by common words alone meets by its shape
            head = [(h * 31 + nth) & _MASK for h, nth in rest[: max(0, alone + 1 - few)]]
            out.update(_pair_cell(head[i], y, 1) for i in range(min(rare, len(head))) for y in head[i + 1 :])
        out |= _met_by(rest, few, n, least, 0, classes - {1})
        if _needed(n, least) <= 1:
            out.update((h * 0x9E3779B97F4A7C15) & _MASK for h, nth in rest[:rare] if nth == 1)
    shape = "".join(chr(0x4E00 + common[h]) if h in common else "\x01" for h in hashes)
    return shape, _signed(bits), [_signed(x) for x in out]


def shape_marks(shape: str, least: float, seed: int) -> tuple[int, list[int]]:
    """(bits, cells) of a shape, which meets every shape of a similarity of ``least`` in a cell."""
    seen: dict[str, int] = {}
    order, bits = [], 0
    for x in sorted(shape):
        if x != "\x01":
            seen[x] = seen.get(x, 0) + 1
            bits |= 1 << (ord(x) & 63)
            order.append((ord(x), seen[x]))
    n, seed = len(shape), seed & _MASK
    out = _met_by(order, n - len(order), n, least, seed, _classes(n, least))
    if _needed(n, least) <= 1:
        out.update((h * 0x9E3779B97F4A7C15 + seed) & _MASK for h, c in order if c == 1)
    return _signed(bits), [_signed(x) for x in out]


def _marks(words, least: float):
    @pandas_udf("shape string, bits long, cells array<long>")
    def marks(hashes: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([text_marks(h.tolist(), words.value, least) for h in hashes], columns=["shape", "bits", "cells"])

    return marks


def _shape_marks(shape: str, least: Column, seed: str) -> Column:
    @pandas_udf("bits long, cells array<long>")
    def marks(shapes: pd.Series, leasts: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shape_marks(*x) for x in zip(shapes.tolist(), leasts.tolist(), seeds.tolist())], columns=["bits", "cells"])

    return marks(shape, least, seed)


def _missing(a: str, b: str) -> Column:
    """How many words the text of bits ``a`` has for certain that the one of bits ``b`` lacks."""
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(b)))


def _best_by_shape(asked: DataFrame, memory: DataFrame, least: float, limit: int) -> DataFrame:
    """(shape_id, id, score): of each asked shape the best ``limit`` units by their shapes' similarity, uses and id.

    A shape whose best ``limit`` include a unit has that unit among its own first ``limit``, and is itself among the best ``limit``
    shapes by their first unit.
    """
    first = Window.partitionBy("shape_id").orderBy(F.desc("use_count"), "id")
    units = cut(memory.select("shape_id", "pair", "shape", "id", "use_count").withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit))
    ys = units.groupBy("shape_id", "pair", "shape").agg(F.count("*").alias("own"), F.max_by("use_count", -F.col("place")).alias("uses"), F.max_by("id", -F.col("place")).alias("first_id"))
    n = F.char_length("shape")
    blank = n - F.char_length(F.translate("shape", "\x01", ""))
    whole = asked.select("shape_id", "pair", "shape").distinct().join(ys.select("shape_id", "own"), "shape_id", "left")
    # where the same shape has enough units, worse ones are of no use
    known = F.when(F.col("own") >= limit, F.greatest(F.lit(least), 1 - blank / n - 1e-4)).otherwise(F.lit(least))
    xs = whole.select(F.col("shape_id").alias("x_id"), "pair", "shape", known.alias("least"), n.alias("nx"), blank.alias("bx")).withColumn("m", _shape_marks("shape", F.col("least"), "pair"))
    xs = xs.select("x_id", "least", "nx", "bx", F.col("shape").alias("x"), F.col("m.bits").alias("x_bits"), F.explode("m.cells").alias("cell"))
    ys = ys.select(F.col("shape_id").alias("y_id"), "pair", "shape", "uses", "first_id", n.alias("ny"), blank.alias("by")).withColumn("m", _shape_marks("shape", F.lit(least), "pair"))
    ys = ys.select("y_id", "uses", "first_id", "ny", "by", F.translate("shape", "\x01", "\x02").alias("y"), F.col("m.bits").alias("y_bits"), F.explode("m.cells").alias("cell"))
    longest = F.greatest("nx", "ny")
    apart = F.greatest(F.col("bx") + _missing("x_bits", "y_bits"), F.col("by") + _missing("y_bits", "x_bits"), F.abs(F.col("nx") - F.col("ny")))
    tasks = int(memory.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows meet very many: their size says nothing of the work
    met = xs.repartition(tasks, "cell").join(ys, "cell").where(longest * (1 - F.col("least")) + 1e-9 >= apart)
    met = met.withColumn("d", F.expr("levenshtein(x, y, cast(floor((1 - least) * greatest(nx, ny) + 1e-9) as int))")).where("d >= 0")
    met = met.select("x_id", "y_id", "uses", "first_id", (1 - F.col("d") / longest).alias("raw")).distinct()
    order = lambda uses, who: Window.partitionBy("x_id").orderBy(F.desc(F.bround("raw", 4)), F.desc(uses), who)
    shapes = met.withColumn("rank", F.row_number().over(order("uses", "first_id"))).where(F.col("rank") <= limit).select("x_id", "y_id", "raw")
    best = shapes.join(units.select(F.col("shape_id").alias("y_id"), "id", "use_count"), "y_id")
    best = best.withColumn("rank", F.row_number().over(order("use_count", "id"))).where(F.col("rank") <= limit)
    return best.select(F.col("x_id").alias("shape_id"), "id", F.col("raw").alias("score"))


def prefix_candidates(asked: DataFrame, memory: DataFrame, least: float, limit: int) -> DataFrame:
    """(key, id) that hold the best ``limit`` units of a similarity of ``least`` for each key; none of these is left out.

    Units that share no rare word with a text are as like as their shapes (``text_marks``): of these the best ``limit`` of each
    shape are enough, found once a shape. The others meet by rare words, as far as they may reach the last of those. Rarity is
    counted in SLOTS hash slots: any order of slots keeps the search whole.
    """
    marks = _marks(memory.sparkSession.sparkContext.broadcast(words_of(memory)), least)
    pair = F.xxhash64("src_lang", "tgt_lang").alias("pair")
    side = lambda df, *own: df.where("size(toks) > 0").select(*own, pair, F.size("toks").alias("n"), marks(word_hashes()).alias("m")).select(*own, "pair", "n", "m.*").withColumn("shape_id", F.xxhash64("pair", "shape"))
    ask, mem = cut(side(asked, "key")), cut(side(memory, "id", "use_count"))
    release(memory.sparkSession)
    best = cut(_best_by_shape(ask, mem, least, limit))
    release(memory.sparkSession)
    last = best.groupBy("shape_id").agg(F.when(F.count("*") >= limit, F.greatest(F.lit(least), F.min("score") - 1e-4)).otherwise(F.lit(least)).alias("least"))
    xs = ask.join(last, "shape_id", "left").select("key", F.col("n").alias("nx"), F.col("bits").alias("x_bits"), F.coalesce("least", F.lit(least)).alias("least"), F.explode("cells").alias("cell"))
    ys = mem.select("id", F.col("n").alias("ny"), F.col("bits").alias("y_bits"), F.explode("cells").alias("cell"))
    apart = F.greatest(_missing("x_bits", "y_bits"), _missing("y_bits", "x_bits"), F.abs(F.col("nx") - F.col("ny")))
    met = xs.join(ys, "cell").where(F.greatest("nx", "ny") * (1 - F.col("least")) + 1e-9 >= apart)
    return ask.select("key", "shape_id").join(best, "shape_id").select("key", "id").unionByName(met.select("key", "id")).distinct()


#: Letters whose marks a full-text index drops; other scripts keep theirs.
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿšž"
_BARE = "aaaaaaceeeeiiiinooooouuuuyysz"


def index_terms(c: Column) -> Column:
    """Terms as a full-text index has them: small, no marks on Latin letters, underscores part words."""
    return F.regexp_extract_all(F.translate(F.lower(c), _MARKED, _BARE), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pair() -> Column:
    return F.xxhash64("src_lang", "tgt_lang").alias("pair")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _asked_terms() -> Column:
    """The TERMS longest distinct terms of ``plain``, those of one length in order."""
    ordered = F.array_sort(F.transform(F.array_distinct(index_terms(F.col("plain"))), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.transform(F.slice(ordered, 1, TERMS), lambda x: x["w"])


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many each row has)."""
    column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(np.int64), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _in_block(n_docs: int, avgdl: float, common: float, least: float, limit: int | None):
    """Searches one block of units for one part of the questions: rows of ``_searched``."""

    def run(block: pa.Table, asked: pa.Table) -> pa.Table:
        is_unit = pc.is_valid(block["id"])
        units, words = block.filter(is_unit).sort_by("id"), block.filter(pc.invert(is_unit))
        known, df = _flat(words["terms"])[0], _flat(words["dfs"])[0]
        order = np.argsort(known)
        known, df = known[order], df[order]
        asked = asked.sort_by("near")
        q_terms, q_sizes = _flat(asked["terms"])
        at = np.minimum(np.searchsorted(known, q_terms), max(0, len(known) - 1))
        there = known[at] == q_terms if len(known) else np.zeros(len(q_terms), bool)
        used = np.unique(at[there])
        ids, terms = np.asarray(units["id"]).astype(np.int64), _flat(units["terms"])
        whole = fulltext.Block(*terms, known[used], df[used], n_docs, avgdl, common)
        whole = fulltext.Block(*terms, known[used], df[used], n_docs, avgdl, common)
        (y, ny), same_words = _flat(units["toks"]), np.asarray(pc.is_null(units["toks"]))  # where they are null, a unit's words are just its terms
        y_at = np.where(same_words, len(y) + fulltext.starts_of(terms[1])[:-1], fulltext.starts_of(ny)[:-1])
        y, ny = np.concatenate((y, terms[0])), np.where(same_words, terms[1], ny)
        bits = fulltext.word_bits(y[fulltext.ranges(y_at, ny)], ny) if limit else None
        own, uses = np.asarray(units["own"]).astype(np.int64), np.asarray(units["use_count"]).astype(np.int64)
        by_own = np.argsort(own, kind="stable")
        several = len(asked) > 0 and asked["blocks"][0].as_py() > 1  # places are known when the blocks meet

        def lists(asked: pa.Table, n: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> pa.Table:
            each = lambda x: pa.ListArray.from_arrays(pa.array(fulltext.starts_of(n), pa.int32()), pa.array(x))
            return pa.table([asked["key"], asked["plain"], asked["src_lang"], asked["tgt_lang"], each(ids[docs]), each(-np.round(scores, 9))], schema=_LISTS)

        def matches(asked: pa.Table, n: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> pa.Table:
            row, place = np.repeat(np.arange(len(n)), n), fulltext.ranges(np.ones(len(n), np.int64), n)
            # units of just the question's text count also where the search leaves them out
            keys = np.asarray(asked["key"]).astype(np.int64)
            first, last = (np.searchsorted(own[by_own], keys, side=side) for side in ("left", "right"))
            code, same = row * len(ids) + docs, np.repeat(np.arange(len(keys)), last - first) * len(ids) + by_own[fulltext.ranges(first, last - first)]
            rest = np.setdiff1d(same, code)
            exact = np.concatenate((np.isin(code, same), np.ones(len(rest), bool)))
            row, docs = np.concatenate((row, rest // max(1, len(ids)))), np.concatenate((docs, rest % max(1, len(ids))))
            place, bm25 = np.concatenate((place, np.zeros(len(rest), np.int64))), np.concatenate((-np.round(scores, 9), np.full(len(rest), np.nan)))
            x, nx = _flat(asked["toks"])
            x_at, x_bits = fulltext.starts_of(nx)[:-1], fulltext.word_bits(x, nx)
            longest = np.maximum(nx[row], ny[docs])
            most = np.floor((1 - least) * longest + 1e-9).astype(np.int64)
            d = np.where(exact, 0, longest)
            near = np.flatnonzero(~exact & (np.abs(nx[row] - ny[docs]) <= most) & (nx[row] > 0) & (ny[docs] > 0) & (fulltext.apart(x_bits[:, row], bits[:, docs]) <= most))
            d[near] = fulltext.distances(x, x_at[row[near]], nx[row[near]], y, y_at[docs[near]], ny[docs[near]])
            raw = np.where(exact | (longest == 0), 1.0, 1 - d / np.maximum(1, longest))
            taken = np.arange(len(row)) if several else np.flatnonzero(raw >= least)
            row, docs, place, bm25, exact, raw = (v[taken] for v in (row, docs, place, bm25, exact, raw))
            score = np.where(exact, 10000, fulltext.four_places(d[taken], longest[taken]))
            if not several:
                order = np.lexsort((docs, place, ~exact, -uses[docs], -score, row))
                sizes = np.bincount(row, minlength=len(keys))
                order = order[fulltext.ranges(fulltext.starts_of(sizes)[:-1], np.minimum(sizes, limit))]
                row, docs, place, bm25, exact, raw, score = (v[order] for v in (row, docs, place, bm25, exact, raw, score))
            return pa.table([keys[row], ids[docs], bm25, place, exact.astype(np.int32), raw, score, uses[docs], np.full(len(row), several)], schema=_MATCHES)

        out, begin = [], fulltext.starts_of(q_sizes)
        for a in range(0, len(asked), AT_ONCE):
            b = min(len(asked), a + AT_ONCE)
            of = slice(begin[a], begin[b])
            n = np.bincount(np.repeat(np.arange(b - a), q_sizes[a:b])[there[of]], minlength=b - a)
            found = whole.best(np.searchsorted(used, at[of][there[of]]), n)
            out.append((matches if limit else lists)(asked.slice(a, b - a), *found))
        return pa.concat_tables(out) if out else (_MATCHES if limit else _LISTS).empty_table()

    return run


_LISTS = pa.schema([("key", pa.int64()), ("plain", pa.string()), ("src_lang", pa.string()), ("tgt_lang", pa.string()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
_MATCHES = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("bm25", pa.float64()), ("place", pa.int64()), ("exact", pa.int32()), ("raw", pa.float64()), ("score", pa.int32()), ("use_count", pa.int64()), ("several", pa.bool_())])


def _searched(asked: DataFrame, memory: DataFrame, least: float = 0.0, limit: int | None = None) -> tuple[DataFrame, bool]:
    """What a full-text search finds in each block of the memory for each part of the questions; whether a pair has several blocks.

    A pair's units are parted into blocks of BLOCK at most, by hash, its questions into parts of near shapes of common terms; each
    part meets each block in one task. Without ``limit`` a row is a question with its lists of units, else it is a match.
    """
    spark = memory.sparkSession
    terms = index_terms(F.col("source"))
    own = [_hashed(F.col("toks")).alias("toks")] if limit else [F.lit(None).cast("array<bigint>").alias("toks")]
    docs = memory.select("id", _pair(), F.xxhash64("src_lang", "tgt_lang", "source").alias("own"), "use_count", terms.alias("terms"), *(["toks"] if limit else []))
    n_docs, avgdl = docs.agg(F.count("*"), F.avg(F.size("terms"))).first()  # two numbers of the whole index
    seen = docs.select("pair", F.explode(_hashed(F.array_distinct("terms"))).alias("h")).groupBy("h").agg(F.count("*").alias("df"), F.collect_set("pair").alias("pairs"))
    seen = cut(seen)
    common = max(COMMON_DF, n_docs / COMMON_SHARE)
    often = spark.sparkContext.broadcast(np.sort(seen.where(F.col("df") > common).select("h").toArrow()["h"].to_numpy()))  # COMMON_SHARE times the terms of a unit at most

    @pandas_udf("long")
    def shape(hashes: pd.Series) -> pd.Series:
        sizes = hashes.map(len).to_numpy(np.int64)
        flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
        rows = np.repeat(np.arange(len(sizes)), sizes)
        held = np.isin(flat, often.value)
        return pd.Series(fulltext.sums(fulltext.mixed(flat[held], 5), rows[held], len(sizes)).view(np.int64), index=hashes.index)

    q = asked.select("key", _pair(), "plain", "src_lang", "tgt_lang", _hashed(_asked_terms()).alias("terms"), *own)
    if limit:
        q = q.drop("plain", "src_lang", "tgt_lang")
    # questions of one shape stand together, those of one that very many have are parted by key
    q = q.withColumn("near", F.shiftright(shape("terms"), 32) * (1 << 32) + F.pmod("key", F.lit(1 << 32)))
    n_asked = asked.count()
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) if n_asked > PART_LEAST else 1, -(-n_asked // PART))
    q = cut(q)  # ranges are sampled first
    release(spark)
    q = cut(q.repartitionByRange(parts, "pair", "near").withColumn("part", F.spark_partition_id()))
    blocks = docs.groupBy("pair").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    tasks = cut(q.groupBy("pair", "part").agg(F.count("*").alias("n")).join(blocks, "pair").select("pair", "part", "blocks"))  # a row a task, but for blocks
    n_tasks, most = tasks.agg(F.sum("blocks"), F.max("blocks")).first()
    release(spark)
    block = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("block")
    met = F.broadcast(tasks)
    if limit:
        # words are the terms but for underscores and marks
        differ = F.when(F.col("toks") != F.col("terms"), _hashed(F.col("toks")))
    else:
        differ = F.lit(None).cast("array<bigint>")
    none = F.lit(None)
    rows = docs.select("pair", "id", "own", "use_count", _hashed(F.col("terms")).alias("terms"), differ.alias("toks"), none.cast("array<bigint>").alias("dfs"))
    rows = rows.join(met, "pair").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("long"))
    rows = rows.select("pair", "part", "block", "id", "own", "use_count", "terms", "toks", "dfs")
    words = seen.select("h", "df", F.explode("pairs").alias("pair")).groupBy("pair", F.pmod("h", F.lit(256)).alias("b")).agg(F.collect_list(F.struct("h", "df")).alias("x"))
    words = words.select("pair", none.cast("long").alias("id"), none.cast("long").alias("own"), none.cast("long").alias("use_count"), F.col("x.h").alias("terms"), none.cast("array<bigint>").alias("toks"), F.col("x.df").alias("dfs"))
    words = words.join(met, "pair").select("pair", "part", block(F.col("blocks")), "id", "own", "use_count", "terms", "toks", "dfs")
    asks = q.join(met, ["pair", "part"]).select("*", block(F.col("blocks")))
    by = ["pair", "part", "block"]
    spread = min(4096, 4 * (n_tasks or 1))
    left = rows.unionByName(words).withColumnsRenamed({c: f"of_{c}" for c in by})
    own_by = [f"of_{c}" for c in by]
    left, right = left.repartition(spread, *own_by), asks.repartition(spread, *by)
    fields = "key long, plain string, src_lang string, tgt_lang string, ids array<long>, scores array<double>" if limit is None else "key long, id long, bm25 double, place long, exact int, raw double, score int, use_count long, several boolean"
    found = left.groupBy(*own_by).cogroup(right.groupBy(*by)).applyInArrow(_in_block(n_docs, avgdl or 1.0, common, least, limit), fields)
    return found, (most or 0) > 1


def _bm25_lists(asked: DataFrame, memory: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(src_lang, tgt_lang, plain, key, ids, scores): the best ``limit`` units of each question in order."""
    found, several = _searched(asked, memory)
    if several:
        pairs = F.arrays_zip(F.col("scores").alias("s"), F.col("ids").alias("i"))
        found = found.groupBy("key", "plain", "src_lang", "tgt_lang").agg(F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, CANDIDATES).alias("x"))
        found = found.select("key", "plain", "src_lang", "tgt_lang", F.col("x.i").alias("ids"), F.col("x.s").alias("scores"))
    return found if limit == CANDIDATES else found.withColumns({c: F.slice(c, 1, limit) for c in ("ids", "scores")})


def bm25_candidates(asked: DataFrame, memory: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """(src_lang, tgt_lang, plain, key, id, bm25, place): the best ``limit`` units of the pair, by the key's longest distinct words, smaller is better."""
    asked = cut(asked.select("key", "src_lang", "tgt_lang", "plain"))
    memory = cut(memory.select("id", "src_lang", "tgt_lang", "source", "use_count"))
    found = _bm25_lists(asked, memory, limit)
    each = found.select("src_lang", "tgt_lang", "plain", "key", F.posexplode(F.arrays_zip("ids", "scores")).alias("at", "x"))
    return each.select("src_lang", "tgt_lang", "plain", "key", F.col("x.ids").alias("id"), F.col("x.scores").alias("bm25"), (F.col("at") + 1).alias("place"))


def _bm25_matches(asked: DataFrame, memory: DataFrame, least: float, limit: int) -> DataFrame:
    """(key, id, raw, rank): the best ``limit`` of the exact matches and those of the full-text search."""
    found, several = _searched(asked, memory, least, limit)
    if several:
        by_text = Window.partitionBy("key").orderBy(F.col("bm25").isNull(), "bm25", "id")
        found = found.withColumn("bm25", F.nanvl("bm25", F.lit(None).cast("double")))
        found = found.withColumn("place", F.when(F.col("several"), F.when(F.col("bm25").isNotNull(), F.row_number().over(by_text)).otherwise(0)).otherwise(F.col("place")))
        found = found.where((F.col("place") <= CANDIDATES) | (F.col("exact") == 1)).withColumn("place", F.when(F.col("place") <= CANDIDATES, F.col("place")).otherwise(0)).where(F.col("raw") >= least)
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("use_count"), F.desc("exact"), "place", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("key", "id", "raw", "rank")


def keyed(asked: DataFrame) -> DataFrame:
    """With one number for each language pair and plain text."""
    return asked.withColumn("key", F.xxhash64("src_lang", "tgt_lang", "plain"))


def lookup(asked: DataFrame, memory: DataFrame, least: float = 0.5, limit: int = 5, mode: str = "prefix") -> DataFrame:
    """(src_lang, tgt_lang, plain, rank, id, percent, use_count, source, target): the best matches of each question.

    ``prefix`` finds every match of at least ``least``; ``bm25`` only among the best CANDIDATES of a full-text search.
    Order: similarity to four places, uses, exactness, full-text rank, id.
    """
    # both are read many times; words are taken anew from the texts, as they would take thrice the room
    asked = cut(keyed(asked).select("key", "src_lang", "tgt_lang", "plain")).withColumn("toks", tokens_of_plain(F.col("plain")))
    memory = cut(memory.select("id", "src_lang", "tgt_lang", "source", "target", "use_count")).withColumn("toks", tokens_of_plain(strip_tags(F.col("source"))))
    raw = F.when(F.col("exact") == 1, F.lit(1.0)).otherwise(similarity(F.col("toks"), F.col("m_toks")))
    texts = memory.select("id", "use_count", "source", "target", F.col("toks").alias("m_toks"))
    columns = ["src_lang", "tgt_lang", "plain", "toks", "rank", "id", "score", percent(F.col("raw")).alias("percent"), "use_count", "source", "target", "m_toks"]
    if mode == "bm25":
        best = cut(_bm25_matches(asked, memory, least, limit))
        release(memory.sparkSession)
        return best.join(texts, "id").join(asked.select("key", "src_lang", "tgt_lang", "plain", "toks"), "key").withColumn("score", F.bround("raw", 4)).select(*columns)
    exact = exact_matches(asked, memory).select(F.xxhash64("src_lang", "tgt_lang", "plain").alias("key"), "id", F.lit(1).alias("exact"), F.lit(0).alias("place"))
    found = prefix_candidates(asked, memory, least, limit).select("key", "id", F.lit(0).alias("exact"), F.lit(0).alias("place"))
    both = cut(exact.unionByName(found).groupBy("key", "id").agg(F.max("exact").alias("exact"), F.max("place").alias("place")))
    del exact, found
    release(memory.sparkSession)
    x = asked.select("key", words_as_hashed_symbols(F.col("toks")).alias("x"), F.size("toks").alias("nx"))
    y = memory.select("id", "use_count", words_as_hashed_symbols(F.col("toks")).alias("y"), F.size("toks").alias("ny"))
    longest = F.greatest("nx", "ny")
    # floor((1 - least) * longest) edits are allowed; more are not counted out
    distance = F.expr(f"levenshtein(x, y, cast(floor({1 - least:.9f}D * greatest(nx, ny) + 1e-9) as int))")
    bound = F.when((F.col("exact") == 1) | (longest == 0), F.lit(1.0)).when((F.col("nx") == 0) | (F.col("ny") == 0) | (F.col("d") < 0), F.lit(0.0)).otherwise(1 - F.col("d") / longest)
    bounded = both.join(x, "key").join(y, "id").withColumn("d", distance).withColumn("bound", bound).where(F.col("bound") >= least)
    order = Window.partitionBy("key").orderBy(F.desc(F.bround("bound", 4)), F.desc("use_count"), F.desc("exact"), "place", "id")
    best = cut(bounded.select("key", "id", "exact", "place", "bound", "use_count").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    release(memory.sparkSession)
    full = best.join(asked.select("key", "src_lang", "tgt_lang", "plain", "toks"), "key").join(texts.drop("use_count"), "id")
    symbols = lambda c: F.transform(c, lambda w: F.xxhash64(w).bitwiseAND(F.lit(0xFFFFF)))
    told_apart = F.size(F.array_union(symbols("toks"), symbols("m_toks"))) == F.size(F.array_union("toks", "m_toks"))
    # the bound is the similarity but for words that share a character; a question with such a match is scored anew, word by word
    full = full.withColumn("raw", F.when(told_apart, F.col("bound")).otherwise(raw)).withColumn("score", F.bround("raw", 4)).withColumn("wrong", F.max(F.col("bound") > F.col("raw") + 1e-9).over(Window.partitionBy("key")))
    right = full.where(~F.col("wrong")).select(*columns)
    again = full.where("wrong").select("key").distinct()
    anew = both.join(again, "key").join(asked.select("key", "src_lang", "tgt_lang", "plain", "toks"), "key").join(texts, "id")
    anew = anew.withColumn("raw", raw).where(F.col("raw") >= least).withColumn("score", F.bround("raw", 4))
    exact_order = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("use_count"), F.desc("exact"), "place", "id")
    anew = anew.withColumn("rank", F.row_number().over(exact_order)).where(F.col("rank") <= limit).select(*columns)
    return right.unionByName(anew)
