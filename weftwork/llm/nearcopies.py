"""Problem 1: units of a language pair whose source and target are both nearly the same as another's.

Method as named. Each word of a side sets a bit of a fingerprint, repeated words one each; the fingerprint is cut into ``FINE``
segments, and a side's bit counts by segment are its embedding. Two sides of nA and nB words that have at least four fifths of
the longer in common lie within a Manhattan distance of ``nA + nB - 2 * ceil(0.8 * max)``, which is the range of the join.

Range join on a grid. A cell is a point on two axes at once: two segments, each with a bit count that the side reaches there. A
side of n words may be missing ``n - ceil(0.8 n)`` of its counts in a near copy, so of its ``missing + k`` counts on the emptiest
axes any near copy reaches ``k`` as well, and of so many two lie in one of ``k - 1`` classes of axes: sides meet in cells of two
axes of one class. How many classes there are goes by the side's length, so that cells grow with the words and not with their
square; a side near a limit enters the cells of both lengths. No qualifying pair is lost and no cell is capped.

Lower bound, then exact. Pairs of a cell are dropped when the Manhattan distance of their coarse counts (the fine segments added
up to ``COARSE``, which never makes the distance larger) exceeds the range on either side; what is left is compared word by word.

Units that agree in both bags of words and are copies by form stand for one another: pairs are searched between
representatives and expanded at the end.

Cases: a null or wordless source or target is near to nothing; a null language is ''; null ids are ignored; equal rows with one
id count once, and an id with several texts is near to what any of them is near to; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftwork.llm.folding import pair_keys
from weftwork.llm.formcopies import sides
from weftwork.operators.memory import numbered
from weftwork.session import cut, salted_join

MIN_WORDS = 8
#: Segments of the fingerprint. How full each is over the corpus goes to every task: a byte each, so the bound is 256 KiB.
FINE = 1 << 18
#: Coarse segments whose counts, up to 255, fill a long.
COARSE = 8
#: Sides of under twice so many words have one class of axes, of under four times so many two, and so on.
ONE_CLASS = 20

_WORD = re.compile(r"[^\W_]+")


def needed(n: Column) -> Column:
    """Words in common that a longer side of n words needs: four fifths of n, rounded up."""
    return F.floor((n * 4 + 4) / 5).cast("int")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@lru_cache(1 << 16)
def _segment(word: str) -> int:
    """As pmod(xxhash64(word), FINE) in Spark."""
    return xxhash.xxh64_intdigest(word, seed=42) % FINE


def embedded(words: list[str]) -> int:
    """Bit counts by coarse segment, a byte each: a count over 255 is 255, which never makes distances larger."""
    packed = 0
    for s, n in Counter(_segment(w) * COARSE // FINE for w in words).items():
        packed |= min(n, 255) << 8 * s
    return _signed(packed)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        if not x.num_rows:
            continue
        la, lb = x["a_lang"].to_pylist(), x["b_lang"].to_pylist()
        k1, k2, _ = pair_keys(la, x["a"], lb, x["b"])
        at, langs, out = [], [], {k: [] for k in ("wa", "wb", "na", "nb", "pa", "pb", "bag1", "bag2")}
        for n, (a, b) in enumerate(zip(x["a"].to_pylist(), x["b"].to_pylist())):
            wa, wb = _WORD.findall((a or "").lower()), _WORD.findall((b or "").lower())
            if len(wa) < MIN_WORDS or not wb:
                continue
            both = f"{la[n]}>{lb[n]}"
            bag = xxhash.xxh128_digest("\n".join((both, " ".join(sorted(wa)), " ".join(sorted(wb)))))
            at.append(n)
            langs.append(both)
            row = " ".join(wa), " ".join(wb), len(wa), len(wb), embedded(wa), embedded(wb), int.from_bytes(bag[:8], "big", signed=True), int.from_bytes(bag[8:], "big", signed=True)
            for column, v in zip(out.values(), row):
                column.append(v)
        kinds = {"wa": pa.string(), "wb": pa.string(), "na": pa.int32(), "nb": pa.int32()}
        columns = [x["id"].take(pa.array(at, pa.int64())), pa.array(langs, pa.string()), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()], pa.array(k1[at]), pa.array(k2[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "langs", *out, "k1", "k2"])


def bags(side: DataFrame) -> DataFrame:
    """Words of either side joined by spaces, their numbers and embeddings, hashes of both bags and of the folded form."""
    return side.mapInArrow(_bags, "id long, langs string, wa string, wb string, na int, nb int, pa long, pb long, bag1 long, bag2 long, k1 long, k2 long")


def segment_fill(reps: DataFrame) -> np.ndarray:
    """How full each fine segment is over all representatives, in logarithmic steps. At most FINE rows reach the driver."""
    word = F.explode(F.split("wa", " "))
    counts = reps.select(word.alias("w")).groupBy(F.pmod(F.xxhash64("w"), F.lit(FINE)).cast("int").alias("seg")).count().toPandas()
    fill = np.zeros(FINE, np.uint8)
    fill[counts.seg.to_numpy()] = np.minimum(255, 1 + 8 * np.log2(counts["count"].to_numpy())).astype(np.uint8)
    return fill


def manhattan(a: Column, b: Column) -> Column:
    """Between two packed embeddings."""
    parts = [F.abs(F.shiftrightunsigned(a, 8 * i).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(b, 8 * i).bitwiseAND(F.lit(255))) for i in range(COARSE)]
    return reduce(lambda x, y: x + y, parts)


def classes_of(n: int) -> int:
    """Classes of axes for a side of ``n`` words, a power of two."""
    return 1 << max(0, (n // ONE_CLASS).bit_length() - 1)


def cells_of(words: list[str], fill: bytes, seed: int) -> list[int]:
    """The grid cells of a side: two axes of a class with a count on each that the side reaches."""
    n = len(words)
    counts = Counter(map(_segment, words))
    points = sorted((fill[s], s, c) for s, most in counts.items() for c in range(1, most + 1))
    missing = n - (4 * n + 4) // 5
    out = []
    # the shorter side of a pair decides on the classes: it may have from four fifths of the words on
    for k in {classes_of(m) for m in ((4 * n + 4) // 5, n)}:
        by_class: dict[int, list[int]] = defaultdict(list)
        for _, s, c in points[: missing + k + 1]:
            by_class[s % k].append(s << 32 | c)
        out += [xxhash.xxh64_intdigest((x << 64 | y).to_bytes(16, "big"), seed=seed ^ k) for own in by_class.values() for x, y in combinations(own, 2)]
    return out


def cell_keys(spark, fill: np.ndarray):
    """A pandas UDF: the grid cells of sides."""
    shared = spark.sparkContext.broadcast(fill.tobytes())

    @pandas_udf("array<long>")
    def keys(langs: pd.Series, words: pd.Series) -> pd.Series:
        seeds = {x: xxhash.xxh32_intdigest(x) for x in langs.unique()}
        return pd.Series([[_signed(c) for c in cells_of(w.split(" "), shared.value, seeds[x])] for x, w in zip(langs, words)])

    return keys


def in_cells(reps: DataFrame) -> DataFrame:
    """Representatives by grid cell, with what the bounds need and no more."""
    keys = cell_keys(reps.sparkSession, segment_fill(reps))
    return reps.select("rep", "na", "nb", "pa", "pb", F.explode(keys("langs", "wa")).alias("cell"))


def met(cells: DataFrame) -> DataFrame:
    """Pairs rep_x < rep_y of a cell, some several times."""
    x, y = [cells.select("cell", *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "na", "nb", "pa", "pb")]) for s in "xy"]
    return x.join(y, "cell").where("rep_x < rep_y")


def in_range(pairs: DataFrame) -> DataFrame:
    """Those whose sides are within the range of the join by the lower bound."""
    for n, p in (("na", "pa"), ("nb", "pb")):
        nx, ny = F.col(f"{n}_x"), F.col(f"{n}_y")
        need = needed(F.greatest(nx, ny))
        pairs = pairs.where((need <= F.least(nx, ny)) & (manhattan(F.col(f"{p}_x"), F.col(f"{p}_y")) <= nx + ny - need * 2))
    return pairs


def near_classes(units: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members: id, rep), (representatives), (pairs of representatives: rep_a < rep_b)."""
    keyed = cut(bags(sides(units)))
    same = ["langs", "bag1", "bag2", "k1", "k2"]
    first = F.min_by(F.struct("wa", "wb", "na", "nb", "pa", "pb"), "id")
    reps = cut(keyed.groupBy(same).agg(F.min("id").alias("rep"), F.count("*").alias("n"), first.alias("first")).select("rep", "n", *same, "first.*"))
    groups = reps.where("n > 1").select(*same, "rep")
    members = cut(salted_join(keyed.select("id", *same), groups, same, ["id"], "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct())
    pairs = in_range(met(in_cells(reps))).select("rep_x", "rep_y").distinct()
    words = reps.select("rep", "langs", "k1", "k2", "wa", "wb")
    for s in "xy":
        pairs = pairs.join(words.select(*[F.col(c).alias(f"{c}_{s}") for c in words.columns]), f"rep_{s}")
    pairs = pairs.where("langs_x = langs_y and (k1_x <> k1_y or k2_x <> k2_y)")
    for w in ("wa", "wb"):
        x, y = [numbered(F.split(f"{w}_{s}", " ")) for s in "xy"]
        pairs = pairs.where(F.size(F.array_intersect(x, y)) * 5 >= F.greatest(F.size(x), F.size(y)) * 4)
    return members, reps, pairs.select(F.col("rep_x").alias("rep_a"), F.col("rep_y").alias("rep_b")).distinct()


def near_pairs(units: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of near copies."""
    members, _, pairs = near_classes(units)
    a, b = [members.select(F.col("rep").alias(f"rep_{s}"), F.col("id").alias(f"id_{s}")) for s in "ab"]
    # few pairs meet many members: a representative may stand for a great share of all units
    both = salted_join(b, salted_join(a, pairs, ["rep_a"], ["id_a"]), ["rep_b"], ["id_b"])
    return both.where("id_a <> id_b").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def _same_edges(a: DataFrame, b: DataFrame) -> bool:
    return a.count() == b.count() and a.join(b, ["u", "v"], "left_anti").isEmpty()


def components(pairs: DataFrame) -> DataFrame:
    """(rep, group_id) of every representative in (rep_a, rep_b): the smallest one that links lead to.

    Large and small stars in turn: every node's larger neighbours are linked to its smallest one, then its smaller ones, until
    nothing changes and each node is linked to the smallest of its component. No row of it reaches the driver.
    """
    ends = [F.greatest("rep_a", "rep_b").alias("u"), F.least("rep_a", "rep_b").alias("v")]
    edges = cut(pairs.select(*ends).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(salted_join(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], ["v"]).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        if _same_edges(new, edges):
            break
        edges = new
    roots = edges.select(F.col("v").alias("rep")).distinct().select("rep", F.col("rep").alias("group_id"))
    return edges.select(F.col("u").alias("rep"), F.col("v").alias("group_id")).unionByName(roots)


def near_groups(units: DataFrame) -> DataFrame:
    """(id, rep, links, group_id), one row for each id: the smallest id of its class of exact copies, to how many classes that is
    near, and the smallest id of the classes that near copies join to it, directly or through others.

    A unit that is near to nothing (under MIN_WORDS words, a null or wordless side) is its own class and group.
    """
    members, _, pairs = near_classes(units)
    pairs = cut(pairs)
    ends = pairs.select(F.col("rep_a").alias("rep")).unionAll(pairs.select(F.col("rep_b").alias("rep")))
    links = ends.groupBy("rep").agg(F.count("*").alias("links")).join(components(pairs), "rep", "left")
    ids = units.select("id").where("id is not null").distinct()
    rows = ids.join(members, "id", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    rows = salted_join(rows, links, ["rep"], ["id"], "left")
    return rows.select("id", "rep", F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("group_id", "rep").alias("group_id"))
