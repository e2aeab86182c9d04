"""Problem 2: records that differ in form only become one, with the number of copies.

Method as named: bytes stream through a skip-and-fold table into rolling polynomial hashes (``folding``), rows with equal
hashes are compared with a two-pointer skip. Sides may be exchanged with their languages: the key is unordered.

Cases: a null text, or one without letter or digit, makes its row no copy of anything; a null language is ''; null ids
are ignored; repeated rows with the same id count once; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwork.functions.text import norm_lang
from weftwork.llm.folding import pair_keys, same_folded
from weftwork.session import salted_join


def sides(units: DataFrame) -> DataFrame:
    """id, base languages and texts only: nothing of other columns can clash."""
    return units.select("id", norm_lang(F.col("src_lang")).alias("a_lang"), norm_lang(F.col("tgt_lang")).alias("b_lang"), F.col("source").alias("a"), F.col("target").alias("b")).where("id is not null")


def form_keys(side: DataFrame) -> DataFrame:
    """(id, k1, k2): the hash pair of each row that has content on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                k1, k2, ok = pair_keys(x["a_lang"].to_pylist(), x["a"], x["b_lang"].to_pylist(), x["b"])
                yield pa.RecordBatch.from_arrays([x["id"].filter(pa.array(ok)), pa.array(k1[ok]), pa.array(k2[ok])], names=["id", "k1", "k2"])

    return side.mapInArrow(run, "id long, k1 long, k2 long")


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        ok = np.array(
            [
                (la == ra and lb == rb and same_folded(a, c) and same_folded(b, d)) or (la == rb and lb == ra and same_folded(a, d) and same_folded(b, c))
                for la, lb, a, b, ra, rb, c, d in zip(x.a_lang, x.b_lang, x.a, x.b, x.r_a_lang, x.r_b_lang, x.r_a, x.r_b)
            ],
            bool,
        )
        yield x[["keep_id", "id"]].assign(same=ok)


def form_copies(units: DataFrame) -> DataFrame:
    """(keep_id, copy_id): each copy with the smallest id of its group."""
    side = sides(units)
    keys = form_keys(side)
    groups = keys.groupBy("k1", "k2").agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id < last").drop("last")
    members = salted_join(keys, groups, ["k1", "k2"], ["id"]).select("id", "keep_id").distinct()
    texts = side.join(members, "id")
    reps = side.join(groups.select(F.col("keep_id").alias("id")), "id").dropDuplicates(["id"])
    reps = reps.select(F.col("id").alias("keep_id"), *[F.col(c).alias(f"r_{c}") for c in ("a_lang", "b_lang", "a", "b")])
    checked = salted_join(texts.where("id <> keep_id"), reps, ["keep_id"], ["id"]).mapInPandas(_verify, "keep_id long, id long, same boolean")
    return checked.where("same").select("keep_id", F.col("id").alias("copy_id")).distinct()


def copy_counts(units: DataFrame) -> DataFrame:
    """(keep_id, copies): one row for each record that is left, with the copies it had, itself among them."""
    found = form_copies(units)
    counts = found.groupBy("keep_id").agg((F.count("*") + 1).alias("copies"))
    ids = units.select("id").where("id is not null").distinct()
    kept = ids.join(found.select(F.col("copy_id").alias("id")), "id", "left_anti").select(F.col("id").alias("keep_id"))
    return kept.join(counts, "keep_id", "left").select("keep_id", F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
