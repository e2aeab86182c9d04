"""Learning from confirmations: what events leave of the segments, and the units they teach."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwork.functions.text import collapse, is_blank, strip_tags
from weftwork.operators.volume import DONE


def once(events: DataFrame) -> DataFrame:
    """Each event once, however often it came."""
    return events.groupBy("event_id").agg(*[F.min_by(c, "arrived_at").alias(c) for c in ("segment_id", "ts", "target", "state")], F.min("arrived_at").alias("arrived_at"))


def replayed(events: DataFrame, segments: DataFrame) -> DataFrame:
    """Events in order with the target and state they leave; a null keeps what was before."""
    known = segments.select(F.col("id").alias("segment_id"), "source", "src_lang", "tgt_lang", F.coalesce("target", F.lit("")).alias("old_target"), F.col("state").alias("old_state"))
    so_far = Window.partitionBy("segment_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    left = once(events).withColumns({"target": last("target"), "state": last("state")})
    joined = left.join(known, "segment_id")
    return joined.withColumns({"target": F.coalesce("target", "old_target"), "state": F.coalesce("state", "old_state")}).drop("old_target", "old_state")


def settled(events: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment_id, target, state, updated_at) that the last event of each segment leaves."""
    rows = replayed(events, segments)
    order = F.struct("ts", "event_id")
    return rows.groupBy("segment_id").agg(F.max_by("target", order).alias("target"), F.max_by("state", order).alias("state"), F.max("ts").alias("updated_at"))


def taught(events: DataFrame, segments: DataFrame) -> DataFrame:
    """(src_lang, tgt_lang, source, target, confirmations, updated_at): units of the confirmed texts, tags left out."""
    done = replayed(events, segments).where(F.col("state").isin(*DONE) & ~is_blank(F.col("target")))
    clean = done.select("src_lang", "tgt_lang", collapse(strip_tags(F.col("source"))).alias("source"), collapse(strip_tags(F.col("target"))).alias("target"), "ts").where("source <> '' and target <> ''")
    return clean.groupBy("src_lang", "tgt_lang", "source", "target").agg(F.count("*").alias("confirmations"), F.max("ts").alias("updated_at"))


def merged(memory: DataFrame, learned: DataFrame) -> DataFrame:
    """The memory with what was taught: known units gain uses, others come new with origin editor and an id by their text."""
    keys = ["src_lang", "tgt_lang", "source", "target"]
    new = learned.select(*keys, "confirmations", F.col("updated_at").alias("learned_at"))
    both = memory.join(new, keys, "full")
    uses = F.when(F.col("id").isNull(), F.col("confirmations") - 1).otherwise(F.col("use_count") + F.coalesce("confirmations", F.lit(0)))
    return both.select(
        F.coalesce("id", -F.abs(F.xxhash64(*keys))).alias("id"), *keys, F.coalesce("origin", F.when(F.col("id").isNull(), "editor")).alias("origin"), uses.cast("long").alias("use_count"), F.greatest("updated_at", "learned_at").alias("updated_at")
    )
