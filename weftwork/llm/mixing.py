"""Problem 8: texts of several sources in target shares.

Method as named, a time-varying curriculum. A mix has as many tokens as its sources' documents together. Each source's demand
is its share of them, or its cap where that is less; what caps leave over goes to the other sources in proportion to their
shares. Its weight over training time t in [0, 1] runs in a line from its natural share towards and beyond its demand, so that
its integral is the demand and all weights add up to 1 at any time. A source's documents stand in an order by hash, pass
after pass, and each goes to the time at which the integrated weight reaches the tokens before its middle; documents are
range-sorted by that time.

Tokens before a document are summed in two levels, buckets of the hash first, so that a source of any size is spread.

Cases: a null source belongs to no mix; a null text is no document; a source without tokens gets none, and its share goes to
the others; repeated targets of one source add up; repeated ids are documents each; an empty table gives no rows; only named
columns are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a source's documents.
BUCKETS = 4096
#: Targets are settings, not data; more than these are refused.
MOST_TARGETS = 100_000


def demands(shares: list[float], caps: list[float], total: float) -> list[float]:
    """min(cap, share * level) with the level at which they add up to ``total``, or all caps."""
    order = sorted((i for i in range(len(shares)) if shares[i] > 0 and caps[i] > 0), key=lambda i: caps[i] / shares[i])
    out = [0.0] * len(shares)
    left, weight = total, sum(shares[i] for i in order)
    for i in order:
        out[i] = min(caps[i], left * shares[i] / weight) if weight > 0 else 0.0
        left -= out[i]
        weight -= shares[i]
    return out


def _plan(x: pd.DataFrame) -> pd.DataFrame:
    total = float(x.tokens.sum())
    want = demands(x.target_share.tolist(), (x.tokens * x.max_repeats).astype(float).tolist(), total)
    x["demand"] = want
    x["natural"] = x.tokens / total if total else 0.0
    reach = [d / total if total else 0.0 for d in want]
    gaps = [r / abs(n - r) for r, n in zip(reach, x.natural) if abs(n - r) > 1e-12]
    x["lean"] = min([1.0, *gaps])
    x["mix_tokens"] = total
    return x[["mix_name", "source", "target_share", "max_repeats", "tokens", "demand", "natural", "lean", "mix_tokens"]]


def mix_plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each mix and source: its tokens, its demand, and its weight's line."""
    tokens = sized.where("source is not null").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = wanted.join(tokens, "source", "left").select("mix_name", "source", F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))
    return both.groupBy("mix_name").applyInPandas(_plan, "mix_name string, source string, target_share double, max_repeats long, tokens long, demand double, natural double, lean double, mix_tokens double")


def placed_before(sized: DataFrame) -> DataFrame:
    """(doc_id, source, n_tokens, before): tokens of the source's documents that stand before each, in the order by hash."""
    docs = sized.where("source is not null").withColumn("h", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    sums = docs.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("sum"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return docs.join(starts, ["source", "bucket"]).select("doc_id", "source", "n_tokens", (F.col("start") + F.col("inner")).alias("before"))


def mixed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, position, doc_id, source, repeat, n_tokens), range-sorted by mix and position in [0, 1]."""
    from weftwork.session import cut

    sized = cut(sized)
    plan = cut(mix_plan(sized, targets))
    if plan.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} sources of mixes")
    use = placed_before(sized).join(F.broadcast(plan), "source")  # a row for each target
    # a document's pass r is used if its middle, at r * tokens + before + n_tokens / 2, lies within the demand
    middle = F.col("before") + F.col("n_tokens") / 2
    uses = F.floor((F.col("demand") - middle) / F.col("tokens")).cast("int") + 1
    use = use.where((F.col("tokens") > 0) & (middle <= F.col("demand"))).withColumn("uses", F.least(uses, F.col("max_repeats").cast("int")))
    use = use.where("uses > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    at = (F.col("repeat") * F.col("tokens") + middle) / F.col("mix_tokens")
    reach = F.col("demand") / F.col("mix_tokens")
    bend = F.col("lean") * (F.col("natural") - reach)
    # reach * t + bend * (t - t * t) = at, for t
    rise = reach + bend
    root = F.sqrt(F.greatest(F.lit(0.0), rise * rise - bend * at * 4))
    time = F.when(rise + root > 0, at * 2 / (rise + root)).otherwise(F.lit(0.0))
    use = use.withColumn("position", F.least(F.lit(1.0), time))
    return use.select("mix_name", "position", "doc_id", "source", "repeat", "n_tokens").orderBy("mix_name", "position", "source", "doc_id", "repeat")


def share_report(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, reached_share, tokens, documents, most_repeats) of each mix."""
    from weftwork.session import cut

    sized = cut(sized)
    got = mixed(sized, targets).groupBy("mix_name", "source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("doc_id").alias("documents"), (F.max("repeat") + 1).alias("most_repeats"))
    wanted = targets.where("mix_name is not null and source is not null").groupBy("mix_name", "source").agg(F.sum("target_share").alias("target_share"))
    total = got.groupBy("mix_name").agg(F.sum("tokens").alias("all"))
    out = wanted.join(got, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    return out.select("mix_name", "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
