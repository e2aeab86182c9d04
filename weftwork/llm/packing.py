"""Problem 7: texts into containers of fixed capacity, with little space left.

Method as named: Karmarkar-Karp differencing into as many windows as the tokens need merges partial partitions whose
imbalances oppose each other; the number of windows rises whenever one exceeds the capacity. What a text holds beyond whole
capacities is an item; its whole capacities are containers of their own.

Where few items make a window, equal sums hardly ever come out at once and raising the number for all would leave much space.
Windows that a differencing fills to the capacity or nearly are therefore closed, and the items of the others differenced anew
in other company, until few close; those that are left get more windows until none exceeds the capacity. No window is made in
any other way.

Items are spread over groups by hash, about ``WINDOWS`` containers each, and each group is packed for itself: a group's work
is bounded whatever the corpus, and what rounding up costs is at most one container in ``WINDOWS``.

Cases: a null text is no item, an empty one is an item of no tokens; repeated ids are items each; a capacity that is null or
not positive, or has no name, has no containers; of capacities of one name the smallest counts; an empty table gives no rows; only named columns are read.
"""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = 256
#: A window is closed with at most this share left free; the share grows by half, up to FREE, when under FEW of the windows close.
CLOSED, FREE, FEW = 0.004, 0.5, 0.05
#: Windows that are differenced together once some are closed: each is tried, and the packing with fewest windows taken.
PARTS = (64, 32, 16)
#: Capacities are settings, not data; more than these are refused.
MOST_PACKS = 1000


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` windows of nearly equal sums, by multiway differencing."""
    # A partial partition is (-imbalance, tie, windows); a window is (sum, tie, item or two windows), the largest first; empty
    # windows are left out.
    heap = [(-size, i, [(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # the largest of b meet the smallest of a where there is no room for both
        over = max(0, len(a) + len(b) - k)
        kept = len(a) - over
        merged = a[:kept] + b[over:]
        for x, y in zip(reversed(a), b[:over]):
            tie += 1
            merged.append((x[0] + y[0], tie, (x, y)))
        merged.sort(reverse=True)
        tie += 1
        heapq.heappush(heap, ((merged[-1][0] if len(merged) == k else 0) - merged[0][0], tie, merged))
    return [_members(w) for w in heap[0][2]] if heap else []


def _members(window: tuple) -> list[int]:
    out, stack = [], [window]
    while stack:
        _, _, inside = stack.pop()
        if isinstance(inside, tuple):
            stack += inside
        else:
            out.append(inside)
    return out


def raised(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices in windows of nearly equal sums: one more as long as one exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity), sum(s * 2 > capacity for s in sizes))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += 1


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices in windows of at most ``capacity``, all from differencing: see above. The same for the same sizes."""
    least = max(1, -(-sum(sizes) // capacity))
    best = difference(sizes, least)
    if all(sum(sizes[i] for i in w) <= capacity for w in best):
        return best
    best = []
    for part in PARTS:
        windows = _closed(sizes, capacity, part)
        if not best or len(windows) < len(best):
            best = windows
        if len(best) <= least:
            break
    return best


def _closed(sizes: list[int], capacity: int, part: int) -> list[list[int]]:
    order = random.Random(part)
    rest, out, free, more = list(range(len(sizes))), [], CLOSED, 0
    while rest and free < FREE:
        order.shuffle(rest)
        total = sum(sizes[i] for i in rest)
        parts = max(1, round(total / capacity / part))
        closed, left = [], []
        for p in range(parts):
            mine = rest[p::parts]
            own = [sizes[i] for i in mine]
            for w in difference(own, max(1, -(-sum(own) // capacity)) + more):
                full = capacity * (1 - free) <= sum(own[i] for i in w) <= capacity
                if full:
                    closed.append([mine[i] for i in w])
                else:
                    left += [mine[i] for i in w]
        out += closed
        rest = left
        if len(closed) * capacity <= total * FEW:
            free *= 1.5
            more = 1 - more  # now and then a window more than the tokens need: fewer exceed the capacity
    return out + [[rest[i] for i in w] for w in raised([sizes[i] for i in rest], capacity)]


def _kinds(packs: DataFrame) -> DataFrame:
    """(pack_name, capacity), the smallest of each name."""
    return packs.where("capacity_tokens > 0 and pack_name is not null").groupBy("pack_name").agg(F.min("capacity_tokens").cast("long").alias("capacity"))


def pieces(sized: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, doc_id, piece, start_token, n_tokens): whole capacities of long texts, and one item of the rest."""
    rows = sorted(tuple(r) for r in _kinds(packs).limit(MOST_PACKS + 1).collect())
    if len(rows) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} capacities")
    kinds = F.array(*[F.struct(F.lit(name).cast("string").alias("pack_name"), F.lit(size).cast("long").alias("capacity")) for name, size in rows]) if rows else F.array().cast("array<struct<pack_name:string,capacity:bigint>>")
    both = sized.select("doc_id", F.col("n_tokens").alias("n"), F.inline(kinds))
    whole = F.floor(F.col("n") / F.col("capacity"))
    count = F.when(F.col("n") % F.col("capacity") == 0, F.greatest(whole, F.lit(1))).otherwise(whole + 1)
    cut = both.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long"))))
    start = F.col("piece") * F.col("capacity")
    return cut.select("pack_name", "capacity", "doc_id", F.col("piece").cast("int").alias("piece"), start.alias("start_token"), F.least(F.col("capacity"), F.col("n") - start).alias("n_tokens"))


def _pack_group(x: pd.DataFrame) -> pd.DataFrame:
    x = x.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
    sizes = x.n_tokens.tolist()
    at = [0] * len(sizes)
    for n, w in enumerate(pack(sizes, int(x.capacity.iloc[0]))):
        for i in w:
            at[i] = n
    x["container"] = [f"{g}-{n}" for g, n in zip(x.group, at)]
    return x[["pack_name", "container", "doc_id", "piece", "start_token", "n_tokens"]]


def containers(sized: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, container, doc_id, piece, start_token, n_tokens): where each text, or each of its pieces, goes."""
    from weftwork.session import cut

    sized = cut(sized)
    items = pieces(sized, packs)
    full = F.col("n_tokens") == F.col("capacity")
    alone = items.where(full).select("pack_name", F.concat_ws("-", F.lit("full"), "doc_id", "piece").alias("container"), "doc_id", "piece", "start_token", "n_tokens")
    rest = items.where(~full)
    # a row for each capacity, MOST_PACKS at most; a group has about WINDOWS containers' tokens, and no more items than 64 for each
    totals = rest.groupBy("pack_name", "capacity").agg(F.sum("n_tokens").alias("total"), F.count("*").alias("items")).collect()
    groups = {r.pack_name: max(1, -(-r.total // (r.capacity * WINDOWS)), -(-r["items"] // (64 * WINDOWS))) for r in totals}
    counts = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair]) if groups else F.lit(None).cast("map<string,int>")
    spread = rest.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(counts[F.col("pack_name")], F.lit(1))).cast("long"))
    # groups are small in bytes and long in work, so they must not be put together by size: a task for each few of them
    tasks = min(20_000, max(rest.sparkSession.sparkContext.defaultParallelism * 2, sum(groups.values()) // 4))
    packed = spread.repartition(tasks, "pack_name", "group").groupBy("pack_name", "group").applyInPandas(_pack_group, "pack_name string, container string, doc_id long, piece int, start_token long, n_tokens long")
    return alone.unionByName(packed)


def fill_report(placed: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, capacity, containers, tokens, filled): how full the containers are."""
    packs = _kinds(packs)
    per = placed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n"))
    sums = per.groupBy("pack_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"))
    return sums.join(packs, "pack_name").select("pack_name", "capacity", "containers", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("filled"))


def placement_report(placed: DataFrame, sized: DataFrame, packs: DataFrame) -> DataFrame:
    """(pack_name, documents, lost_tokens, over_full, needless_splits): what must hold of any packing, counted.

    Texts with a place, tokens without one or with two, containers over their capacity, texts split though they fit in one.
    """
    kinds = _kinds(packs)
    all_tokens = sized.agg(F.sum("n_tokens")).first()[0] or 0
    docs = placed.groupBy("pack_name", "doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    docs = docs.join(F.broadcast(kinds), "pack_name").groupBy("pack_name").agg(F.count("*").alias("documents"), F.sum("n").alias("n"), F.sum(F.abs(F.col("n") - F.col("end"))).alias("twice"), F.count_if((F.col("pieces") > 1) & (F.col("end") <= F.col("capacity"))).alias("needless_splits"))
    per = placed.groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(kinds), "pack_name")
    over = per.groupBy("pack_name").agg(F.count_if(F.col("n") > F.col("capacity")).alias("over_full"))
    lost = F.lit(all_tokens) - F.col("n") + F.col("twice")
    return docs.join(over, "pack_name").select("pack_name", "documents", lost.cast("long").alias("lost_tokens"), "over_full", "needless_splits")
