"""Filling containers of fixed capacity with items, by minimum bin slack."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

#: A histogram of lengths has at most so many entries: a capacity above it would need another way to find combinations.
MAX_CAPACITY = 1 << 17
#: Items of one size that one task numbers, about.
GROUP_ROWS = 200_000


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths (each at most as often as it is available) with the largest sum up to ``room``.

    Subset sums as bits of one integer: a length is added to all sums found so
    far by a shift. The first length that reaches the best sum is remembered
    per step, which gives the combination when walked back. It stops early
    when the room can be filled exactly. Larger lengths come first.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left = min(counts[x], room // x)
        k = 1
        while left > 0:  # binary splitting: 1, 2, 4, ... copies at once
            take = min(k, left)
            new = (reach | reach << (take * x)) & mask
            if new != reach:
                steps.append((x, take, reach))
                reach = new
            left -= take
            k *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    out: list[int] = []
    for x, take, before in reversed(steps):
        if not before >> best & 1:
            out += [x] * take
            best -= take * x
    return out


def longest_first(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The longest length that fits, again and again: what first fit by falling length puts into a bin."""
    out: list[int] = []
    for x in lengths:
        n = min(counts[x], room // x)
        out += [x] * n
        room -= n * x
    return out


def plan_best(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """The plan by minimum bin slack; where it needs more bins than the total size, that by first fit too, and the one with fewer bins of the two."""
    plan = plan_bins(histogram, capacity)
    bins = sum(n for n, _ in plan)
    if bins * capacity - sum(x * n for x, n in histogram.items()) < capacity:
        return plan
    other = plan_bins(histogram, capacity, longest_first)
    return other if sum(n for n, _ in other) < bins else plan


def plan_bins(histogram: dict[int, int], capacity: int, fill=fullest) -> list[tuple[int, list[int]]]:
    """Bins as (how many alike, lengths in one), by minimum bin slack over a histogram of lengths.

    Each bin starts with the longest item left and is then filled as full as
    the other lengths allow. The same combination is repeated as often as the
    items last, so the number of rounds follows the number of distinct
    lengths, not of items.
    """
    counts = {x: n for x, n in histogram.items() if n > 0 and x > 0}
    lengths = sorted(counts, reverse=True)
    plan: list[tuple[int, list[int]]] = []
    while lengths:
        x = lengths[0]
        counts[x] -= 1
        rest = fill(lengths, counts, capacity - x)
        counts[x] += 1
        combo = [x, *rest]
        need: dict[int, int] = {}
        for v in combo:
            need[v] = need.get(v, 0) + 1
        times = min(counts[v] // n for v, n in need.items())
        for v, n in need.items():
            counts[v] -= n * times
        plan.append((times, combo))
        lengths = [v for v in lengths if counts[v] > 0]
    return plan


def slots(plan: list[tuple[int, list[int]]]) -> tuple[np.ndarray, int]:
    """Where the items of each length go: rows (length, first rank, items per bin, first bin) by length and rank; and the number of bins."""
    used: dict[int, int] = {}
    rows, first_bin = [], 1
    for times, combo in plan:
        need: dict[int, int] = {}
        for v in combo:
            need[v] = need.get(v, 0) + 1
        for v, n in need.items():
            rows.append((v, used.get(v, 0), n, first_bin))
            used[v] = used.get(v, 0) + n * times
        first_bin += times
    out = np.array(sorted(rows), "int64").reshape(-1, 4)
    return out, first_bin - 1


def pack(items: DataFrame, capacities: dict[str, int], groups: int | None = None) -> DataFrame:
    """Every item, or its pieces, with a container, for each capacity.

    ``items`` has (item_id unique, size); other columns are ignored. Result:
    limit_label, item_id, piece_no, start, size, bin_no. An item longer than
    the capacity is cut into full pieces and a rest; nothing else is split.
    Null, zero and negative sizes take no room and stand in bin 1. Rows with
    a null id are not items. No items give no rows.

    Method: minimum bin slack (plan_best) on the histogram of sizes (of rests, for longer
    items), which has at most one entry per unit of capacity however many
    items there are; only that histogram comes to the driver. The items stay
    distributed: each gets its rank among those of its size, from counts by
    (size, hash group) and a rank within the group, so one size with a third of all items is still
    cut into ``groups``, by default so many that each has about GROUP_ROWS
    items of the commonest size; its bin follows from the rank. Ties go by id.
    """
    spark = items.sparkSession
    sized = items.select("item_id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("bigint").alias("size")).filter(F.col("item_id").isNotNull())
    if any(not 0 < v <= MAX_CAPACITY for v in capacities.values()):
        raise ValueError("capacities lie between 1 and MAX_CAPACITY")
    limits = F.array(*[F.struct(F.lit(k).alias("limit_label"), F.lit(int(v)).cast("bigint").alias("capacity")) for k, v in capacities.items()])
    rest = sized.select("*", F.explode(limits).alias("l")).select("item_id", "size", "l.*")
    rest = rest.withColumn("n_full", F.expr("size div capacity")).withColumn("rest", F.col("size") % F.col("capacity"))
    per_size = rest.groupBy("limit_label", "rest").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full")).collect()  # at most one row per unit of capacity
    if groups is None:  # pieces of long items are numbered by group too, whatever their rests
        longs = [sum(r.n for r in per_size if r.limit_label == k and r.n_full) for k in capacities]
        groups = max(1, -(-max([r.n for r in per_size] + longs, default=1) // GROUP_ROWS))
    rest = rest.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(groups)).cast("int"))
    slot = ["limit_label", "rest", "part"]
    counts = rest.groupBy(*slot).agg(F.count("*").alias("n"))
    full = {k: sum(r.n_full for r in per_size if r.limit_label == k) for k in capacities}
    tables = {}
    for label, cap in capacities.items():
        tables[label], n_bins = slots(plan_best({r.rest: r.n for r in per_size if r.limit_label == label}, cap))
        full[label] = (max(n_bins, 1) if not full.get(label) else n_bins, full.get(label) or 0)
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("bigint")
    def bin_of(label, x, rank):
        import pandas as pd

        out = np.ones(len(x), "int64")
        for one in label.unique():
            at = np.flatnonzero((label == one).to_numpy() & (x > 0).to_numpy())
            if len(at):
                t, r = shared.value[one], rank.to_numpy()[at]
                row = _row(t, x.to_numpy()[at], r)
                out[at] = t[row, 3] + (r - t[row, 1]) // t[row, 2]
        return pd.Series(out)

    before = F.sum("n").over(Window.partitionBy("limit_label", "rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*slot, F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy(*slot).orderBy("item_id")) - 1
    ranked = rest.withColumn("local", local.cast("bigint")).join(offsets, slot).withColumn("rank", F.col("local") + F.col("before"))
    rests = ranked.filter((F.col("rest") > 0) | (F.col("n_full") == 0)).select(
        "limit_label", "item_id", (F.col("n_full") + 1).alias("piece_no"), (F.col("n_full") * F.col("capacity")).alias("start"), F.col("rest").alias("size"),
        bin_of("limit_label", "rest", "rank").alias("bin_no"),
    )
    if not any(f for _, f in full.values()):
        return rests
    # full pieces have a bin each; numbered per group of items, from counts again
    pieces = rest.filter("n_full > 0").groupBy("limit_label", "part").agg(F.sum("n_full").alias("n")).collect()
    base, run = [], {k: v[0] for k, v in full.items()}
    for r in sorted(pieces, key=lambda r: (r.limit_label, r.part)):
        base.append((r.limit_label, r.part, run[r.limit_label]))
        run[r.limit_label] += r.n
    bases = F.broadcast(spark.createDataFrame(base, "limit_label string, part int, base bigint"))
    w = Window.partitionBy("limit_label", "part").orderBy("item_id").rowsBetween(Window.unboundedPreceding, -1)
    longs = rest.filter("n_full > 0").withColumn("prior", F.coalesce(F.sum("n_full").over(w), F.lit(0))).join(bases, ["limit_label", "part"])
    wholes = longs.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n_full"))).alias("piece_no")).select(
        "limit_label", "item_id", "piece_no", ((F.col("piece_no") - 1) * F.col("capacity")).alias("start"), F.col("capacity").alias("size"),
        (F.col("base") + F.col("prior") + F.col("piece_no")).alias("bin_no"),
    )
    return rests.unionByName(wholes)


def _row(t: np.ndarray, x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The slot row of each (length, rank): the last with that length that begins at or before the rank."""
    first = np.searchsorted(t[:, 0], x)
    key = t[:, 0] * (1 << 40) + t[:, 1]
    row = np.searchsorted(key, x * (1 << 40) + rank, "right") - 1
    return np.maximum(row, first)
