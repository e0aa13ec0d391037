"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

#: Bits of the permutation, and of one step of the search for the last text taken.
ORDER_BITS, STEP_BITS = 60, 10
#: Texts of the last block, chosen one by one in one task per source.
LAST_BLOCK = 2000
#: A mix has at most so many sources: their totals and weights are planned on the driver.
MAX_SOURCES = 100_000


def entropy(w: dict[str, float]) -> float:
    return -sum(v * math.log(v) for v in w.values() if v > 0)


def _normal(w: dict[str, float]) -> dict[str, float]:
    total = sum(w.values())
    return {k: v / total for k, v in w.items()} if total else w


def _bisect(meets, lo: float, hi: float, rounds: int = 60) -> float:
    """The least value in [lo, hi] for which ``meets`` holds, if it holds from some point up to hi."""
    if meets(lo):
        return lo
    for _ in range(rounds):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if meets(mid) else (mid, hi)
    return hi


def tempered(sizes: dict[str, int], exponent: float) -> dict[str, float]:
    """Shares of sizes, exponentiated and normalised: 1 natural, 0 uniform."""
    q = _normal({k: float(v) for k, v in sizes.items() if v > 0})
    return _normal({k: v**exponent for k, v in q.items()})


def exponent_for_entropy(sizes: dict[str, int], target: float) -> float:
    """The exponent in [0, 1] at which the tempered shares have that entropy: 1 if the natural shares have more, 0 if uniform ones have less."""
    return _bisect(lambda a: entropy(tempered(sizes, a)) <= target, 0.0, 1.0)


def exponent_for_limits(sizes: dict[str, int], limits: dict[str, int], budget: int, least: float = 0.0) -> float:
    """The least exponent from ``least`` on at which tempered shares of the budget ask of no source more than its limit; 1 if none does."""
    return _bisect(lambda a: all(budget * w <= limits[k] * (1 + 1e-9) for k, w in tempered(sizes, a).items()), least, 1.0)


def plan_mix(
    sizes: dict[str, int], shares: dict[str, float] | None, caps: dict[str, int], budget: int | None = None, least_use: float = 0.5, target_entropy: float | None = None
) -> tuple[dict[str, int], float]:
    """Budget of each source, and the exponent of the tempered shares it was planned from.

    First the token shares of the sources are tempered: the exponent is
    bisected to ``target_entropy`` (that of the target shares unless given),
    then, if some source would have to be repeated more often than its cap,
    raised to the least at which none is. Then the tempered shares are moved to the targets as far as
    the caps let them: a source whose target asks more than its text times
    its cap gives that limit; all others get their target, and what the
    limited ones leave over goes by the tempered shares, which ask more of
    large sources without draining small ones. With ``shares`` None there are no targets
    and the tempered shares are the plan.

    Without a budget, it is the largest at which all targets hold within the
    caps, but at least ``least_use`` of what there is. Sources without text
    or target give nothing.
    """
    live = {k: v for k, v in sizes.items() if v > 0 and (shares is None or shares.get(k, 0) > 0) and caps.get(k, 0) > 0}
    if not live:
        return {}, 1.0
    limit = {k: v * caps[k] for k, v in live.items()}
    goal = _normal({k: shares[k] for k in live}) if shares is not None else None
    if target_entropy is None:
        target_entropy = entropy(goal or _normal({k: float(v) for k, v in live.items()}))
    a = exponent_for_entropy(live, target_entropy)
    if budget is None:
        wanted = goal or tempered(live, a)
        budget = int(max(min(limit[k] / wanted[k] for k in live), least_use * sum(live.values())))
    budget = min(budget, sum(limit.values()))
    a = exponent_for_limits(live, limit, budget, a)
    base = tempered(live, a)
    goal = goal or base
    pinned: dict[str, int] = {}
    while True:
        free = [k for k in live if k not in pinned]
        spare = budget - sum(pinned.values()) - sum(budget * goal[k] for k in free)
        weight = sum(base[k] for k in free)
        want = {k: budget * goal[k] + spare * base[k] / weight for k in free}
        over = [k for k in free if want[k] > limit[k] * (1 + 1e-9)]
        if not over:
            break
        pinned |= {k: limit[k] for k in over}
    return {k: int(v + 1e-6) for k, v in want.items()} | pinned, a


def _last_block(n_left: str):
    """Texts of one source's last block, in the order of the hash, each taken if it still fits."""

    def run(pdf):
        pdf = pdf.sort_values(["h", "item_id"])
        left, taken = int(pdf[n_left].iloc[0]), []
        for size in pdf["size"].tolist():
            fits = size <= left
            left -= size * fits
            taken.append(int(fits))
        return pdf.assign(more=taken)[["source", "item_id", "size", "more"]]

    return run


def mixed(texts: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0, target_entropy: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The chosen texts with their repeats, and the shares reached.

    ``texts`` has (item_id unique, source, size), ``targets`` (source,
    target_share, max_repeats); other columns are ignored. Chosen: item_id,
    source, size, repeats (1 to max_repeats). Shares, one row per target:
    source, target_share, n_texts, available, used, reached_share,
    most_repeats, tempered_share, exponent. Null sources, sources without a target and texts
    of no size are never chosen; a target without texts reaches 0. Repeated
    targets of one source: the first by share.

    Method: plan_mix on the token totals of the sources (tempered shares,
    then moved to the targets), then each source's
    budget becomes full passes over its texts and a rest. For the rest the
    texts are taken in the order of a hash: a threshold is found by totals of
    blocks of the hash, finer from round to round, and only the last block
    of a source is chosen text by text. No source is ever collected or
    sorted, and per round the driver gets one row per source.
    """
    spark = texts.sparkSession
    rows = targets.select("source", "target_share", "max_repeats").dropna(subset=["source"]).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError("too many sources for a mix")
    goal: dict = {}
    for r in sorted(rows, key=lambda r: (r.source, r.target_share or 0)):
        goal.setdefault(r.source, (float(r.target_share or 0), int(r.max_repeats or 0)))
    h = F.xxhash64("item_id", F.lit(seed)).bitwiseAND(F.lit((1 << ORDER_BITS) - 1))
    names = spark.createDataFrame([(k,) for k in goal], "source string")
    pool = texts.select("item_id", "source", F.col("size").cast("bigint").alias("size")).filter((F.col("size") > 0) & F.col("item_id").isNotNull())
    pool = pool.join(F.broadcast(names), "source").withColumn("h", h)
    have = {r.source: (r.size, r.n) for r in pool.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    totals, wanted, caps = {k: v[0] for k, v in have.items()}, {k: v[0] for k, v in goal.items()}, {k: v[1] for k, v in goal.items()}
    budgets, exponent = plan_mix(totals, wanted, caps, budget, target_entropy=target_entropy)
    passes, rest = {}, {}
    for k, b in budgets.items():
        passes[k] = min(b // have[k][0], goal[k][1])
        rest[k] = b - passes[k] * have[k][0] if passes[k] < goal[k][1] else 0
    # the block of the hash order in which the rest ends: first key, width, what is still wanted, texts in it
    block = {k: (0, 1 << ORDER_BITS, r, have[k][1]) for k, r in rest.items() if r > 0}
    within = (F.col("h") >= F.col("lo")) & (F.col("h") - F.col("lo") < F.col("width"))
    while wide := {k: v for k, v in block.items() if v[3] > LAST_BLOCK and v[1] > 1}:
        at = spark.createDataFrame([(k, lo, (width >> STEP_BITS) or 1, width, want) for k, (lo, width, want, _) in wide.items()], "source string, lo bigint, step bigint, width bigint, want bigint")
        inside = pool.join(F.broadcast(at), "source").filter(within)
        steps = inside.groupBy("source", "lo", "step", "want", F.expr("(h - lo) div step").alias("i")).agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        before = F.sum("size").over(Window.partitionBy("source").orderBy("i")) - F.col("size")  # at most 1 << STEP_BITS rows a source
        reached = steps.withColumn("before", before).filter(F.col("before") < F.col("want"))
        ends = reached.groupBy("source").agg(F.max(F.struct("i", "lo", "step", "want", "before", "n")).alias("e")).select("source", "e.*").collect()
        for r in ends:
            block[r.source] = (r.lo + r.i * r.step, r.step, r.want - r.before, r.n)
    plan = spark.createDataFrame([(k, passes[k], *(block[k][:3] if k in block else (0, 0, 0))) for k in budgets], "source string, passes bigint, lo bigint, width bigint, left bigint")
    planned = pool.join(F.broadcast(plan), "source")
    certain = planned.filter(~within).select("item_id", "source", "size", (F.col("passes") + (F.col("h") < F.col("lo")).cast("bigint")).alias("repeats"))
    chosen = certain
    if block:
        kinds = dict(pool.dtypes)
        last = planned.filter(within).groupBy("source").applyInPandas(_last_block("left"), f"source string, item_id {kinds['item_id']}, size bigint, more bigint")
        chosen = certain.unionByName(last.join(F.broadcast(plan.select("source", "passes")), "source").select("item_id", "source", "size", (F.col("passes") + F.col("more")).alias("repeats")))
    chosen = chosen.filter(F.col("repeats") > 0)
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("repeats")).alias("used"), F.max("repeats").alias("most_repeats"))
    base = tempered({k: totals[k] for k in budgets}, exponent)
    facts = spark.createDataFrame(
        [(k, *goal[k], have.get(k, (0, 0))[1], have.get(k, (0, 0))[0], float(base.get(k, 0.0))) for k in goal],
        "source string, target_share double, max_repeats int, n_texts bigint, available bigint, tempered_share double",
    )
    shares = facts.join(used, "source", "left").na.fill(0, ["used", "most_repeats"])
    total = shares.agg(F.sum("used").alias("total"))
    shares = shares.join(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.try_divide("used", "total"), F.lit(0.0))).withColumn("exponent", F.lit(float(exponent)))
    return chosen, shares.select("source", "target_share", "max_repeats", "n_texts", "available", "used", "reached_share", "most_repeats", "tempered_share", "exponent")
