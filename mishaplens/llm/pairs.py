"""Items that appear together in one basket, against chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mishaplens.operators.skew import heavy_keys, split_join
from mishaplens.session import stage

#: Baskets handled through a bit mask, at most (the bits of a long); and the size from which one may be.
HOT_BASKETS, HOT_ITEMS = 62, 64
#: Items of a basket that one task pairs at a time.
BLOCK = 256
#: A frequent-item dictionary of at most so many rows is broadcast.
BROADCAST_ITEMS = 200_000


def _frequent(inc: DataFrame, at_least: int) -> tuple[DataFrame, bool]:
    """Items in at least ``at_least`` baskets with an integer code each; whether they are few enough to broadcast."""
    counted = inc.groupBy("item").agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
    coded = stage(counted.withColumn("code", F.monotonically_increasing_id()), "frequent_items")
    return coded, coded.count() <= BROADCAST_ITEMS


def _blocked_pairs(coded: DataFrame, big: DataFrame) -> DataFrame:
    """Pairs of the baskets in ``big`` (basket, n): items are dealt to blocks, and each pair of blocks is one row of work."""
    blocks = (
        coded.join(big, "basket")
        .withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("code"), F.col("n_blocks")).cast("int"))
        .groupBy("basket", "n_blocks", "block")
        .agg(F.sort_array(F.collect_list("code")).alias("codes"))
    )
    left = blocks.select("basket", "block", "codes", F.explode(F.sequence("block", F.col("n_blocks") - 1)).alias("other"))
    right = blocks.select("basket", F.col("block").alias("other"), F.col("codes").alias("codes_2"))
    both = left.join(right, ["basket", "other"])
    crossed = both.select(F.explode("codes").alias("x"), "codes_2", (F.col("block") == F.col("other")).alias("same"))
    crossed = crossed.select("x", F.explode("codes_2").alias("y"), "same").filter(~F.col("same") | (F.col("x") < F.col("y")))
    return crossed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs_of(codes: Column) -> Column:
    return F.flatten(F.transform(codes, lambda x, i: F.transform(F.slice(codes, i + 2, F.size(codes)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def item_pairs(baskets: DataFrame, min_support: int = 5, min_share: int | None = None, min_lift: int | None = None) -> DataFrame:
    """Pairs of items with the number of baskets that have both, their lift and their pointwise mutual information.

    ``baskets`` has (basket, item); repeated rows count once, rows with a null
    in either take part in nothing, other columns are ignored. Result:
    item_a < item_b by code points, n_a, n_b, n_ab, n_baskets, lift, pmi
    (natural logarithm). A pair is given if n_ab >= min_support, if
    ``min_share * n_ab >= n_baskets`` and if its lift is at least
    ``min_lift``, where these are set. No rows give no pairs.

    Method: items are deduplicated per basket; only items frequent enough to
    be in such a pair are kept, under integer codes; each basket emits its
    ordered pairs, which are counted with a map-side combine. The few largest
    baskets, fewer than the support asked for, emit none: a pair they alone
    have cannot qualify, and for all others a bit mask per item tells which
    of them hold both. Further large baskets are paired block by block, so no
    task meets a whole one.
    """
    inc = stage(baskets.select("basket", "item").dropna().distinct(), "incidences")
    sizes = inc.groupBy("basket").agg(F.count("*").alias("n"))
    n_baskets = sizes.count()
    at_least = max(min_support, 1, -(-n_baskets // min_share) if min_share else 1)
    freq, few = _frequent(inc, at_least)
    if few:
        coded = inc.join(F.broadcast(freq.select("item", "code")), "item").select("basket", "code")
    else:
        heavy = heavy_keys(freq.select("item", "n"), ["item"])
        coded = split_join(inc, freq.select("item", "code"), ["item"], heavy).select("basket", "code")
    kept = coded.groupBy("basket").agg(F.count("*").alias("n"))
    top = kept.filter(F.col("n") > HOT_ITEMS).orderBy(F.desc("n"), "basket").limit(HOT_BASKETS).collect()
    hot = [r.basket for r in top[: at_least - 1]]
    rest = coded.filter(~F.col("basket").isin(hot)) if hot else coded
    big = kept.filter(F.col("n") > BLOCK)
    big = big.filter(~F.col("basket").isin(hot)) if hot else big
    plain = rest
    pairs = None
    if not big.isEmpty():
        big = stage(big, "big_baskets")
        plain = rest.join(big, "basket", "left_anti")
        pairs = _blocked_pairs(rest, big)
    lists = plain.groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("codes")).filter(F.size("codes") > 1)
    emitted = lists.select(F.explode(_pairs_of(F.col("codes"))).alias("p")).select("p.a", "p.b")
    pairs = emitted if pairs is None else emitted.unionByName(pairs)
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    if hot:
        bit = F.lit(0).cast("bigint")
        for i, b in enumerate(hot):
            bit = F.when(F.col("basket") == b, F.lit(1 << i).cast("bigint")).otherwise(bit)
        masks = coded.filter(F.col("basket").isin(hot)).groupBy("code").agg(F.bit_or(bit).alias("mask"))
        freq = stage(freq.join(masks, "code", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("bigint"))), "masked_items")
    else:
        freq = freq.withColumn("mask", F.lit(0).cast("bigint"))
        counted = counted.filter(F.col("n") >= at_least)
    for side in ("a", "b"):
        one = freq.select(F.col("code").alias(side), F.col("item").alias(f"item_{side}"), F.col("n").alias(f"n_{side}"), F.col("mask").alias(f"mask_{side}"))
        counted = counted.join(F.broadcast(one) if few else one, side)
    n, total = F.col("n_ab"), F.lit(n_baskets).cast("bigint")
    out = counted.withColumn("n_ab", F.col("n") + F.bit_count(F.col("mask_a").bitwiseAND(F.col("mask_b")))).filter(n >= at_least)
    if min_lift is not None:
        wide = lambda c: c.cast("decimal(19,0)")
        out = out.filter(wide(n) * wide(total) >= min_lift * (wide(F.col("n_a")) * wide(F.col("n_b"))))
    lift = n * total / (F.col("n_a").cast("double") * F.col("n_b"))
    flip = F.col("item_a") > F.col("item_b")
    return out.select(
        F.least("item_a", "item_b").alias("item_a"),
        F.greatest("item_a", "item_b").alias("item_b"),
        F.when(flip, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"),
        F.when(flip, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"),
        "n_ab",
        total.alias("n_baskets"),
        lift.alias("lift"),
        F.log(lift).alias("pmi"),
    )
