"""Joins that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A key is heavy if it has at least this share of the rows, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 1000


def heavy_keys(counts: DataFrame, on: list[str], n: str = "n", share: float = HEAVY_SHARE, least: int = 1000) -> DataFrame:
    """Keys with at least ``share`` of all rows (and ``least`` rows).

    ``counts`` has a row count per key, pre-aggregated. By construction no more
    than 1 / share keys qualify, which bounds every broadcast of the result.
    The sum over the pre-aggregate is one number.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    floor = max(least, int(total * share) + 1)
    return counts.groupBy(*on).agg(F.sum(n).alias(n)).filter(F.col(n) >= floor).select(*on)


def split_join(many: DataFrame, one: DataFrame, on: list[str], heavy: DataFrame, how: str = "inner") -> DataFrame:
    """``many`` join ``one`` (unique on the keys) without moving the rows of heavy keys.

    Rows of heavy keys meet a broadcast of the few matching rows of ``one``;
    all others are shuffled by key, where no key is large. Null keys take the
    second way and match nothing.
    """
    few = one.join(F.broadcast(heavy), on, "left_semi")
    hot = many.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(few), on, how)
    cold = many.join(F.broadcast(heavy), on, "left_anti").join(one, on, how)
    return hot.unionByName(cold)
