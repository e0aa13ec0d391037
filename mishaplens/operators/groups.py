"""Ordered groups of child rows that stay bounded when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mishaplens.operators.skew import heavy_keys
from mishaplens.session import stage

#: Rows of a key that one nested record holds; more go to further parts.
CHUNK = 1000
#: Rows of a key from which it is not sorted in one task.
LARGE = 200_000
_OFFSET = (1 << 33) - 1


def first_per_key(df: DataFrame, by: str, order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the first by ``order`` (nulls last), ties by all other columns (nulls first).

    An aggregate, so rows are combined before the shuffle and no group is
    sorted; only orderable columns may be kept. Null keys are dropped.
    """
    columns = columns or [c for c in df.columns if c != by]
    head = [f for c in order for f in (F.isnull(c), F.col(c))]
    rest = [c for c in df.columns if c != by and c not in order]
    packed = F.struct(*[h.alias(f"o{i}") for i, h in enumerate(head)], *rest)
    got = df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(packed).alias("_r"))
    out = []
    for c in columns:
        out.append(F.col(f"_r.o{2 * order.index(c) + 1}").alias(c) if c in order else F.col(f"_r.{c}").alias(c))
    return got.select(by, *out)


def large_keys(df: DataFrame, by: str, least: int | None = None) -> list:
    """Keys with too many rows for one task: LARGE at least, and a 1000th of all, so at most 1000.

    Repeated rows may be left in ``df``, as to count them with the others
    costs less than to remove them first.
    """
    if df.count() < (least or LARGE):
        return []
    return [r[0] for r in heavy_keys(df.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")), [by], least=least or LARGE).collect()]


def _order(df: DataFrame, by: str, order: list[str]) -> list[Column]:
    rest = [c for c in df.columns if c != by and c not in order]
    return [*[F.asc_nulls_last(c) for c in order], *[F.asc_nulls_first(c) for c in rest]]


def _split(df: DataFrame, by: str, large: list) -> tuple[DataFrame, DataFrame | None]:
    """Rows of all other keys, and those of the large ones if there are any; null keys are dropped."""
    rows = df.filter(F.col(by).isNotNull())
    return (rows.filter(~F.col(by).isin(large)), rows.filter(F.col(by).isin(large))) if large else (rows, None)


def positioned(df: DataFrame, by: str, order: list[str], large: list | None = None) -> DataFrame:
    """``df`` with ``position`` (from 0) of each row in its key, by ``order`` with nulls last, ties by all other columns.

    A window over the key numbers the rows of ordinary keys. ``large`` keys
    (large_keys unless given) would be sorted in one task; their rows are
    range-partitioned by key and order together, so such a key spans several
    ranges. Null keys are dropped.
    """
    small, hot = _split(df, by, large_keys(df, by) if large is None else large)
    w = Window.partitionBy(by).orderBy(*_order(df, by, order))
    out = small.withColumn("position", (F.row_number().over(w) - 1).cast("bigint"))
    return out if hot is None else out.unionByName(_ranged(hot, by, order))


def _ranged(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Positions of the rows of large keys: each range numbers its rows and learns from the counts of the ranges before it where its part of the key begins."""
    keys = [F.col(by), *_order(rows, by, order)]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = stage(rows.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().bitwiseAND(F.lit(_OFFSET)).alias("_at")), "ranges")
    counts = rows.groupBy(by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, "_range", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    placed = rows.join(starts, [by, "_range"])
    return placed.withColumn("position", F.col("_before") + F.col("_at") - F.col("_first")).drop("_range", "_at", "_first", "_n", "_before")


def grouped_records(df: DataFrame, by: str, order: list[str], into: str, chunk: int = CHUNK, large: list | None = None) -> DataFrame:
    """Child rows as ordered arrays of records: key, part_no, array. A key with more than ``chunk`` rows has several parts."""
    fields = [c for c in df.columns if c != by]
    placed = positioned(df, by, order, large).withColumn("part_no", F.expr(f"cast(position div {chunk} as int)"))
    packed = F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("r"))))
    return placed.groupBy(by, "part_no").agg(F.transform(packed, lambda x: x["r"]).alias(into))


def with_next(df: DataFrame, by: str, order: list[str], value: str, block: int = 10_000, large: list | None = None) -> DataFrame:
    """Each row with its position, whether a row follows in its key (has_next), and the ``value`` of that row (next_value).

    For large keys, work is cut into blocks of positions; the first row of a
    block is lent to the one before, so no task meets a whole one.
    """
    small, hot = _split(df, by, large_keys(df, by) if large is None else large)
    w = Window.partitionBy(by).orderBy(*_order(df, by, order))
    out = small.select("*", (F.row_number().over(w) - 1).cast("bigint").alias("position"), F.lead(value).over(w).alias("next_value"), F.coalesce(F.lead(F.lit(True)).over(w), F.lit(False)).alias("has_next"))
    if hot is None:
        return out
    placed = _ranged(hot, by, order).withColumn("_block", F.expr(f"position div {block}"))
    lent = (F.col("position") % block == 0) & (F.col("position") > 0)
    homes = F.when(lent, F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))
    rows = placed.withColumn("_home", F.explode(homes))
    w = Window.partitionBy(by, "_home").orderBy("position")
    rows = rows.withColumn("next_value", F.lead(value).over(w)).withColumn("has_next", F.lead("position").over(w).isNotNull())
    return out.unionByName(rows.filter(F.col("_home") == F.col("_block")).drop("_block", "_home"))


def array_of(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))
