"""References to records that do not exist, or did not when the reference was last changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mishaplens.functions.text import key
from mishaplens.operators.skew import HEAVY_SHARE, heavy_keys, split_join
from mishaplens.session import stage

GROUP = ["child_table", "ev_id", "lchg_month"]


def references(children: dict[str, DataFrame], id_col: str = "ev_id", at_col: str = "lchg_date") -> DataFrame:
    """One row per referring row that has a key: child_table, ev_id (the key), changed_at, lchg_month ('none' without a date)."""
    out = None
    for label, df in children.items():
        part = df.select(F.lit(label).alias("child_table"), key(F.col(id_col)).alias("ev_id"), F.col(at_col).alias("changed_at"))
        out = part if out is None else out.unionByName(part)
    month = F.coalesce(F.date_format("changed_at", "yyyy-MM"), F.lit("none"))
    return out.filter(F.col("ev_id").isNotNull()).withColumn("lchg_month", month)


def parent_spans(parents: DataFrame, withdrawn: DataFrame | None, grace_days: int = 7) -> DataFrame:
    """Per key the time a reference to it is good: from ``grace_days`` before its first arrival until, exclusively, its withdrawal.

    A parent without any date is good from ever; a key that is withdrawn
    several times counts from the first. Withdrawals of keys that the parent
    table lacks have no effect.
    """
    first = (
        parents.select(key(F.col("ev_id")).alias("ev_id"), "lchg_date")
        .filter(F.col("ev_id").isNotNull())
        .groupBy("ev_id")
        .agg(F.min("lchg_date").alias("since"))
        .select("ev_id", (F.col("since") - F.expr(f"interval {grace_days} days")).alias("good_from"), F.lit(True).alias("known"))
    )
    if withdrawn is None:
        return first.withColumn("good_until", F.lit(None).cast("timestamp"))
    last = (
        withdrawn.select(key(F.col("ev_id")).alias("ev_id"), "withdrawn_at")
        .filter(F.col("ev_id").isNotNull())
        .groupBy("ev_id")
        .agg(F.min("withdrawn_at").alias("good_until"))
    )
    return first.join(last, "ev_id", "left")


def _early(at: str | Column) -> Column:
    return F.coalesce((F.col(at) if isinstance(at, str) else at) < F.col("good_from"), F.lit(False))


def _late(at: str | Column) -> Column:
    return F.coalesce((F.col(at) if isinstance(at, str) else at) >= F.col("good_until"), F.lit(False))


def judged_groups(refs: DataFrame, spans: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """References pre-aggregated per table, key and month, each group with the span of its parent.

    The pre-aggregate (count, first and last change) is combined on the map
    side, so a key with a third of all rows arrives as a few rows per month.
    Keys that are still heavy, at most 1 / heavy_share, meet a broadcast of
    their spans; all others an ordinary shuffled join. Both results are united.
    """
    groups = stage(
        refs.groupBy(*GROUP).agg(F.count("*").alias("n"), F.min("changed_at").alias("first_at"), F.max("changed_at").alias("last_at")),
        "reference_groups",
    )
    heavy = heavy_keys(groups.select("ev_id", "n"), ["ev_id"], share=heavy_share)
    return split_join(groups, spans, ["ev_id"], heavy, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def orphan_references(refs: DataFrame, spans: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Distinct (child_table, ev_id, lchg_month) with at least one orphan reference.

    A reference is an orphan if the parent table lacks its key, or if its own
    date lies outside the span. References without a date are orphans only if
    the key is missing; null and empty keys take part in nothing. Empty
    inputs give an empty result, an empty parent table makes all references
    orphans. Columns other than key and date are ignored.
    """
    g = judged_groups(refs, spans, heavy_share)
    return g.filter(~F.col("known") | _early("first_at") | _late("last_at")).select(*GROUP)


def orphan_report(refs: DataFrame, spans: DataFrame, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Per table and month: references, orphan references, those without any parent, and orphan keys.

    A group that lies wholly inside or outside its span is counted from the
    pre-aggregate. Only groups that a bound cuts through (at most two months
    a key) go back to their rows, in the same split join.
    """
    g = stage(judged_groups(refs, spans, heavy_share), "judged_groups")
    outside = ~F.col("known") | _early("last_at") | _late("first_at")
    inside = F.col("known") & ~_early("first_at") & ~_late("last_at")
    whole = g.select(*GROUP, "n", "known", F.when(outside, F.col("n")).when(inside, F.lit(0)).alias("orphans"))
    cut = g.filter(~outside & ~inside).select(*GROUP, "n", "good_from", "good_until")
    heavy = heavy_keys(cut.select(*GROUP, "n"), GROUP, share=heavy_share)
    recount = (
        split_join(refs, cut.drop("n"), GROUP, heavy)
        .groupBy(*GROUP)
        .agg(F.count_if(_early("changed_at") | _late("changed_at")).alias("recounted"))
    )
    counted = whole.join(recount, GROUP, "left").withColumn("orphans", F.coalesce("orphans", "recounted"))
    return counted.groupBy("child_table", "lchg_month").agg(
        F.sum("n").alias("n_references"),
        F.sum("orphans").alias("n_orphans"),
        F.sum(F.when(~F.col("known"), F.col("n")).otherwise(0)).alias("n_without_parent"),
        F.count_if(F.col("orphans") > 0).alias("n_orphan_keys"),
    )
