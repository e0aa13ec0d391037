"""Causes of incidents from structured findings and from narratives, and their statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.functions.text import CAUSE_INDICATORS, causes_from_narrative, strip, truthy
from mishaplens.operators.groups import CHUNK, grouped_records
from mishaplens.operators.incidents import FINDING_COLUMNS, child_rows, crowded, first_rows


def structured_causes(findings: DataFrame) -> DataFrame:
    """(ev_id, cause) of each causal finding: stripped factor 'C'. The cause may be null, as counting accepts that."""
    f = child_rows(findings, FINDING_COLUMNS).filter(strip(F.col("cause_factor")) == "C")
    return f.select("ev_id", F.col("finding_description").alias("cause"))


def narrative_causes(narratives: DataFrame, indicators=CAUSE_INDICATORS) -> DataFrame:
    """(ev_id, cause) of each sentence found; a sentence that occurs twice counts twice."""
    n = first_rows(narratives, {"narr_cause": "string"}).filter(F.col("narr_cause").isNotNull())
    return n.select("ev_id", F.explode(causes_from_narrative(F.col("narr_cause"), indicators)).alias("cause"))


def combined_causes(findings: DataFrame, narratives: DataFrame, known: DataFrame | None = None, indicators=CAUSE_INDICATORS) -> DataFrame:
    """Occurrences of both kinds: ev_id, cause, kind. Only those of ``known`` incidents, if given."""
    both = structured_causes(findings).withColumn("kind", F.lit("structured")).unionByName(narrative_causes(narratives, indicators).withColumn("kind", F.lit("narrative")))
    return both if known is None else both.join(known.select("ev_id").distinct(), "ev_id", "left_semi")


def cause_counts(occurrences: DataFrame, n_incidents: DataFrame) -> DataFrame:
    """Per cause: occurrences by kind and together, base probability (occurrences per incident, so it may exceed 1) and distinct incidents.

    ``n_incidents`` has one row (n_incidents).
    """
    per = occurrences.groupBy("cause").agg(
        F.count_if(F.col("kind") == "structured").alias("n_structured"), F.count_if(F.col("kind") == "narrative").alias("n_narrative"), F.count("*").alias("n_combined"), F.countDistinct("ev_id").alias("n_distinct_incidents")
    )
    return per.join(F.broadcast(n_incidents)).withColumn("base_probability", F.coalesce(F.try_divide("n_combined", "n_incidents"), F.lit(0.0))).drop("n_incidents")


def incident_causes(occurrences: DataFrame) -> DataFrame:
    """Distinct (ev_id, cause) with a non-empty cause: what an incident's entries are evidence for.

    Kept long instead of as an array per entry: one incident may have a large
    share of all findings, and every entry of an incident shares the causes.
    """
    return occurrences.filter(truthy(F.col("cause"))).select("ev_id", "cause").distinct()


def finding_arrays(findings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per incident and part of up to ``chunk`` findings, in their order: findings, cause_factors and causal_findings as arrays. Entries find theirs by incident."""
    g = grouped_records(child_rows(findings, FINDING_COLUMNS), "ev_id", ["finding_no"], "f", chunk, crowded(findings))
    causal = F.filter("f", lambda x: strip(x["cause_factor"]) == "C")
    return g.select(
        "ev_id", "part_no", F.transform("f", lambda x: x["finding_description"]).alias("findings"), F.transform("f", lambda x: x["cause_factor"]).alias("cause_factors"),
        F.transform(causal, lambda x: x["finding_description"]).alias("causal_findings"),
    )


def coverage(events: DataFrame, occurrences: DataFrame) -> DataFrame:
    """How many of the incidents (ev_id) have structured causes only, narrative ones only, both, or any; with percentages."""
    flags = occurrences.groupBy("ev_id").agg(F.bool_or(F.col("kind") == "structured").alias("s"), F.bool_or(F.col("kind") == "narrative").alias("n"))
    s, n = F.coalesce("s", F.lit(False)), F.coalesce("n", F.lit(False))
    got = events.select("ev_id").distinct().join(flags, "ev_id", "left").agg(
        F.count("*").alias("n_incidents"), F.count_if(s & ~n).alias("structured_only"), F.count_if(~s & n).alias("narrative_only"), F.count_if(s & n).alias("both"), F.count_if(s | n).alias("any_kind")
    )
    return got.withColumn("any_percent", F.round(F.coalesce(F.try_divide(F.col("any_kind") * 100.0, "n_incidents"), F.lit(0.0)), 6))


def global_statistics(counts: DataFrame, n_incidents: DataFrame) -> DataFrame:
    """One row; scopes are mixed as in the source of this operator: distinct causes and totals are of structured findings only, the rest of both kinds."""
    got = counts.agg(
        F.count_if(F.col("n_structured") > 0).alias("unique_causes"), F.coalesce(F.sum("n_structured"), F.lit(0)).alias("total_causal_findings"),
        F.count_if(F.col("n_narrative") > 0).alias("unique_narrative_causes"), F.count("*").alias("unique_combined_causes"), F.round(F.max("base_probability"), 6).alias("largest_probability"),
    )
    return got.join(F.broadcast(n_incidents))
