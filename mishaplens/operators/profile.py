"""Profile of a data set: what share of incidents has what."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.functions.text import strip, truthy


def incident_flags(events: DataFrame, narratives: DataFrame, findings: DataFrame, sequences: DataFrame) -> DataFrame:
    """One row per incident: which narratives it has, its number of findings and of sequence rows. Inputs hold one row per thing, keyed by ev_id; narratives one per incident."""
    n_f = findings.groupBy("ev_id").agg(F.count("*").alias("n_findings"))
    n_s = sequences.groupBy("ev_id").agg(F.count("*").alias("n_sequence"))
    n = narratives.select("ev_id", truthy(F.col("narr_cause")).alias("has_cause"), truthy(F.col("narr_accf")).alias("has_factual"))
    out = events.select("ev_id").join(n, "ev_id", "left").join(n_f, "ev_id", "left").join(n_s, "ev_id", "left")
    return out.na.fill({"has_cause": False, "has_factual": False, "n_findings": 0, "n_sequence": 0})


def _percent(n: str):
    return F.round(F.coalesce(F.try_divide(F.col(n) * 100.0, "n_incidents"), F.lit(0.0)), 6)


def dataset_coverage(flags: DataFrame) -> DataFrame:
    got = flags.agg(
        F.count("*").alias("n_incidents"), F.count_if("has_cause").alias("with_cause"), F.count_if("has_factual").alias("with_factual"), F.count_if(F.col("has_cause") | F.col("has_factual")).alias("with_narrative"),
        F.count_if(F.col("n_findings") > 0).alias("with_findings"), F.count_if(F.col("n_sequence") > 0).alias("with_sequence"),
    )
    for c in ("with_narrative", "with_findings", "with_sequence"):
        got = got.withColumn(f"{c}_percent", _percent(c))
    return got


def both_only_neither(flags: DataFrame) -> DataFrame:
    f, n = F.col("n_findings") > 0, F.col("has_cause") | F.col("has_factual")
    return flags.agg(F.count_if(f & n).alias("both"), F.count_if(f & ~n).alias("only_findings"), F.count_if(~f & n).alias("only_narratives"), F.count_if(~f & ~n).alias("neither"))


def findings_statistics(flags: DataFrame) -> DataFrame:
    """Findings in all and per incident, those without any counted as 0."""
    return flags.agg(F.sum("n_findings").alias("n_findings"), F.round(F.avg("n_findings"), 6).alias("findings_per_incident"), F.max("n_findings").alias("most_findings"))


def factor_distribution(findings: DataFrame) -> DataFrame:
    return findings.groupBy(strip(F.col("cause_factor")).alias("factor")).agg(F.count("*").alias("n"))


def finding_shares(findings: DataFrame, causal: bool, denominator: DataFrame, limit: int) -> DataFrame:
    """The most frequent findings (causal ones only, if so) with their share of ``denominator`` (one row, n_total). A top list by definition; ties by text."""
    rows = findings.filter(strip(F.col("cause_factor")) == "C") if causal else findings
    top = rows.groupBy("finding_description").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("finding_description")).limit(limit)
    return top.join(F.broadcast(denominator)).select("finding_description", "n", F.round(F.coalesce(F.try_divide("n", "n_total"), F.lit(0.0)), 6).alias("share"))


def recommendation(flags: DataFrame, unique_causes: DataFrame) -> DataFrame:
    """Which way of finding causes the data supports. ``unique_causes`` has one row (unique_causes)."""
    share = lambda c: F.avg(c.cast("double"))
    got = flags.agg(share(F.col("has_cause") | F.col("has_factual")).alias("n"), share(F.col("n_findings") > 0).alias("f")).join(F.broadcast(unique_causes))
    narrative, findings, diverse = (F.coalesce(c, F.lit(False)) for c in (F.col("n") > 0.5, F.col("f") > 0.3, F.col("unique_causes") > 20))
    word = F.when(narrative & findings, "both").when(narrative, "narratives").when(findings, "findings").otherwise("limited")
    return got.select(narrative.alias("narrative_rich"), findings.alias("findings_rich"), diverse.alias("causes_diverse"), word.alias("recommendation"))
