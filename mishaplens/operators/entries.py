"""Searchable entries: the texts of incidents and of the dictionary, one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.functions.text import clean_narrative
from mishaplens.operators.groups import first_per_key
from mishaplens.operators.incidents import FINDING_COLUMNS, NARRATIVE_COLUMNS, child_rows, first_rows


def narrative_entries(narratives: DataFrame) -> DataFrame:
    """Causal and factual narratives; the preliminary one only if both are missing. One pass, no union."""
    n = first_rows(narratives, NARRATIVE_COLUMNS)
    a, b, c = (clean_narrative(F.col(x)) for x in ("narr_cause", "narr_accf", "narr_accp"))
    kinds = F.array(
        F.struct(F.lit("causal_narrative").alias("entry_type"), a.alias("text")),
        F.struct(F.lit("factual_narrative").alias("entry_type"), b.alias("text")),
        F.struct(F.lit("fallback_narrative").alias("entry_type"), F.when(a.isNull() & b.isNull(), c).alias("text")),
    )
    e = n.select("ev_id", F.explode(F.filter(kinds, lambda x: x["text"].isNotNull())).alias("e"))
    return e.select(F.lit("incident").alias("source"), "ev_id", "e.entry_type", F.lit(None).cast("int").alias("finding_no"), "e.text")


def finding_entries(findings: DataFrame) -> DataFrame:
    f = child_rows(findings, FINDING_COLUMNS).withColumn("text", clean_narrative(F.col("finding_description"))).filter(F.col("text").isNotNull())
    return f.select(F.lit("incident").alias("source"), "ev_id", F.lit("finding").alias("entry_type"), "finding_no", "text")


def incident_entries(narratives: DataFrame, findings: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of incidents that ``known`` (ev_id) has."""
    every = narrative_entries(narratives).unionByName(finding_entries(findings))
    return every.join(known.select("ev_id").distinct(), "ev_id", "left_semi")


def dictionary_entries(dictionary: DataFrame) -> DataFrame:
    """(code, meaning) rows as entries; a missing meaning gives none."""
    d = dictionary.withColumn("text", clean_narrative(F.col("meaning"))).filter(F.col("text").isNotNull())
    return d.select(F.lit("dictionary").alias("source"), "code", "text").distinct()


def all_entries(incident: DataFrame, dictionary: DataFrame) -> DataFrame:
    return incident.unionByName(dictionary, allowMissingColumns=True)


def mapped_entries(embeddings_map: DataFrame) -> DataFrame:
    """The entry table: one whole row per entry_id, the least by its columns with nulls last, with the incident's key."""
    m = embeddings_map.withColumn("ev_id", F.nullif(F.upper(F.trim("ev_id")), F.lit(""))).filter(F.col("entry_id").isNotNull())
    columns = [c for c in m.columns if c != "entry_id"]
    return first_per_key(m, "entry_id", sorted(columns, key=lambda c: (c != "source", c != "ev_id")), columns)


def known_and_skipped(entries: DataFrame, known: DataFrame) -> DataFrame:
    """Incident entries of known incidents (to be augmented) and those skipped."""
    flag = known.select("ev_id").distinct().withColumn("is_known", F.lit(True))
    e = entries.filter("source = 'incident'").join(flag, "ev_id", "left")
    return e.agg(F.count_if("is_known").alias("augmented"), F.count_if(F.col("is_known").isNull()).alias("skipped"))


