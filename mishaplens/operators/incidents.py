"""Raw tables to one nested record per incident."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mishaplens.functions.text import iso, key, nan_text_to_null
from mishaplens.operators import groups
from mishaplens.operators.groups import CHUNK, array_of, first_per_key, grouped_records, large_keys
from mishaplens.operators.skew import split_join
from mishaplens.sources.tables import select_or_null, select_where

# The columns kept of each table.
EVENT_COLUMNS = {
    "ev_date": "timestamp_ntz", "ev_time": "string", "ev_city": "string", "ev_state": "string", "ev_country": "string", "light_cond": "string", "sky_cond_nonceil": "string",
    "vis_sm": "double", "wx_temp": "double", "wind_dir_deg": "double", "wind_vel_kts": "double", "gust_kts": "double", "wx_cond_basic": "string", "ev_highest_injury": "string",
}
AIRCRAFT_COLUMNS = {
    "damage": "string", "acft_fire": "string", "acft_expl": "string", "acft_make": "string", "acft_model": "string", "total_seats": "int", "num_eng": "int", "type_last_insp": "string", "afm_hrs": "double",
}
NARRATIVE_COLUMNS = {"narr_accp": "string", "narr_accf": "string", "narr_cause": "string"}
ENGINE_COLUMNS = {"eng_no": "int", "eng_type": "string", "eng_mfgr": "string", "eng_model": "string", "power_units": "double", "propeller_type": "string"}
FINDING_COLUMNS = {"finding_no": "int", "finding_description": "string", "cause_factor": "string"}
INJURY_COLUMNS = {"inj_person_category": "string", "injury_level": "string", "inj_person_count": "int"}
UNKNOWN_TEXT = ("acft_make", "acft_model", "light_cond", "wx_cond_basic")


def keyed(df: DataFrame) -> DataFrame:
    """With ``ev_id`` as join key; rows without one are dropped."""
    return df.withColumn("ev_id", key(F.col("ev_id"))).filter(F.col("ev_id").isNotNull())


def first_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The first row of each incident by arrival, with the named columns; missing ones are null."""
    picked = select_or_null(keyed(df), {"ev_id": "string", **columns, "lchg_date": "timestamp_ntz"})
    return first_per_key(picked, "ev_id", ["lchg_date"], list(columns))


def crowded(df: DataFrame) -> list:
    """Incidents with too many rows for one task; none, without looking, if the table has not that many."""
    return large_keys(keyed(df.select("ev_id")), "ev_id") if df.count() >= groups.LARGE else []


def child_rows(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Distinct rows of a child table; all columns but those of the load date, or the named ones."""
    kept = select_where(keyed(df), lambda c: "lchg" not in c) if columns is None else select_or_null(keyed(df), {"ev_id": "string", **columns})
    return kept.distinct()


def incident_records(
    events: DataFrame, narratives: DataFrame, aircraft: DataFrame, sequences: DataFrame, findings: DataFrame, engines: DataFrame, injuries: DataFrame | None = None, chunk: int = CHUNK
) -> DataFrame:
    """One record per incident: scalar fields of event, narrative and first aircraft, and four arrays that may be empty but never null.

    Missing texts of UNKNOWN_TEXT read 'Unknown'. Left joins on the key for the
    scalar sides, 1:1; the arrays are united and joined once. An incident with more than ``chunk`` rows in a
    child table continues in further parts, rows with the same ev_id and the
    next part_no, so that no record is unbounded; part 0 always exists.
    """
    base = first_rows(events, EVENT_COLUMNS).join(first_rows(narratives, NARRATIVE_COLUMNS), "ev_id", "left").join(first_rows(aircraft, AIRCRAFT_COLUMNS), "ev_id", "left")
    base = base.na.fill("Unknown", [c for c in UNKNOWN_TEXT if c in base.columns])
    arrays = {
        "sequence_of_events": (child_rows(sequences), ["occurrence_no"]),
        "findings": (child_rows(findings, FINDING_COLUMNS), ["finding_no"]),
        "engines": (child_rows(engines, ENGINE_COLUMNS), ["eng_no"]),
    }
    if injuries is not None:
        arrays["injuries"] = (child_rows(injuries, INJURY_COLUMNS), [])
    raw = {"sequence_of_events": sequences, "findings": findings, "engines": engines, "injuries": injuries}
    large = {k: crowded(raw[k]) for k in arrays}
    grouped = {k: grouped_records(df, "ev_id", order, k, chunk, large[k]) for k, (df, order) in arrays.items()}
    kinds = {k: g.schema[k].dataType.simpleString() for k, g in grouped.items()}
    rows = base.select("ev_id", F.lit(0).alias("part_no"))
    for g in grouped.values():
        rows = rows.unionByName(g, allowMissingColumns=True)
    parts = rows.groupBy("ev_id", "part_no").agg(*[F.first(k, ignorenulls=True).alias(k) for k in grouped])
    hot = sorted({k for v in large.values() for k in v})
    if hot:  # one key may have a third of all parts
        out = split_join(parts, base, ["ev_id"], parts.sparkSession.createDataFrame([(k,) for k in hot], "ev_id string"))
    else:
        out = parts.join(base, "ev_id")
    for k, kind in kinds.items():
        out = out.withColumn(k, array_of(F.col(k), kind))
    if injuries is None:
        kind = "array<struct<" + ",".join(f"{c}:{t}" for c, t in INJURY_COLUMNS.items()) + ">>"
        out = out.withColumn("injuries", F.array().cast(kind))
    return out.select("ev_id", "part_no", *[c for c in base.columns if c != "ev_id"], *arrays, *(["injuries"] if injuries is None else []))


def json_ready(df: DataFrame) -> DataFrame:
    """Scalars as JSON export has them: ISO timestamps, NaN and the text 'nan' as null. Export with ignoreNullFields=false to keep nulls."""
    out = []
    for f in df.schema:
        kind, c = f.dataType.simpleString(), F.col(f.name)
        if kind.startswith("timestamp"):
            c = iso(c)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        elif kind == "string":
            c = nan_text_to_null(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def as_json(df: DataFrame) -> DataFrame:
    """(ev_id, json): one document per record, nulls kept."""
    return df.select("ev_id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
