"""Event chains of incidents and transitions between events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from mishaplens.operators.groups import grouped_records, with_next
from mishaplens.operators.incidents import child_rows, crowded, keyed

CHAIN = {"occurrence_no": "int", "occurrence_code": "string", "occurrence_description": "string", "phase_no": "string", "defining_ev": "int"}
NO_CHAINS = "No causal chains found to build a chart."


def chain_rows(sequences: DataFrame) -> DataFrame:
    return child_rows(sequences, CHAIN)


def chain_edges(sequences: DataFrame) -> DataFrame:
    """ev_id, i, event, next_event for each event but the last of its chain."""
    n = _steps(sequences).filter("has_next")
    return n.select("ev_id", F.col("position").alias("i"), F.col("occurrence_description").alias("event"), F.col("next_value").alias("next_event"))


def _steps(sequences: DataFrame) -> DataFrame:
    return with_next(chain_rows(sequences), "ev_id", ["occurrence_no"], "occurrence_description", large=crowded(sequences))


def mermaid_lines(edges: DataFrame) -> DataFrame:
    """One line of flow-chart text per edge, in the order of ev_id and i; labels are kept raw."""

    def node(i, label):
        return F.concat(F.lit('"'), "ev_id", F.lit("_"), i.cast("string"), F.lit('"["'), F.coalesce(label, F.lit("None")), F.lit('"]'))

    line = F.concat(node(F.col("i"), F.col("event")), F.lit(" --> "), node(F.col("i") + 1, F.col("next_event")), F.lit(";"))
    return edges.select("ev_id", "i", line.alias("line"))


def mermaid_text(lines: DataFrame, ids: list[str]) -> str:
    """The chart of a few incidents on the driver."""
    rows = lines.filter(F.col("ev_id").isin(ids)).orderBy("ev_id", "i").collect()
    if not rows:
        return NO_CHAINS
    out, now = ["graph TD;"], None
    for r in rows:
        if r.ev_id != now:
            out += ["    end"] * (now is not None) + [f"    subgraph {r.ev_id}"]
            now = r.ev_id
        out.append(f"        {r.line}")
    return "\n".join([*out, "    end", ""])


def flow_strips(sequences: DataFrame, arrow: str = " → ", chunk: int = 1000) -> DataFrame:
    """Per incident and part the events in order as one text, with their number."""
    g = grouped_records(chain_rows(sequences), "ev_id", ["occurrence_no"], "seq", chunk, crowded(sequences))
    return g.select("ev_id", "part_no", F.size("seq").alias("n_events"), F.array_join(F.transform("seq", lambda x: F.coalesce(x["occurrence_description"], F.lit("Unknown"))), arrow).alias("strip"))


def event_frequency(sequences: DataFrame) -> DataFrame:
    """Per event: occurrences and their number per incident with a sequence."""
    rows = chain_rows(sequences)
    n = rows.groupBy("occurrence_description").agg(F.count("*").alias("n"))
    with_seq = rows.agg(F.countDistinct("ev_id").alias("n_incidents"))
    return n.join(F.broadcast(with_seq)).select(F.col("occurrence_description").alias("event"), "n", F.round(F.col("n") / F.col("n_incidents"), 6).alias("per_incident"))


def transitions(sequences: DataFrame) -> DataFrame:
    """event, next_event, n, p: how often one follows the other, over all occurrences of the first (also as last of a chain, so shares need not sum to 1)."""
    counts = _steps(sequences).groupBy(F.col("occurrence_description").alias("event"), "has_next", F.col("next_value").alias("next_event")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("event"))  # over counts, so no event is hot
    return counts.withColumn("p", share).filter("has_next").select("event", "next_event", "n", "p")


def event_totals(sequences: DataFrame) -> DataFrame:
    """One row: events, distinct ones, incidents that have any, and events that another follows."""
    rows = chain_rows(sequences).agg(F.count("*").alias("n_events"), F.countDistinct("occurrence_description").alias("n_distinct"), F.countDistinct("ev_id").alias("n_incidents"))
    followed = chain_edges(sequences).agg(F.countDistinct("event").alias("n_followed"))
    return rows.join(F.broadcast(followed))


def chains_of_causes(diagnosis: DataFrame, sequences: DataFrame, n_causes: int = 10) -> DataFrame:
    """The first causes of a diagnosis with the chains of their first five supporting incidents, each once: cause, ev_id, part_no, n_events, strip."""
    top = diagnosis.orderBy(F.desc("probability"), "first_rank", "cause").limit(n_causes)
    wanted = F.broadcast(top.select("cause", F.explode(F.array_distinct("supporting")).alias("ev_id")))
    rows = keyed(sequences)
    return flow_strips(rows.join(wanted.select("ev_id").distinct(), "ev_id", "left_semi")).join(wanted, "ev_id").select("cause", "ev_id", "part_no", "n_events", "strip")


def top_followers(trans: DataFrame, frequency: DataFrame, n_events: int = 3, n_followers: int = 5) -> DataFrame:
    """The most frequent followers of the most frequent events; ties by name."""
    top = frequency.filter(F.col("event").isNotNull()).orderBy(F.desc("n"), "event").limit(n_events).select("event")
    w = Window.partitionBy("event").orderBy(F.desc("n"), "next_event")
    return trans.join(F.broadcast(top), "event").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n_followers)


def sequence_probability(trans: DataFrame, frequency: DataFrame, events: list[str]) -> float:
    """P(first) times the chance of each step: an extension, only sketched where this operator comes from."""
    p = frequency.filter(F.col("event") == events[0]).first()
    out = float(p.per_incident) if p else 0.0
    for a, b in zip(events, events[1:]):
        r = trans.filter((F.col("event") == a) & (F.col("next_event") == b)).first()
        out *= float(r.p) if r else 0.0
    return out
