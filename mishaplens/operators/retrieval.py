"""Exact vector search, weighted diagnosis and what is shown of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from mishaplens.operators.causes import combined_causes, incident_causes
from mishaplens.operators.entries import mapped_entries
from mishaplens.operators.incidents import keyed
from mishaplens.operators.skew import heavy_keys, split_join
from mishaplens.session import stage

#: A query vector comes from the driver; a batch of them is bounded.
MAX_QUERIES = 10_000
#: Numbers of the score table one Arrow batch may need.
SCORE_CELLS = 4_000_000


def usable_rows(vectors: DataFrame, dim: int) -> DataFrame:
    """Rows whose vector has ``dim`` finite numbers that are not all zero; repeated rows stay."""
    e = F.col("embedding")
    ok = (F.size(e) == dim) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.filter(F.coalesce(ok, F.lit(False)) & F.col("entry_id").isNotNull())


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """One vector per entry; of differing ones the least."""
    return usable_rows(vectors, dim).groupBy("entry_id").agg(F.min("embedding").alias("embedding"))


def _unit_queries(queries: dict[int, list[float]]) -> tuple[np.ndarray, np.ndarray]:
    if len(queries) > MAX_QUERIES:
        raise ValueError("too many query vectors for one batch")
    ids = np.array(sorted(queries), "int64")
    q = np.array([queries[i] for i in ids.tolist()], "f8").reshape(len(ids), -1 if len(ids) else 1)
    norms = np.sqrt((q * q).sum(1, keepdims=True))
    return ids, np.divide(q, norms, out=np.zeros_like(q), where=norms > 0)


def _unit_rows(batch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and unit vectors of the usable rows of an Arrow batch (entry_id, embedding)."""
    import pyarrow.compute as pc

    full = pc.and_(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False), pc.is_valid(batch.column(0)))
    b = batch.filter(full)
    if not b.num_rows:
        return np.zeros(0, "int64"), np.zeros((0, dim))
    x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype("f8")
    n = np.sqrt((x * x).sum(1))
    good = np.isfinite(x).all(1) & (n > 0)
    return b.column(0).to_numpy(zero_copy_only=False)[good], x[good] / n[good, None]


def scored(vectors: DataFrame, queries: dict[int, list[float]]) -> DataFrame:
    """(query_id, entry_id, score): cosine of every usable vector with every query vector, in double.

    The query vectors travel with the task; the vectors are scanned once and
    never shuffled, and rows that are not usable are left out on the way. An
    entry with several rows counts once, with its best score. Rows of equal
    vectors get equal scores, as every row is summed in the same order. A
    query vector of zeros scores 0.
    """
    ids, q = _unit_queries(queries)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            entry, x = _unit_rows(b, q.shape[1])
            step = max(1, SCORE_CELLS // max(1, len(entry)))
            for lo in range(0, len(ids) if len(entry) else 0, step):
                s = np.stack([(x * v).sum(1) for v in q[lo : lo + step]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[lo : lo + step], len(entry))), pa.array(np.tile(entry, len(s))), pa.array(s.ravel())], names=["query_id", "entry_id", "score"]
                )

    rows = vectors.select("entry_id", "embedding").mapInArrow(run, "query_id bigint, entry_id bigint, score double")
    return rows.groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))


def top_scored(vectors: DataFrame, queries: dict[int, list[float]], k: int = 50) -> DataFrame:
    """The rows of ``scored`` that can be among the first ``k`` of a query (ties: larger id): each task keeps its best ``k`` distinct entries.

    What is shuffled is bounded by queries x k x tasks instead of queries x
    entries. No entry is lost: one of the first k of all is one of the first
    k in the task that has its best row.
    """
    ids, q = _unit_queries(queries)

    def run(batches):
        import pyarrow as pa

        kept = [(np.zeros(0, "int64"), np.zeros(0)) for _ in ids]
        for b in batches:
            entry, x = _unit_rows(b, q.shape[1])
            for i, v in enumerate(q if len(entry) else ()):
                s = (x * v).sum(1)
                e0, s0 = kept[i]
                at = np.flatnonzero(s >= s0[-1]) if len(s0) == k else np.arange(len(s))
                e, s = np.r_[e0, entry[at]], np.r_[s0, s[at]]
                order = np.lexsort((-e, -s))
                e, s = e[order], s[order]
                _, first = np.unique(e, return_index=True)  # the best row of each entry
                first = np.sort(first)[:k]
                kept[i] = e[first], s[first]
        n = [len(e) for e, _ in kept]
        if sum(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(np.concatenate([e for e, _ in kept])), pa.array(np.concatenate([s for _, s in kept]))], names=["query_id", "entry_id", "score"])

    rows = vectors.select("entry_id", "embedding").mapInArrow(run, "query_id bigint, entry_id bigint, score double")
    return rows.groupBy("query_id", "entry_id").agg(F.max("score").alias("score"))


def top_entries(scores: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` entries of one query with their rank from 1; ties go to the larger id. No full sort."""
    best = scores.orderBy(F.desc("score"), F.desc("entry_id")).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("entry_id"))))


def top_per_query(scores: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` entries of each query; groups are cut before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("entry_id"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def best_per_incident(scores: DataFrame, entries: DataFrame) -> DataFrame:
    """Best score of each incident over all its entries; entries without an incident are left out."""
    s = scores.join(entries.filter(F.col("ev_id").isNotNull() & (F.col("source") == "incident")).select("entry_id", "ev_id"), "entry_id")
    return s.groupBy("ev_id").agg(F.max("score").alias("score"), F.max_by("entry_id", F.struct("score", "entry_id")).alias("best_entry_id"))


def ranked_incidents(top: DataFrame, embeddings_map: DataFrame) -> DataFrame:
    """The ranked entries that belong to an incident: query_id, entry_id, score, rank, ev_id.

    The limit comes first: entries of the dictionary are dropped and not
    replaced. The result is small and read several times, so it is staged.
    """
    few = stage(top, "top_entries")
    entry = mapped_entries(embeddings_map.join(F.broadcast(few.select("entry_id").distinct()), "entry_id", "left_semi"))
    own = entry.filter((F.col("source") == "incident") & F.col("ev_id").isNotNull()).select("entry_id", "ev_id")
    return stage(few.join(F.broadcast(own), "entry_id"), "ranked_incidents")


def restricted(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """Rows of the ranked incidents only: what follows then costs by the number of ranks, not of incidents."""
    return keyed(df).join(F.broadcast(ranked.select("ev_id").distinct()), "ev_id", "left_semi")


def evidence(ranked: DataFrame, findings: DataFrame, narratives: DataFrame, events: DataFrame) -> DataFrame:
    """(entry, cause) pairs of the ranked incidents, each distinct non-empty cause of a known incident once per entry."""
    occurrences = combined_causes(restricted(findings, ranked), restricted(narratives, ranked), restricted(events, ranked))
    return incident_causes(occurrences).join(F.broadcast(ranked), "ev_id")


def weighted_diagnosis(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Causes by probability: sum of scores over the sum of scores of all (entry, cause) pairs, 0 if that is not positive.

    Result: cause, raw_score, probability, num_incidents (entries; an
    incident counts once per entry), supporting (incidents of the first five
    entries), first_rank. ``by`` are columns of a batch of queries.
    """
    by = by or []
    five = F.slice(F.sort_array(F.collect_list(F.struct("rank", "ev_id"))), 1, 5)  # at most k pairs a cause
    per = pairs.groupBy(*by, "cause").agg(F.sum("score").alias("raw_score"), F.count("*").alias("num_incidents"), F.transform(five, lambda x: x["ev_id"]).alias("supporting"), F.min("rank").alias("first_rank"))
    total = F.sum("raw_score").over(Window.partitionBy(*by))
    return per.withColumn("probability", F.when(total > 0, F.col("raw_score") / total).otherwise(0.0))


def diagnosis_metadata(top: DataFrame, pairs: DataFrame) -> DataFrame:
    used = pairs.agg(F.countDistinct("entry_id").alias("incidents_analyzed"), F.countDistinct("cause").alias("total_causes_found"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("total_similarity_weight"))
    return used.join(F.broadcast(top.agg(F.count("*").alias("entries_ranked"))))


def per_incident_diagnosis(pairs: DataFrame) -> DataFrame:
    """The documented variant: sum of scores with the cause over the sum of scores of all entries used."""
    used = pairs.select("entry_id", "score").distinct().agg(F.sum("score").alias("total"))
    per = pairs.groupBy("cause").agg(F.sum("score").alias("raw_score"))
    return per.join(F.broadcast(used)).withColumn("probability", F.when(F.col("total") > 0, F.col("raw_score") / F.col("total")).otherwise(0.0)).drop("total")


def incident_details(wanted: DataFrame, records: DataFrame) -> DataFrame:
    """Ranked ids (ev_id, ...) with the fields of their incidents; unknown ids are dropped. Ids are few."""
    return records.join(F.broadcast(wanted), "ev_id")


def base_probabilities(causes: DataFrame, counts: DataFrame) -> DataFrame:
    """(ev_id, cause, base_probability), 0 where a cause was not counted. A cause may have a large share of all rows."""
    heavy = heavy_keys(causes.groupBy("cause").agg(F.count("*").alias("n")), ["cause"])
    return split_join(causes, counts.select("cause", "base_probability"), ["cause"], heavy, "left").withColumn("base_probability", F.coalesce("base_probability", F.lit(0.0)))
