"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mishaplens.functions.text import clean, key
from mishaplens.llm import frequency, mixing, names, neighbours, packing, pairs, subsequences, truncation
from mishaplens.llm.tokens import with_token_counts
from mishaplens.session import stage
from mishaplens.sources.tables import table


# Problem 2


def _causal_baskets(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings")
    f = f.filter(F.upper(F.trim("cause_factor")).isin("C", "F"))
    return f.select(key(F.col("ev_id")).alias("basket"), clean(F.col("finding_description")).alias("item"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.item_pairs(_causal_baskets(spark, d), min_support=5, min_share=2000, min_lift=3).select("item_a", "item_b")


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pair_report(spark, d, 5)


def p2_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pair_report(spark, d, 1)


def _pair_report(spark: SparkSession, d: str, min_support: int) -> DataFrame:
    out = pairs.item_pairs(_causal_baskets(spark, d), min_support=min_support)
    return out.select("item_a", "item_b", "n_a", "n_b", "n_ab", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


# Problem 3


def _described(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for t, c in (("findings", "finding_description"), ("events_sequence", "occurrence_description")):
        part = table(spark, d, t).select(F.lit(c).alias("field_label"), key(F.col("ev_id")).alias("record"), clean(F.col(c)).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    marks = frequency.marked(frequency.token_frequencies(_described(spark, d)))
    return marks.filter(F.col("mark").isNotNull()).select("field_label", "unit_label", "token", "mark")


def p3_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return frequency.marked(frequency.token_frequencies(_described(spark, d))).drop("n_records")


# Problem 4


def _chains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events_sequence").select(
        key(F.col("ev_id")).alias("sequence"), F.col("occurrence_no").alias("place_1"), F.col("phase_no").alias("place_2"), clean(F.col("occurrence_description")).alias("item")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return subsequences.frequent_subsequences(_chains(spark, d)).select("step_1", "step_2", "step_3")


def p4_patterns(spark: SparkSession, d: str) -> DataFrame:
    return subsequences.frequent_subsequences(_chains(spark, d)).drop("n_sequences")


# Problem 5


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    owners = table(spark, d, "embeddings_map").select("entry_id", key(F.col("ev_id")).alias("owner"))
    return table(spark, d, "entry_vectors"), owners


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.nearest_neighbours(*_vectors(spark, d), min_cosine=0.9)
    return n.select(F.least("entry_id", "neighbour_id").alias("entry_id_a"), F.greatest("entry_id", "neighbour_id").alias("entry_id_b")).distinct()


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    n = neighbours.nearest_neighbours(*_vectors(spark, d), margin=5.0)
    return n.select("entry_id", "neighbour_id", F.round("cosine", 3).alias("cosine"), "place")


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether p5_neighbours gives 0.9 or more of the places that a comparison with all entries gives, for entries whose id is divisible by 50."""
    vectors, owners = _vectors(spark, d)
    true = neighbours.exact_neighbours(vectors, owners)
    found = p5_neighbours(spark, d).filter(F.col("entry_id") % 50 == 0).select("entry_id", "neighbour_id", F.lit(True).alias("hit"))
    both = true.join(found, ["entry_id", "neighbour_id"], "left")
    return both.agg(F.countDistinct("entry_id").alias("n_queries"), (F.count_if("hit") >= 0.9 * F.count("*")).alias("recall_reached"))


# Problem 6

# The columns with names, by what they name.
_NAMED = (("maker", names.Reference, (("acft_make", "aircraft"), ("eng_mfgr", "engines"))), ("model", names.ModelReference, (("acft_model", "aircraft"),)))


def p6_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Columns that name the same kind of item are attributed together, so that what is learned from one holds for the other."""
    out = None
    for ref_field, kind, columns in _NAMED:
        typed = None
        for field, t in columns:
            part = table(spark, d, t).select(F.lit(field).alias("name_field"), F.col(field).alias("spelling"))
            typed = part if typed is None else typed.unionByName(part)
        found = names.attributed(typed, table(spark, d, "name_reference"), ref_field, kind).select("spelling", "ref_id", "ref_label")
        counted = typed.filter(F.col("spelling").isNotNull()).groupBy("name_field", "spelling").agg(F.count("*").alias("n_rows"))
        part = counted.join(found, "spelling").select("name_field", "spelling", "n_rows", "ref_id", "ref_label")
        out = part if out is None else out.unionByName(part)
    return out


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_spellings(spark, d).filter(F.col("spelling") != F.col("ref_label")).select("name_field", "spelling", "ref_id")


# Problems 8 and 9


def _token_sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", "text")
    return stage(with_token_counts(docs, out="size").select("item_id", "source", "size"), "token_sizes")


def _capacities(spark: SparkSession, d: str) -> dict[str, int]:
    return {r.limit_label: r.capacity_tokens for r in table(spark, d, "pack_limits").collect()}


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    out = packing.pack(_token_sizes(spark, d), _capacities(spark, d))
    return out.select("limit_label", F.col("item_id").alias("doc_id"), "piece_no", F.col("start").alias("first_token"), F.col("size").alias("n_tokens"), "bin_no")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    caps = _capacities(spark, d)
    per_bin = packing.pack(_token_sizes(spark, d), caps).groupBy("limit_label", "bin_no").agg(F.sum("size").alias("used"), F.count("*").alias("n_pieces"))
    limits = F.broadcast(table(spark, d, "pack_limits"))
    return per_bin.join(limits, "limit_label").groupBy("limit_label", "capacity_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("n_pieces").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        F.sum(F.col("capacity_tokens") - F.col("used")).alias("unused_tokens"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_possible"),
    )


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per limit: texts packed, texts whose pieces do not make them up, texts cut though they fit, containers above capacity, and gaps in their numbers."""
    sizes, caps = _token_sizes(spark, d), _capacities(spark, d)
    packed = stage(packing.pack(sizes, caps), "packed")
    per_item = packed.groupBy("limit_label", "item_id").agg(F.sum("size").alias("used"), F.count("*").alias("n_pieces"))
    limits = F.broadcast(table(spark, d, "pack_limits"))
    items = per_item.join(sizes, "item_id").join(limits, "limit_label").groupBy("limit_label").agg(
        F.count("*").alias("n_texts"),
        F.count_if(F.col("used") != F.col("size")).alias("n_not_whole"),
        F.count_if((F.col("n_pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("n_cut"),
    )
    bins = packed.groupBy("limit_label", "bin_no").agg(F.sum("size").alias("used")).join(limits, "limit_label").groupBy("limit_label").agg(
        F.count_if(F.col("used") > F.col("capacity_tokens")).alias("n_too_full"), (F.max("bin_no") - F.count("*")).alias("n_gaps")
    )
    return items.join(bins, "limit_label")


def p9_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts of another source, repeated above the cap or given twice; whether use and shares reported are those of the texts; and whether the target is within 0.005, unless the source is exhausted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("source").alias("own"))
    chosen, shares = _mix(spark, d)
    chosen = stage(chosen, "chosen")
    facts = chosen.join(docs, "item_id").groupBy("source").agg(
        F.count_if(F.col("own") != F.col("source")).alias("n_foreign"), (F.count("*") - F.countDistinct("item_id")).alias("n_twice"), F.sum(F.col("size") * F.col("repeats")).alias("sum_used"), F.max("repeats").alias("most")
    )
    total = F.broadcast(chosen.agg(F.sum(F.col("size") * F.col("repeats")).alias("all_used")))
    out = shares.join(facts, "source", "left").join(total).na.fill(0, ["n_foreign", "n_twice", "sum_used", "most"])
    spent = F.col("used") >= 0.99 * F.col("available") * F.col("max_repeats")
    return out.select(
        "source", "n_foreign", "n_twice", (F.col("most") <= F.col("max_repeats")).alias("within_cap"),
        ((F.col("used") == F.col("sum_used")) & (F.abs(F.col("reached_share") - F.col("sum_used") / F.col("all_used")) < 1e-9)).alias("as_reported"),
        (spent | (F.abs(F.col("reached_share") - F.col("target_share")) <= 0.005)).alias("on_target"),
    )


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(_token_sizes(spark, d), table(spark, d, "source_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].select(F.col("item_id").alias("doc_id"), "source", F.col("size").alias("n_tokens"), "repeats")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


# Problem 10


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "source", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.judged_texts(_texts(spark, d)).filter("truncated").select(F.col("item_id").alias("doc_id"))


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncation_report(_texts(spark, d))


def p10_audit(spark: SparkSession, d: str) -> DataFrame:
    """Per source: texts judged, each once, and texts that end in a full stop behind a letter and count as cut all the same."""
    j = truncation.judged_texts(_texts(spark, d)).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text"), "item_id")
    closed = F.col("truncated") & F.col("text").rlike("[a-z]\\.\\z")
    return j.groupBy("source").agg(F.count("*").alias("n_judged"), F.countDistinct("item_id").alias("n_texts"), F.count_if(closed).alias("n_closed_cut"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_all_pairs": p2_all_pairs,
    "p3_found": p3_found,
    "p3_frequencies": p3_frequencies,
    "p4_found": p4_found,
    "p4_patterns": p4_patterns,
    "p5_found": p5_found,
    "p5_neighbours": p5_neighbours,
    "p5_recall": p5_recall,
    "p6_found": p6_found,
    "p6_spellings": p6_spellings,
    "p8_packed": p8_packed,
    "p8_containers": p8_containers,
    "p8_audit": p8_audit,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p9_audit": p9_audit,
    "p10_found": p10_found,
    "p10_report": p10_report,
    "p10_audit": p10_audit,
}


def _clean_sql(c: str) -> str:
    v = f"trim(regexp_replace(lower({c}), '[ \\t]+', ' ', 'g'), ' ')"
    return f"CASE WHEN {v} NOT IN ('', 'null', 'none', 'nan') THEN {v} END"


_KEY = "nullif(upper(trim(ev_id, ' ')), '')"

_P2 = f"""
WITH inc AS (
  SELECT DISTINCT {_KEY} AS k, {_clean_sql('finding_description')} AS v FROM findings WHERE upper(trim(cause_factor, ' ')) IN ('C', 'F')
), g AS (SELECT k, v FROM inc WHERE k IS NOT NULL AND v IS NOT NULL),
n AS (SELECT v, count(*) AS n FROM g GROUP BY 1),
total AS (SELECT count(DISTINCT k) AS n_baskets FROM g),
ab AS (SELECT x.v AS item_a, y.v AS item_b, count(*) AS n_ab FROM g x JOIN g y ON x.k = y.k AND x.v < y.v GROUP BY 1, 2 HAVING count(*) >= 5),
p AS (
  SELECT ab.*, na.n AS n_a, nb.n AS n_b, n_baskets FROM ab JOIN n na ON item_a = na.v JOIN n nb ON item_b = nb.v, total
)
"""

_P3 = f"""
WITH raw AS (
  SELECT 'finding_description' AS field_label, {_KEY} AS k, {_clean_sql('finding_description')} AS v FROM findings
  UNION ALL SELECT 'occurrence_description', {_KEY}, {_clean_sql('occurrence_description')} FROM events_sequence
), g AS (SELECT * FROM raw WHERE k IS NOT NULL AND v IS NOT NULL),
tokens AS (
  SELECT field_label, k, 'value' AS unit_label, v AS token FROM g
  UNION ALL SELECT field_label, k, 'term', unnest(regexp_extract_all(v, '[a-z0-9]+')) FROM g
), total AS (SELECT field_label, count(DISTINCT k) AS t FROM g GROUP BY 1),
f AS (
  SELECT field_label, unit_label, token, count(*) AS occurrences, count(DISTINCT k) AS records FROM tokens GROUP BY 1, 2, 3
), m AS (
  SELECT f.*, CASE WHEN 10 * records >= t THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM f JOIN total USING (field_label)
)
"""

_P4 = f"""
WITH raw AS (
  SELECT DISTINCT {_KEY} AS k, occurrence_no AS o, coalesce(phase_no, '') AS p, {_clean_sql('occurrence_description')} AS v FROM events_sequence
), s AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY o, p, v) AS i FROM raw WHERE k IS NOT NULL AND o IS NOT NULL AND v IS NOT NULL
), t AS (
  SELECT a.v AS step_1, b.v AS step_2, c.v AS step_3, count(DISTINCT a.k) AS support
  FROM s a JOIN s b ON a.k = b.k AND a.i < b.i JOIN s c ON b.k = c.k AND b.i < c.i GROUP BY 1, 2, 3
), f AS (SELECT * FROM t WHERE support >= 3 AND 400 * support >= (SELECT count(DISTINCT k) FROM s))
"""

_P5 = f"""
WITH v AS (
  SELECT entry_id, min(embedding)::DOUBLE[] AS e FROM entry_vectors
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY 1
), o AS (SELECT entry_id, min({_KEY}) AS k FROM embeddings_map GROUP BY 1),
w AS (SELECT v.entry_id, e, k FROM v LEFT JOIN o USING (entry_id)),
c AS (
  SELECT a.entry_id AS a, b.entry_id AS b, list_cosine_similarity(a.e, b.e) AS s
  FROM w a JOIN w b ON a.entry_id <> b.entry_id AND (a.k IS NULL OR b.k IS NULL OR a.k <> b.k)
), n AS (SELECT a, b, s FROM c QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
"""

SQL = {
    "p2_found": _P2 + "SELECT item_a, item_b FROM p WHERE 2000 * n_ab >= n_baskets AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p2_pairs": _P2 + """SELECT item_a, item_b, n_a, n_b, n_ab, round(n_ab * n_baskets / (n_a::DOUBLE * n_b), 6) AS lift,
      round(ln(n_ab * n_baskets / (n_a::DOUBLE * n_b)), 6) AS pmi FROM p""",
    "p2_all_pairs": _P2.replace(" HAVING count(*) >= 5", "") + """SELECT item_a, item_b, n_a, n_b, n_ab, round(n_ab * n_baskets / (n_a::DOUBLE * n_b), 6) AS lift,
      round(ln(n_ab * n_baskets / (n_a::DOUBLE * n_b)), 6) AS pmi FROM p""",
    "p3_found": _P3 + "SELECT field_label, unit_label, token, mark FROM m WHERE mark IS NOT NULL",
    "p3_frequencies": _P3 + "SELECT field_label, unit_label, token, occurrences, records, mark FROM m",
    "p4_found": _P4 + "SELECT step_1, step_2, step_3 FROM f",
    "p5_found": _P5 + "SELECT DISTINCT least(a, b) AS entry_id_a, greatest(a, b) AS entry_id_b FROM n WHERE s >= 0.9",
    "p5_recall": """SELECT count(DISTINCT entry_id) AS n_queries, true AS recall_reached FROM entry_vectors
      WHERE entry_id % 50 = 0 AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "p8_audit": "SELECT limit_label, (SELECT count(*) FROM documents) AS n_texts, 0::BIGINT AS n_not_whole, 0::BIGINT AS n_cut, 0::BIGINT AS n_too_full, 0::BIGINT AS n_gaps FROM pack_limits",
    "p9_audit": "SELECT source, 0::BIGINT AS n_foreign, 0::BIGINT AS n_twice, true AS within_cap, true AS as_reported, true AS on_target FROM source_targets",
    "p10_audit": "SELECT source, count(*) AS n_judged, count(*) AS n_texts, 0::BIGINT AS n_closed_cut FROM documents WHERE regexp_matches(text, '[^\\s]') GROUP BY 1",
    "p4_patterns": _P4 + "SELECT step_1, step_2, step_3, support FROM f",
}
