"""Queries over incidents, entries, causes, chains and vectors, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mishaplens.functions import text as T
from mishaplens.functions.vectors import cosine, dot, norm
from mishaplens.operators import causes, chains, entries, incidents, profile, retrieval
from mishaplens.operators.groups import first_per_key, grouped_records
from mishaplens.operators.incidents import AIRCRAFT_COLUMNS, EVENT_COLUMNS, FINDING_COLUMNS, NARRATIVE_COLUMNS, child_rows, first_rows, keyed
from mishaplens.sources.tables import select_or_null, select_where, table

DIM, TOP = 64, 50
QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL it is checked against."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- shared SQL

_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 8232, 8233, 12288, 5760, *range(8192, 8203), 8239, 8287]))
_KEY = "nullif(upper(trim(ev_id, ' ')), '')"


def _strip_sql(c: str) -> str:
    return f"trim({c}, '{_SPACE}')"


def _clean_sql(c: str) -> str:
    kept = f"CASE WHEN {c} NOT IN ('null', 'None') THEN {c} END"
    return f"nullif(replace({_strip_sql(kept)}, chr(0), ''), '')"


def _first_sql(t: str, columns) -> str:
    order = ", ".join(f"{c} NULLS FIRST" for c in columns)
    return f"SELECT * REPLACE (k AS ev_id) FROM (SELECT *, {_KEY} AS k FROM {t}) WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY lchg_date NULLS LAST, {order}) = 1"


def _child_sql(t: str, columns) -> str:
    return f"SELECT DISTINCT {_KEY} AS ev_id, {', '.join(columns)} FROM {t} WHERE {_KEY} IS NOT NULL"


_INDICATORS = "|".join(T.CAUSE_INDICATORS)


def _sentences_sql(c: str) -> str:
    parts = f"list_transform(string_split_regex({c}, '[.!?]'), lambda s: {_strip_sql('s')})"
    hits = f"list_filter({parts}, lambda s: length(s) >= 15 AND regexp_matches(lower(s), '{_INDICATORS}'))"
    return (
        f"CASE WHEN length({_strip_sql(c)}) >= 10 THEN list_transform(CASE WHEN len({hits}) > 0 THEN {hits} ELSE list_filter({parts}[1:1], lambda s: length(s) >= 15) END, lambda s: s[1:100]) ELSE [] END"
    )


_CTES = {
    "ev": _first_sql("incident_events", EVENT_COLUMNS),
    "ac": _first_sql("aircraft", AIRCRAFT_COLUMNS),
    "na": _first_sql("narratives", NARRATIVE_COLUMNS),
    "fi": _child_sql("findings", FINDING_COLUMNS),
    "en": _child_sql("engines", incidents.ENGINE_COLUMNS),
    "sq": _child_sql("events_sequence", chains.CHAIN),
    "occ": f"""SELECT o.* FROM (
      SELECT ev_id, finding_description AS cause, 'structured' AS kind FROM fi WHERE {_strip_sql('cause_factor')} = 'C'
      UNION ALL SELECT ev_id, unnest({_sentences_sql('narr_cause')}) AS cause, 'narrative' AS kind FROM na WHERE narr_cause IS NOT NULL
    ) o WHERE ev_id IN (SELECT ev_id FROM ev)""",
    "cnt": """SELECT cause, count(*) FILTER (WHERE kind = 'structured') AS n_structured, count(*) FILTER (WHERE kind = 'narrative') AS n_narrative, count(*) AS n_combined,
      count(DISTINCT ev_id) AS n_distinct_incidents, count(*) / (SELECT count(*) FROM ev)::DOUBLE AS base_probability FROM occ GROUP BY 1""",
    "ic": "SELECT DISTINCT ev_id, cause FROM occ WHERE cause <> ''",
    "entry": f"SELECT entry_id, min(source) AS source, min({_KEY}) AS ev_id FROM embeddings_map WHERE entry_id IS NOT NULL GROUP BY 1",
    "vec": f"""SELECT entry_id, min(embedding)::DOUBLE[] AS e FROM entry_vectors WHERE entry_id IS NOT NULL AND len(embedding) = {DIM}
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1""",
    "q": "SELECT row_number() OVER (ORDER BY entry_id) - 1 AS query_id, e AS qe FROM (SELECT * FROM vec ORDER BY entry_id LIMIT 5)",
    "sc": "SELECT query_id, entry_id, list_cosine_similarity(e, qe) AS score FROM vec, q",
    "rk": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id DESC) AS rank FROM sc QUALIFY rank <= {TOP}",
    "ev_pairs": "SELECT rk.*, ic.ev_id, cause FROM rk JOIN entry ON rk.entry_id = entry.entry_id AND source = 'incident' AND ev_id IS NOT NULL JOIN ic ON ic.ev_id = entry.ev_id",
    "dg": """SELECT query_id, cause, sum(score) AS raw_score, count(*) AS num_incidents, array_to_string(list(ev_id ORDER BY rank, ev_id)[1:5], ', ') AS supporting, min(rank) AS first_rank,
      CASE WHEN sum(sum(score)) OVER (PARTITION BY query_id) > 0 THEN sum(score) / sum(sum(score)) OVER (PARTITION BY query_id) ELSE 0 END AS probability FROM ev_pairs GROUP BY 1, 2""",
    "pos": "SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY occurrence_no NULLS LAST, occurrence_code NULLS FIRST, occurrence_description NULLS FIRST, phase_no NULLS FIRST, defining_ev NULLS FIRST) - 1 AS position FROM sq",
    "edge": "SELECT * FROM (SELECT ev_id, position AS i, occurrence_description AS event, lead(occurrence_description) OVER w AS next_event, lead(position) OVER w AS nx FROM pos WINDOW w AS (PARTITION BY ev_id ORDER BY position)) WHERE nx IS NOT NULL",
    "fl": """SELECT ev.ev_id, coalesce(length(na.narr_cause) > 0, false) AS has_cause, coalesce(length(na.narr_accf) > 0, false) AS has_factual, coalesce(nf, 0) AS n_findings, coalesce(ns, 0) AS n_sequence
      FROM ev LEFT JOIN na USING (ev_id) LEFT JOIN (SELECT ev_id, count(*) AS nf FROM fi GROUP BY 1) USING (ev_id) LEFT JOIN (SELECT ev_id, count(*) AS ns FROM sq GROUP BY 1) USING (ev_id)""",
}
_NEEDS = {
    "occ": ("fi", "na", "ev"), "cnt": ("occ",), "ic": ("occ",), "q": ("vec",), "sc": ("q",), "rk": ("sc",), "ev_pairs": ("rk", "entry", "ic"), "dg": ("ev_pairs",), "pos": ("sq",), "edge": ("pos",), "fl": ("ev", "na", "fi", "sq"),
}


def _with(names: str, body: str) -> str:
    done: list[str] = []

    def add(n):
        for m in _NEEDS.get(n, ()):
            add(m)
        if n not in done:
            done.append(n)

    for n in names.split():
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({_CTES[n]})" for n in done) + "\n" + body


# ------------------------------------------------------------ shared inputs


def _events(s, d):
    return first_rows(table(s, d, "incident_events"), EVENT_COLUMNS)


def _narratives(s, d):
    return first_rows(table(s, d, "narratives"), NARRATIVE_COLUMNS)


def _findings(s, d):
    return child_rows(table(s, d, "findings"), FINDING_COLUMNS)


def _known(s, d):
    return keyed(table(s, d, "incident_events")).select("ev_id").distinct()


def _n_incidents(s, d):
    return _known(s, d).agg(F.count("*").alias("n_incidents"))


def _occurrences(s, d):
    return causes.combined_causes(table(s, d, "findings"), table(s, d, "narratives"), _known(s, d))


def _counts(s, d):
    return causes.cause_counts(_occurrences(s, d), _n_incidents(s, d))


def _entries(s, d):
    return entries.mapped_entries(table(s, d, "embeddings_map"))


def _vectors(s, d):
    return retrieval.usable(table(s, d, "entry_vectors"), DIM)


def _query_vectors(s, d, n):
    """The vectors of the first entries stand in for embedded query texts."""
    rows = retrieval.usable_rows(table(s, d, "entry_vectors"), DIM).orderBy("entry_id", "embedding")
    found, m, got = {}, 4 * n, None
    while got is None or len(found) < n and len(got) == m:  # further rows if entries repeat
        m = m if got is None else 8 * m
        got = rows.limit(m).collect()
        for r in got:
            found.setdefault(r.entry_id, list(r.embedding))
    return dict(enumerate(list(found.values())[:n]))


def _scores(s, d, n=1):
    return retrieval.scored(table(s, d, "entry_vectors"), _query_vectors(s, d, n))


def _best(s, d, n=1):
    return retrieval.top_scored(table(s, d, "entry_vectors"), _query_vectors(s, d, n), TOP)


def _top(s, d):
    return retrieval.top_entries(_best(s, d), TOP)


def _pairs(s, d, top=None):
    ranked = retrieval.ranked_incidents(_top(s, d) if top is None else top, table(s, d, "embeddings_map"))
    return retrieval.evidence(ranked, *[table(s, d, t) for t in ("findings", "narratives", "incident_events")])


def _flags(s, d):
    seq = chains.chain_rows(table(s, d, "events_sequence"))
    return profile.incident_flags(_events(s, d), _narratives(s, d), _findings(s, d), seq)


def _r(*names):
    return [F.round(n, 6).alias(n) for n in names]


# --------------------------------------------------------------- incidents


@query(_with("ev", "SELECT ev_id, ev_city, ev_state, ev_time FROM ev"))
def dedup_first(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).select("ev_id", "ev_city", "ev_state", "ev_time")


@query(_with("ev ac", """SELECT ev.ev_id, coalesce(acft_make, 'Unknown') AS acft_make, coalesce(acft_model, 'Unknown') AS acft_model, coalesce(light_cond, 'Unknown') AS light_cond,
  coalesce(wx_cond_basic, 'Unknown') AS wx_cond_basic FROM ev LEFT JOIN ac USING (ev_id)"""))
def fill_unknown(s: SparkSession, d: str) -> DataFrame:
    j = _events(s, d).join(first_rows(table(s, d, "aircraft"), AIRCRAFT_COLUMNS), "ev_id", "left")
    return j.na.fill("Unknown", list(incidents.UNKNOWN_TEXT)).select("ev_id", *incidents.UNKNOWN_TEXT)


@query("SELECT ev_id, eng_no, NULL::VARCHAR AS eng_colour, eng_model FROM engines")
def select_or_null_columns(s: SparkSession, d: str) -> DataFrame:
    return select_or_null(table(s, d, "engines"), {"ev_id": "string", "eng_no": "int", "eng_colour": "string", "eng_model": "string"})


@query("SELECT * EXCLUDE (lchg_date) FROM events_sequence")
def columns_by_name(s: SparkSession, d: str) -> DataFrame:
    return select_where(table(s, d, "events_sequence"), lambda c: "lchg" not in c)


@query(_with("ev", """SELECT ev_id, strftime(ev_date, '%Y-%m-%dT%H:%M:%S') AS ev_date, CASE WHEN lower(ev_time) <> 'nan' THEN ev_time END AS ev_time,
  CASE WHEN NOT isnan(vis_sm) THEN vis_sm END AS vis_sm FROM ev"""))
def iso_dates(s: SparkSession, d: str) -> DataFrame:
    return incidents.json_ready(_events(s, d)).select("ev_id", "ev_date", "ev_time", "vis_sm")


@query(_with("fi", """SELECT ev_id, (position // 500)::INT AS part_no, count(*) AS n, string_agg(coalesce(finding_description, '-'), ' | ' ORDER BY position) AS texts FROM (
  SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY finding_no NULLS LAST, finding_description NULLS FIRST, cause_factor NULLS FIRST) - 1 AS position FROM fi) GROUP BY 1, 2"""))
def group_findings(s: SparkSession, d: str) -> DataFrame:
    large = incidents.crowded(table(s, d, "findings"))
    g = grouped_records(_findings(s, d), "ev_id", ["finding_no"], "f", chunk=500, large=large)
    texts = F.array_join(F.transform("f", lambda x: F.coalesce(x["finding_description"], F.lit("-"))), " | ")
    return g.select("ev_id", "part_no", F.size("f").cast("bigint").alias("n"), texts.alias("texts"))


def _records(s, d):
    return incidents.incident_records(*[table(s, d, t) for t in ("incident_events", "narratives", "aircraft", "events_sequence", "findings", "engines")])


@query(_with("ev na ac fi sq en", """, parts AS (
  SELECT ev_id, 0 AS part_no FROM ev UNION SELECT ev_id, (unnest(range(0, n, 1000)) // 1000)::INT FROM (
    SELECT ev_id, count(*) AS n FROM fi WHERE ev_id IN (SELECT ev_id FROM ev) GROUP BY 1 UNION ALL SELECT ev_id, count(*) FROM sq WHERE ev_id IN (SELECT ev_id FROM ev) GROUP BY 1 UNION ALL SELECT ev_id, count(*) FROM en WHERE ev_id IN (SELECT ev_id FROM ev) GROUP BY 1)
), sz AS (SELECT p.*, least(1000, greatest(0, coalesce(f.n, 0) - 1000 * part_no)) AS n_findings, least(1000, greatest(0, coalesce(q.n, 0) - 1000 * part_no)) AS n_sequence, least(1000, greatest(0, coalesce(e.n, 0) - 1000 * part_no)) AS n_engines
  FROM parts p LEFT JOIN (SELECT ev_id, count(*) AS n FROM fi GROUP BY 1) f USING (ev_id) LEFT JOIN (SELECT ev_id, count(*) AS n FROM sq2 GROUP BY 1) q USING (ev_id) LEFT JOIN (SELECT ev_id, count(*) AS n FROM en GROUP BY 1) e USING (ev_id))
SELECT sz.ev_id, part_no, n_sequence, n_findings, n_engines, 0 AS n_injuries, ev_city, narr_cause, coalesce(acft_make, 'Unknown') AS acft_make FROM sz JOIN ev USING (ev_id) LEFT JOIN na USING (ev_id) LEFT JOIN ac USING (ev_id)""".replace("sq2", "sq")).replace("\n, parts AS", ",\nparts AS"))
def incident_merge(s: SparkSession, d: str) -> DataFrame:
    sizes = [F.size(c).cast("bigint").alias(n) for c, n in (("sequence_of_events", "n_sequence"), ("findings", "n_findings"), ("engines", "n_engines"))]
    return _records(s, d).select("ev_id", "part_no", *sizes, F.size("injuries").alias("n_injuries"), "ev_city", "narr_cause", "acft_make")


@query()
def incident_documents(s: SparkSession, d: str) -> DataFrame:
    return incidents.as_json(incidents.json_ready(_records(s, d)))


@query(_with("ev na fi", """SELECT ev_id, ev_city, strftime(ev_date, '%Y-%m-%dT%H:%M:%S') AS ev_date, narr_cause, least(1000, count(fi.ev_id)) AS n_findings FROM ev LEFT JOIN na USING (ev_id) LEFT JOIN fi USING (ev_id) GROUP BY 1, 2, 3, 4"""))
def document_fields(s: SparkSession, d: str) -> DataFrame:
    doc = incident_documents(s, d).select("ev_id", *[F.get_json_object("json", f"$.{c}").alias(c) for c in ("ev_city", "ev_date", "narr_cause", "part_no")], F.json_array_length(F.get_json_object("json", "$.findings")).cast("bigint").alias("n_findings"))
    return doc.filter("part_no = '0'").drop("part_no")


@query(_with("ev na", "SELECT ev_id, ev_city, narr_cause FROM ev LEFT JOIN na USING (ev_id) ORDER BY ev_id LIMIT 3"))
def first_samples(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).join(_narratives(s, d), "ev_id", "left").orderBy("ev_id").limit(3).select("ev_id", "ev_city", "narr_cause")


# ----------------------------------------------------------------- entries


@query(f"SELECT ev_id, {_clean_sql('narr_cause')} AS narr_cause, replace(narr_accf, chr(10), ' ') AS one_line FROM narratives")
def clean_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "narratives").select("ev_id", T.clean_narrative(F.col("narr_cause")).alias("narr_cause"), T.one_line(F.col("narr_accf")).alias("one_line"))


_ENTRIES = f"""t AS (SELECT ev_id, {_clean_sql('narr_cause')} AS a, {_clean_sql('narr_accf')} AS b, {_clean_sql('narr_accp')} AS c FROM na),
ent AS (
  SELECT 'incident' AS source, ev_id, 'causal_narrative' AS entry_type, NULL::INT AS finding_no, a AS text FROM t WHERE a IS NOT NULL
  UNION ALL SELECT 'incident', ev_id, 'factual_narrative', NULL, b FROM t WHERE b IS NOT NULL
  UNION ALL SELECT 'incident', ev_id, 'fallback_narrative', NULL, c FROM t WHERE a IS NULL AND b IS NULL AND c IS NOT NULL
  UNION ALL SELECT 'incident', ev_id, 'finding', finding_no, {_clean_sql('finding_description')} FROM fi WHERE {_clean_sql('finding_description')} IS NOT NULL
)
"""


def _texts(s, d):
    return entries.incident_entries(table(s, d, "narratives"), table(s, d, "findings"), _known(s, d))


@query(_with("na fi ev", "").rstrip() + ",\n" + _ENTRIES + "SELECT * FROM ent WHERE ev_id IN (SELECT ev_id FROM ev)")
def entries_explode(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d)


@query(_with("na fi ev", "").rstrip() + ",\n" + _ENTRIES + f"""SELECT source, ev_id, entry_type, finding_no, text, NULL::VARCHAR AS code FROM ent WHERE ev_id IN (SELECT ev_id FROM ev)
  UNION ALL SELECT DISTINCT 'dictionary', NULL, NULL, NULL::INT, {_clean_sql('text')}, code FROM embeddings_map WHERE source = 'dictionary' AND {_clean_sql('text')} IS NOT NULL""")
def entries_union(s: SparkSession, d: str) -> DataFrame:
    dictionary = table(s, d, "embeddings_map").filter("source = 'dictionary'").select("code", F.col("text").alias("meaning"))
    return entries.all_entries(_texts(s, d), entries.dictionary_entries(dictionary))


@query(_with("na", f"SELECT ev_id, unnest({_sentences_sql('narr_cause')}) AS cause FROM na WHERE narr_cause IS NOT NULL"))
def cause_extract(s: SparkSession, d: str) -> DataFrame:
    return causes.narrative_causes(table(s, d, "narratives"))


@query(_with("entry ev", "SELECT count(*) FILTER (WHERE ev.ev_id IS NOT NULL) AS augmented, count(*) FILTER (WHERE ev.ev_id IS NULL) AS skipped FROM entry LEFT JOIN ev USING (ev_id) WHERE source = 'incident'"))
def skip_counts(s: SparkSession, d: str) -> DataFrame:
    return entries.known_and_skipped(_entries(s, d), _known(s, d))


# ------------------------------------------------------------------ causes


@query(_with("fi", f"""SELECT ev_id, (position // 1000)::INT AS part_no, count(*)::INT AS n_findings, string_agg(coalesce(finding_description, '-'), ' | ' ORDER BY position) AS findings,
  string_agg(coalesce(cause_factor, '-'), ' | ' ORDER BY position) AS cause_factors, coalesce(string_agg(coalesce(finding_description, '-'), ' | ' ORDER BY position) FILTER (WHERE {_strip_sql('cause_factor')} = 'C'), '') AS causal_findings FROM (
  SELECT *, row_number() OVER (PARTITION BY ev_id ORDER BY finding_no NULLS LAST, finding_description NULLS FIRST, cause_factor NULLS FIRST) - 1 AS position FROM fi) GROUP BY 1, 2"""))
def finding_arrays(s: SparkSession, d: str) -> DataFrame:
    joined = [F.array_join(c, " | ", "-").alias(c) for c in ("findings", "cause_factors", "causal_findings")]
    return causes.finding_arrays(table(s, d, "findings")).select("ev_id", "part_no", F.size("findings").alias("n_findings"), *joined)


@query(_with("fi", f"""SELECT finding_description AS cause, count(*) AS n_all, count(*) FILTER (WHERE {_strip_sql('cause_factor')} = 'C') AS n_causal FROM fi GROUP BY 1"""))
def cause_counts_structured(s: SparkSession, d: str) -> DataFrame:
    f = _findings(s, d).withColumn("causal", F.coalesce(T.strip(F.col("cause_factor")) == "C", F.lit(False)))
    return f.groupBy(F.col("finding_description").alias("cause")).agg(F.count("*").alias("n_all"), F.count_if("causal").alias("n_causal"))


@query(_with("cnt", "SELECT * REPLACE (round(base_probability, 6) AS base_probability) FROM cnt"))
def cause_counts_combined(s: SparkSession, d: str) -> DataFrame:
    return _counts(s, d).withColumn("base_probability", F.round("base_probability", 6))


@query(_with("cnt", "SELECT cause, round(base_probability, 6) AS base_probability FROM cnt ORDER BY n_combined DESC, cause NULLS LAST LIMIT 10"))
def top_base_probabilities(s: SparkSession, d: str) -> DataFrame:
    return _counts(s, d).orderBy(F.desc("n_combined"), F.asc_nulls_last("cause")).limit(10).select("cause", *_r("base_probability"))


@query(_with("occ ev", """, f AS (SELECT ev.ev_id, coalesce(s, false) AS s, coalesce(n, false) AS n FROM ev LEFT JOIN (SELECT ev_id, bool_or(kind = 'structured') AS s, bool_or(kind = 'narrative') AS n FROM occ GROUP BY 1) USING (ev_id))
SELECT count(*) AS n_incidents, count(*) FILTER (WHERE s AND NOT n) AS structured_only, count(*) FILTER (WHERE n AND NOT s) AS narrative_only, count(*) FILTER (WHERE s AND n) AS both, count(*) FILTER (WHERE s OR n) AS any_kind,
  round(count(*) FILTER (WHERE s OR n) * 100.0::DOUBLE / count(*), 6) AS any_percent FROM f""").replace("\n, f AS", ",\nf AS"))
def coverage(s: SparkSession, d: str) -> DataFrame:
    return causes.coverage(_known(s, d), _occurrences(s, d))


@query(_with("entry ic", "SELECT entry_id, count(cause) AS n_causes, count(cause) > 0 AS has_diagnostic_data FROM entry LEFT JOIN ic USING (ev_id) WHERE source = 'incident' GROUP BY 1"))
def entry_causes(s: SparkSession, d: str) -> DataFrame:
    per = causes.incident_causes(_occurrences(s, d)).groupBy("ev_id").agg(F.count("*").alias("n_causes"))
    e = _entries(s, d).filter("source = 'incident'").join(per, "ev_id", "left").select("entry_id", F.coalesce("n_causes", F.lit(0).cast("bigint")).alias("n_causes"))
    return e.withColumn("has_diagnostic_data", F.col("n_causes") > 0)


@query(_with("ic cnt", "SELECT ev_id, ic.cause, round(coalesce(base_probability, 0), 6) AS base_probability FROM ic LEFT JOIN cnt USING (cause)"))
def base_prob_lookup(s: SparkSession, d: str) -> DataFrame:
    return retrieval.base_probabilities(causes.incident_causes(_occurrences(s, d)), _counts(s, d)).select("ev_id", "cause", *_r("base_probability"))


@query(_with("cnt ev", """SELECT count(*) FILTER (WHERE n_structured > 0) AS unique_causes, coalesce(sum(n_structured), 0)::BIGINT AS total_causal_findings, count(*) FILTER (WHERE n_narrative > 0) AS unique_narrative_causes,
  count(*) AS unique_combined_causes, round(max(base_probability), 6) AS largest_probability, (SELECT count(*) FROM ev) AS n_incidents FROM cnt"""))
def global_stats(s: SparkSession, d: str) -> DataFrame:
    return causes.global_statistics(_counts(s, d), _n_incidents(s, d))


# ----------------------------------------------------------------- vectors


@query(_with("sc", "SELECT entry_id, round(score, 6) AS score FROM sc WHERE query_id = 0"))
def cosine_scores(s: SparkSession, d: str) -> DataFrame:
    return _scores(s, d).select("entry_id", *_r("score"))


@query(_with("vec", "SELECT entry_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM vec"))
def vector_norms(s: SparkSession, d: str) -> DataFrame:
    return _vectors(s, d).select("entry_id", F.round(norm(F.col("embedding")), 6).alias("norm"))


@query(_with("vec q", "SELECT count(*) AS n, bool_and(abs(list_cosine_similarity(e, qe) - list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe))) < 1e-6) AS agree FROM vec, q WHERE query_id = 0"))
def cosine_verify(s: SparkSession, d: str) -> DataFrame:
    q = _query_vectors(s, d, 1)
    v = _vectors(s, d)
    lit = F.array(*[F.lit(float(x)) for x in q.get(0, [])])
    e = F.col("embedding")
    one = v.select("entry_id", cosine(e, lit).alias("a"), (dot(e, lit) / norm(e) / norm(lit)).alias("b"))
    both = one.join(retrieval.scored(v, q), "entry_id")
    return both.agg(F.count("*").alias("n"), F.bool_and((F.abs(F.col("a") - F.col("b")) < 1e-6) & (F.abs(F.col("a") - F.col("score")) < 1e-6)).alias("agree"))


@query(_with("rk", "SELECT entry_id, rank, round(score, 6) AS score FROM rk WHERE query_id = 0"))
def topk_entries(s: SparkSession, d: str) -> DataFrame:
    return _top(s, d).select("entry_id", "rank", *_r("score"))


@query(_with("sc entry", "SELECT ev_id, round(max(score), 6) AS score, arg_max(entry_id, (score, entry_id)) AS best_entry_id FROM sc JOIN entry USING (entry_id) WHERE query_id = 0 AND source = 'incident' AND ev_id IS NOT NULL GROUP BY 1"))
def best_per_incident(s: SparkSession, d: str) -> DataFrame:
    return retrieval.best_per_incident(_scores(s, d), _entries(s, d)).select("ev_id", *_r("score"), "best_entry_id")


_SHOW = "cause, round(raw_score, 6) AS raw_score, round(probability, 6) AS probability, num_incidents, supporting, first_rank"


def _shown(df):
    return df.select("cause", *_r("raw_score", "probability"), "num_incidents", F.array_join("supporting", ", ").alias("supporting"), "first_rank")


@query(_with("dg", f"SELECT {_SHOW} FROM dg WHERE query_id = 0"))
def weighted_diagnosis(s: SparkSession, d: str) -> DataFrame:
    return _shown(retrieval.weighted_diagnosis(_pairs(s, d)))


@query(_with("dg", "SELECT cause, round(probability, 6) AS probability FROM dg WHERE query_id = 0 ORDER BY dg.probability DESC, first_rank, cause LIMIT 10"))
def top_causes(s: SparkSession, d: str) -> DataFrame:
    return retrieval.weighted_diagnosis(_pairs(s, d)).orderBy(F.desc("probability"), "first_rank", "cause").limit(10).select("cause", *_r("probability"))


@query(_with("ev_pairs", """SELECT cause, round(sum(score), 6) AS raw_score, round(CASE WHEN any_value(t) > 0 THEN sum(score) / any_value(t) ELSE 0 END, 6) AS probability
  FROM ev_pairs, (SELECT sum(score) AS t FROM (SELECT DISTINCT entry_id, score FROM ev_pairs WHERE query_id = 0)) WHERE query_id = 0 GROUP BY 1"""))
def weighted_diagnosis_incident(s: SparkSession, d: str) -> DataFrame:
    return retrieval.per_incident_diagnosis(_pairs(s, d)).select("cause", *_r("raw_score", "probability"))


@query(_with("rk ev_pairs", """SELECT count(DISTINCT entry_id) AS incidents_analyzed, count(DISTINCT cause) AS total_causes_found, round(coalesce(sum(score), 0), 6) AS total_similarity_weight,
  (SELECT count(*) FROM rk WHERE query_id = 0) AS entries_ranked FROM ev_pairs WHERE query_id = 0"""))
def diagnosis_metadata(s: SparkSession, d: str) -> DataFrame:
    top = _top(s, d)
    return retrieval.diagnosis_metadata(top, _pairs(s, d, top)).withColumn("total_similarity_weight", F.round("total_similarity_weight", 6))


@query(_with("dg", f"SELECT query_id, {_SHOW} FROM dg"))
def batch_diagnosis(s: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(s, d, retrieval.top_per_query(_best(s, d, 5), TOP))
    diag = retrieval.weighted_diagnosis(pairs, ["query_id"])
    return diag.select("query_id", "cause", *_r("raw_score", "probability"), "num_incidents", F.array_join("supporting", ", ").alias("supporting"), "first_rank")


_BEST = """, best AS (SELECT ev_id, max(score) AS score FROM sc JOIN entry USING (entry_id) WHERE query_id = 0 AND source = 'incident' AND ev_id IS NOT NULL GROUP BY 1 ORDER BY score DESC, ev_id LIMIT 50)
"""


def _report(s, d):
    best = retrieval.best_per_incident(_scores(s, d), _entries(s, d))
    return best.orderBy(F.desc("score"), "ev_id").limit(TOP)


@query((_with("sc entry", "").rstrip() + _BEST) + "SELECT ev_id AS EVID, 'N/A' AS findings_cause, 'N/A' AS narrative_cause, round(score, 6) AS cosine_similarity_score FROM best")
def incident_report(s: SparkSession, d: str) -> DataFrame:
    na = F.lit("N/A")
    return _report(s, d).select(F.col("ev_id").alias("EVID"), na.alias("findings_cause"), na.alias("narrative_cause"), F.round("score", 6).alias("cosine_similarity_score"))


@query((_with("sc entry ev na", "").rstrip() + _BEST) + "SELECT best.ev_id, round(score, 6) AS score, ev_city, narr_cause FROM best JOIN ev USING (ev_id) LEFT JOIN na USING (ev_id)")
def incident_details(s: SparkSession, d: str) -> DataFrame:
    records = _events(s, d).join(_narratives(s, d), "ev_id", "left")
    return retrieval.incident_details(_report(s, d), records).select("ev_id", *_r("score"), "ev_city", "narr_cause")


@query((_with("sc entry pos", "").rstrip() + _BEST) + "SELECT ev_id, count(*) AS n_events, string_agg(coalesce(occurrence_description, 'Unknown'), ' → ' ORDER BY position) AS strip FROM best JOIN pos USING (ev_id) GROUP BY 1")
def causal_chains(s: SparkSession, d: str) -> DataFrame:
    few = F.broadcast(_report(s, d).select("ev_id"))
    seq = keyed(table(s, d, "events_sequence")).join(few, "ev_id", "left_semi")
    return chains.flow_strips(seq).select("ev_id", F.col("n_events").cast("bigint").alias("n_events"), "strip")


@query(_with("dg pos", """, top AS (SELECT cause, supporting FROM dg WHERE query_id = 0 ORDER BY probability DESC, first_rank, cause LIMIT 10),
x AS (SELECT DISTINCT cause, unnest(string_split(supporting, ', ')) AS ev_id FROM top)
SELECT cause, ev_id, (position // 1000)::INT AS part_no, count(*)::INT AS n_events, string_agg(coalesce(occurrence_description, 'Unknown'), ' → ' ORDER BY position) AS strip FROM x JOIN pos USING (ev_id) GROUP BY 1, 2, 3""").replace("\n, top AS", ",\ntop AS"))
def cause_chains(s: SparkSession, d: str) -> DataFrame:
    return chains.chains_of_causes(retrieval.weighted_diagnosis(_pairs(s, d)), table(s, d, "events_sequence"))


# ------------------------------------------------------------------ chains


def _seq(s, d):
    return table(s, d, "events_sequence")


@query(_with("edge", "SELECT ev_id, i, event, next_event FROM edge"))
def chain_edges(s: SparkSession, d: str) -> DataFrame:
    return chains.chain_edges(_seq(s, d))


@query(_with("edge", """SELECT ev_id, i, '"' || ev_id || '_' || i || '"["' || coalesce(event, 'None') || '"] --> "' || ev_id || '_' || (i + 1) || '"["' || coalesce(next_event, 'None') || '"];' AS line FROM edge"""))
def mermaid_lines(s: SparkSession, d: str) -> DataFrame:
    return chains.mermaid_lines(chains.chain_edges(_seq(s, d)))


@query(_with("pos", "SELECT ev_id, (position // 1000)::INT AS part_no, count(*)::INT AS n_events, string_agg(coalesce(occurrence_description, 'Unknown'), ' → ' ORDER BY position) AS strip FROM pos GROUP BY 1, 2"))
def flow_strip(s: SparkSession, d: str) -> DataFrame:
    return chains.flow_strips(_seq(s, d))


@query(_with("edge", """SELECT count(*) AS n_events, count(DISTINCT occurrence_description) AS n_distinct, count(DISTINCT ev_id) AS n_incidents, (SELECT count(DISTINCT event) FROM edge) AS n_followed FROM sq"""))
def event_totals(s: SparkSession, d: str) -> DataFrame:
    return chains.event_totals(_seq(s, d))


@query(_with("sq", "SELECT occurrence_description AS event, count(*) AS n, round(count(*) / (SELECT count(DISTINCT ev_id) FROM sq)::DOUBLE, 6) AS per_incident FROM sq GROUP BY 1"))
def event_frequency(s: SparkSession, d: str) -> DataFrame:
    return chains.event_frequency(_seq(s, d))


_TRANS = """, tr AS (SELECT e.event, e.next_event, e.n, e.n / f.n::DOUBLE AS p FROM (SELECT event, next_event, count(*) AS n FROM edge GROUP BY 1, 2) e
  JOIN (SELECT occurrence_description AS event, count(*) AS n FROM sq GROUP BY 1) f ON e.event IS NOT DISTINCT FROM f.event)
"""


@query(_with("edge", "SELECT event, next_event, count(*) AS n FROM edge GROUP BY 1, 2"))
def transition_counts(s: SparkSession, d: str) -> DataFrame:
    return chains.chain_edges(_seq(s, d)).groupBy("event", "next_event").agg(F.count("*").alias("n"))


@query(_with("edge", "").rstrip() + _TRANS + "SELECT event, next_event, n, round(p, 6) AS p FROM tr")
def transition_probs(s: SparkSession, d: str) -> DataFrame:
    return chains.transitions(_seq(s, d)).withColumn("p", F.round("p", 6))


@query(_with("edge", "").rstrip() + _TRANS + """SELECT event, next_event, n, round(p, 6) AS p, row_number() OVER (PARTITION BY event ORDER BY n DESC, next_event NULLS FIRST) AS place FROM tr
  WHERE event IN (SELECT occurrence_description FROM sq WHERE occurrence_description IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) QUALIFY place <= 5""")
def top_followers(s: SparkSession, d: str) -> DataFrame:
    t = chains.transitions(_seq(s, d))
    return chains.top_followers(t, chains.event_frequency(_seq(s, d))).withColumn("p", F.round("p", 6))


@query(_with("sq", "SELECT ev_id, occurrence_code, CASE WHEN defining_ev = 1 THEN 'Yes' ELSE 'No' END AS defining FROM sq"))
def defining_events(s: SparkSession, d: str) -> DataFrame:
    return chains.chain_rows(_seq(s, d)).select("ev_id", "occurrence_code", F.when(F.col("defining_ev") == 1, "Yes").otherwise("No").alias("defining"))


# ----------------------------------------------------------------- profile


@query(_with("fl", """SELECT count(*) AS n_incidents, count(*) FILTER (WHERE has_cause) AS with_cause, count(*) FILTER (WHERE has_factual) AS with_factual, count(*) FILTER (WHERE has_cause OR has_factual) AS with_narrative,
  count(*) FILTER (WHERE n_findings > 0) AS with_findings, count(*) FILTER (WHERE n_sequence > 0) AS with_sequence, round(count(*) FILTER (WHERE has_cause OR has_factual) * 100::DOUBLE / count(*), 6) AS with_narrative_percent,
  round(count(*) FILTER (WHERE n_findings > 0) * 100::DOUBLE / count(*), 6) AS with_findings_percent, round(count(*) FILTER (WHERE n_sequence > 0) * 100::DOUBLE / count(*), 6) AS with_sequence_percent FROM fl"""))
def dataset_coverage(s: SparkSession, d: str) -> DataFrame:
    return profile.dataset_coverage(_flags(s, d))


@query(_with("fl", "SELECT sum(n_findings)::BIGINT AS n_findings, round(avg(n_findings), 6) AS findings_per_incident, max(n_findings) AS most_findings FROM fl"))
def findings_stats(s: SparkSession, d: str) -> DataFrame:
    return profile.findings_statistics(_flags(s, d))


@query(_with("fi", f"SELECT {_strip_sql('cause_factor')} AS factor, count(*) AS n FROM fi GROUP BY 1"))
def factor_distribution(s: SparkSession, d: str) -> DataFrame:
    return profile.factor_distribution(_findings(s, d))


@query(_with("fi", "SELECT finding_description, count(*) AS n, round(count(*) / (SELECT count(DISTINCT ev_id) FROM fi)::DOUBLE, 6) AS share FROM fi GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 20"))
def finding_share(s: SparkSession, d: str) -> DataFrame:
    f = _findings(s, d)
    return profile.finding_shares(f, False, f.agg(F.countDistinct("ev_id").alias("n_total")), 20)


@query(_with("fi ev", f"SELECT finding_description, count(*) AS n, round(count(*) / (SELECT count(*) FROM ev)::DOUBLE, 6) AS share FROM fi WHERE {_strip_sql('cause_factor')} = 'C' GROUP BY 1 ORDER BY n DESC, 1 NULLS LAST LIMIT 15"))
def causal_top(s: SparkSession, d: str) -> DataFrame:
    return profile.finding_shares(_findings(s, d), True, _n_incidents(s, d).withColumnRenamed("n_incidents", "n_total"), 15)


@query(_with("fl", """SELECT count(*) FILTER (WHERE n_findings > 0 AND (has_cause OR has_factual)) AS both, count(*) FILTER (WHERE n_findings > 0 AND NOT (has_cause OR has_factual)) AS only_findings,
  count(*) FILTER (WHERE n_findings = 0 AND (has_cause OR has_factual)) AS only_narratives, count(*) FILTER (WHERE n_findings = 0 AND NOT (has_cause OR has_factual)) AS neither FROM fl"""))
def both_only_neither(s: SparkSession, d: str) -> DataFrame:
    return profile.both_only_neither(_flags(s, d))


@query(_with("fl", f"""SELECT n AS narrative_rich, f AS findings_rich, c > 20 AS causes_diverse, CASE WHEN n AND f THEN 'both' WHEN n THEN 'narratives' WHEN f THEN 'findings' ELSE 'limited' END AS recommendation FROM (
  SELECT avg((has_cause OR has_factual)::INT) > 0.5 AS n, avg((n_findings > 0)::INT) > 0.3 AS f, (SELECT count(DISTINCT finding_description) FROM fi WHERE {_strip_sql('cause_factor')} = 'C') AS c FROM fl)"""))
def recommendation(s: SparkSession, d: str) -> DataFrame:
    unique = causes.structured_causes(table(s, d, "findings")).agg(F.countDistinct("cause").alias("unique_causes"))
    return profile.recommendation(_flags(s, d), unique)


THEMES = ("engine", "fire", "power", "turbine", "fuel")


@query(_with("cnt", "SELECT cause, list_filter(['engine', 'fire', 'power', 'turbine', 'fuel'], lambda t: contains(lower(cause), t))[1] AS theme FROM cnt WHERE cause IS NOT NULL"))
def theme_relevance(s: SparkSession, d: str) -> DataFrame:
    themes = F.array(*[F.lit(t) for t in THEMES])
    hit = F.get(F.filter(themes, lambda t: F.lower("cause").contains(F.lower(t))), F.lit(0))
    return _counts(s, d).filter(F.col("cause").isNotNull()).select("cause", hit.alias("theme"))


@query("SELECT doc_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS short, printf('%.1f%%', n_chars / 10.0::DOUBLE) AS tenth FROM documents")
def truncate_text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", T.shorten(F.col("text"), 80).alias("short"), F.concat(T.one_decimal(F.col("n_chars") / 10.0), F.lit("%")).alias("tenth"))


@query(_with("ev", "SELECT ev_state, min(ev_id) AS first_ev_id, count(*) AS n FROM ev GROUP BY 1"))
def first_per_state(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    firsts = first_per_key(e.select("ev_state", "ev_id"), "ev_state", ["ev_id"])
    n = e.groupBy("ev_state").agg(F.count("*").alias("n"), F.min("ev_id").alias("own"))
    return n.join(firsts, "ev_state", "left").select("ev_state", F.coalesce("ev_id", "own").alias("first_ev_id"), "n")
