"""Queries that pass tables through readers, writers, the embedding and the driver-side orchestration, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mishaplens import agent, embedding, sinks
from mishaplens.operators import retrieval
from mishaplens.plans import diagnosis as D
from mishaplens.session import scratch_path
from mishaplens.sources import tables
from mishaplens.sources.tables import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_PLACES = ["ev_id", "ev_city", "ev_state", "ev_time", "light_cond"]


def _places(s, d):
    return table(s, d, "incident_events").select(*_PLACES)


# ------------------------------------------------------- readers and writers


@query("SELECT DISTINCT code, text FROM embeddings_map WHERE source = 'dictionary'")
def read_csv(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    sinks.write_delimited(table(s, d, "embeddings_map").filter("source = 'dictionary'").select("code", "text").distinct(), path)
    return tables.delimited(s, path)


@query(f"SELECT {', '.join(_PLACES)} FROM incident_events")
def read_tsv(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "tsv")
    sinks.write_delimited(_places(s, d), path, "\t")
    return tables.delimited(s, path, "\t")


@query("SELECT DISTINCT code, text AS meaning FROM embeddings_map WHERE source = 'dictionary'")
def read_csv_without_header(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    sinks.write_delimited(table(s, d, "embeddings_map").filter("source = 'dictionary'").select("code", "text").distinct(), path, header=False)
    return tables.delimited(s, path, header=False, names=["code", "meaning"])


@query("SELECT DISTINCT code, text AS meaning FROM embeddings_map WHERE source = 'dictionary'")
def read_csv_renamed(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "csv")
    sinks.write_delimited(table(s, d, "embeddings_map").filter("source = 'dictionary'").select("code", "text").distinct(), path)
    return tables.delimited(s, path, names=["code", "meaning"])


@query(D._with("ev", "SELECT ev_id, ev_city, vis_sm FROM ev"))
def read_keyed_json(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "json")
    sinks.write_keyed_json(D._events(s, d).select("ev_id", "ev_city", "vis_sm"), path)
    return tables.keyed_json(s, path, T.StructType([T.StructField("ev_city", T.StringType()), T.StructField("vis_sm", T.DoubleType())]))


@query("SELECT entry_id, source, ev_id, finding_no FROM embeddings_map")
def read_json_array(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "json")
    rows = table(s, d, "embeddings_map").select("entry_id", "source", "ev_id", "finding_no")
    sinks.write_json_array(rows, path)
    return tables.json_array(s, path, rows.schema)


@query(D._with("vec", "SELECT row_number() OVER (ORDER BY entry_id) - 1 AS entry_id, round(sqrt(list_dot_product(e, e)), 5) AS norm FROM vec"))
def read_npy(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "npy")
    sinks.write_npy(D._vectors(s, d), path)
    return tables.npy_matrix(s, path).select("entry_id", F.round(D.norm(F.col("embedding")), 5).alias("norm"))


@query(D._with("vec entry", "SELECT entry_id, source, ev_id, len(e)::INT AS dim FROM vec JOIN entry USING (entry_id)"))
def keyed_vector_table(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "vectors")
    sinks.write_table(D._vectors(s, d).join(D._entries(s, d), "entry_id"), path, partition_by=["source"])
    return s.read.parquet(path).select("entry_id", "source", "ev_id", F.size("embedding").alias("dim"))


@query(D._with("ev", "SELECT ev_id, ev_state FROM ev WHERE ev_state IS NOT NULL"))
def published_version(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "versions")
    sinks.publish(D._events(s, d).select("ev_id", "ev_state"), path)
    sinks.publish(sinks.published(s, path).filter("ev_state is not null"), path)
    return sinks.published(s, path)


@query(D._with("ev", "SELECT ev_id, ev_city, gust_kts FROM ev"))
def json_export(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "json")
    sinks.write_json(D._events(s, d).select("ev_id", "ev_city", "gust_kts"), path)
    return s.read.schema("ev_id string, ev_city string, gust_kts double").json(path)


@query("SELECT 'no_such_table' AS missing")
def missing_tables(s: SparkSession, d: str) -> DataFrame:
    found = tables.missing_inputs(s, [f"{d}/{t}.parquet" for t in (*agent.NEEDED, "no_such_table")])
    return s.createDataFrame([(f.rsplit("/", 1)[1].removesuffix(".parquet"),) for f in found], "missing string")


@query("SELECT * FROM (VALUES ('MISHAPLENS_UNSET', 'default'), ('MISHAPLENS_UNSET without default', 'error')) t(setting, found)")
def settings(s: SparkSession, d: str) -> DataFrame:
    rows = [("MISHAPLENS_UNSET", tables.setting("MISHAPLENS_UNSET", "default"))]
    try:
        agent.api_key("MISHAPLENS_UNSET")
    except RuntimeError:
        rows.append(("MISHAPLENS_UNSET without default", "error"))
    return s.createDataFrame(rows, "setting string, found string")


# ----------------------------------------------------------------- embedding


_TEXTS = "SELECT DISTINCT entry_id FROM embeddings_map WHERE text IS NOT NULL AND entry_id IS NOT NULL"


@query(f"WITH e AS ({_TEXTS}) SELECT entry_id, 64 AS dim FROM e")
def embed_resumed(s: SparkSession, d: str) -> DataFrame:
    """Texts embedded in batches with retries; a second call finds what the first left."""
    path = scratch_path(s, "embedded")
    texts = table(s, d, "embeddings_map").filter("text is not null and entry_id is not null").groupBy("entry_id").agg(F.min("text").alias("text"))
    embedding.embed_missing(s, texts.filter("entry_id % 2 = 0"), path, embedding.hashed_embedder)  # the interrupted run
    embedding.embed_missing(s, texts, path, embedding.hashed_embedder, every=20)
    return s.read.parquet(path).select("entry_id", F.size("embedding").alias("dim"))


# ------------------------------------------------------------- orchestration


def _base(s, d, n=1, **how):
    """A knowledge base whose embedding service knows the first entries by number."""
    found = D._query_vectors(s, d, n)
    return agent.KnowledgeBase(s, d, lambda text: found[int(text)], D.DIM, D.TOP, **how)


def _scripted(messages, offered):
    if offered:
        return "", [agent.Call("diagnose_root_causes", '{"query": "0", "top_n": 10}', "a")]
    return ("summary of " + messages[-1]["tool_call_id"] if messages[-1]["role"] == "tool" else "0"), []


@query(D._with("dg", "SELECT 'summary of a' AS summary, cause, round(probability, 6) AS probability FROM dg WHERE query_id = 0 ORDER BY dg.probability DESC, first_rank, cause LIMIT 10"))
def agent_run(s: SparkSession, d: str) -> DataFrame:
    """Report, tool call and summary with a scripted chat service."""
    got = agent.run_agent(_base(s, d), _scripted, "0")
    rows = [(got["final_summary"], c["cause"], c["probability"]) for c in got["tool_results"]["top_causes"]]
    return s.createDataFrame(rows, "summary string, cause string, probability double").withColumn("probability", F.round("probability", 6))


@query(D._with("ev_pairs", f"SELECT count(DISTINCT entry_id) AS incidents_analyzed, count(DISTINCT cause) AS total_causes_found, '{agent.METHOD}' AS methodology FROM ev_pairs WHERE query_id = 0"))
def tool_metadata(s: SparkSession, d: str) -> DataFrame:
    meta = agent.diagnose_root_causes(_base(s, d), "0")["diagnosis_metadata"]
    return s.createDataFrame([(meta["incidents_analyzed"], meta["total_causes_found"], meta["methodology"])], "incidents_analyzed long, total_causes_found long, methodology string")


@query(D._with("sc entry ev", """SELECT ev_id, round(max(score), 6) AS score, any_value(ev_city) AS ev_city FROM sc JOIN entry USING (entry_id) JOIN ev USING (ev_id)
  WHERE query_id = 0 AND source = 'incident' AND ev_id IS NOT NULL GROUP BY 1"""))
def incident_diagnosis(s: SparkSession, d: str) -> DataFrame:
    _, details, _ = agent.diagnose_incident(_base(s, d), "0")
    return details.select("ev_id", F.round("score", 6).alias("score"), "ev_city")


@query(D._with("sc", "").rstrip() + f""", dict AS (SELECT entry_id, min(text) AS text FROM embeddings_map WHERE source = 'dictionary' GROUP BY 1)
SELECT replace('{agent.DICTIONARY_ONLY.replace("'", "''")}', '{{}}', text) AS message FROM sc JOIN dict USING (entry_id) WHERE query_id = 0 ORDER BY score DESC, entry_id DESC LIMIT 1""")
def dictionary_message(s: SparkSession, d: str) -> DataFrame:
    words = table(s, d, "embeddings_map").filter("source = 'dictionary'")
    vectors = table(s, d, "entry_vectors").join(F.broadcast(words.select("entry_id").distinct()), "entry_id", "left_semi")
    base = _base(s, d, tables={"embeddings_map": words, "entry_vectors": vectors})
    return s.createDataFrame([(agent.diagnose_incident(base, "0")[1],)], "message string")


@query(f"SELECT '{agent.NOTHING_SIMILAR}' AS message UNION ALL SELECT '{agent.NO_INCIDENT}' UNION ALL SELECT '{agent.NO_TOOL}'")
def other_messages(s: SparkSession, d: str) -> DataFrame:
    vectors, nothing = table(s, d, "entry_vectors"), table(s, d, "embeddings_map").limit(0)
    said = [agent.diagnose_incident(_base(s, d, tables=t), "0")[1] for t in ({"entry_vectors": vectors.limit(0)}, {"embeddings_map": nothing})]
    said.append(agent.run_agent(_base(s, d), lambda messages, offered: ("0", []), "0")["final_summary"])
    return s.createDataFrame([(x,) for x in said], "message string")


@query(D._with("dg", """, five AS (SELECT query_id, cause FROM dg WHERE query_id < 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY probability DESC, first_rank, cause) <= 5)
SELECT query_id::VARCHAR AS test_case, bool_or(len(list_filter(['engine', 'fire', 'power', 'turbine', 'fuel'], lambda t: contains(lower(cause), t))) > 0) AS passed FROM five GROUP BY 1""").replace("\n, five AS", ",\nfive AS"))
def validation_results(s: SparkSession, d: str) -> DataFrame:
    got = agent.validate(_base(s, d, 2), [("0", D.THEMES), ("1", D.THEMES)])
    return s.createDataFrame([(r["test_case"], r["passed"]) for r in got["results"]], "test_case string, passed boolean")
