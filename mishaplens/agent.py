"""Driver-side orchestration: report, tool call, summary. Chat and embedding services are injected."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from mishaplens.functions.text import one_line
from mishaplens.operators import entries, retrieval
from mishaplens.session import stage
from mishaplens.sources.tables import missing_inputs, setting, table

# The tool as a chat service is told of it.
TOOL = {
    "type": "function",
    "function": {
        "name": "diagnose_root_causes",
        "description": "Finds the probable root causes of an incident from a text that describes it, with their weighted probabilities.",
        "parameters": {
            "type": "object",
            "properties": {"query": {"type": "string", "description": "What happened."}, "top_n": {"type": "integer", "description": "How many causes to return; 10 unless given."}},
            "required": ["query"],
        },
    },
}
NO_TOOL = "No diagnosis was made: the model answered without calling the tool."
NOTHING_SIMILAR = "No entry of the knowledge base can be compared with this text."
DICTIONARY_ONLY = "The closest entry is the dictionary event '{}'; no incident is linked to what was found."
NO_INCIDENT = "None of the entries found belongs to an incident."
#: The text a front end offers when nothing has been typed yet.
DEFAULT_QUERY = "engine fire during takeoff"
METHOD = "similarity-weighted causes of the most similar entries"
NEEDED = ("incident_events", "findings", "narratives", "embeddings_map", "entry_vectors")


@dataclass
class Call:
    """A tool call of the model; ``id`` pairs it with its answer."""

    name: str
    arguments: str
    id: str = ""


#: A chat service: messages and tools in, text and tool calls out.
Chat = Callable[[list[dict], list[dict] | None], tuple[str, list[Call]]]


def api_key(name: str = "CHAT_API_KEY") -> str:
    """Read when it is needed, so that a session without remote services needs none."""
    return setting(name)


class KnowledgeBase:
    """Tables of one folder, opened lazily; what is missing is named when a query first needs it. ``tables`` stand in for those of the folder."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str], list[float]], dim: int = 64, top: int = 50, tables: dict[str, DataFrame] | None = None) -> None:
        self.spark, self.folder, self.embed, self.dim, self.top, self.tables = spark, folder, embed, dim, top, tables or {}

    def _need(self) -> None:
        missing = missing_inputs(self.spark, [f"{self.folder}/{t}.parquet" for t in NEEDED if t not in self.tables])
        if missing:
            raise RuntimeError("knowledge base not loaded; missing: " + ", ".join(missing))

    def _t(self, name: str) -> DataFrame:
        return self.tables[name] if name in self.tables else table(self.spark, self.folder, name)

    def vector(self, text: str) -> list[float]:
        clean = self.spark.createDataFrame([(text,)], "t string").select(one_line(F.col("t"))).first()[0]
        return self.embed(clean)

    def scores(self, text: str) -> DataFrame:
        self._need()
        return retrieval.scored(self._t("entry_vectors"), {0: self.vector(text)})

    def best(self, text: str) -> DataFrame:
        """Scores of the entries that can be among the first."""
        self._need()
        return retrieval.top_scored(self._t("entry_vectors"), {0: self.vector(text)}, self.top)

    def entries(self) -> DataFrame:
        return entries.mapped_entries(self._t("embeddings_map"))

    def pairs(self, top: DataFrame) -> DataFrame:
        ranked = retrieval.ranked_incidents(top, self._t("embeddings_map"))
        return retrieval.evidence(ranked, *[self._t(t) for t in ("findings", "narratives", "incident_events")])


def diagnose_root_causes(kb: KnowledgeBase, query: str, top_n: int = 10, scores: DataFrame | None = None) -> dict:
    """Most probable causes for a text: top_causes, all_causes, diagnosis_metadata. At most the causes of the top entries are collected. ``scores`` may be given if they are known."""
    top = retrieval.top_entries(kb.best(query) if scores is None else scores, kb.top)
    pairs = stage(kb.pairs(top), "evidence")
    rows = retrieval.weighted_diagnosis(pairs).orderBy(F.desc("probability"), "first_rank", "cause").collect()
    every = [{"cause": r.cause, "probability": r.probability, "raw_score": r.raw_score, "num_incidents": r.num_incidents, "supporting_incidents": list(r.supporting)} for r in rows]
    used = pairs.select("entry_id").distinct().count()
    return {"top_causes": every[:top_n], "all_causes": every, "diagnosis_metadata": {"incidents_analyzed": used, "total_causes_found": len(every), "methodology": METHOD}}


def diagnose_incident(kb: KnowledgeBase, query: str) -> tuple[DataFrame | None, DataFrame | str, dict | None]:
    """(best score per incident, their details, diagnosis), or (None, message, None) if nothing of an incident is similar. The text is embedded and the vectors are scanned once."""
    scores, e = stage(kb.scores(query), "scores"), kb.entries()
    best = stage(retrieval.best_per_incident(scores, e), "best_per_incident")
    if best.isEmpty():
        first = retrieval.top_entries(scores, 1).join(e, "entry_id", "left").first()
        if first is None:
            return None, NOTHING_SIMILAR, None
        return None, DICTIONARY_ONLY.format(first.text) if first.source == "dictionary" else NO_INCIDENT, None
    from mishaplens.operators.incidents import EVENT_COLUMNS, NARRATIVE_COLUMNS, first_rows

    records = first_rows(kb._t("incident_events"), EVENT_COLUMNS).join(first_rows(kb._t("narratives"), NARRATIVE_COLUMNS), "ev_id", "left")
    return best, best.join(records, "ev_id"), diagnose_root_causes(kb, query, scores=scores)


def run_agent(kb: KnowledgeBase, chat: Chat, user_query: str = DEFAULT_QUERY) -> dict:
    """A report from the user's words, the tool call the model chooses, and a summary of its result. An empty text is refused."""
    if not user_query:
        raise ValueError("a query is needed")
    registry = {"diagnose_root_causes": diagnose_root_causes}
    report, _ = chat([{"role": "system", "content": "Write a short factual incident report from the user's words."}, {"role": "user", "content": user_query}], None)
    messages = [{"role": "system", "content": "Diagnose the incident with the tool, then explain the result."}, {"role": "user", "content": report}]
    said, calls = chat(messages, [TOOL])
    if not calls:
        return {"generated_report": report, "tool_results": None, "final_summary": NO_TOOL}
    for i, c in enumerate(calls):
        c.id = c.id or f"call_{i}"
    messages.append({"role": "assistant", "content": said, "tool_calls": [{"id": c.id, "type": "function", "function": {"name": c.name, "arguments": c.arguments}} for c in calls]})
    results = None
    for c in calls:
        args = json.loads(c.arguments)
        results = registry[c.name](kb, args["query"], args.get("top_n", 10))  # an unknown name is an error
        messages.append({"role": "tool", "tool_call_id": c.id, "name": c.name, "content": json.dumps(results)})
    summary, _ = chat(messages, None)
    return {"generated_report": report, "tool_results": results, "final_summary": summary}


# Queries to validate a knowledge base with, and the words one of which its first causes should hold.
VALIDATION_CASES = (
    ("Engine fire during takeoff", ("engine", "fire", "power", "turbine", "fuel")),
    ("Turbulence encounter during cruise flight", ("turbulence", "weather", "convective", "environmental")),
    ("Landing gear collapsed during landing", ("landing gear", "mechanical", "failure", "collapse")),
    ("Loss of engine power in flight", ("engine", "power", "fuel", "mechanical")),
    ("Bird strike on approach", ("bird", "wildlife", "animal", "environmental")),
)


def relevant_themes(causes_found: list[str], themes) -> list[str]:
    """For each of the first five causes the first theme it contains, ignoring case; causes without one give none."""
    out = []
    for c in causes_found[:5]:
        hit = next((t for t in themes if t.lower() in (c or "").lower()), None)
        if hit:
            out.append(hit)
    return out


def validate(kb: KnowledgeBase, cases=VALIDATION_CASES, path: str | None = None) -> dict:
    """Diagnose each case and see whether its themes occur; a failure is a result, not an end. Optionally written as JSON."""
    rows = []
    for text, themes in cases:
        try:
            got = diagnose_root_causes(kb, text)
            hits = relevant_themes([c["cause"] for c in got["top_causes"]], themes)
            meta = got["diagnosis_metadata"]
            rows.append({"test_case": text, "passed": bool(hits), "incidents_analyzed": meta["incidents_analyzed"], "causes_found": meta["total_causes_found"], "relevant_themes": hits})
        except Exception as e:  # noqa: BLE001
            rows.append({"test_case": text, "passed": False, "error": str(e)})
    out = {"results": rows, "pass_rate": sum(r["passed"] for r in rows) / len(rows) if rows else 0.0}
    if path:
        with open(path, "w") as f:
            json.dump(out, f, indent=2)
    return out
