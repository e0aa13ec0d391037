import datetime as dt
import json

import pytest

from mishaplens import agent, embedding, sinks
from mishaplens.operators import causes, entries, incidents, profile, retrieval
from mishaplens.sources import tables
from mishaplens.streaming.incremental import embed_stream, windowed_counts

DAY = dt.datetime(2020, 1, 1)


def pairs(spark, rows):
    return spark.createDataFrame(rows, "entry_id long, ev_id string, cause string, score double, rank int")


def test_worked_examples(spark):
    one = pairs(spark, [(1, "a", "x", 0.92, 1), (2, "b", "x", 0.87, 2), (3, "c", "y", 0.81, 3), (4, "d", "x", 0.75, 4)])
    r = {x.cause: x for x in retrieval.per_incident_diagnosis(one).collect()}
    assert round(r["x"].probability, 3) == 0.758
    w = {x.cause: x.probability for x in retrieval.weighted_diagnosis(one.filter("cause = 'x'")).collect()}
    assert w == {"x": 1.0}
    two = pairs(spark, [(i, f"p{i}", "pilot error", 0.6, i) for i in range(10)] + [(i, f"m{i}", "mechanical failure", 0.95, i) for i in range(10, 15)])
    r = {x.cause: x for x in retrieval.weighted_diagnosis(two).collect()}
    assert abs(r["pilot error"].raw_score - 6) < 1e-9 and abs(r["mechanical failure"].probability - 4.75 / 10.75) < 1e-9
    assert r["pilot error"].supporting == ["p0", "p1", "p2", "p3", "p4"]


def test_negative_total_and_empty(spark):
    neg = pairs(spark, [(1, "a", "x", -0.5, 1), (2, "b", "y", 0.1, 2)])
    assert {r.probability for r in retrieval.weighted_diagnosis(neg).collect()} == {0.0}
    assert retrieval.weighted_diagnosis(neg.limit(0)).count() == 0


def test_limit_before_filter_and_entries_counted(spark):
    e = spark.createDataFrame([(i, "dictionary", None) for i in range(50)] + [(50, "incident", "A"), (51, "incident", "A"), (51, "incident", "A")], "entry_id long, source string, ev_id string")
    s = spark.createDataFrame([(0, i, 1.0 - i / 100) for i in range(52)], "query_id long, entry_id long, score double")
    ev, na, _, _, fi, _ = fixture(spark)
    assert retrieval.evidence(retrieval.ranked_incidents(retrieval.top_entries(s, 50), e), fi, na, ev).count() == 0
    r = retrieval.weighted_diagnosis(retrieval.evidence(retrieval.ranked_incidents(retrieval.top_entries(s, 52), e), fi, na, ev)).collect()
    assert {(x.cause, x.num_incidents) for x in r} == {("early", 2), ("late", 2), ("Loss of control in the turn", 2), ("Pilot did not see it", 2)} and r[0].supporting == ["A", "A"]


def test_scores_and_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, None), (None, [1.0, 1.0]), (2, [2.0, 0.0])], "entry_id long, embedding array<float>")
    u = retrieval.usable(v, 2)
    assert sorted(r.entry_id for r in u.collect()) == [1, 2]
    top = retrieval.top_entries(retrieval.scored(u, {0: [1.0, 0.0]}), 5).orderBy("rank").collect()
    assert [r.entry_id for r in top] == [2, 1] and top[0].score == 1.0
    assert sorted(r.entry_id for r in retrieval.scored(v, {0: [1.0, 0.0]}).collect()) == [1, 2]
    assert retrieval.scored(u, {}).count() == 0 and retrieval.scored(u.limit(0), {0: [1.0, 0.0]}).count() == 0


def fixture(spark):
    ev = spark.createDataFrame([("A", "one", DAY), ("a ", "two", dt.datetime(2021, 1, 1)), ("B", None, DAY), (None, "x", DAY)], "ev_id string, ev_city string, lchg_date timestamp_ntz")
    na = spark.createDataFrame([("A", None, None, "Loss of control in the turn. Pilot did not see it", DAY), ("B", "prelim", "", "null", DAY), ("C", "p", "f", None, DAY)], "ev_id string, narr_accp string, narr_accf string, narr_cause string, lchg_date timestamp_ntz")
    fi = spark.createDataFrame([("A", 2, "late", " C ", DAY), ("A", None, "none", "F", DAY), ("A", 1, "early", "C", DAY), ("A", 1, "early", "C", DAY), ("B", 1, None, "C", DAY)], "ev_id string, finding_no int, finding_description string, cause_factor string, lchg_date timestamp_ntz")
    sq = spark.createDataFrame([("A", 1, "1", "spin", None, 1, DAY)], "ev_id string, occurrence_no int, occurrence_code string, occurrence_description string, phase_no string, defining_ev int, lchg_date timestamp_ntz")
    ac = spark.createDataFrame([("A", None, DAY), ("A", "second", dt.datetime(2022, 1, 1))], "ev_id string, acft_make string, lchg_date timestamp_ntz")
    en = spark.createDataFrame([], "ev_id string, eng_no int, lchg_date timestamp_ntz")
    return ev, na, ac, sq, fi, en


def test_incident_records(spark):
    ev, na, ac, sq, fi, en = fixture(spark)
    rows = {(r.ev_id, r.part_no): r for r in incidents.incident_records(ev, na, ac, sq, fi, en, chunk=2).collect()}
    assert set(rows) == {("A", 0), ("A", 1), ("B", 0)}
    a = rows["A", 0]
    assert a.ev_city == "one" and a.acft_make == "Unknown" and [f.finding_description for f in a.findings] == ["early", "late"]
    assert [f.finding_description for f in rows["A", 1].findings] == ["none"] and rows["B", 0].sequence_of_events == [] and rows["B", 0].injuries == []
    doc = json.loads(incidents.as_json(incidents.json_ready(incidents.incident_records(ev, na, ac, sq, fi, en))).filter("ev_id = 'B'").first().json)
    assert doc["ev_city"] is None and doc["findings"][0]["cause_factor"] == "C"
    injuries = spark.createDataFrame([("A", "crew", "minor", 2)], "ev_id string, inj_person_category string, injury_level string, inj_person_count int")
    got = incidents.incident_records(ev, na, ac, sq, fi, en, injuries).filter("ev_id = 'A'").first()
    assert got.injuries[0].inj_person_count == 2


def test_entries_and_causes(spark):
    ev, na, _, _, fi, _ = fixture(spark)
    known = incidents.keyed(ev)
    e = {(r.ev_id, r.entry_type, r.text) for r in entries.incident_entries(na, fi, known).collect()}
    assert ("B", "fallback_narrative", "prelim") in e and ("A", "finding", "late") in e and not any(x[0] == "C" for x in e)
    occ = causes.combined_causes(fi, na, known)
    c = {r.cause: (r.n_structured, r.n_narrative) for r in causes.cause_counts(occ, known.agg({"ev_id": "count"}).toDF("n_incidents")).collect()}
    assert c["late"] == (1, 0) and c["Loss of control in the turn"] == (0, 1) and c[None] == (1, 0)
    cov = causes.coverage(known, occ).first()
    assert (cov.n_incidents, cov.both, cov.structured_only, cov.any_kind) == (2, 1, 1, 2)


def test_profile_on_empty(spark):
    ev, na, _, sq, fi, _ = fixture(spark)
    flags = profile.incident_flags(incidents.first_rows(ev, {"ev_city": "string"}).limit(0), incidents.first_rows(na, incidents.NARRATIVE_COLUMNS), fi, sq)
    assert profile.dataset_coverage(flags).first().with_narrative_percent == 0.0
    unique = spark.createDataFrame([(0,)], "unique_causes long")
    assert profile.recommendation(flags, unique).first().recommendation == "limited"


def test_sources(spark, tmp_path):
    (tmp_path / "d.csv").write_text('1,"a, b"\n2,c\n')
    assert tables.delimited(spark, str(tmp_path / "d.csv"), header=False, names=["code", "meaning"]).first().meaning == "a, b"
    (tmp_path / "t.txt").write_text("x\ty\n1\t2\n")
    assert tables.delimited(spark, str(tmp_path / "t.txt"), sep="\t").columns == ["x", "y"]
    (tmp_path / "k.json").write_text(json.dumps({"A": {"n": 1}, "B": {"n": None}}))
    from pyspark.sql import types as T

    got = tables.keyed_json(spark, str(tmp_path / "k.json"), T.StructType([T.StructField("n", T.IntegerType())]))
    assert sorted(tuple(r) for r in got.collect()) == [("A", 1), ("B", None)]
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    assert tables.json_array(spark, str(tmp_path / "a.json")).count() == 2
    import numpy as np

    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert [r.embedding for r in tables.npy_matrix(spark, str(tmp_path / "m.npy")).orderBy("entry_id").collect()][2] == [4.0, 5.0]
    blocks = tables.npy_matrix(spark, str(tmp_path / "m.npy"), block_bytes=20)
    assert [(r.entry_id, r.embedding) for r in blocks.orderBy("entry_id").collect()] == [(i, [2.0 * i, 2.0 * i + 1]) for i in range(3)]
    assert tables.missing_inputs(spark, [str(tmp_path / "m.npy"), str(tmp_path / "no")]) == [str(tmp_path / "no")]
    with pytest.raises(RuntimeError):
        tables.setting("MISHAPLENS_NO_SUCH_SETTING")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("A", 0.5), ("B", 0.9)], "EVID string, cosine_similarity_score double")
    assert sinks.write_report(df, str(tmp_path / "new" / "r.json"), 1) == 1
    assert json.loads((tmp_path / "new" / "r.json").read_text())[0]["EVID"] == "B"
    sinks.publish(df, str(tmp_path / "t"))
    sinks.publish(df.limit(1), str(tmp_path / "t"))
    assert sinks.published(spark, str(tmp_path / "t")).count() == 1
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_embedding_resume_and_retry(spark, tmp_path):
    e = spark.createDataFrame([(1, "engine fire"), (2, "bird strike"), (3, None)], "entry_id long, text string")
    make = lambda: embedding.hashed_embedder(8)
    assert embedding.embed_missing(spark, e.limit(1), str(tmp_path / "v"), make) == 1
    assert embedding.embed_missing(spark, e, str(tmp_path / "v"), make, chunks=2) == 2
    tries = []

    def flaky(texts):
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return [[1.0]] * len(texts)

    assert embedding.with_retries(flaky, pause=0)(["x"]) == [[1.0]]
    with pytest.raises(OSError):
        embedding.with_retries(lambda t: (_ for _ in ()).throw(OSError()), tries=2, pause=0)(["x"])
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = embed_stream(stream.filter("text is not null"), str(tmp_path / "v"), str(tmp_path / "cp"), make)
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def kb(spark, folder):
    ev, na, _, _, fi, _ = fixture(spark)
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "entry_id long, embedding array<float>")
    m = spark.createDataFrame([(1, "incident", "A", "finding", 1, None, None), (2, "dictionary", None, None, None, "9", "word")], "entry_id long, source string, ev_id string, entry_type string, finding_no int, code string, text string")
    for n, df in (("incident_events", ev), ("narratives", na), ("findings", fi), ("embeddings_map", m), ("entry_vectors", vec)):
        df.write.parquet(f"{folder}/{n}.parquet")
    return agent.KnowledgeBase(spark, str(folder), lambda t: [1.0, 0.5], dim=2)


def test_agent(spark, tmp_path):
    with pytest.raises(RuntimeError, match="entry_vectors"):
        agent.diagnose_root_causes(agent.KnowledgeBase(spark, str(tmp_path / "no"), lambda t: [1.0]), "q")
    base = kb(spark, tmp_path / "kb")
    got = agent.diagnose_root_causes(base, "engine\nfire", 2)
    assert len(got["top_causes"]) == 2 and got["diagnosis_metadata"]["incidents_analyzed"] == 1
    assert abs(sum(c["probability"] for c in got["all_causes"]) - 1) < 1e-9
    best, details, _ = agent.diagnose_incident(base, "q")
    assert best.first().ev_id == "A" and details.first().ev_city == "one"

    def chat(messages, tools):
        if tools:
            return "", [agent.Call("diagnose_root_causes", '{"query": "q", "top_n": 1}')]
        return ("summary" if messages[-1]["role"] == "tool" else "report"), []

    out = agent.run_agent(base, chat, "fire")
    assert out["final_summary"] == "summary" and len(out["tool_results"]["top_causes"]) == 1
    assert agent.run_agent(base, lambda m, t: ("r", []), "fire")["final_summary"] == agent.NO_TOOL
    with pytest.raises(ValueError):
        agent.run_agent(base, chat, "")


def test_validation(spark, tmp_path):
    base = kb(spark, tmp_path / "kb")
    got = agent.validate(base, [("x", ("LATE",)), ("y", ("nothing",))], str(tmp_path / "v.json"))
    assert [r["passed"] for r in got["results"]] == [True, False] and got["pass_rate"] == 0.5
    assert json.loads((tmp_path / "v.json").read_text()) == got
    missing = agent.validate(agent.KnowledgeBase(spark, str(tmp_path / "no"), lambda t: [1.0]), [("x", ("a",))])
    assert "missing" in missing["results"][0]["error"]
    assert agent.relevant_themes(["Fuel starvation", None, "wind"], ("fuel", "engine")) == ["fuel"]


def test_windowed_counts(spark, tmp_path):
    rows = [(dt.datetime(2020, 1, 1, 3), "a"), (dt.datetime(2020, 1, 1, 9), "a"), (dt.datetime(2020, 1, 2, 1), "b")]
    df = spark.createDataFrame(rows, "at timestamp, k string")
    df.write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark, str(tmp_path / "in"), df.schema, "at", "k").writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.k, r.n) for r in spark.sql("select * from windowed").collect()) == [("a", 2), ("b", 1)]


def test_keyed_json_piece_by_piece(tmp_path):
    docs = {"": None, "é": {"a": [1, 2, {"b": "} , : {"}]}, "long": {"t": "x" * 500}, "n": 12345678, "m": -1.5e3, "t": True, "s": "last"}
    for indent in (None, 4):
        (tmp_path / "d.json").write_text(json.dumps(docs, indent=indent, ensure_ascii=False))
        for size in (1, 7, 1 << 20):
            with open(tmp_path / "d.json", "rb") as f:
                assert {k: json.loads(v) for k, v in tables._members(f, size)} == docs
    (tmp_path / "e.json").write_text(" { } ")
    with open(tmp_path / "e.json", "rb") as f:
        assert list(tables._members(f)) == []


def workbook(path, sheets):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>ev_id</t></si><si><r><t>spl</t></r><r><t>it</t></r></si></sst>")
        for i, cells in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {main}><sheetData>{cells}</sheetData></worksheet>")


def test_excel(spark, tmp_path):
    from pyspark.sql import types as T

    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>total_seats</t></is></c></row>'
    workbook(tmp_path / "b.xlsx", {"one": head + '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>4</v></c></row><row r="3"><c r="C3"><v>x</v></c></row><row r="4"/>', "two": head + '<row><c><v>B</v></c></row>', "none": ""})
    schema = T.StructType([T.StructField("ev_id", T.StringType()), T.StructField("total_seats", T.IntegerType()), T.StructField("lacking", T.DoubleType())])
    got = sorted((tuple(r) for r in tables.excel(spark, str(tmp_path / "b.xlsx"), schema).collect()), key=str)
    assert got == [("B", None, None), ("split", 4, None), (None, None, None)]
    assert tables.excel(spark, str(tmp_path / "b.xlsx"), schema, "two").count() == 1


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from mishaplens import session

    class Context:
        def __init__(self, master, conf):
            self.master, self.getConf = master, lambda: conf

    class Session:
        def __init__(self, *context):
            self.sparkContext = Context(*context)

    for master in ("spark://somewhere:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master, {}))
        assert session.shared_dir(Session(master, {"spark.checkpoint.dir": "hdfs://x/y"})) == "hdfs://x/y"
    for master in ("local", "local[*]", "local[4]"):
        assert session.shared_dir(Session(master, {})).startswith("file://")
    with session.scratch(spark):
        t = session.stage(spark.range(3), "t")
        path = t.inputFiles()[0].removeprefix("file://")
        assert t.count() == 3
    import os

    assert not os.path.exists(path)
    assert session.get_session(cores="1").sparkContext.master == spark.sparkContext.master


def test_best_entries_are_kept_in_the_scan(spark):
    import random

    rnd = random.Random(2)
    rows = [(i % 60, [float(rnd.randint(-3, 3)), float(rnd.randint(-3, 3)), 1.0]) for i in range(400)] + [(None, [1.0, 1.0, 1.0]), (7, None)]
    v = spark.createDataFrame(rows, "entry_id long, embedding array<float>").repartition(5)
    q = {0: [1.0, 0.0, 0.0], 3: [1.0, 1.0, 1.0], 5: [0.0, 0.0, 0.0]}
    for k in (1, 7, 100):
        want = {tuple(r) for r in retrieval.top_per_query(retrieval.scored(v, q), k).collect()}
        assert {tuple(r) for r in retrieval.top_per_query(retrieval.top_scored(v, q, k), k).collect()} == want
    assert retrieval.top_scored(v.limit(0), q).count() == 0 and retrieval.top_scored(v, {}).count() == 0


def test_large_keys(spark, monkeypatch):
    from mishaplens.operators import groups

    ev, na, ac, sq, fi, en = fixture(spark)
    many = spark.range(300).selectExpr("if(id % 3 = 0, 'B', 'A') ev_id", "cast(id as int) finding_no", "cast(id as string) finding_description", "'C' cause_factor")
    plain = sorted(map(str, incidents.incident_records(ev, na, ac, sq, many, en, chunk=7).collect()))
    monkeypatch.setattr(groups, "LARGE", 150)
    assert groups.large_keys(many, "ev_id") == ["A"]
    assert sorted(map(str, incidents.incident_records(ev, na, ac, sq, many, en, chunk=7).collect())) == plain


def test_writers_and_readers_agree(spark, tmp_path):
    from pyspark.sql import types as T

    rows = [("A", 'say "x", then\ttab', 1.5), ("é\\", " blanks ", None), ("C", "", 0.0), ("D", None, -2.0), (None, "no key", 3.0)]
    df = spark.createDataFrame(rows, "ev_id string, words string, n double").repartition(3)
    value = T.StructType([T.StructField("words", T.StringType()), T.StructField("n", T.DoubleType())])
    for i, part in enumerate((df, df.limit(0))):
        kept = sorted(map(tuple, part.collect()), key=str)
        sinks.write_delimited(part, str(tmp_path / f"d{i}"), "\t")
        read = tables.delimited(spark, str(tmp_path / f"d{i}"), "\t", schema=df.schema)
        assert sorted(map(tuple, read.collect()), key=str) == sorted(((a, b or None, n) for a, b, n in kept), key=str)
        sinks.write_keyed_json(part, str(tmp_path / f"k{i}"))
        assert sorted(map(tuple, tables.keyed_json(spark, str(tmp_path / f"k{i}"), value).collect()), key=str) == [r for r in kept if r[0] is not None]
        sinks.write_json_array(part, str(tmp_path / f"a{i}"))
        assert sorted(map(tuple, tables.json_array(spark, str(tmp_path / f"a{i}"), df.schema).collect()), key=str) == kept


def test_matrix_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "NPY_ROWS", 10)
    v = spark.range(45).selectExpr("99 - id as entry_id", "array(cast(id as float), 0.5f) as embedding").repartition(4)
    assert sinks.write_npy(v, str(tmp_path / "m")) == 45
    got = tables.npy_matrix(spark, str(tmp_path / "m")).orderBy("entry_id").collect()
    assert [(r.entry_id, r.embedding) for r in got] == [(i, [44.0 - i, 0.5]) for i in range(45)]
    assert sinks.write_npy(v.limit(0), str(tmp_path / "none")) == 0


def test_causes_chains_and_totals(spark):
    from mishaplens.operators import chains

    ev, na, _, sq, fi, _ = fixture(spark)
    more = sq.unionByName(spark.createDataFrame([("A", 2, "2", "fall", None, 0, DAY), ("a", 3, "3", None, None, 0, DAY), ("Z", 1, "1", "spin", None, 1, DAY), (None, 1, "1", "x", None, 1, DAY)], sq.schema))
    assert tuple(chains.event_totals(more).first()) == (4, 2, 2, 2)
    assert tuple(chains.event_totals(more.limit(0)).first()) == (0, 0, 0, 0)
    d = spark.createDataFrame([("c1", ["A", "A", "none"], 0.9, 1), ("c2", ["Z"], 0.1, 2)], "cause string, supporting array<string>, probability double, first_rank int")
    assert [tuple(r) for r in chains.chains_of_causes(d, more, 1).collect()] == [("c1", "A", 0, 3, "spin → fall → Unknown")]
    got = {(r.ev_id, r.part_no): r for r in causes.finding_arrays(fi, chunk=2).collect()}
    assert got["A", 0].findings == ["early", "late"] and got["A", 0].causal_findings == ["early", "late"] and got["A", 1].cause_factors == ["F"]
    assert got["B", 0].causal_findings == [None] and causes.finding_arrays(fi.limit(0)).count() == 0


def test_entry_rows_stay_whole(spark):
    m = spark.createDataFrame([(1, "incident", "B", "x"), (1, "incident", "a", "y"), (1, None, None, "z"), (None, "incident", "A", "x")], "entry_id long, source string, ev_id string, text string")
    assert [tuple(r) for r in entries.mapped_entries(m).select("entry_id", "source", "ev_id", "text").collect()] == [(1, "incident", "A", "y")]


def test_messages_and_call_ids(spark, tmp_path):
    base = kb(spark, tmp_path / "kb")
    words = spark.read.parquet(str(tmp_path / "kb" / "embeddings_map.parquet")).filter("source = 'dictionary'")
    vectors = spark.read.parquet(str(tmp_path / "kb" / "entry_vectors.parquet"))
    ask = lambda **t: agent.diagnose_incident(agent.KnowledgeBase(spark, base.folder, base.embed, 2, tables=t), "q")
    assert ask(entry_vectors=vectors.limit(0)) == (None, agent.NOTHING_SIMILAR, None)
    assert ask(embeddings_map=words)[1] == agent.NO_INCIDENT
    assert ask(embeddings_map=words, entry_vectors=vectors.filter("entry_id = 2"))[1] == agent.DICTIONARY_ONLY.format("word")
    seen = []

    def chat(messages, tools):
        seen.append([dict(m) for m in messages])
        return ("", [agent.Call("diagnose_root_causes", '{"query": "q"}', "x1"), agent.Call("diagnose_root_causes", '{"query": "r"}')]) if tools else ("said", [])

    agent.run_agent(base, chat)
    calls = [c["id"] for m in seen[-1] for c in m.get("tool_calls", ())]
    assert calls == ["x1", "call_1"] == [m["tool_call_id"] for m in seen[-1] if m["role"] == "tool"] and agent.DEFAULT_QUERY in seen[0][-1]["content"]
