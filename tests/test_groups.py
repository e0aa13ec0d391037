import random

import pytest

from mishaplens.operators import chains, groups


def order(r):
    return (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "")


@pytest.mark.parametrize("large", [groups.LARGE, 100])
def test_positions_parts_and_next(spark, monkeypatch, large):
    monkeypatch.setattr(groups, "LARGE", large)
    rnd = random.Random(7)
    rows = list({("hot" if i % 3 == 0 else f"k{rnd.randint(0, 30)}", rnd.choice([None, *range(20)]), rnd.choice([None, *"abcdefghij"]) or None) for i in range(3000)}) + [(None, 1, "a")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    want = {}
    for r in sorted((r for r in rows if r[0]), key=lambda r: (r[0], *order(r))):
        want.setdefault(r[0], []).append(r)
    got = {}
    for r in groups.positioned(df, "k", ["o"]).collect():
        got.setdefault(r.k, {})[r.position] = (r.k, r.o, r.v)
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == want
    parts = groups.grouped_records(df, "k", ["o"], "g", chunk=7).collect()
    assert all(len(p.g) <= 7 for p in parts)
    joined = {}
    for p in sorted(parts, key=lambda p: p.part_no):
        joined.setdefault(p.k, []).extend((p.k, x.o, x.v) for x in p.g)
    assert joined == want
    nxt = {(r.k, r.position): r.next_value for r in groups.with_next(df, "k", ["o"], "v", block=5).collect()}
    for k, seq in want.items():
        for i, r in enumerate(seq):
            assert nxt[k, i] == (seq[i + 1][2] if i + 1 < len(seq) else None)


def test_first_per_key(spark):
    df = spark.createDataFrame([("a", None, "z"), ("a", 2, "y"), ("a", 2, "x"), ("b", None, None), (None, 1, "q")], "k string, o int, v string")
    assert sorted(tuple(r) for r in groups.first_per_key(df, "k", ["o"]).collect()) == [("a", 2, "x"), ("b", None, None)]


SEQ = "ev_id string, occurrence_no int, occurrence_code string, occurrence_description string, phase_no string, defining_ev int, lchg_date timestamp_ntz"


def test_chains(spark):
    rows = [("E", i, None, v, None, 0, None) for i, v in enumerate("ABAC")] + [("one", 1, None, "A", None, 1, None)]
    s = spark.createDataFrame(rows + rows[:2], SEQ)
    assert sorted((r.event, r.next_event) for r in chains.chain_edges(s).collect()) == [("A", "B"), ("A", "C"), ("B", "A")]
    p = {(r.event, r.next_event): r.p for r in chains.transitions(s).collect()}
    assert p["A", "B"] == 1 / 3 and p["B", "A"] == 1.0
    lines = chains.mermaid_lines(chains.chain_edges(s))
    assert chains.mermaid_text(lines, ["E"]).split("\n")[:3] == ["graph TD;", "    subgraph E", '        "E_0"["A"] --> "E_1"["B"];']
    assert chains.mermaid_text(lines, ["none"]) == chains.NO_CHAINS
    assert chains.chain_edges(s.limit(0)).count() == 0
    f = chains.event_frequency(s)
    assert abs(chains.sequence_probability(chains.transitions(s), f, ["B", "A"]) - 0.5) < 1e-9
