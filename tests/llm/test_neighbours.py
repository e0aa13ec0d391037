import numpy as np
import pytest

from mishaplens.llm import neighbours as nb, queries
from mishaplens.llm.router import Router, balanced_parts, neighbour_graph

SCHEMA = "entry_id long, embedding array<float>, owner string, cell long, vec binary"


def clusters(n, dim, seed, each=6, noise=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((n // each, dim))
    x = np.repeat(c, each, 0) + noise * rng.standard_normal((n // each * each, dim)) * np.linalg.norm(c, axis=1).mean() / np.sqrt(dim)
    return (x * rng.uniform(0.1, 10, (len(x), 1))).astype("f4")


def brute(x, owner, k, least=None):
    u = x / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    for i in range(len(x)):
        for j in range(len(x)):
            if i == j or owner[i] is not None and owner[i] == owner[j]:
                s[i, j] = -2
    out = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (-s[i, j], j))[:k]
        out[i] = [j for j in order if s[i, j] > (-1.5 if least is None else least)]
    return out, s


def run(spark, x, owner, **kw):
    rows = [(i, v.tolist(), "clash", 1, None) for i, v in enumerate(x)]
    bad = [(9001, None, "", 1, None), (9002, [1.0], "", 1, None), (9003, [0.0] * x.shape[1], "", 1, None), (9004, [float("nan")] + [1.0] * (x.shape[1] - 1), "", 1, None), (9005, [None] + [1.0] * (x.shape[1] - 1), "", 1, None), (None, [1.0] * x.shape[1], "", 1, None), (9006, [float("inf")] * x.shape[1], "", 1, None)]
    v = spark.createDataFrame(rows + rows[:20] + bad, SCHEMA)
    o = spark.createDataFrame([(i, k, "clash") for i, k in enumerate(owner)] + [(i, k, "again") for i, k in enumerate(owner[:9])], "entry_id long, owner string, vec string")
    out = {}
    for r in nb.nearest_neighbours(v, o, dim=x.shape[1], **kw).collect():
        out.setdefault(r.entry_id, {})[r.place] = r.neighbour_id
    return {i: [v[p] for p in sorted(v)] for i, v in out.items()}


def test_exact_when_small(spark):
    x = clusters(240, 16, 1)
    owner = [None if i % 7 == 0 else f"o{i // 4}" for i in range(len(x))]
    want, s = brute(x, owner, 5)
    got = run(spark, x, owner)
    for i, w in want.items():
        assert len(got[i]) == len(w) and max(abs(s[i, a] - s[i, b]) for a, b in zip(got[i], w)) < 1e-4
    want, _ = brute(x, owner, 3, 0.9)
    got = run(spark, x, owner, k=3, min_cosine=0.9)
    assert sum(set(got.get(i, [])) == set(w) for i, w in want.items()) >= len(x) - 2


def test_learned_parts_and_cells(spark, monkeypatch):
    monkeypatch.setattr(nb, "PART_ROWS", 150)
    x = clusters(2400, 16, 2, noise=0.2)
    owner = [None] * len(x)
    want, _ = brute_fast(x, 5)
    for cell in (20_000, 60):
        monkeypatch.setattr(nb, "CELL_ROWS", cell)
        got = run(spark, x, owner, margin=3.0)
        hit = sum(len(set(got[i]) & set(want[i])) for i in range(len(x)))
        assert hit / (5 * len(x)) >= 0.97


def test_two_levels(spark, monkeypatch):
    monkeypatch.setattr(nb, "PART_ROWS", 100)
    monkeypatch.setattr(nb, "MAX_PARTS", 4)
    monkeypatch.setattr(nb, "SAMPLE_PER_PART", 60)
    x = clusters(2400, 16, 4, noise=0.2)
    want, _ = brute_fast(x, 5)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "entry_id long, embedding array<float>")
    index = nb.fit_index(v, 16, 1.5)
    assert index.n_inner == 4 and len(index.inner) == 4
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    row, part, own = index.locate(unit)
    assert (row[own] == np.arange(len(x))).all() and len(np.unique(part[own])) > 8 and len(row) < 10 * len(x)
    got = run(spark, x, [None] * len(x), margin=1.5)
    assert sum(len(set(got[i]) & set(want[i])) for i in range(len(x))) / (5 * len(x)) >= 0.9


def test_sample_bounds_the_first_level(spark, monkeypatch):
    monkeypatch.setattr(nb, "PART_ROWS", 100)
    monkeypatch.setattr(nb, "SAMPLE_PER_PART", 100)
    monkeypatch.setattr(nb, "MAX_SAMPLE", 500)
    x = clusters(2400, 16, 5, noise=0.2)
    want, _ = brute_fast(x, 5)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "entry_id long, embedding array<float>")
    index = nb.fit_index(v, 16, 2.0)
    assert index.router.weights[2].shape[1] == 4 and index.n_inner == 4
    got = run(spark, x, [None] * len(x), margin=2.0)
    assert sum(len(set(got[i]) & set(want[i])) for i in range(len(x))) / (5 * len(x)) >= 0.9


def brute_fast(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {i: np.argsort(-s[i])[:k].tolist() for i in range(len(x))}, s


def test_query_finds_far_neighbours_through_parts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(nb, "PART_ROWS", 60)
    x = clusters(4000, 64, 6, each=20, noise=1.0)
    want, s = brute_fast(x, 5)
    assert np.median([s[i, w[4]] for i, w in want.items()]) < 0.65
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "entry_id long, embedding array<float>").write.parquet(f"{tmp_path}/entry_vectors.parquet")
    spark.createDataFrame([(i, f"k{i}") for i in range(len(x))], "entry_id long, ev_id string").write.parquet(f"{tmp_path}/embeddings_map.parquet")
    got = queries.QUERIES["p5_neighbours"](spark, str(tmp_path)).collect()
    assert sum(r.neighbour_id in want[r.entry_id] for r in got) / (5 * len(x)) >= 0.9


def test_ties_and_equal_vectors(spark):
    x = np.ones((9, 4), "f4")
    got = run(spark, x, [None] * 9, k=3)
    assert got[0] == [1, 2, 3] and got[5] == [0, 1, 2]
    assert run(spark, x, ["same"] * 9) == {}


def test_empty(spark):
    v = spark.createDataFrame([], SCHEMA)
    o = spark.createDataFrame([], "entry_id long, owner string")
    assert nb.nearest_neighbours(v, o).count() == 0


@pytest.mark.parametrize("parts", [2, 8])
def test_parts_are_balanced_and_learned(parts):
    x = clusters(1600, 16, 3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = neighbour_graph(x, 5)
    p = balanced_parts(g, parts)
    size = np.bincount(p, minlength=parts)
    assert size.max() - size.min() <= parts and (p[g] == p[:, None]).mean() > 0.8
    held = np.arange(len(x)) % 5 == 0
    gs = neighbour_graph(x[~held], 5)
    ps = balanced_parts(gs, parts)
    odds = Router.fit(x[~held], gs, ps, parts, epochs=30).log_odds(x[held])
    near = (x[held] @ x[~held].T).argmax(1)
    top2 = np.argsort(-odds, 1)[:, :2]
    assert (top2 == ps[near][:, None]).any(1).mean() > 0.7
