import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from mishaplens.llm import subsequences as sub


def model(rows, steps, support, share):
    seqs = defaultdict(set)
    for s, p, q, i, *_ in rows:
        if s is not None and p is not None and i is not None:
            seqs[s].add((p, q or "", i))
    n = Counter()
    for v in seqs.values():
        chain = [x[2] for x in sorted(v)]
        n.update(set(combinations(chain, steps)))
    return {p: k for p, k in n.items() if k >= support and share * k >= len(seqs)}


def run(spark, rows, steps=3, support=3, share=400):
    df = spark.createDataFrame(rows, "sequence string, place_1 int, place_2 string, item string, code int, n int, at string")
    out = sub.frequent_subsequences(df, steps, support, share).collect()
    return {tuple(r[f"step_{i + 1}"] for i in range(steps)): r.support for r in out}


def data(seed, n=150, hot=0):
    rnd = random.Random(seed)
    items = list("abcdefgh") + ["é", "rare1", "x" * 2000]
    weights = [9, 8, 7, 5, 4, 3, 2, 2, 1, 0.1, 1]
    rows = []
    for s in range(n):
        rows += [(f"s{s}", rnd.choice([None, *range(6)]), rnd.choice([None, "", "1", "2"]), *rnd.choices([*items, None], [*weights, 1])) for _ in range(rnd.randint(0, 8))]
    for s in range(hot):
        rows += [(f"hot{s}", i, None, *rnd.choices(items, weights)) for i in range(400)]
    rows += rows[:40] + [(None, 1, None, "a")]
    rnd.shuffle(rows)
    return [(*r, 1, 2, "clash") for r in rows]


@pytest.mark.parametrize("steps", [2, 3, 4])
def test_against_model(spark, steps):
    rows = data(1)
    assert run(spark, rows, steps) == model(rows, steps, 3, 400)
    assert run(spark, rows, steps, 2, 20) == model(rows, steps, 2, 20)


def test_long_sequences_are_reduced(spark, monkeypatch):
    rows = data(2, 60, hot=3)
    want = model(rows, 3, 4, 400)
    monkeypatch.setattr(sub, "LONG", 50)
    assert run(spark, rows, 3, 4) == want


def test_small_trees(spark, monkeypatch):
    monkeypatch.setattr(sub, "TREE", 7)
    rows = data(3)
    assert run(spark, rows) == model(rows, 3, 3, 400)


def test_empty_and_ties(spark):
    assert run(spark, []) == {}
    same = [(s, 1, None, i, 1, 1, "") for s in "pqr" for i in "ba"] + [(s, 1, "", i, 1, 1, "") for s in "pqr" for i in "ba"]
    assert run(spark, same, 2) == {("a", "b"): 3}


def test_tree_alone():
    rnd = random.Random(4)
    seqs = sorted({tuple(rnd.choices(range(4), k=rnd.randint(1, 7))) for _ in range(80)})
    w = [rnd.randint(1, 5) for _ in seqs]
    want = Counter()
    for s, k in zip(seqs, w):
        for p in set(combinations(s, 3)):
            want[p] += k
    assert dict(sub.CodedTree([list(s) for s in seqs], w).mine(3)) == dict(want)


@pytest.mark.parametrize("steps", [2, 3, 4])
def test_reduced_word_keeps_its_patterns(steps):
    rnd = random.Random(steps)
    for _ in range(150):
        word = rnd.choices("abcd"[: rnd.randint(1, 4)], k=rnd.randint(0, 24))
        keep = [c for c, k in zip(word, sub.reduced_word(word, steps)) if k]
        for k in range(1, steps + 1):
            assert set(combinations(keep, k)) == set(combinations(word, k))
    assert sum(sub.reduced_word(list("abc") * 2000, steps)) <= 4 ** steps


def test_thousands_of_long_sequences(spark, monkeypatch):
    monkeypatch.setattr(sub, "LONG", 20)
    rnd = random.Random(8)
    rows = [(f"s{s}", i, None, rnd.choice("abc" if s % 2 else "cd"), 1, 1, "") for s in range(3000) for i in range(28)]
    assert run(spark, rows, 3, 3) == model(rows, 3, 3, 400)


def test_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(sub, "MAX_FREQUENT", 2)
    rows = data(9)
    assert run(spark, rows) == model(rows, 3, 3, 400)
