import math
import random
from collections import Counter
from itertools import combinations

import pytest

from mishaplens.llm import pairs, queries


def model(rows, support, share=None, lift=None):
    baskets = {}
    for b, i, *_ in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    n = Counter(i for s in baskets.values() for i in s)
    ab = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    total = len(baskets)
    return {
        (a, b): (n[a], n[b], k)
        for (a, b), k in ab.items()
        if k >= support and (share is None or share * k >= total) and (lift is None or k * total >= lift * n[a] * n[b])
    }


def run(spark, rows, support, share=None, lift=None):
    df = spark.createDataFrame(rows, "basket string, item string, n int, code int, mask string, a int")
    out = pairs.item_pairs(df, support, share, lift).collect()
    for r in out:
        assert abs(r.lift - r.n_ab * r.n_baskets / (r.n_a * r.n_b)) < 1e-9 and abs(r.pmi - math.log(r.lift)) < 1e-9
    return {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab) for r in out}


def data(seed, hot):
    rnd = random.Random(seed)
    items = [f"i{k}" for k in range(400)] + ["é", "Z", "z" * 3000]
    rows = []
    for b in range(300):
        start = rnd.randrange(300)
        rows += [(f"b{b}", items[(start + rnd.randrange(8)) % len(items)]) for _ in range(rnd.randint(0, 7))]
    for b in hot:
        rows += [(f"hot{b}", i) for i in items if rnd.random() < 0.9]
    rows += rows[:50] + [(None, "x"), ("b1", None), (None, None)]
    rnd.shuffle(rows)
    return [(*r, 1, 2, "clash", 3) for r in rows]


@pytest.mark.parametrize("hot", [range(0), range(1), range(3), range(9)])
def test_against_model(spark, monkeypatch, hot):
    monkeypatch.setattr(pairs, "BLOCK", 100)
    rows = data(len(hot), hot)
    assert run(spark, rows, 3) == model(rows, 3)
    assert run(spark, rows, 2, 100, 3) == model(rows, 2, 100, 3)


def test_dictionary_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BROADCAST_ITEMS", 10)
    rows = data(11, range(2))
    assert run(spark, rows, 3) == model(rows, 3)


def test_empty_and_single(spark):
    assert run(spark, [], 1) == {}
    one = [("b", "x", 1, 1, "", 1), ("b", "x", 1, 1, "", 1), ("c", "y", 1, 1, "", 1)]
    assert run(spark, one, 1) == {}


def test_report_of_all_pairs(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(pairs, "BLOCK", 100)
    rows = [(b, i) for b, i, *_ in data(12, range(2)) if b and i and i != "Z"]
    found = [(f" {b} ", i.upper() if i != "é" else i, "c ") for b, i in rows] + [("b1", "x", "N"), ("b1", "none", "C")]
    spark.createDataFrame(found, "ev_id string, finding_description string, cause_factor string").write.parquet(f"{tmp_path}/findings.parquet")
    out = {(r.item_a, r.item_b): (r.n_a, r.n_b, r.n_ab) for r in queries.QUERIES["p2_all_pairs"](spark, str(tmp_path)).collect()}
    want = model(rows, 1)
    assert out == want and min(n for _, _, n in want.values()) == 1


def test_more_big_baskets_than_the_mask_holds(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 40)
    rnd = random.Random(13)
    items = [f"i{k}" for k in range(70)]
    rows = [(f"b{b}", i, 1, 1, "", 1) for b in range(75) for i in items if rnd.random() < 0.97]
    taken = []
    way = pairs._blocked_pairs
    monkeypatch.setattr(pairs, "_blocked_pairs", lambda coded, big: taken.append(big.count()) or way(coded, big))
    assert run(spark, rows, 66) == model(rows, 66)
    assert taken == [75 - pairs.HOT_BASKETS]
