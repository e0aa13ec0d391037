import random

from mishaplens.llm import mixing

TEXTS = "item_id long, source string, size long, h long, repeats int, passes string"
TARGETS = "source string, target_share double, max_repeats int, size int, h int"


def run(spark, texts, targets, **kw):
    t = spark.createDataFrame([(*r, 1, 9, "clash") for r in texts], TEXTS)
    g = spark.createDataFrame([(*r, 1, 1) for r in targets], TARGETS)
    chosen, shares = mixing.mixed(t, g, **kw)
    chosen, shares = chosen.collect(), {r.source: r for r in shares.collect()}
    caps = {}
    for s, _, c in targets:
        if s is not None:
            caps.setdefault(s, c)
    size = {i: (s, n) for i, s, n in texts}
    used = {}
    assert len({r.item_id for r in chosen}) == len(chosen)
    for r in chosen:
        assert size[r.item_id] == (r.source, r["size"]) and 1 <= r.repeats <= caps[r.source]
        used[r.source] = used.get(r.source, 0) + r["size"] * r.repeats
    for s, r in shares.items():
        assert r.used == used.get(s, 0) and abs(r.reached_share - (r.used / sum(used.values()) if used else 0)) < 1e-12
    assert set(shares) == set(caps)
    return chosen, shares


def corpus(seed, n=3000):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = "big" if i % 3 else rnd.choice(["mid", "small", None, "untargeted"])
        out.append((i, s, rnd.choice([None, 0, rnd.randint(1, 50), rnd.randint(1, 400)])))
    return out


def test_targets_are_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_BLOCK", 50)
    texts = corpus(1)
    _, shares = run(spark, texts, [("big", 0.6, 1), ("mid", 0.25, 2), ("small", 0.15, 3), ("none", 0.1, 2), (None, 0.3, 1)])
    for s, t in (("big", 0.6), ("mid", 0.25), ("small", 0.15)):
        assert abs(shares[s].reached_share - t) < 0.004
    assert shares["none"].reached_share == 0


def test_tiny_source_is_pinned(spark):
    texts = [(i, "a", 100) for i in range(1000)] + [(5000, "tiny", 10)]
    chosen, shares = run(spark, texts, [("a", 0.5, 1), ("tiny", 0.5, 3)])
    assert shares["tiny"].used == 30 and shares["a"].used >= 40_000


def test_budget_and_empty(spark):
    texts = [(i, "ab"[i % 2], 10) for i in range(400)]
    _, shares = run(spark, texts, [("a", 0.5, 1), ("b", 0.5, 1)], budget=1000)
    assert shares["a"].used == shares["b"].used == 500
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    assert run(spark, texts, [])[0] == []
    assert run(spark, texts, [("a", 0.0, 1), ("b", 1.0, 0)])[0] == []


def test_exponents():
    sizes = {"a": 900, "b": 90, "c": 10}
    assert abs(sum(mixing.tempered(sizes, 0.3).values()) - 1) < 1e-12
    even = mixing.tempered(sizes, 0.0)
    assert max(even.values()) - min(even.values()) < 1e-12
    for want in (0.5, 0.8, 1.0):
        a = mixing.exponent_for_entropy(sizes, want)
        assert 0 < a < 1 and abs(mixing.entropy(mixing.tempered(sizes, a)) - want) < 1e-6
    assert mixing.exponent_for_entropy(sizes, 0.01) == 1.0 and mixing.exponent_for_entropy(sizes, 9.0) == 0.0
    limits = {k: 2 * v for k, v in sizes.items()}
    a = mixing.exponent_for_limits(sizes, limits, 800)
    keeps = lambda a: all(800 * w <= limits[k] * (1 + 1e-6) for k, w in mixing.tempered(sizes, a).items())
    assert 0 < a < 1 and keeps(a) and not keeps(a - 0.01)


def test_the_exponent_decides_what_limited_sources_leave_over():
    sizes, goal, caps = {"a": 1000, "b": 200, "tiny": 20}, {"a": 0.3, "b": 0.3, "tiny": 0.4}, {"a": 2, "b": 9, "tiny": 3}
    out, a = mixing.plan_mix(sizes, goal, caps, budget=600)
    base = mixing.tempered(sizes, a)
    spare = 600 - 60 - 0.6 * 600
    assert 0 < a < 1 and out["tiny"] == 60
    for k in "ab":
        assert abs(out[k] - 0.3 * 600 - spare * base[k] / (base["a"] + base["b"])) <= 1
    even, e = mixing.plan_mix(sizes, goal, caps, budget=600, target_entropy=0.4)
    assert e > a and even["a"] > out["a"] and even["b"] < out["b"]  # nearer to natural shares
    # half the sum of differences from the targets is what the limit takes away, however it is dealt out
    far = lambda w: sum(abs(w[k] / 600 - goal[k]) for k in goal) / 2
    assert abs(far(out) - (0.4 - 0.1)) < 0.01 and abs(far(even) - far(out)) < 0.01
    assert mixing.plan_mix(sizes, goal, caps, budget=100)[0] == {"a": 30, "b": 30, "tiny": 40}


def test_random_plans_keep_limits_and_use_the_exponent():
    rnd, seen = random.Random(5), set()
    for _ in range(2000):
        n = rnd.randint(1, 8)
        sizes = {f"s{i}": int(10 ** rnd.uniform(0, 6)) for i in range(n)}
        goal = {k: rnd.random() for k in sizes}
        caps = {k: rnd.randint(1, 5) for k in sizes}
        budget = rnd.choice([None, rnd.randint(1, 2 * sum(sizes.values()))])
        out, a = mixing.plan_mix(sizes, goal, caps, budget)
        assert 0 <= a <= 1 and all(0 <= v <= sizes[k] * caps[k] for k, v in out.items())
        if budget is not None:
            assert abs(sum(out.values()) - min(budget, sum(sizes[k] * caps[k] for k in sizes))) <= n
        seen.add(round(a, 3))
    assert len(seen) > 200


def test_no_targets_gives_the_tempered_shares():
    sizes = {"a": 900, "b": 90, "c": 10}
    out, a = mixing.plan_mix(sizes, None, {k: 3 for k in sizes}, budget=100, target_entropy=0.8)
    assert 0 < a < 1 and all(abs(out[k] / 100 - w) < 0.011 for k, w in mixing.tempered(sizes, a).items())


def test_last_block_is_chosen_on_the_executors(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LAST_BLOCK", 3)
    texts = [(i, "ab"[i % 7 == 0], 1 + i % 13) for i in range(3000)]
    _, shares = run(spark, texts, [("a", 0.6, 1), ("b", 0.4, 4)], budget=5001)
    assert 4970 <= shares["a"].used + shares["b"].used <= 5001 and 0 < shares["a"].exponent < 1
