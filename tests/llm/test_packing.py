import random
from collections import defaultdict
from itertools import combinations

import pytest

from mishaplens.llm import packing
from mishaplens.llm.tokens import load, with_token_counts


def run(spark, sizes, caps, groups=4):
    df = spark.createDataFrame([(i, s, 1, 1, "clash") for i, s in sizes], "item_id long, size long, rest int, part int, limit_label string")
    out = packing.pack(df, caps, groups=groups).collect()
    real = [(i, max(0, s or 0)) for i, s in sizes if i is not None]
    for label, cap in caps.items():
        mine = [r for r in out if r.limit_label == label]
        by_item, by_bin = defaultdict(list), defaultdict(int)
        for r in mine:
            by_item[r.item_id].append(r)
            by_bin[r.bin_no] += r["size"]
        assert all(v <= cap for v in by_bin.values())
        assert sorted(by_bin) == list(range(1, len(by_bin) + 1))
        assert set(by_item) == {i for i, _ in real}
        for i, s in real:
            p = sorted(by_item[i], key=lambda r: r.piece_no)
            assert sum(r["size"] for r in p) == s and len(p) == max(1, -(-s // cap))
            assert [r.start for r in p] == [k * cap for k in range(len(p))] and [r.piece_no for r in p] == list(range(1, len(p) + 1))
    return out


def test_packs_everything(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice([None, -3, 0, 1, 7, 7, 7, rnd.randint(1, 30), rnd.randint(1, 300)])) for i in range(900)] + [(None, 5), (5000, 10_000)]
    out = run(spark, sizes, {"a": 20, "b": 64, "c": 1000})
    for label, cap in (("a", 20), ("b", 64), ("c", 1000)):
        assert max(r.bin_no for r in out if r.limit_label == label) <= first_fit([max(0, s or 0) for i, s in sizes if i is not None], cap)


def first_fit(sizes, cap):
    """Bins that first fit, longest first, needs."""
    full, bins = sum(s // cap for s in sizes), []
    for s in sorted((s % cap for s in sizes), reverse=True):
        for i, b in enumerate(bins):
            if b + s <= cap:
                bins[i] += s
                break
        else:
            bins.append(s)
    return full + len(bins)


def test_hot_size_and_empty(spark):
    run(spark, [(i, 11) for i in range(500)] + [(1000 + i, 9) for i in range(400)], {"x": 20})
    assert run(spark, [], {"x": 20}) == []
    assert [r.bin_no for r in run(spark, [(1, None), (2, 0)], {"x": 20})] == [1, 1]
    run(spark, [(1, 40), (2, 60)], {"x": 20})


def test_fullest_is_the_best():
    rnd = random.Random(2)
    for _ in range(200):
        counts = {rnd.randint(1, 15): rnd.randint(1, 3) for _ in range(rnd.randint(1, 5))}
        room = rnd.randint(0, 30)
        got = packing.fullest(sorted(counts, reverse=True), counts, room)
        items = [x for x, n in counts.items() for _ in range(n)]
        best = max(s for k in range(len(items) + 1) for c in combinations(items, k) if (s := sum(c)) <= room)
        assert sum(got) == best and all(got.count(x) <= counts.get(x, 0) for x in got)


def test_bad_capacity(spark):
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], {"x": 0})


def test_token_counts_round_trip(spark):
    texts = [None, "", "The engine quit.", "naïve – 東京 \x00 �", "<|endoftext|>", "a" * 50_000, "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    enc = load("/opt/tokenizers/byte_bpe_50k.tiktoken")
    for r in with_token_counts(df).collect():
        ids = enc.encode_ordinary(r.text) if r.text else []
        assert r.n_tokens == len(ids) and enc.decode(ids) == (r.text or "")


def test_groups_follow_the_commonest_size(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 50)
    run(spark, [(i, 11) for i in range(500)] + [(1000 + i, 45 + i % 3) for i in range(300)], {"x": 20}, groups=None)
    assert run(spark, [], {"x": 20}, groups=None) == []
