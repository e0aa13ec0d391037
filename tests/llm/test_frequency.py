import random
import re
from collections import Counter, defaultdict

import pytest

from mishaplens.llm import frequency


def model(rows):
    occ, rec, total = Counter(), defaultdict(set), defaultdict(set)
    for f, k, v, *_ in rows:
        if None in (f, k, v):
            continue
        total[f].add(k)
        for unit, t in [("value", v), *[("term", t) for t in re.findall("[a-z0-9]+", v)]]:
            occ[f, unit, t] += 1
            rec[f, unit, t].add(k)
    out = {}
    for (f, u, t), n in occ.items():
        r, T = len(rec[f, u, t]), len(total[f])
        out[f, u, t] = (n, r, "common" if 10 * r >= T else "rare" if r <= 2 else None)
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "field_label string, record string, value string, n int, id int, token string")
    out = frequency.marked(frequency.token_frequencies(df, **kw)).collect()
    got = {(r.field_label, r.unit_label, r.token): (r.occurrences, r.records, r.mark) for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("share", [0.001, 0.05])
def test_against_model(spark, share):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["é", "-", "a", "9"]
    rows = []
    for i in range(6000):
        v = "hot value" if i % 3 == 0 else " ".join(rnd.choices(words, k=rnd.randint(0, 4)))
        rows.append((rnd.choice("fg"), "hot" if i % 4 == 0 else f"k{rnd.randint(0, 300)}", v, 1, 2, "clash"))
    rows += [("f", None, "x", 1, 1, ""), (None, "k", "x", 1, 1, ""), ("f", "k", None, 1, 1, ""), ("f", "k", "long " * 20000, 1, 1, ""), ("f", "k", "", 1, 1, "")]
    assert run(spark, rows, heavy_share=share) == model(rows)


def test_empty(spark):
    assert run(spark, []) == {}


def test_blocks_are_flushed(spark, monkeypatch):
    monkeypatch.setattr(frequency, "BLOCK_BITS", 3)
    rows = [("f", f"k{i % 50}", f"v{i} common", 1, 1, "") for i in range(3000)]
    assert run(spark, rows) == model(rows)


def test_records_that_span_batches(spark):
    rnd = random.Random(5)
    rows = [("f", f"r{rnd.randint(0, 12)}", " ".join(rnd.choices(["a", "b", "c", "d", "e"], k=rnd.randint(0, 6)))) for _ in range(400)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("1", "3", "7"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert run(spark, [(*r, 1, 1, "") for r in rows]) == model(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
