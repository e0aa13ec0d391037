import datetime as dt
import random

from mishaplens.operators import orphans

D = dt.datetime


def frames(spark, parents, gone, children):
    p = spark.createDataFrame(parents, "ev_id string, lchg_date timestamp_ntz, n int")
    w = spark.createDataFrame(gone, "ev_id string, withdrawn_at timestamp_ntz")
    c = {k: spark.createDataFrame(v, "ev_id string, lchg_date timestamp_ntz, lchg_month string, n int, known int") for k, v in children.items()}
    return orphans.references(c), orphans.parent_spans(p, w)


def model(parents, gone, children):
    key = lambda s: (s or "").strip(" ").upper()
    first, known, end = {}, set(), {}
    for k, at, *_ in parents:
        if key(k):
            known.add(key(k))
            if at:
                first[key(k)] = min(first.get(key(k), at), at)
    for k, at in gone:
        if key(k) and at:
            end[key(k)] = min(end.get(key(k), at), at)
    found, counts = set(), {}
    for t, rows in children.items():
        for k, at, *_ in rows:
            k = key(k)
            if not k:
                continue
            month = at.strftime("%Y-%m") if at else "none"
            bad = k not in known or at is not None and (k in first and at < first[k] - dt.timedelta(days=7) or k in end and at >= end[k])
            c = counts.setdefault((t, month), [0, 0, 0, set()])
            c[0] += 1
            c[1] += bad
            c[2] += k not in known
            if bad:
                found.add((t, k, month))
                c[3].add(k)
    return found, {k: (a, b, c, len(d)) for k, (a, b, c, d) in counts.items()}


def check(spark, parents, gone, children, **kw):
    refs, spans = frames(spark, parents, gone, children)
    found, counts = model(parents, gone, children)
    assert sorted(tuple(r) for r in orphans.orphan_references(refs, spans, **kw).collect()) == sorted(found)
    got = {(r.child_table, r.lchg_month): (r.n_references, r.n_orphans, r.n_without_parent, r.n_orphan_keys) for r in orphans.orphan_report(refs, spans, **kw).collect()}
    assert got == counts


def test_cases(spark):
    parents = [("A ", D(2020, 1, 10), 1), ("a", D(2020, 2, 1), 1), ("B", None, 1), (None, D(2020, 1, 1), 1), ("", None, 1), ("C", D(2020, 1, 1), 2)]
    gone = [("c", D(2020, 3, 1)), (" C", D(2020, 4, 1)), ("A", None), (None, D(2019, 1, 1)), ("ZZ", D(2019, 1, 1))]
    rows = [("A", D(2020, 1, 3)), ("a", D(2020, 1, 2, 23)), ("B", D(1990, 1, 1)), ("C", D(2020, 3, 1)), ("C", D(2020, 2, 29)), ("x", None), ("A", None), (None, D(2020, 1, 1)), (" ", None), ("ZZ", D(2020, 1, 1))]
    rows = [(*r, "clash", 7, 7) for r in rows]
    check(spark, parents, gone, {"t": rows + rows[:3], "u": rows[3:]})


def test_empty_tables(spark):
    rows = [("A", D(2020, 1, 3), "m", 1, 1)]
    check(spark, [], [], {"t": rows})
    check(spark, [("A", D(2020, 1, 1), 1)], [], {"t": []})


def test_hot_key_and_random(spark):
    rnd = random.Random(3)
    day = lambda: rnd.choice([None, D(2020, 1, 1) + dt.timedelta(days=rnd.randint(0, 200))])
    keys = [f"K{i}" for i in range(40)] + ["x" * 5000]
    parents = [(rnd.choice(keys), day(), 0) for _ in range(60)]
    gone = [(rnd.choice(keys), day()) for _ in range(10)]
    rows = [("K1" if i % 3 == 0 else rnd.choice(keys), day(), "m", 1, 1) for i in range(6000)]
    check(spark, parents, gone, {"t": rows[:3000], "u": rows[3000:]}, heavy_share=0.05)
