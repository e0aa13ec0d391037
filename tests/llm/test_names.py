import random

import numpy as np

from mishaplens.llm import names as N

MAKERS = [
    (1, "maker", "Kiethash Industries Limited", "KTIL", None, None), (2, "maker", "Kiethamh Industries Limited", None, "Wielern Planes", None), (3, "maker", "Klalesh Helicopter Division", "KLHD", None, None),
    (4, "maker", "Klalesh Aviation Corporation", "KLAC", None, None), (5, "maker", "Theodore Seackuck Aircraft Company", "SCAC", None, None), (6, "maker", "Brirorn Aviation Corporation", "BRAC1", None, None),
    (7, "model", "Kethick 860", None, None, 1), (8, "model", "Flienarn 610", "FL610", None, 1), (9, "model", "Flienarn 630", "FL630", None, 1), (None, "maker", "No id", None, None, None), (10, "maker", None, None, None, None),
]
REF = "ref_id long, ref_field string, ref_label string, short_form string, also_known string, maker_ref_id long"


def run(spark, spellings, field="maker", kind=N.Reference):
    df = spark.createDataFrame([(s, 5, 5, "clash") for s in spellings], "spelling string, ref_id int, n_rows int, ref_label string")
    out = N.attributed(df, spark.createDataFrame(MAKERS, REF), field, kind).collect()
    assert len({r.spelling for r in out}) == len(out)
    return {r.spelling: r.ref_id for r in out}


def test_makers(spark):
    want = {
        "KIETHASH INDUSTRIES LIMITED": 1, "Kieth-ash Inds. Ltd": 1, "Industries Limited, Kiethash": 1, "K1ethash": 1, "ktil": 1, "K.T.I.L. Industries": 1, "Kiethamh Ind Ltd": 2, "wielern planes": 2,
        "Klalesh Hel. Division": 3, "klhd": 3, "Klalesh Av. Corp": 4, "Klálésh Aviation": 4, "Ted Seackuck": 5, "Seackuck, T., Aircraft Co": 5, "SEACKUKC": 5, "br-ac1": 6, "BrirornAviation Corp.": 6,
    }
    none = ["Unknown", "N/A", "", "   ", None, "?", "Plairombul Aircraft", "Homebuilt", "x" * 10000, "é"]
    got = run(spark, [*want, *none, *want])
    assert got == want


def test_models(spark):
    want = {"FLIENARN-610": 8, "630, Flienran": 9, "fl 610": 8, "Model Kethick 860": 7, "Kethick Mk 0860": 7, "860 KEHICK": 7, "FL-630": 9}
    assert run(spark, [*want, "Flienarn 620", "Kit", "860", "", None, "EXP"], "model", N.ModelReference) == want


def test_empty(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([("Kiethash",)], "spelling string")
    assert N.attributed(df, spark.createDataFrame([], REF), "maker").count() == 0


def test_prior_decides_ties(spark):
    got = run(spark, ["Klalesh"] + ["Klalesh Aviation Corporation"] * 30 + ["Klalesh Helicopter Division"])
    assert got["Klalesh"] == 4


def test_held_out_typos(spark):
    rnd = random.Random(6)
    want = {}
    for ref, field, label, *_ in MAKERS:
        if field == "maker" and ref and label and ref not in (1, 2):
            for _ in range(40):
                s = list(label)
                for _ in range(2):
                    i = rnd.randrange(len(s) - 1)
                    k = rnd.randrange(3)
                    if k == 0:
                        s[i], s[i + 1] = s[i + 1], s[i]
                    elif k == 1:
                        del s[i]
                    else:
                        s.insert(i, rnd.choice("aeinrst"))
                want["".join(s)] = ref
    got = run(spark, list(want))
    assert sum(got.get(s) == r for s, r in want.items()) >= 0.99 * len(want)


def test_channel_costs_against_plain_distance():
    def plain(a, b):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                d[i, j] = i + j if not i * j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        return d[len(a), len(b)]

    rnd = random.Random(7)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(0, 7))) for _ in range(200)]
    a, b = words[:100], words[100:]
    cost = N.channel_costs(a, b)
    for x, y, c in zip(a, b, cost):
        assert 0.6 * plain(x, y) - 1e-6 <= c * 1.5 + 1e-6 and c <= 1.2 * plain(x, y) + 1e-6 and (c < 1e-6) == (x == y)


def test_labels_of_any_length(spark):
    long = "Verylongnamed" * 10 + " X"
    ref = spark.createDataFrame([(1, "maker", "Qx", None, None, None), (2, "maker", long, None, None, None), (3, "model", "747-400B", None, None, None), (4, "model", "Cub", None, None, None), (5, "model", "Zed 40", None, None, None)], REF)
    assert len(N.compact(long)) == 131
    for field, kind, want in (("maker", N.Reference, {"Qx": 1, "QX": 1, long: 2, long.upper(): 2, long.replace("named", "nmed", 1): 2}), ("model", N.ModelReference, {"747-400B": 3, "747 400b": 3, "cub": 4, "Zed 040": 5, "ZED40": 5})):
        df = spark.createDataFrame([(s,) for s in [*want, "y" * 5000]], "spelling string")
        assert {r.spelling: r.ref_id for r in N.attributed(df, ref, field, kind).collect()} == want


def test_short_names_are_learned(spark):
    ref = spark.createDataFrame([(i, "maker", f"Robert {w} Aircraft Company", None, None, None) for i, w in enumerate(["Kluraol", "Tumanem", "Vessinor"])], REF)
    df = spark.createDataFrame([(s,) for s in ["Bob Kluraol Aircraft Company", "Bob Tumanem Aircraft", "Bob Vesinor", "BobKlurol"]], "spelling string")
    got = {r.spelling: (r.ref_id, round(r.cost, 2)) for r in N.attributed(df, ref, "maker").collect()}
    assert {k: v[0] for k, v in got.items()} == {"Bob Kluraol Aircraft Company": 0, "Bob Tumanem Aircraft": 1, "Bob Vesinor": 2, "BobKlurol": 0}
    assert got["Bob Kluraol Aircraft Company"][1] == N.LEARNED


def test_blocking_loses_little():
    rnd = random.Random(9)
    syllables = ["ka", "lo", "mir", "ten", "su", "ba", "rol", "vik", "ne", "dra", "pos", "ux", "em", "ti", "gor"]
    cores = sorted({"".join(rnd.choices(syllables, k=rnd.randint(2, 4))) for _ in range(400)})
    ref = N.Reference([(i, f"{c.title()} Aircraft Company", None, None) for i, c in enumerate(cores)])
    typed = []
    for i, c in enumerate(cores):
        s = list(c)
        for _ in range(1 + len(s) // 8):
            j = rnd.randrange(len(s))
            s[j : j + 1] = rnd.choice([[], [s[j], s[j]], [rnd.choice("aeioklmnt")]])
        typed.append(["".join(s) or c, "aircraft", "co"])
    blocked = ref.candidates(typed)
    ref.needed[:] = 0
    ref._near = lambda s: np.arange(len(cores))
    whole = ref.candidates(typed)
    best = [min(w, key=w.get) for w in whole if w]
    kept = [i for i, w in enumerate(whole) if w and min(w, key=w.get) in blocked[i]]
    assert len(kept) >= 0.99 * len(best)


def test_reference_in_blocks(spark, monkeypatch):
    rnd = random.Random(11)
    ref = [(i, "maker", "".join(rnd.choices(["ka", "lo", "mir", "ten", "su", "rol", "vik", "dra", "gor"], k=4)).title() + " Aircraft", f"C{i}X" if i % 3 else None, None, None) for i in range(40)]
    typed = [r[2].upper() for r in ref] + [r[2][:4] + r[2][5:] for r in ref] + [r[3].lower() for r in ref if r[3]] + ["nothing at all"]
    df, ref = spark.createDataFrame([(s,) for s in typed], "spelling string"), spark.createDataFrame(ref, REF)
    whole = {tuple(r) for r in N.attributed(df, ref, "maker").collect()}
    monkeypatch.setattr(N, "MAX_REFERENCE", 7)
    assert {tuple(r) for r in N.attributed(df, ref, "maker").collect()} == whole and len(whole) >= 100


def rows(spark, typed, ref, kind=N.Reference, field="maker"):
    df = spark.createDataFrame([(s,) for s in typed], "spelling string")
    return {tuple(r) for r in N.attributed(df, spark.createDataFrame(ref, REF), field, kind).collect()}


def test_all_learned_words_count(spark, monkeypatch):
    monkeypatch.setattr(N, "MAX_REFERENCE", 7)
    short = ["Bob", "Rick", "Hank", "Chuck", "Dick", "Jake", "Ned", "Polly", "Gus", "Wim", "Tex", "Zeke"]
    ref = [(i, "maker", f"{given} {w} Aircraft Company", None, None, None) for i, (given, w) in enumerate([("Robert", "Kluraol"), ("Robert", "Tumanem"), ("Oswald", "Vessinor")])]
    want = {f"{n} {w}": k for n in short for k, w in enumerate(["Kluraol Aircraft Company", "Tumanem Aircraft"])}
    for limit in (10**6, 150):
        monkeypatch.setattr(N, "MAX_FORMS", limit, raising=False)
        got = {r[0]: (r[2], round(r[4], 2)) for r in rows(spark, want, ref)}
        assert {s: k for s, (k, _) in got.items()} == want
        assert all(cost == (N.LEARNED if s.endswith("Company") else N.LEARNED + 0.3) for s, (_, cost) in got.items())


def test_blocks_and_pieces_give_the_rows_of_the_whole(spark, monkeypatch):
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choices(["ka", "lo", "mir", "ten", "su", "rol", "vik", "dra", "gor"], k=3)).title()
    given, ends = ["Robert", "Theodore", "William"], ["Aircraft Company", "Aviation", "Planes Limited Works"]
    makers = [(i, "maker", f"{rnd.choice(given)} {word()} {rnd.choice(ends)}" if i % 2 else f"{word()} {rnd.choice(ends)}", f"C{i % 25}X" if i % 3 else None, f"{word()} Works" if i % 5 == 0 else None, None) for i in range(30)]
    models = [(i, "model", f"{word()} {600 + 10 * (i % 9)}" if i % 4 else f"{word()} {word()} B", f"M{i % 30}" if i % 3 else None, None, None) for i in range(30)]
    short = {"Robert": ["Bob", "Rob"], "Theodore": ["Ted"], "William": ["Bill", "Will", "Liam"]}
    for ref, kind, field in ((makers, N.Reference, "maker"), (models, N.ModelReference, "model")):
        typed = [r[2] for r in ref] + [r[3] for r in ref if r[3]] + [r[4] for r in ref if r[4]]
        for label in list(typed):
            first, *rest = label.split(" ")
            typed += [" ".join([n, *rest[:2]]) for n in short.get(first, ["Super", "Mk"] if kind is N.ModelReference else [])]
            typed += [f"{n} {label}" for n in ("Super", "Kit")] if kind is N.ModelReference else []
            typed += [label[:k] + label[k + 1 :] for k in rnd.sample(range(len(label)), 2)]
        whole = rows(spark, typed, ref, kind, field)
        assert len(whole) >= 120
        with monkeypatch.context() as m:
            m.setattr(N, "MAX_REFERENCE", 15)
            m.setattr(N, "MAX_FORMS", 100 if kind is N.Reference else 2, raising=False)
            assert rows(spark, typed, ref, kind, field) == whole


def test_added_words_of_any_length():
    ref = N.Reference([(1, "Robert Kluraol Aircraft Company", None, None), (2, "James Tumanem Aircraft Company", None, None)])
    assert ref.candidates([["r" + "x" * 300, "kluraol", "aircraft", "company"]]) == [{1: N.LEARNED + 0.8}]
    long = "experimental" * 5
    assert list(N.ModelReference([(1, "Flienarn 610", None, None)], {"": {long}}).candidates([[long, "flinarn", "610"]])[0]) == [1]
