import random

from mishaplens.llm import truncation

NOUNS = ["pilot", "student", "mechanic", "witness", "owner"]
VERBS = ["lowered the nose", "heard a loud bang", "closed the throttle", "felt a vibration in the pedals", "reported light snow"]
PLACES = ["near the field", "at 3000 feet", "during the climb", "after the landing roll", "over the lake"]
FOOTERS = ["Page 3 of 9", "(sent by the regional desk)", "--- end of file ---", "cc: records unit"]
SCHEMA = "item_id long, source string, text string, tokens string, w int, n_chars int"


def sentence(rnd):
    return f"The {rnd.choice(NOUNS)} {rnd.choice(VERBS)} {rnd.choice(PLACES)} and the {rnd.choice(NOUNS)} {rnd.choice(VERBS)} {rnd.choice(PLACES)}."


def corpus(seed=1, n=1500):
    rnd = random.Random(seed)
    rows, cut = [], set()
    for i in range(n):
        t = " ".join(sentence(rnd) for _ in range(rnd.randint(2, 6)))
        src = rnd.choice(["limited", "free", None])
        if src == "limited" and len(t) > 300:
            t = t[:300]
            if not t.endswith("."):
                cut.add(i)
        elif rnd.random() < 0.1:
            t = t[: rnd.randrange(40, len(t) - 20)].rstrip()
            if not t.endswith("."):
                cut.add(i)
            if rnd.random() < 0.3:
                t += rnd.choice(["…", "�"])
                cut.add(i)
        elif rnd.random() < 0.08:
            t = t[:-1]
        if src != "limited" and rnd.random() < 0.2:
            t += rnd.choice(["\n", " ", "\n\n"]) + rnd.choice(FOOTERS)
        rows.append((i, src, t))
    return rows, cut


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    return {r.item_id: r for r in truncation.judged_texts(df).collect()}


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    odd = [(9001, "free", None), (9002, "free", ""), (9003, None, "  \n"), (9004, "free", "see docket"), (9005, "free", "N/A"), (9006, "free", "Page 3 of 9"), (9007, "free", "The pilot lowered the nose near the field." * 3000), (9008, "free", "The " + "x" * 50_000)]
    got = run(spark, rows + odd)
    found = {i for i, r in got.items() if r.truncated and i < 9000}
    recall, precision = len(found & cut) / len(cut), len(found & cut) / len(found)
    assert recall > 0.93 and precision > 0.97, (recall, precision)
    assert not {9001, 9002, 9003} & set(got) and not any(got[i].truncated for i in (9004, 9005, 9006, 9007))
    assert any(r.at_spike and r.source == "limited" for r in got.values())


def test_repeats_and_empty(spark):
    rows, _ = corpus(2, 200)
    got = run(spark, rows + [(1000 + i, s, t) for i, s, t in rows])
    assert all(got[i].truncated == got[1000 + i].truncated for i, _, t in rows if i in got)
    assert run(spark, []) == {}
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    rep = truncation.truncation_report(df).collect()
    assert sum(r.n_texts for r in rep) == 200 and all(0 <= r.truncated_share <= 1 for r in rep)


def test_lengths_decide_first(spark):
    rnd = random.Random(3)
    rows, cut = [], set()
    for i in range(1200):
        t = " ".join(sentence(rnd) for _ in range(rnd.randint(2, 6)))
        if len(t) > 250:
            t = t[:250].rstrip()
            if not t.endswith("."):
                cut.add(i)
            if i % 3 == 0:
                t = f"Ref {rnd.randint(1, 9999)} / {t}"
            elif i % 3 == 1:
                t += rnd.choice([" ", "\n"]) + rnd.choice(FOOTERS)
        rows.append((i, "limited", t))
    got = run(spark, rows)
    by = {i: r.found_by for i, r in got.items()}
    # a cut behind a blank is one character short of the limit
    assert sum(by[i] == "length" for i in cut) > 0.8 * len(cut) and sum(by[i] in ("length", "near_length") for i in cut) > 0.95 * len(cut)
    assert sum(by[i] is not None for i in cut) > 0.98 * len(cut)
    assert not any(by[i] for i in set(got) - cut)


def test_footers_of_any_length_and_pieces_of_words(spark):
    rnd = random.Random(4)
    long = "this copy was made for the archive of the regional desk and is not signed"
    rows, cut = [], set()
    for i in range(1500):
        t = " ".join(sentence(rnd) for _ in range(3))
        if i % 5 == 0:
            t = t[: rnd.randrange(60, 200)].rstrip()
            if not t.endswith("."):
                cut.add(i)
        if i % 7 == 0:
            t += " " + rnd.choice(["ENDE", long])
        rows.append((i, "free", t))
    df = spark.createDataFrame([(*r, "clash", 1, 1) for r in rows], SCHEMA)
    _, footers = truncation.learned_affixes(df, df.select("item_id", "source", "text").mapInArrow(truncation._both_ends, "item_id long, source string, n_chars bigint, n_bytes bigint, n_tokens int, head string, tail string, digest bigint"))
    assert set(footers) == {"ENDE", long}
    found = {i for i, r in run(spark, rows).items() if r.truncated}
    assert len(found & cut) > 0.93 * len(cut) and len(found & cut) > 0.97 * len(found)
