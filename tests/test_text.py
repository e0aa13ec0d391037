import random
import re

import pytest
from pyspark.sql import functions as F

from mishaplens.functions import text as T
from mishaplens.functions.vectors import cosine, dot, norm


def causes_model(text, words):
    if text is None or len(text.strip()) < 10:
        return []
    parts = [p.strip() for p in re.split("[.!?]", text)]
    hits = [p[:100] for p in parts if len(p) >= 15 and any(w in p.lower() for w in words)]
    if hits:
        return hits
    return [parts[0][:100]] if len(parts[0]) >= 15 else []


def run(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    None,
    "",
    "too short",
    "Engine failure due to fatigue. Short. Pilot did not check fuel",
    "The sky was blue that day. Nothing else",
    "Blue sky. Nothing else of note here",
    "x" * 130 + " failure" + "y" * 20,
    "The 0.5 inch bolt failure was found",
    " \x1c  Loss of control   ",
]


def test_causes_from_narrative(spark):
    rnd = random.Random(1)
    pool = ["failure", "Loss of ", "wind", ".", "!", "?", " ", "\t", " ", "pilot did not", "aaaaaaaaaaaaaaaa", "é"]
    cases = CASES + ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(300)]
    assert run(spark, cases, T.causes_from_narrative) == [causes_model(c, T.CAUSE_INDICATORS) for c in cases]


def test_clean_narrative(spark):
    got = run(spark, ["null", "None", " null ", None, "", " \x00 ", " a\x00b ", "x"], T.clean_narrative)
    assert got == [None, None, "null", None, None, None, "ab", "x"]


def test_strip_is_pythons(spark):
    cases = [c + "a b" + c for c in [" ", "\t", "\n", "\x1c", "\x1f", " ", " ", "　", ""]]
    assert run(spark, cases, T.strip) == [c.strip() for c in cases]


def test_key_and_clean(spark):
    assert run(spark, ["  a1 ", "", "  ", None, "Ab"], T.key) == ["A1", None, None, None, "AB"]
    assert run(spark, ["  A \t\t b ", "NULL", "none", " nan ", "", None, "x"], T.clean) == ["a b", None, None, None, None, None, "x"]


@pytest.mark.parametrize("n", [3, 80])
def test_shorten(spark, n):
    assert run(spark, ["a" * n, "a" * (n + 1), None], lambda c: T.shorten(c, n)) == ["a" * n, "a" * n + "...", None]


def test_one_decimal(spark):
    values = [405.95, 0.05, 2.25, 1e6, 99.99]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in rows.select(T.one_decimal(F.col("v"))).collect()] == [f"{v:.1f}" for v in values]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    rows = df.select(dot(F.col("a"), F.col("b")), norm(F.col("a")), cosine(F.col("a"), F.col("b"))).collect()
    assert rows[0][0] == 24 and rows[0][1] == 5 and abs(rows[0][2] - 0.96) < 1e-12
    assert rows[1][2] == 0.0
