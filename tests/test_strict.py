import datetime as dt
import random
import re

from mishaplens.sources import strict

LAYOUT = [
    ("f", 1, "id", "key", 1, None, None), ("f", 2, "n", "int", 1, 1, 99), ("f", 3, "t", "free", 0, None, None), ("f", 4, "c", "factor", 0, None, None),
    ("f", 5, "six", "digits6", 0, None, None), ("f", 6, "d", "iso_date", 0, None, None), ("g", 1, "only", "digits3", 0, None, None),
]
GOOD = "20200229A00ZZ9\t12\ttext\tC\t123456\t2021-12-31"


def split_model(line):
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            j = i + 1
            while True:
                j = line.find('"', j)
                if j < 0:
                    return None
                if line[j + 1 : j + 2] == '"':
                    j += 2
                    continue
                break
            if j + 1 < len(line) and line[j + 1] != "\t":
                return None
            out.append(line[i + 1 : j].replace('""', '"'))
            i = j + 1
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            if '"' in line[i:j]:
                return None
            out.append(line[i:j])
            i = j
        if i >= len(line):
            return out
        i += 1
        if i == len(line):
            return out + [""]


def is_date(s):
    try:
        dt.date(int(s[:4]), int(s[4:6]), int(s[6:8]))
        return True
    except ValueError:
        return False


def value_ok(v, rule, lo, hi):
    full = lambda p: re.fullmatch(p, v, re.ASCII) is not None
    return {
        "key": lambda: full("[0-9]{8}[A-Z][0-9A-Z]{5}") and is_date(v[:8]), "int": lambda: full("[0-9]{1,6}") and lo <= int(v) <= hi, "digits6": lambda: full("[0-9]{6}"), "digits3": lambda: full("[0-9]{3}"),
        "factor": lambda: v in ("C", "F"), "iso_date": lambda: full("[0-9]{4}-[0-9]{2}-[0-9]{2}") and is_date(v.replace("-", "")), "free": lambda: not re.search("[�\x7f\x00-\x08\x0b-\x1f]", v),
    }[rule]()


def reason_model(label, line):
    cols = [c for c in LAYOUT if c[0] == label]
    if line is None:
        return "columns"
    fields = split_model(line)
    if fields is None:
        return "quoting"
    if len(fields) != len(cols) or not cols:
        return "columns"
    for v, (_, _, _, rule, must, lo, hi) in zip((f.strip(" ") for f in fields), cols):
        if v == "" and must or v != "" and not value_ok(v, rule, lo, hi):
            return "bad_value"
    return None


def test_against_model(spark):
    rnd = random.Random(5)
    lines = [GOOD, None, "", "\t", GOOD.replace("text", '"a\tb\n""c"""'), GOOD.replace("text", '"a"b'), GOOD.replace("text", 'a"b'), GOOD.replace("text", '"'), GOOD.replace("text", '""'), GOOD + "\t", GOOD + "\r"]
    lines += [GOOD.replace("20200229", "20210229"), GOOD.replace("\t12\t", "\t0\t"), GOOD.replace("\t12\t", "\t٣\t"), GOOD.replace("\t12\t", "\t\t"), GOOD.replace("\t12\t", "\t 7 \t"), GOOD.replace("text", "x�"), GOOD.replace("text", "\x7f")]
    lines += [GOOD.replace("text", '"' + '""' * 20000 + '"'), GOOD.replace("text", "y" * 200000), GOOD.replace("2021-12-31", "2021-02-30"), GOOD.replace("2021-12-31", "0000-01-01")]
    for _ in range(400):
        s = list(GOOD)
        for _ in range(rnd.randint(1, 4)):
            s[rnd.randrange(len(s))] = rnd.choice(['"', "\t", "", " ", '""', "9", "X", "\n", "\x0b"])
        lines.append("".join(s))
    rows = [(i, label, i, s, "clash") for label in ("f", "g", "unknown") for i, s in enumerate(lines, {"f": 0, "g": 10_000, "unknown": 20_000}[label])] + [(30_000, None, 1, "a", "c")]
    df = spark.createDataFrame(rows, "line_id long, file_label string, line_no long, raw_line string, fields string")
    layout = spark.createDataFrame(LAYOUT, "file_label string, col_no int, col_label string, col_rule string, is_required int, min_int int, max_int int")
    want = {(i, reason_model(label, s)) for i, label, _, s, _ in rows}
    got = {tuple(r) for r in strict.failing(df, layout).collect()}
    assert got == {w for w in want if w[1]}
    valid = strict.valid_rows(df, layout, "f").collect()
    assert {r.line_id for r in valid} == {i for i, label, _, s, _ in rows if label == "f" and reason_model("f", s) is None}
    assert next(r for r in valid if r.line_id == 0).asDict() == {"line_id": 0, "line_no": 0, "id": "20200229A00ZZ9", "n": 12, "t": "text", "c": "C", "six": "123456", "d": dt.date(2021, 12, 31)}


def test_empty(spark):
    df = spark.createDataFrame([], "line_id long, file_label string, line_no long, raw_line string")
    layout = spark.createDataFrame(LAYOUT, "file_label string, col_no int, col_label string, col_rule string, is_required int, min_int int, max_int int")
    assert strict.failing(df, layout).count() == 0 and strict.valid_rows(df, layout, "f").count() == 0
    one = spark.createDataFrame([(1, "f", 1, GOOD)], df.schema)
    assert [tuple(r) for r in strict.failing(one, layout.limit(0)).collect()] == [(1, "columns")]


def test_numbered_lines(spark, tmp_path):
    lines = {"a.txt": [f"row {i} " + "x" * (i % 50) for i in range(3000)], "b.txt": ["one", "", "three"]}
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = strict.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(r.file_label, r.line_no): r.raw_line for r in got} == {(n, i + 1): x for n, rows in lines.items() for i, x in enumerate(rows)}
    assert len({r.line_id for r in got}) == len(got) == 3003
