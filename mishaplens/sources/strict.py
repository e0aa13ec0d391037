"""Strict load of delimited lines: conforming rows as columns, the rest with the reason they fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from mishaplens.session import stage

# One field with the tab before it. Possessive, so a long text neither backtracks nor recurses.
_FIELD = r'\t("[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|(?!")[^\t"]*+)'
_LINE = r'\A(?:\t(?:"[^"]*+(?:""[^"]*+)*+"(?=\t|\z)|(?!")[^\t"]*+))*+\z'

# The shapes a column may require.
_SHAPES = {"int": "[0-9]{1,6}", "digits6": "[0-9]{6}", "digits3": "[0-9]{3}", "factor": "[CF]"}
_FORBIDDEN = "[\\x{FFFD}\\x7f\\x00-\\x08\\x0b-\\x1f]"

MAX_LAYOUT_ROWS = 10_000


def _is_date(y: Column, m: Column, d: Column) -> Column:
    y, m, d = y.cast("int"), m.cast("int"), d.cast("int")
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= days)


def _obeys(v: Column, rule: str, lo, hi) -> Column:
    """Whether the non-empty text ``v`` meets a column rule; false, never null or an error, for any text."""
    if rule == "free":
        return ~v.rlike(_FORBIDDEN)
    if rule == "key":
        date = F.when(v.rlike(r"\A[0-9]{8}[A-Z][0-9A-Z]{5}\z"), _is_date(F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2)))
        return F.coalesce(date, F.lit(False))
    if rule == "iso_date":
        date = F.when(v.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), _is_date(F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2)))
        return F.coalesce(date, F.lit(False))
    shape = v.rlike(rf"\A(?:{_SHAPES[rule]})\z")
    if rule != "int" or (lo is None and hi is None):
        return shape
    n = F.when(shape, v).cast("int")
    return F.coalesce(n.between(-(10**9) if lo is None else lo, 10**9 if hi is None else hi), F.lit(False))


def read_layout(layout: DataFrame) -> dict[str, list[dict]]:
    """The columns of each file in order, on the driver. A layout describes columns, so its size is checked and refused above a bound."""
    rows = layout.select("file_label", "col_no", "col_label", "col_rule", "is_required", "min_int", "max_int").limit(MAX_LAYOUT_ROWS + 1).collect()
    if len(rows) > MAX_LAYOUT_ROWS:
        raise ValueError("a layout of that many columns is not one")
    out: dict[str, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r.file_label, r.col_no)):
        out.setdefault(r.file_label, []).append(r.asDict())
    return out


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files as strict loading takes them: line_id (unique), file_label (the file's name), line_no (from 1), raw_line.

    Files are split among tasks; each part numbers its lines, and the counts
    of a file's parts tell where each begins. No file is read by one task.
    """
    at = F.monotonically_increasing_id()
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    raw = stage(raw, "lines")
    parts = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("file", "block", "first", before.alias("before"))
    return raw.join(starts, ["file", "block"]).select(
        F.col("at").alias("line_id"), F.element_at(F.split("file", "/"), -1).alias("file_label"), (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), F.col("value").alias("raw_line")
    )


def tokenised(lines: DataFrame) -> DataFrame:
    """Lines with ``fields`` (unquoted, trimmed), null where the quoting is broken."""
    padded = F.concat(F.lit("\t"), "raw_line")
    body = F.when(padded.rlike(_LINE), F.regexp_extract_all(padded, F.lit(_FIELD), F.lit(1)))

    def plain(f: Column) -> Column:
        inner = F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
        return F.trim(F.when(f.startswith('"'), inner).otherwise(f))

    return lines.withColumn("fields", F.transform(body, plain))


def _width(layout: dict[str, list[dict]]) -> Column:
    out = F.lit(0)
    for label, cols in layout.items():
        out = F.when(F.col("file_label") == label, len(cols)).otherwise(out)
    return out


def _values_hold(layout: dict[str, list[dict]]) -> Column:
    """Whether every field of a line of the right width meets its rule."""
    out = F.lit(False)
    for label, cols in layout.items():
        ok = F.lit(True)
        for i, c in enumerate(cols):
            v = F.get("fields", F.lit(i))
            ok = ok & F.when(v == "", F.lit(c["is_required"] != 1)).otherwise(_obeys(v, c["col_rule"], c["min_int"], c["max_int"]))
        out = F.when(F.col("file_label") == label, ok).otherwise(out)
    return out


def conforming(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """The lines that load strictly: line_id, file_label, line_no, fields.

    A line conforms if its quoting is sound, it has as many fields as the
    layout of its file and each field meets its rule. A null line and a line
    of a file without a layout never conform.
    """
    cols = read_layout(layout)
    t = tokenised(lines.select("line_id", "file_label", "line_no", "raw_line"))
    good = F.col("fields").isNotNull() & F.col("file_label").isNotNull() & (F.size("fields") == _width(cols))
    return t.filter(F.when(good, _values_hold(cols)).otherwise(False)).select("line_id", "file_label", "line_no", "fields")


def failing(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """line_id and the first reason that applies: 'quoting', 'columns' or 'bad_value'.

    The offsets (line_id, unique) of the conforming rows are subtracted from
    the raw ones, and only the remainder is diagnosed. A null line counts as
    'columns', as it has no fields; so does a line of an unknown file with
    sound quoting. Empty input gives no rows.
    """
    cols = read_layout(layout)
    raw = lines.select("line_id", "file_label", "raw_line")
    rest = tokenised(raw.join(conforming(lines, layout).select("line_id"), "line_id", "left_anti"))
    reason = (
        F.when(F.col("raw_line").isNotNull() & F.col("fields").isNull(), "quoting")
        .when(F.coalesce(F.size("fields") != _width(cols), F.lit(True)) | (_width(cols) == 0), "columns")
        .otherwise("bad_value")
    )
    return rest.select("line_id", reason.alias("reason"))


def valid_rows(lines: DataFrame, layout: DataFrame, file_label: str) -> DataFrame:
    """The conforming rows of one file as typed columns, with line_id and line_no; empty fields are null."""
    cols = read_layout(layout)[file_label]
    kinds = {"int": "int", "iso_date": "date"}
    rows = conforming(lines.filter(F.col("file_label") == file_label), layout)
    named = [F.nullif(F.get("fields", F.lit(i)), F.lit("")).cast(kinds.get(c["col_rule"], "string")).alias(c["col_label"]) for i, c in enumerate(cols)]
    return rows.select("line_id", "line_no", *named)
