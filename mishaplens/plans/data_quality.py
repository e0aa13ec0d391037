"""Queries of problems 1 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mishaplens.operators import orphans
from mishaplens.sources import strict
from mishaplens.sources.tables import table

CHILDREN = ("aircraft", "findings", "narratives", "events_sequence")


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = orphans.references({t: table(spark, d, t) for t in CHILDREN})
    return refs, orphans.parent_spans(table(spark, d, "incident_events"), table(spark, d, "withdrawn_incidents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_p1(spark, d))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(*_p1(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return strict.failing(table(spark, d, "raw_lines"), table(spark, d, "raw_layout"))


def _p7_valid(label: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return strict.valid_rows(table(spark, d, "raw_lines"), table(spark, d, "raw_layout"), label)

    return run


QUERIES = {
    "p1_found": p1_found,
    "p1_report": p1_report,
    "p7_found": p7_found,
    "p7_valid_events_sequence": _p7_valid("events_sequence.txt"),
    "p7_valid_occurrences": _p7_valid("occurrences.txt"),
    "p7_valid_seq_of_events": _p7_valid("seq_of_events.txt"),
}

_REFS = " UNION ALL ".join(f"SELECT '{t}' AS child_table, ev_id AS raw_id, lchg_date FROM {t}" for t in CHILDREN)
_P1 = f"""
WITH refs AS (
  SELECT child_table, upper(trim(raw_id, ' ')) AS ev_id, lchg_date, coalesce(strftime(lchg_date, '%Y-%m'), 'none') AS lchg_month
  FROM ({_REFS}) WHERE trim(raw_id, ' ') <> ''
), arrived AS (
  SELECT upper(trim(ev_id, ' ')) AS ev_id, min(lchg_date) - INTERVAL 7 DAY AS good_from
  FROM incident_events WHERE trim(ev_id, ' ') <> '' GROUP BY 1
), gone AS (
  SELECT upper(trim(ev_id, ' ')) AS ev_id, min(withdrawn_at) AS good_until
  FROM withdrawn_incidents WHERE trim(ev_id, ' ') <> '' GROUP BY 1
), judged AS (
  SELECT refs.*, arrived.ev_id IS NULL AS unknown,
         arrived.ev_id IS NULL OR coalesce(lchg_date < good_from, false) OR coalesce(lchg_date >= good_until, false) AS orphan
  FROM refs LEFT JOIN arrived USING (ev_id) LEFT JOIN gone USING (ev_id)
)
"""

_FIELD_RE = '("([^"]|"")*"|[^\\t"]*)'


def _p7_ctes() -> str:
    date = lambda y, m, dd: (
        f"(try_cast({y} AS INT) >= 1 AND try_cast({m} AS INT) BETWEEN 1 AND 12 AND try_cast({dd} AS INT) BETWEEN 1 AND "
        f"CASE WHEN try_cast({m} AS INT) = 2 THEN CASE WHEN try_cast({y} AS INT) % 400 = 0 OR (try_cast({y} AS INT) % 4 = 0 AND try_cast({y} AS INT) % 100 <> 0) THEN 29 ELSE 28 END "
        f"WHEN try_cast({m} AS INT) IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"
    )
    return f"""
WITH cut AS (
  SELECT line_id, file_label,
         CASE WHEN regexp_full_match(raw_line, '{_FIELD_RE}(\\t{_FIELD_RE})*') THEN regexp_extract_all(chr(9) || raw_line, '\\t{_FIELD_RE}', 1) END AS f
  FROM raw_lines
), wide AS (SELECT file_label, count(*) AS k FROM raw_layout GROUP BY 1),
fields AS (
  SELECT line_id, file_label, i AS col_no,
         trim(CASE WHEN f[i] LIKE '"%' THEN replace(f[i][2:len(f[i]) - 1], '""', '"') ELSE f[i] END, ' ') AS v
  FROM (SELECT cut.*, unnest(range(1, len(f) + 1)) AS i FROM cut JOIN wide ON cut.file_label = wide.file_label AND len(f) = k)
), bad AS (
  SELECT DISTINCT line_id FROM fields JOIN raw_layout USING (file_label, col_no)
  WHERE CASE WHEN v = '' THEN is_required = 1 ELSE NOT coalesce(CASE col_rule
    WHEN 'key' THEN regexp_full_match(v, '[0-9]{{8}}[A-Z][0-9A-Z]{{5}}') AND {date('v[1:4]', 'v[5:6]', 'v[7:8]')}
    WHEN 'int' THEN regexp_full_match(v, '[0-9]{{1,6}}') AND try_cast(v AS INT) BETWEEN min_int AND max_int
    WHEN 'digits6' THEN regexp_full_match(v, '[0-9]{{6}}')
    WHEN 'digits3' THEN regexp_full_match(v, '[0-9]{{3}}')
    WHEN 'factor' THEN v IN ('C', 'F')
    WHEN 'iso_date' THEN regexp_full_match(v, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND {date('v[1:4]', 'v[6:7]', 'v[9:10]')}
    WHEN 'free' THEN NOT regexp_matches(v, '[\\x{{FFFD}}\\x7f\\x00-\\x08\\x0b-\\x1f]') END, false) END
)
"""


_P7_FOUND = """
SELECT line_id, CASE WHEN f IS NULL THEN 'quoting' WHEN k IS NULL OR len(f) <> k THEN 'columns' ELSE 'bad_value' END AS reason
FROM cut LEFT JOIN wide USING (file_label)
WHERE f IS NULL OR k IS NULL OR len(f) <> k OR line_id IN (SELECT line_id FROM bad)
"""

# The typed columns of each file.
_P7_COLUMNS = {
    "events_sequence.txt": "ev_id aircraft_key:INT occurrence_no:INT occurrence_code occurrence_description phase_no eventsoe_no:INT defining_ev:INT lchg_date:DATE",
    "occurrences.txt": "ev_id aircraft_key:INT occurrence_no:INT occurrence_code phase_of_flight altitude_ft:INT lchg_date:DATE",
    "seq_of_events.txt": "ev_id aircraft_key:INT occurrence_no:INT seq_event_no:INT subject_note cause_factor modifier_code lchg_date:DATE",
}


def _p7_valid_sql(label: str) -> str:
    cols = []
    for i, c in enumerate(_P7_COLUMNS[label].split(), 1):
        name, _, kind = c.partition(":")
        cols.append(f"nullif(max(v) FILTER (WHERE col_no = {i}), '')::{kind or 'VARCHAR'} AS {name}")
    return _p7_ctes() + f"""SELECT line_id, line_no, {', '.join(cols)} FROM fields JOIN raw_lines USING (line_id, file_label)
WHERE file_label = '{label}' AND line_id NOT IN (SELECT line_id FROM bad) GROUP BY 1, 2"""


SQL = {
    "p1_found": _P1 + "SELECT DISTINCT child_table, ev_id, lchg_month FROM judged WHERE orphan",
    "p1_report": _P1
    + """SELECT child_table, lchg_month, count(*) AS n_references, count(*) FILTER (WHERE orphan) AS n_orphans,
  count(*) FILTER (WHERE unknown) AS n_without_parent, count(DISTINCT ev_id) FILTER (WHERE orphan) AS n_orphan_keys
  FROM judged GROUP BY 1, 2""",
    "p7_found": _p7_ctes() + _P7_FOUND,
    **{f"p7_valid_{label.removesuffix('.txt')}": _p7_valid_sql(label) for label in _P7_COLUMNS},
}
