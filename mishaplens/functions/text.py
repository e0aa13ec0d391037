"""Text and key normalisation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What Python's str.strip() removes, as a Java pattern.
STRIP_PATTERN = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Texts that stand for a missing value.
MISSING_TEXTS = ("", "null", "none", "nan")

# Words and phrases that mark a causal sentence in a narrative.
CAUSE_INDICATORS = (
    "failure", "failed", "malfunction", "error", "inadequate", "improper",
    "loss of", "lack of", "unable to", "did not", "fatigue", "corrosion",
    "contamination", "starvation", "exhaustion", "defect", "impairment",
    "deterioration", "mismanagement", "oversight", "omission", "collision",
    "strike", "fracture", "separation", "rupture", "overload", "overheat",
)


def strip(c: Column) -> Column:
    """Without leading and trailing white space as Python's ``str.strip`` sees it; null stays null."""
    return F.regexp_replace(c, STRIP_PATTERN, "")


def key(c: Column) -> Column:
    """Join key of an incident: blanks trimmed, upper case; null or empty gives null."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def clean(c: Column) -> Column:
    """Lower case, runs of blanks and tabs as one blank, trimmed; texts that stand for a missing value give null."""
    v = F.trim(F.regexp_replace(F.lower(c), "[ \\t]+", " "))
    return F.when(~v.isin(*MISSING_TEXTS), v)


def clean_narrative(c: Column) -> Column:
    """Null for 'null' and 'None' (exact); otherwise stripped, then without NUL characters, empty as null."""
    kept = F.when(~c.isin("null", "None"), c)
    return F.nullif(F.replace(strip(kept), F.lit("\x00"), F.lit("")), F.lit(""))


def one_line(c: Column) -> Column:
    """Query-side normaliser: line feeds become blanks."""
    return F.replace(c, F.lit("\n"), F.lit(" "))


def nan_text_to_null(c: Column) -> Column:
    return F.when(F.lower(c) != "nan", c)


def shorten(c: Column, limit: int, mark: str = "...") -> Column:
    """At most ``limit`` characters, then ``mark`` if anything was left out."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def one_decimal(c: Column) -> Column:
    return F.call_function("format_number", c, F.lit("0.0"))


def truthy(c: Column, kind: str = "text") -> Column:
    """Not null and not empty."""
    return F.coalesce((F.length(c) if kind == "text" else F.size(c)) > 0, F.lit(False))


def iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def causes_from_narrative(c: Column, indicators=CAUSE_INDICATORS) -> Column:
    """Causal sentences of a narrative, as an array.

    Texts under 10 characters (stripped) give none. Sentences are split at
    ``.``, ``!`` and ``?``; those of at least 15 characters that hold an
    indicator are kept, cut at 100 characters, duplicates included. Without
    any, the first sentence stands in if it has at least 15 characters.
    """
    pattern = "|".join(r"\Q" + w + r"\E" for w in indicators)
    parts = F.transform(F.split(c, "[.!?]", -1), strip)
    hits = F.filter(parts, lambda s: (F.length(s) >= 15) & F.lower(s).rlike(pattern))
    first = F.filter(F.slice(parts, 1, 1), lambda s: F.length(s) >= 15)
    chosen = F.when(F.size(hits) > 0, hits).otherwise(first)
    empty = F.array().cast("array<string>")
    return F.when(F.length(strip(c)) >= 10, F.transform(chosen, lambda s: F.substring(s, 1, 100))).otherwise(empty)
