"""The intrinsic scores of a record's fields (C1 to C9), as columns."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.common import blank, has_any, messages, strip, when_first
from rollbook.schema import COUNT_FIELDS, FIELDS, TEXT_FIELDS, WEIGHTS

# The words and patterns that scores look for.
COUNCIL_WORDS = ("council", "borough", "city", "district", "county")
STREET_WORDS = ("street", "road", "avenue", "lane", "drive", "close", "way", "place")
POSTCODE = r"[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}"
THRESHOLD = 0.7


def council_score(c: Column) -> Column:
    s = strip(c)
    return when_first((blank(c), 0.0), (F.length(s) < 3, 0.3), (has_any(F.lower(s), COUNCIL_WORDS), 0.9), other=0.7)


def reference_score(c: Column) -> Column:
    s = strip(c)
    return when_first(
        (blank(c), 0.0),
        (F.upper(s).rlike(r"^[A-Z]{2,5}\d+$"), 0.95),
        (s.rlike(r"^\d{2,4}[/-]\w+[/-]?\d*$"), 0.9),
        (s.rlike(r"^\d{3,}$"), 0.8),
        (F.upper(s).rlike(r"^[A-Z0-9/-]{3,}$"), 0.6),
        other=0.4,
    )


def address_score(c: Column) -> Column:
    s = strip(c)
    parts = F.lit(0.5) + F.when(F.upper(s).rlike(POSTCODE), 0.3).otherwise(0.0) + F.when(has_any(F.lower(s), STREET_WORDS), 0.15).otherwise(0.0) + F.when(s.rlike(r"^\d"), 0.05).otherwise(0.0)
    return F.when(blank(c), 0.0).when(F.length(s) < 10, 0.3).otherwise(F.least(parts, F.lit(1.0)))


def date_score(c: Column) -> Column:
    s = strip(c)
    return when_first((blank(c), 0.0), (s.rlike(r"^\d{4}-\d{2}-\d{2}$"), 0.95), (s.rlike(r"^(\d{2}-\d{2}|\d{1,2}/\d{1,2})[/-]\d{4}$") & s.rlike(r"^\d+/\d+/|^\d+-\d+-"), 0.8), (s.rlike(r"\d{4}"), 0.4), other=0.1)


def number_score(c: Column, field: str) -> Column:
    must, most, beyond = field in ("max_occupancy", "number_of_storeys"), *{"max_occupancy": (50, 0.6), "number_of_storeys": (10, 0.5)}.get(field, (20, 0.6))
    return F.when(c < 0, 0.0).when(c == 0, 0.2 if must else 0.6).when(c <= most, 0.9).otherwise(beyond)


def name_score(c: Column) -> Column:
    s = strip(c)
    plain = s.rlike(r"^[A-Za-z\s\-'.]+$")
    return when_first((blank(c), 0.0), (F.length(s) < 2, 0.2), (plain & s.rlike(r"\S\s+\S"), 0.9), (plain, 0.7), (s.rlike("[A-Za-z]"), 0.5), other=0.2)


def field_score(field: str) -> Column:
    c = F.col(field)
    if field not in TEXT_FIELDS:
        return number_score(c, field)
    kind = {"council": council_score, "reference": reference_score}.get(field) or (address_score if "address" in field else name_score if "name" in field else date_score)
    return kind(c)


def field_errors() -> list[Column]:
    """The errors of the council, the reference and the numbers; null where there is none."""
    council, reference = F.col("council"), F.col("reference")
    found = [
        F.when(blank(council), "Council field is empty").when(F.length(strip(council)) < 3, "Council name too short"),
        F.when(blank(reference), "Reference field is empty"),
    ]
    for f in ("max_occupancy", *COUNT_FIELDS, "number_of_storeys"):
        zero = F.when((F.col(f) == 0) & F.lit(f not in COUNT_FIELDS), f"{f} should not be zero")
        found.append(F.coalesce(F.when(F.col(f) < 0, f"{f} cannot be negative"), zero))
    return found


def overall(scores: Column) -> Column:
    """Weighted mean over the keys of a map of scores; 0 for an empty map."""
    weight = F.create_map(*[F.lit(x) for f, w in WEIGHTS.items() for x in (f, w)])
    of = lambda k: F.coalesce(F.try_element_at(weight, k), F.lit(1.0))
    entries = F.map_entries(scores)
    total = F.aggregate(entries, F.lit(0.0), lambda a, e: a + e["value"] * of(e["key"]))
    whole = F.aggregate(entries, F.lit(0.0), lambda a, e: a + of(e["key"]))
    return F.coalesce(F.try_divide(total, whole), F.lit(0.0))


def with_scores(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """records with `scores` (a column for each field, prefixed s_), `overall`, `errors` and `flagged`.

    Scores stay plain columns, so each is computed once and Catalyst prunes those that aren't used; `flagged` doesn't need the
    array of errors, whose lambda would keep the projection out of whole-stage code generation.
    """
    errors = field_errors()
    wrong = functools.reduce(lambda a, b: a | b, [e.isNotNull() for e in errors])
    scored = records.select("*", *[field_score(f).alias(f"s_{f}") for f in FIELDS], messages(*errors).alias("errors"), wrong.alias("__wrong"))
    total = sum((F.col(f"s_{f}") * WEIGHTS[f] for f in FIELDS), F.lit(0.0)) / sum(WEIGHTS.values())
    scored = scored.withColumn("overall", total)
    return scored.withColumn("flagged", (F.col("overall") < threshold) | F.col("__wrong")).drop("__wrong")


def score_map() -> Column:
    return F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"s_{f}"))])
