"""The validator's field and cross-field rules (V1 to V13), as columns. Its constants differ from the intrinsic scores'."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.common import date_of_parts, date_parts, has_any, messages, strip, weighted_mean, when_first
from rollbook.schema import COUNT_FIELDS, FIELDS, TEXT_FIELDS, VALIDATOR_WEIGHTS

# The words and patterns of the rules, and below the texts of their messages.
COUNCIL_WORDS = ("council", "borough", "city", "district", "county", "authority")
STREET_WORDS = (
    "street", "road", "avenue", "lane", "drive", "close", "way", "place", "crescent", "gardens", "park", "square",
    "terrace", "grove", "court", "mews", "walk", "rise", "hill", "view", "green", "common",
)
REFERENCES = (r"^[A-Z]{2,5}\d+$", r"^\d{2,4}[/-]\w+[/-]?\d*$", r"^[A-Z]+[/-]\d+[/-]?\d*$", r"^\d{3,}$", r"^[A-Z0-9/-]{3,}$")
POSTCODE = r"(?i)[A-Z]{1,2}[0-9R][0-9A-Z]?\s?[0-9][A-Z]{2}"


@dataclass
class Rule:
    """A field's score and the messages that may come with it; null messages don't apply."""

    score: Column
    errors: list[Column] = field(default_factory=list)
    warnings: list[Column] = field(default_factory=list)
    suggestion: Column | None = None


def blank(s: Column) -> Column:
    """Of stripped text, as the rules take it."""
    return s.isNull() | (s == "")


def council_rule(s: Column) -> Rule:
    short, usual = F.length(s) < 3, has_any(F.lower(s), COUNCIL_WORDS)
    return Rule(
        when_first((blank(s), 0.0), (short, 0.2), (usual, 0.95), (F.length(s) >= 5, 0.7), other=0.5),
        [F.when(blank(s), "Council field is required").when(short, "Council name is too short")],
        [F.when(~blank(s) & ~short & ~usual, F.when(F.length(s) >= 5, "Council name doesn't match typical patterns").otherwise("Council name may be incomplete"))],
    )


def reference_rule(s: Column) -> Rule:
    known = has_any(F.upper(s), REFERENCES)
    bad = ~blank(s) & ~known
    return Rule(
        when_first((blank(s), 0.0), (known, 0.9), other=0.3),
        [F.when(blank(s), "License reference is required").when(bad, "License reference format is invalid")],
        suggestion=F.when(bad, "Should contain letters and/or numbers (e.g., HMO123, 2023/001)"),
    )


def address_rule(s: Column, name: str, compat: bool = True) -> Rule:
    """compat: the postcode must be the whole address, so no address of 10 characters or more has one."""
    short = F.length(s) < 10
    postcode = s.rlike(f"^{POSTCODE}$".replace("^(?i)", "(?i)^") if compat else POSTCODE)
    parts = F.lit(0.5) + F.when(postcode, 0.3).otherwise(0.0) + F.when(has_any(F.lower(s), STREET_WORDS), 0.15).otherwise(0.0) + F.when(s.rlike(r"^\d"), 0.05).otherwise(0.0)
    empty = F.when(blank(s), "HMO address is required" if name == "hmo_address" else f"{name} is empty")
    rest = F.when(~blank(s), F.when(short, f"{name} appears incomplete").when(~postcode, f"{name} missing valid UK postcode"))
    score = F.when(blank(s), 0.0).when(short, 0.3).otherwise(F.least(parts, F.lit(1.0)))
    return Rule(score, [empty], [rest]) if name == "hmo_address" else Rule(score, [], [F.coalesce(empty, rest)])


def date_rule(s: Column, d: Column, iso: Column, name: str, as_of: date) -> Rule:
    """s: the text; d: its date; iso: whether that is written year first with hyphens."""
    start = name == "licence_start"
    far = d > F.add_months(F.lit(as_of), 24) if start else d < F.add_months(F.lit(as_of), -120)
    return Rule(
        when_first((blank(s), 0.0), (d.isNull(), 0.2), (far, 0.6 if start else 0.5), (iso, 0.95), other=0.85),
        [F.when(blank(s), f"{name} is required").when(d.isNull(), f"{name} has invalid date format")],
        [F.when(~blank(s) & far, "License start date is far in the future" if start else "License expiry date is very old")],
        F.when(~blank(s) & d.isNull(), "Use format YYYY-MM-DD or DD/MM/YYYY"),
    )


def occupancy_rule(c: Column) -> Rule:
    return Rule(
        when_first((c <= 0, 0.0), (c > 100, 0.6), (c > 50, 0.7), other=0.9),
        [F.when(c <= 0, "Maximum occupancy must be greater than 0")],
        [F.when(c > 100, "Maximum occupancy is unusually high").when(c > 50, "Maximum occupancy is high for typical HMO")],
    )


def name_rule(s: Column, name: str) -> Rule:
    plain, two = s.rlike(r"^[A-Za-z\s\-'.]+$"), s.rlike(r"\S\s+\S")
    text = (
        F.when(blank(s), f"{name} is empty")
        .when(F.length(s) < 2, f"{name} is too short")
        .when(plain & two, F.lit(None))
        .when(plain, f"{name} may be incomplete (single name)")
        .when(s.rlike("[A-Za-z]"), f"{name} contains unusual characters")
        .otherwise(f"{name} doesn't appear to be a valid name")
    )
    return Rule(when_first((blank(s), 0.0), (F.length(s) < 2, 0.2), (plain & two, 0.9), (plain, 0.7), (s.rlike("[A-Za-z]"), 0.5), other=0.2), [], [text])


def count_rule(c: Column, name: str) -> Rule:
    return Rule(when_first((c < 0, 0.0), (c == 0, 0.6), (c > 50, 0.6), other=0.9), [F.when(c < 0, f"{name} cannot be negative")], [F.when(c > 50, f"{name} is unusually high")])


def storeys_rule(c: Column) -> Rule:
    return Rule(
        when_first((c <= 0, 0.0), (c > 20, 0.5), (c > 10, 0.7), other=0.9),
        [F.when(c <= 0, "Number of storeys must be greater than 0")],
        [F.when(c > 20, "Number of storeys is unusually high for HMO").when(c > 10, "Number of storeys is high for typical HMO")],
    )


def cross_rules() -> Rule:
    """Over columns of `prepared`."""
    start, expiry = F.col("d_licence_start"), F.col("d_licence_expiry")
    years = F.datediff(expiry, start) / 365.25
    people, bath, kitchen, homes = F.col("max_occupancy"), F.col("number_of_shared_bathrooms"), F.col("number_of_shared_kitchens"), F.col("number_of_households")
    return Rule(
        F.lit(None),
        [F.when(expiry <= start, "License expiry date must be after start date")],
        [
            F.when(years > 10, "License duration is unusually long").when(years < 0.5, "License duration is very short"),
            F.when((people > 0) & (bath > 0) & (F.try_divide(people, bath) > 10), "High occupancy to bathroom ratio"),
            F.when((people > 0) & (kitchen > 0) & (F.try_divide(people, kitchen) > 15), "High occupancy to kitchen ratio"),
            F.when((homes > 0) & (people > 0) & (homes > people), "Number of households exceeds maximum occupancy"),
        ],
    )


def prepared(records: DataFrame) -> DataFrame:
    """records with its text fields stripped as t_<field> and its dates as p_<field> (parts) and d_<field>.

    Each is a column of a projection of its own: what is used often stays a column there, and isn't computed again in each rule.
    """
    dates = [f for f in TEXT_FIELDS if f.startswith("licence_") and f in ("licence_start", "licence_expiry")]
    out = records.select("*", *[strip(F.col(f)).alias(f"t_{f}") for f in TEXT_FIELDS])
    out = out.select("*", *[date_parts(F.col(f"t_{f}")).alias(f"p_{f}") for f in dates])
    return out.select("*", *[date_of_parts(F.col(f"p_{f}")).alias(f"d_{f}") for f in dates])


def rules(as_of: date, compat: bool = True) -> dict[str, Rule]:
    """Over columns of `prepared`."""
    out = {}
    for f in FIELDS:
        c = F.col(f"t_{f}") if f in TEXT_FIELDS else F.col(f)
        if f in ("council", "reference"):
            out[f] = council_rule(c) if f == "council" else reference_rule(c)
        elif "address" in f:
            out[f] = address_rule(c, f, compat)
        elif "name" in f:
            out[f] = name_rule(c, f)
        elif f.startswith("licence_"):
            parts, d = F.col(f"p_{f}"), F.col(f"d_{f}")
            out[f] = date_rule(c, d, F.coalesce((F.length(parts[0]) == 4) & (parts[3] == "-") & d.isNotNull(), F.lit(False)), f, as_of)
        elif f in COUNT_FIELDS:
            out[f] = count_rule(c, f)
        else:
            out[f] = occupancy_rule(c) if f == "max_occupancy" else storeys_rule(c)
    return out


def with_validation(records: DataFrame, as_of: date, compat: bool = True) -> DataFrame:
    """records with v_score, v_errors, v_warnings, v_suggestions (a map) and v_valid: no error that says `required` or `critical`."""
    found = rules(as_of, compat)
    order = [*found.values(), cross_rules()]
    out = prepared(records).select(
        *records.columns,
        weighted_mean({f: r.score for f, r in found.items()}, VALIDATOR_WEIGHTS).alias("v_score"),
        messages(*[e for r in order for e in r.errors]).alias("v_errors"),
        messages(*[w for r in order for w in r.warnings]).alias("v_warnings"),
        F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(f).alias("key"), r.suggestion.alias("value")) for f, r in found.items() if r.suggestion is not None]), lambda e: e["value"].isNotNull())).alias("v_suggestions"),
    )
    return out.withColumn("v_valid", ~F.exists("v_errors", lambda e: F.lower(e).rlike("critical|required")))
