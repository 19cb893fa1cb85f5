"""The extraction model's confidences (C10 to C19), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import strip, when_first
from rollbook.schema import COUNT_FIELDS

# Types, thresholds, patterns, keywords and method scores.
THRESHOLDS = {"council": 0.75, "reference": 0.80, "address": 0.70, "date": 0.85, "person": 0.65, "numeric": 0.80, "text": 0.60}
PATTERNS = {
    "reference": ((r"(?i)^[A-Z]{2,4}/\d{4,8}$", 0.95), (r"(?i)^HMO/\d{4,8}$", 0.90), (r"(?i)^[A-Z]{1,3}\d{4,8}$", 0.85), (r"^\d{6,8}$", 0.75)),
    "date": ((r"^\d{4}-\d{2}-\d{2}$", 0.95), (r"^\d{1,2}/\d{1,2}/\d{4}$", 0.85), (r"^\d{1,2}-\d{1,2}-\d{4}$", 0.85)),
    "address": ((r"(?i)^\d+\s+[A-Za-z\s]+(?:Street|Road|Avenue|Lane|Drive|Close|Way|Place)", 0.90), (r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}", 0.85)),
}
KEYWORDS = {
    "council": ("council", "borough", "district", "authority"),
    "reference": ("reference", "ref", "licence", "license", "number", "no"),
    "address": ("address", "property", "premises", "location"),
    "date": ("date", "from", "to", "expires", "expiry", "start", "end"),
    "person": ("name", "manager", "holder", "owner", "contact"),
    "numeric": ("occupancy", "maximum", "max", "number", "households", "rooms"),
}
METHODS = {"spacy_ner": 0.8, "regex_pattern": 0.9, "table_extraction": 0.85, "ocr": 0.6, "manual_pattern": 0.75, "ensemble": 0.9, "unknown": 0.5}
FACTORS = {"pattern": 0.25, "context": 0.20, "format": 0.20, "length": 0.10, "consistency": 0.15, "method": 0.10}
LENGTHS = {"reference": ((6, 15, 0.9), (4, 20, 0.7), 0.4), "person": ((5, 50, 0.8), (3, 80, 0.6), 0.3), "address": ((15, 100, 0.8), (10, 150, 0.6), 0.4)}


def field_type(field: str) -> str:
    if field in ("council", "reference"):
        return field
    if "address" in field:
        return "address"
    if field in ("licence_start", "licence_expiry"):
        return "date"
    if field in ("hmo_manager_name", "licence_holder_name"):
        return "person"
    return "numeric" if field in (*COUNT_FIELDS, "max_occupancy", "number_of_storeys") else "text"


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def pattern_score(kind: str, c: Column) -> Column:
    tests = [(c.rlike(p), s) for p, s in PATTERNS.get(kind, ())]
    if kind == "numeric":
        tests.append((c.rlike(r"^\d+$"), 0.8))
    if kind == "text":
        tests.append((F.length(c) > 2, 0.6))
    return when_first((_empty(c), 0.0), *tests, other=0.4)


def context_score(kind: str, context: Column) -> Column:
    low = F.lower(context)
    hits = sum((F.when(low.contains(k), 1).otherwise(0) for k in KEYWORDS.get(kind, ())), F.lit(0))
    return when_first((_empty(context), 0.5), (hits == 0, 0.3), (hits == 1, 0.7), other=0.9)


def format_score(kind: str, c: Column) -> Column:
    if kind == "date":
        tests, other = [(c.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4})$"), 0.9)], 0.3
    elif kind == "numeric":
        tests, other = [(c.rlike(r"^\d+$"), 0.9), (c.rlike(r"^\d+\.\d+$"), 0.8)], 0.2
    elif kind == "person":
        tests, other = [(c.rlike(r"^[A-Z][a-z]+\s+[A-Z][a-z]+"), 0.8)], 0.5
    elif kind == "address":
        tests, other = [(c.rlike(r"\d") & (F.length(c) > 10), 0.8)], 0.5
    else:
        tests, other = [], 0.6
    return when_first((_empty(c), 0.0), *tests, other=other)


def length_score(kind: str, c: Column) -> Column:
    n = F.length(strip(c))
    if kind in LENGTHS:
        (a, b, x), (d, e, y), other = LENGTHS[kind]
        tests = [(n.between(a, b), x), (n.between(d, e), y)]
    elif kind == "numeric":
        tests, other = [(n.between(1, 5), 0.9)], 0.5
    else:
        tests, other = [(n < 2, 0.2), (n > 200, 0.3)], 0.7
    return when_first((_empty(c), 0.0), *tests, other=other)


def method_score(method: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in METHODS.items() for x in p]), F.lower(method)), F.lit(0.5))


def factors(field: str, value: Column, context: Column, method: Column, normalized: Column | None = None, consistency: float = 0.0) -> dict[str, Column]:
    """What a field's confidence is made of, by the names of FACTORS. Consistency isn't computed by the model and stays 0 unless given."""
    kind = field_type(field)
    best = value if normalized is None else F.when(_empty(normalized), value).otherwise(normalized)
    return {"pattern": pattern_score(kind, best), "context": context_score(kind, context), "format": format_score(kind, best), "length": length_score(kind, value), "consistency": F.lit(consistency), "method": method_score(method)}


def weighed(parts: dict[str, Column]) -> Column:
    """The confidence that factors come to."""
    return F.least(F.greatest(sum((parts[k] * w for k, w in FACTORS.items()), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def confidence(field: str, value: Column, context: Column, method: Column, normalized: Column | None = None, consistency: float = 0.0) -> Column:
    """A field's confidence from its factors."""
    return weighed(factors(field, value, context, method, normalized, consistency))


def is_low(field: str, score: Column) -> Column:
    return score < THRESHOLDS[field_type(field)]


def found_score(count: Column, length: Column, base: float = 0.8, start: float = 0.3) -> Column:
    """Confidence of a list of `count` pattern finds in a text of that length: base .8 for text, .6 after OCR, .9 and start .4 for word documents."""
    quality = F.least(F.lit(1.0), length / 1000)
    return F.when(count > 0, F.least(F.lit(0.9), count * 0.2 + start) * base * quality).otherwise(0.0)


def document_confidence(kind: str, length: Column, found: dict[str, Column], tables: Column, accuracy: Column | None = None) -> dict[str, Column]:
    """The confidence of each part of an extracted document (C10, C11): kind is `pdf`, `ocr` or `docx`; found: how many finds each potential_* list has.

    tables: how many there are; accuracy: their mean accuracy, 0.8 where unknown. Word documents' tables, metadata and structure are taken as sound.
    """
    base, start = {"pdf": (0.8, 0.3), "ocr": (0.6, 0.3), "docx": (0.9, 0.4)}[kind]
    of_tables = F.lit(0.95) if kind == "docx" else F.least(F.lit(0.95), (F.lit(0.8) if accuracy is None else F.coalesce(accuracy, F.lit(0.8))) * base)
    out = {n: found_score(c, length, base, start) for n, c in found.items()}
    out |= {"tables": F.when(tables > 0, of_tables).otherwise(0.0), "full_text": F.lit(base) * F.least(F.lit(1.0), length / 1000)}
    if kind == "docx":
        out |= {"metadata": F.lit(0.98), "paragraphs": F.lit(0.95), "headings": F.lit(0.95), "headers_footers": F.lit(0.95)}
    return out | {"average": F.round(sum(out.values(), F.lit(0.0)) / len(out), 3)}


def entity_confidence(label: Column, text: Column) -> Column:
    base = F.when(label.isin("LICENSE_REF", "POSTCODE"), 0.9).when(label.isin("PERSON", "ORG"), 0.8).when(label.isin("DATE", "DATE_PATTERN"), 0.85).otherwise(0.7)
    return base * F.when(F.length(text) < 3, 0.8).when(F.length(text) > 50, 0.9).otherwise(1.0)
