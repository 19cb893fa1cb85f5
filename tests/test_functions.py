"""Scores, confidences, validation, text and mapping functions on single values."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from rollbook.functions import common, confidence, mapping, scoring, support, text, validation
from rollbook.schema import FIELDS, WEIGHTS


def values(spark, inputs, column):
    kind = "string" if isinstance(next(x for x in inputs if x is not None), str) else "int"
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    scoring.reference_score: {"HMO123": 0.95, "LIC456789": 0.95, "2023/001": 0.9, "23-HMO-001": 0.9, "123456": 0.8, "ABC123DEF": 0.6, "AB": 0.4, "": 0, None: 0},
    scoring.date_score: {"2023-01-01": 0.95, "01/01/2023": 0.8, "01-01-2023": 0.8, "1/1/2023": 0.8, "1-1-2023": 0.4, "2023": 0.4, "invalid": 0.1, "": 0, "2023-99-99": 0.95},
    scoring.name_score: {"John Smith": 0.9, "O'Connor": 0.7, "Smith-Jones": 0.7, "John": 0.7, "J": 0.2, "John123": 0.5, "": 0, "12": 0.2},
    scoring.council_score: {"Test Borough Council": 0.9, "Test Authority": 0.7, "TC": 0.3, "": 0, "  ": 0},
    scoring.address_score: {"": 0, "Short": 0.3, "1 High Street, Town, AB1 2CD": 1.0, "High Street, Town": 0.65, "Somewhere else": 0.5},
    text.is_reference: {"HMO/123456": True, "ABC/789012": True, "XYZ123": True, "123456": True, "AB": False, "123": False, "": False, "!@#$%": False, "ABCD": False, "12345": False},
    text.normalize_name: {"john smith": "John Smith", "SARAH JOHNSON": "Sarah Johnson", "michael o'connor": "Michael O'Connor", "  a   b ": "A B"},
    text.normalize_address: {"12  high st,  town": "12 High Street, Town", "1 oak RD": "1 Oak Road", "5 mill ln AB1 2CD": "5 Mill Lane Ab1 2cd"},
    text.normalize_date: {"2023-04-01": "2023-04-01", "01/04/2023": "2023-04-01", "04/15/2023": "2023-04-15", "31/02/2023": None, "3 Mar 2021": "2021-03-03", "March 3, 2021": "2021-03-03", "1/1/1800": None},
    lambda c: text.normalize_date(c, True): {"2023-04-01": "2023-01-04", "2023-04-15": "2023-04-15", "01/04/2023": "2023-04-01"},
    lambda c: common.parse_date(c).cast("string"): {"2023-1-5": "2023-01-05", "5/1/2023": "2023-01-05", "05-01-23": "2023-01-05", "05/01/75": "1975-01-05", "2023/01/05": "2023-01-05", "12/25/2023": "2023-12-25", "29/02/2023": None, "29/02/2024": "2024-02-29", "x": None},
    text.needs_ocr: {"short": True, "a" * 100: False, "-" * 200: True, None: True},
    text.line_kind: {"A Council": "council", "HMO Manager: X": "reference", "Property": "hmo_address", "Holder": "hmo_manager_name", "4 persons": "max_occupancy", "else": None},
    support.document_type: {"/a/B.PDF": "pdf", "x.docx": "docx", "x.doc": "unknown", "pdf": "unknown"},
    support.error_class: {"File too large": "file_too_large", "PDF cannot read": "corrupted_file", "pdf extract": "pdf_extraction_failed", "extraction": "entity_extraction_failed", "?": "unknown_error"},
    support.stage_progress: {"nlp_processing": 0.3, "what": 0.0},
    support.safe_name: {'a<b>:"c" d': "a_b___c__d", "  ": "export"},
}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_table(spark, case):
    column, table = list(CASES.items())[case]
    got = values(spark, list(table), column)
    assert [round(x, 6) if isinstance(x, float) else x for x in got] == list(table.values())


def test_number_scores(spark):
    for field, table in {"max_occupancy": {-1: 0, 0: 0.2, 50: 0.9, 51: 0.6}, "number_of_storeys": {0: 0.2, 10: 0.9, 11: 0.5}, "number_of_households": {-1: 0, 0: 0.6, 20: 0.9, 21: 0.6}}.items():
        assert values(spark, list(table), lambda c, f=field: scoring.number_score(c, f)) == list(table.values())


def test_overall(spark):
    assert sum(WEIGHTS.values()) == 24
    row = spark.range(1).select(scoring.overall(F.create_map(F.lit("council"), F.lit(0.9), F.lit("hmo_manager_name"), F.lit(0.5))).alias("a"), scoring.overall(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))).alias("b")).first()
    assert round(row.a, 6) == round((0.9 * 3 + 0.5) / 4, 6) and row.b == 0


def test_confidence(spark):
    row = spark.range(1).select(
        confidence.confidence("reference", F.lit("ABC/123456"), F.lit("licence ref"), F.lit("regex_pattern")).alias("r"),
        confidence.confidence("council", F.lit("Some Council"), F.lit("council borough"), F.lit("regex_pattern")).alias("c"),
        confidence.found_score(F.lit(2), F.lit(500)).alias("f"),
        confidence.entity_confidence(F.lit("DATE"), F.lit("ab")).alias("e"),
    ).first()
    assert [round(x, 6) for x in row] == [0.7175, 0.56, round(0.7 * 0.8 * 0.5, 6), 0.68]


def test_text_finds(spark):
    body = "Test Council\nReference: HMO/123456\nAddress: 12 High Street, Town, AB1 2CD\nManager: John Smith\nOccupancy: 5 persons\nfrom 01/02/2023 to 2024-02-01"
    d = spark.createDataFrame([(body,)], "t string")
    row = d.select(text.references(F.col("t")).alias("r"), text.references(F.col("t"), True).alias("u"), text.dates(F.col("t")).alias("d"), *[c.alias(n) for n, c in text.basic_data(F.col("t")).items()]).first()
    assert row.r == ["HMO/123456", "HMO/123456", "123456", "HMO/123456"] and row.u == ["HMO/123456", "123456"] and row.d == ["2023-02-01", "2024-02-01"]
    assert row.potential_numbers == [5, 5] and "01/02/2023" in row.potential_dates and "HMO/123456" in row.potential_references
    found = spark.createDataFrame([("Flat at 12 High St, Town, AB1 2CD and 9 Oak Rd, City, CD3 4EF",)], "t string").select(F.inline(text.address_candidates(F.col("t")))).collect()
    assert [r.confidence for r in found].count(0.9) == 2 and found[0].confidence == 0.8 and found[-1].text.endswith("Cd3 4ef")
    rules = spark.createDataFrame([("see HMO/1234 and fife council on 1/2/2020 max occupancy",)], "t string").select(F.inline(text.ruler(F.col("t")))).collect()
    assert [(r.label, r.text) for r in rules] == [("LICENSE_REF", "HMO/1234"), ("COUNCIL", "fife council"), ("HMO_TERM", "max occupancy"), ("DATE_PATTERN", "1/2/2020")]
    heads = spark.createDataFrame([(["Name", "Address"],), (["12", "x y z q w"],), ([],), (["COUNCIL", "5", "6"],)], "r array<string>").select(text.looks_like_header(F.col("r")).alias("h")).collect()
    assert [r.h for r in heads] == [True, False, False, False]


def record(**over):
    base = {"council": "Town Borough Council", "reference": "HMO123", "hmo_address": "1 High Street, Town, AB1 2CD", "licence_start": "2000-01-01", "licence_expiry": "2005-01-01", "max_occupancy": 6, "hmo_manager_name": "Alex Smith", "hmo_manager_address": "1 Mill Lane, Town", "licence_holder_name": "Sam Patel", "licence_holder_address": "2 Oak Road, Town", "number_of_households": 2, "number_of_shared_kitchens": 1, "number_of_shared_bathrooms": 1, "number_of_shared_toilets": 1, "number_of_storeys": 2} | over
    return tuple(base[f] for f in FIELDS)


def test_validation(spark):
    kinds = ", ".join(f"{f} {'int' if 'number' in f or 'occupancy' in f else 'string'}" for f in FIELDS)
    rows = [record(), record(council="", reference="#!"), record(licence_expiry="1999-12-31"), record(max_occupancy=0), record(number_of_households=9, max_occupancy=60, licence_expiry="2015-01-01"), record(hmo_address=None, licence_start="31/02/2000")]
    out = validation.with_validation(spark.createDataFrame(rows, kinds).coalesce(1), date(2001, 8, 1)).collect()
    assert out[0].v_valid and not out[0].v_errors and out[0].v_warnings == ["hmo_address missing valid UK postcode", "hmo_manager_address missing valid UK postcode", "licence_holder_address missing valid UK postcode"]
    assert not out[1].v_valid and out[1].v_errors == ["Council field is required", "License reference format is invalid"] and "reference" in out[1].v_suggestions
    assert "License expiry date must be after start date" in out[2].v_errors and "License duration is very short" in out[2].v_warnings and out[2].v_valid
    assert out[3].v_errors == ["Maximum occupancy must be greater than 0"] and out[3].v_valid
    assert {"License duration is unusually long", "High occupancy to bathroom ratio", "High occupancy to kitchen ratio", "Maximum occupancy is high for typical HMO"} <= set(out[4].v_warnings)
    assert out[5].v_errors == ["HMO address is required", "licence_start has invalid date format"] and all(0 <= r.v_score <= 1 for r in out)
    strict = validation.with_validation(spark.createDataFrame(rows, kinds).coalesce(1), date(2001, 8, 1), compat=False).first()
    assert "hmo_address missing valid UK postcode" not in strict.v_warnings and strict.v_score > out[0].v_score


def test_mapping(spark):
    d = spark.createDataFrame([("5.7", "yes", "1.5", 0), ("x", "0", "", 3)], "council string, reference string, hmo_address string, max_occupancy int").coalesce(1)
    made = [mapping.Mapping("council", "N", "integer"), mapping.Mapping("reference", "B", "boolean"), mapping.Mapping("hmo_address", "F", "float"), mapping.Mapping("max_occupancy", "O", "integer", default=1)]
    assert [tuple(r) for r in mapping.export_rows(d, made).collect()] == [("5", "true", "1.5", "1"), ("x", "false", "", "3")]
    errors = [m.error().alias(m.name) for m in (mapping.Mapping("council", "N", "integer", True, {"max_value": 4}), mapping.Mapping("hmo_address", "A", "string", True, {"min_length": 5, "pattern": r"\d"}))]
    assert [tuple(r) for r in d.select(*errors).collect()] == [("'N' must be no more than 4", "'A' must be at least 5 characters"), ("Invalid integer value for 'N'", "Required field 'A' is empty")]
    assert mapping.preset("standard")[2].rules == {"min_length": 10} and mapping.preset("detailed")[2].rules == {"min_length": 15} and len(mapping.preset("compact")) == 6
    assert mapping.from_json(mapping.to_json(mapping.preset("detailed"))) == mapping.preset("detailed") and not mapping.problems(mapping.preset("standard"))
    assert len(mapping.problems([mapping.Mapping("council", "9x"), mapping.Mapping("nope", "A", rules={"odd": 1}), mapping.Mapping("council", "A")])) == 4


def test_memory_estimate_and_upload_advice(spark):
    rows = [(50_000, 51.0, False, 0, ".pdf", 21), (5, 50.0, True, 1, ".pdf", 20), (5_000, None, None, None, None, None)]
    t = spark.createDataFrame(rows, "n long, mb double, has boolean, est long, ext string, pages long")
    got = t.select(support.memory_estimate(F.col("n"), 1000).alias("m"), support.upload_advice(*map(F.col, ("mb", "has", "est", "ext", "pages"))).alias("a")).collect()
    assert [tuple(r.m) for r in got] == [(1000 / 1024, 50_000 / 1024, 1000), (1000 / 1024, 5 / 1024, 100), (1000 / 1024, 5_000 / 1024, 500)]
    assert [[x.split()[0] for x in r.a] for r in got] == [["Consider", "Document", "No", "Large"], [], ["Document", "No"]]


def test_fixed_point_text_rounds_by_the_exact_value(spark):
    """0.625 is a half and 0.615 is a little less than one: as C's and Python's formats, not as Java's."""
    found = [0.625, 0.615, 0.125, 0.375, 0.675, 0.005, 1.005, 2.675, 0.9995, 0.9996, 0.0, 1.0, 99.95, 0.25, 0.05, 12.5, 0.0625, -0.625, -0.001, 1e-300, 123456.785, 1e15]
    found += [k / 1000 for k in range(1000)] + [k / 16 for k in range(64)]
    rows = spark.createDataFrame([(x,) for x in found], "x double").select("x", *[common.fixed("x", d).alias(f"d{d}") for d in (1, 2, 3)]).collect()
    assert [tuple(r)[1:] for r in rows] == [tuple(f"{r.x:.{d}f}" for d in (1, 2, 3)) for r in rows]
