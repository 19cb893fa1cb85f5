"""Column mappings (E1 to E8): renaming, typing, rules, defaults and formatting, compiled to columns."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions.common import blank, strip
from rollbook.schema import FIELDS, TEXT_FIELDS

# Truths, rules, date shapes and presets.
TRUE = ("true", "1", "yes", "on")
RULES = ("required", "min_length", "max_length", "pattern", "min_value", "max_value", "date_format")
DATE_SHAPES = {"YYYY-MM-DD": r"^\d{4}-\d{2}-\d{2}$", "DD/MM/YYYY": r"^\d{2}/\d{2}/\d{4}$", "MM/DD/YYYY": r"^\d{2}/\d{2}/\d{4}$", "DD-MM-YYYY": r"^\d{2}-\d{2}-\d{4}$"}
STANDARD = {
    "council": ("Council", "string", True, {"min_length": 2}),
    "reference": ("Reference", "string", True, {"min_length": 3}),
    "hmo_address": ("HMO Address", "string", True, {"min_length": 10}),
    "licence_start": ("Licence Start Date", "date", False, {"date_format": "YYYY-MM-DD"}),
    "licence_expiry": ("Licence Expiry Date", "date", False, {"date_format": "YYYY-MM-DD"}),
    "max_occupancy": ("Maximum Occupancy", "integer", False, {"min_value": 1, "max_value": 100}),
    "hmo_manager_name": ("Manager Name", "string", False, {}),
    "hmo_manager_address": ("Manager Address", "string", False, {}),
    "licence_holder_name": ("Licence Holder Name", "string", False, {}),
    "licence_holder_address": ("Licence Holder Address", "string", False, {}),
    "number_of_households": ("Number of Households", "integer", False, {"min_value": 0, "max_value": 50}),
    "number_of_shared_kitchens": ("Shared Kitchens", "integer", False, {"min_value": 0, "max_value": 20}),
    "number_of_shared_bathrooms": ("Shared Bathrooms", "integer", False, {"min_value": 0, "max_value": 20}),
    "number_of_shared_toilets": ("Shared Toilets", "integer", False, {"min_value": 0, "max_value": 20}),
    "number_of_storeys": ("Number of Storeys", "integer", False, {"min_value": 1, "max_value": 20}),
}
DETAILED = {"hmo_address": {"min_length": 15}, "hmo_manager_name": {"min_length": 2}, "licence_holder_name": {"min_length": 2}}
#: Shown names of each user preset, its bounds of high, medium and flagged confidence, its required fields, and whether dates and addresses are checked strictly.
UI_NAMES = {
    "default": {
        "council": "Council", "reference": "Reference", "hmo_address": "HMO Address", "licence_start": "Licence Start", "licence_expiry": "Licence Expiry", "max_occupancy": "Max Occupancy",
        "hmo_manager_name": "Manager Name", "hmo_manager_address": "Manager Address", "licence_holder_name": "Holder Name", "licence_holder_address": "Holder Address", "number_of_households": "Households",
        "number_of_shared_kitchens": "Shared Kitchens", "number_of_shared_bathrooms": "Shared Bathrooms", "number_of_shared_toilets": "Shared Toilets", "number_of_storeys": "Storeys",
    },
    "minimal": {"council": "Council", "reference": "Reference", "hmo_address": "Address", "licence_start": "Start Date", "licence_expiry": "Expiry Date"},
    "comprehensive": {
        "council": "Local Authority", "reference": "HMO License Reference", "hmo_address": "Property Address", "licence_start": "License Start Date", "licence_expiry": "License Expiry Date", "max_occupancy": "Maximum Occupancy",
        "hmo_manager_name": "HMO Manager Full Name", "hmo_manager_address": "HMO Manager Address", "licence_holder_name": "License Holder Full Name", "licence_holder_address": "License Holder Address",
        "number_of_households": "Number of Households", "number_of_shared_kitchens": "Shared Kitchen Facilities", "number_of_shared_bathrooms": "Shared Bathroom Facilities",
        "number_of_shared_toilets": "Shared Toilet Facilities", "number_of_storeys": "Number of Storeys",
    },
}
# The shown presets' bounds and required fields.
UI_BOUNDS = {"default": (0.8, 0.6, 0.4), "minimal": (0.7, 0.5, 0.3), "comprehensive": (0.9, 0.7, 0.5)}
UI_REQUIRED = {"default": ("council", "reference", "hmo_address"), "minimal": ("council", "reference", "hmo_address"), "comprehensive": ("council", "reference", "hmo_address", "licence_start", "licence_expiry")}


@dataclass
class Mapping:
    source: str
    name: str
    kind: str = "string"
    required: bool = False
    rules: dict = field(default_factory=dict)
    default: str | int | float | bool | None = None

    def converted(self, c: Column) -> Column:
        """The value in its type, null where it can't be (E2). Integers truncate toward zero."""
        s = strip(c.cast("string"))
        if self.kind == "integer":
            return F.when(s == "", F.lit(0)).otherwise(s.try_cast("double").try_cast("int"))
        if self.kind == "float":
            return F.when(s == "", F.lit(0.0)).otherwise(s.try_cast("double"))
        if self.kind == "boolean":
            return F.lower(c.cast("string")).isin(*TRUE)
        return c.cast("string")

    def _failure(self, rule: str, value, c: Column) -> Column:
        text = self.kind in ("string", "date")
        if rule == "min_length" and text:
            return F.when(F.length(c) < value, f"'{self.name}' must be at least {value} characters")
        if rule == "max_length" and text:
            return F.when(F.length(c) > value, f"'{self.name}' must be no more than {value} characters")
        if rule == "pattern" and text:
            return F.when(~c.rlike(f"^(?:{value})"), f"'{self.name}' does not match required pattern")
        if rule == "date_format" and text:
            return F.when(~c.rlike(DATE_SHAPES.get(value, f"^(?:{value})")), f"'{self.name}' must match date format {value}")
        if rule == "min_value" and not text:
            return F.when(c < value, f"'{self.name}' must be at least {value}")
        if rule == "max_value" and not text:
            return F.when(c > value, f"'{self.name}' must be no more than {value}")
        return F.lit(None).cast("string")

    def error(self) -> Column:
        """The first thing wrong with the value; null if nothing is."""
        c = F.col(self.source)
        value = self.converted(c)
        failures = [self._failure(rule, x, value) for rule, x in self.rules.items()]
        empty = F.when(F.lit(self.required), f"Required field '{self.name}' is empty")
        return F.when(blank(c.cast("string")), empty).when(value.isNull(), f"Invalid {self.kind} value for '{self.name}'").otherwise(F.coalesce(*failures, F.lit(None)))

    def formatted(self) -> Column:
        """The value as text in the output, with the default where it is empty or 0."""
        c = F.col(self.source)
        s = strip(c.cast("string"))
        if self.default is not None:
            empty = blank(c) if self.source in TEXT_FIELDS else c.isNull() | (c == 0)
            s = F.when(empty, F.lit(str(self.default))).otherwise(s)
        number = s.try_cast("double")
        if self.kind == "integer":
            s = F.coalesce(number.try_cast("bigint").cast("string"), s)
        elif self.kind == "float":
            s = F.coalesce(number.cast("string"), s)
        elif self.kind == "boolean":
            s = F.when(F.lower(s).isin(*TRUE) & F.lit(self.source in TEXT_FIELDS), "true").otherwise("false")
        return F.coalesce(s, F.lit("")).alias(self.name)


def preset(name: str) -> list[Mapping]:
    """standard, compact (the first six fields) or detailed (stricter rules). Each call gives rules of its own."""
    found = [Mapping(f, *spec[:3], dict(spec[3])) for f, spec in STANDARD.items()]
    if name == "compact":
        return found[:6]
    if name == "detailed":
        for m in found:
            m.rules |= DETAILED.get(m.source, {})
    return found


def problems(mappings: list[Mapping]) -> list[str]:
    """What is wrong with a configuration: repeated or odd names, unknown fields or rules."""
    out = [f"duplicate column name: {m.name}" for i, m in enumerate(mappings) if m.name in [x.name for x in mappings[:i]]]
    for m in mappings:
        if not re.match(r"^[A-Za-z][A-Za-z0-9\s_-]*$", m.name):
            out.append(f"invalid column name: {m.name}")
        if m.source not in FIELDS:
            out.append(f"unknown field: {m.source}")
        out += [f"unknown rule: {r}" for r in m.rules if r not in RULES]
    return out


def to_json(mappings: list[Mapping]) -> str:
    return json.dumps([asdict(m) for m in mappings])


def from_json(text: str) -> list[Mapping]:
    found = [Mapping(**x) for x in json.loads(text)]
    if wrong := problems(found):
        raise ValueError("; ".join(wrong))
    return found


def save_preset(folder: str, name: str, mappings: list[Mapping], compression: str = "none") -> None:
    """An export preset as a JSON file (S31); folder is the driver's."""
    (Path(folder) / f"{name}.json").write_text(json.dumps({"name": name, "columns": [asdict(m) for m in mappings], "compression": compression}, indent=2))


def load_preset(folder: str, name: str) -> tuple[list[Mapping], str] | None:
    """A saved preset's mappings and compression; None if there is none."""
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        return None
    saved = json.loads(path.read_text())
    return from_json(json.dumps(saved["columns"])), saved.get("compression", "none")


def list_presets(folder: str) -> list[str]:
    return sorted(p.stem for p in Path(folder).glob("*.json"))


def delete_preset(folder: str, name: str) -> bool:
    path = Path(folder) / f"{name}.json"
    if not path.exists():
        return False
    path.unlink()
    return True


def ui_view(scored: DataFrame, name: str) -> DataFrame:
    """Scored records as a user preset shows them (E7): its columns under its names, the level of the confidence, and whether a record is flagged or lacks a required field."""
    high, medium, flag = UI_BOUNDS[name]
    level = F.when(F.col("overall") >= high, "high").when(F.col("overall") >= medium, "medium").otherwise("low")
    missing = F.lit(False)
    for f in UI_REQUIRED[name]:
        missing = missing | blank(F.col(f))
    return scored.select("record_id", *[F.col(f).alias(shown) for f, shown in UI_NAMES[name].items()], level.alias("level"), ((F.col("overall") < flag) | missing).alias("needs_review"))


def export_rows(records: DataFrame, mappings: list[Mapping]) -> DataFrame:
    return records.select(*[m.formatted() for m in mappings])


def _empty(m: Mapping) -> Column:
    return blank(F.col(m.source)) if m.source in TEXT_FIELDS else F.col(m.source).isNull() | (F.col(m.source) == 0)


def _errors(mappings: list[Mapping]) -> Column:
    """What is wrong with a record: a struct of field and error for each field that has one. 0 counts as empty here."""
    required = lambda m: F.when(_empty(m), F.when(F.lit(m.required), f"Required field '{m.name}' is empty")).otherwise(m.error())
    return F.filter(F.array(*[F.struct(F.lit(m.source).alias("field"), required(m).alias("error")) for m in mappings]), lambda e: e["error"].isNotNull())


def record_errors(records: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """record_id, field and error: a row for each error."""
    return records.select("record_id", F.inline(_errors(mappings)))


def export_summary(records: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """One row: records, valid and invalid ones, errors."""
    n = records.select(F.size(_errors(mappings)).alias("k"))
    return n.agg(F.count("*").alias("total"), F.count_if(F.col("k") == 0).alias("valid"), F.count_if(F.col("k") > 0).alias("invalid"), F.coalesce(F.sum("k"), F.lit(0)).alias("errors"))


def export_checks(records: DataFrame, mappings: list[Mapping]) -> DataFrame:
    """For each mapped column: rows, empty values and errors (A14), in one pass."""
    long = records.select(F.inline(F.array(*[F.struct(F.lit(m.source).alias("field"), _empty(m).alias("empty"), F.when(_empty(m), F.lit(m.required)).otherwise(m.error().isNotNull()).alias("wrong")) for m in mappings])))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("empty").alias("n_empty"), F.count_if("wrong").alias("n_errors"))
