"""The fixed record of a licence register and the classes and weights of its fields."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names, their order and their classes.
TEXT_FIELDS = (
    "council", "reference", "hmo_address", "licence_start", "licence_expiry", "hmo_manager_name",
    "hmo_manager_address", "licence_holder_name", "licence_holder_address",
)
COUNT_FIELDS = ("number_of_households", "number_of_shared_kitchens", "number_of_shared_bathrooms", "number_of_shared_toilets")
FIELDS = (*TEXT_FIELDS[:5], "max_occupancy", *TEXT_FIELDS[5:], *COUNT_FIELDS, "number_of_storeys")
CRITICAL = ("council", "reference", "hmo_address")
IMPORTANT = ("licence_start", "licence_expiry", "max_occupancy")
RELATED = ("hmo_manager_name", "hmo_manager_address", "licence_holder_name", "licence_holder_address")

#: Weights of the intrinsic score and of the validator's.
WEIGHTS = {f: 3.0 if f in CRITICAL else 2.0 if f in IMPORTANT else 1.0 for f in FIELDS}
VALIDATOR_WEIGHTS = {f: 1.5 if f in RELATED else w for f, w in WEIGHTS.items()}


def field_class(field: str) -> str:
    return "critical" if field in CRITICAL else "important" if field in IMPORTANT else "optional"


RECORD = T.StructType(
    [T.StructField("record_id", T.LongType()), T.StructField("session_id", T.StringType())]
    + [T.StructField(f, T.StringType() if f in TEXT_FIELDS else T.IntegerType()) for f in FIELDS]
)
