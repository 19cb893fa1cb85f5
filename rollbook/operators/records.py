"""Records out of entities and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.functions.common import strip
from rollbook.functions.text import line_kind
from rollbook.schema import FIELDS, TEXT_FIELDS

KINDS = ("council", "reference", "hmo_address", "hmo_manager_name", "max_occupancy")


def from_entities(docs: DataFrame) -> DataFrame:
    """One row for each record of a document's entity arrays (councils, references, addresses, dates, names, occupancies).

    Record i takes item i of the first three and of the occupancies, and items 2i and 2i+1 of dates and names; a single date or
    name goes to record 0. Records with neither council, reference nor address are dropped.
    """
    i = F.col("i")
    # the arrays pass through a generator as one struct, so that no rule merges the finds into each of their uses
    bound = docs.select("doc", F.explode(F.array(F.struct("councils", "references", "addresses", "dates", "names", "occupancies"))).alias("a")).select("doc", "a.*")
    n = F.greatest(F.size("councils"), F.size("references"), F.size("addresses"), F.lit(1))
    rows = bound.select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))

    def pair(array: str, k: int) -> Column:
        many = F.get(array, i * 2 + k)
        return F.coalesce(F.when(F.size(array) >= 2, many).when((i == 0) & F.lit(k == 0), F.get(array, F.lit(0))), F.lit(""))

    at = lambda a: F.coalesce(F.get(a, i), F.lit(""))
    made = rows.select(
        "doc", "i", at("councils").alias("council"), at("references").alias("reference"), at("addresses").alias("hmo_address"),
        pair("dates", 0).alias("licence_start"), pair("dates", 1).alias("licence_expiry"), pair("names", 0).alias("hmo_manager_name"), pair("names", 1).alias("licence_holder_name"),
        F.coalesce(F.get("occupancies", i).try_cast("int"), F.lit(0)).alias("max_occupancy"),
    )
    return made.filter("council != '' or reference != '' or hmo_address != ''")


def from_lines(lines: DataFrame) -> DataFrame:
    """Records of documents' lines (doc, pos, line): a council line begins one, later lines set its fields, the last one of a kind counts.

    Documents without a record give none here; see with_default.
    """
    text = strip(F.col("line"))
    kinds = lines.select("doc", "pos", text.alias("line"), line_kind(text).alias("kind")).filter("line != '' and kind is not null")
    kinds = kinds.filter((F.col("kind") != "max_occupancy") | F.col("line").rlike(r"\d"))
    running = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grouped = kinds.withColumn("grp", F.sum(F.when(F.col("kind") == "council", 1).otherwise(0)).over(running))
    last = [F.max_by(F.when(F.col("kind") == k, F.col("line")), F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in KINDS]
    made = grouped.groupBy("doc", "grp").agg(*last)
    index = F.row_number().over(Window.partitionBy("doc").orderBy("grp")) - 1
    digits = F.regexp_extract("max_occupancy", r"(\d+)", 1).try_cast("int")
    out = made.select("doc", index.alias("i"), *[F.col(k) for k in KINDS[:4]], digits.alias("max_occupancy"))
    return out.select("*", *_about())


def _about() -> list[Column]:
    """What every simple record says of itself: its id, the same score for each field, the method, and that it needs a review."""
    scores = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(0.5))])
    return [F.concat(F.col("doc").cast("string"), F.lit("_"), F.col("i").cast("string")).alias("record_id"), scores.alias("scores"), F.lit("simple_pattern_matching").alias("extraction_method"), F.lit(True).alias("needs_review")]


def with_default(docs: DataFrame, records: DataFrame) -> DataFrame:
    """Every document's records; one with a note for documents that have none."""
    key = F.substring(F.col("doc").cast("string"), 1, 8)
    joined = docs.select("doc").join(records, "doc", "left")
    none = F.col("i").isNull()
    out = joined.select(
        "doc",
        F.coalesce("i", F.lit(0)).alias("i"),
        F.when(none, "Unknown Council").otherwise(F.col("council")).alias("council"),
        F.when(none, F.concat(F.lit("EXTRACTED_"), key)).otherwise(F.col("reference")).alias("reference"),
        F.when(none, "Address not found in document").otherwise(F.col("hmo_address")).alias("hmo_address"),
        F.when(none, "Manager not specified").otherwise(F.col("hmo_manager_name")).alias("hmo_manager_name"),
        F.when(none, 0).otherwise(F.col("max_occupancy")).alias("max_occupancy"),
        F.when(none, "Basic extraction - manual review recommended").alias("extraction_note"),
        none.alias("is_default"),
    )
    return out.select("*", *_about())


#: The fields of a record as text: others are left out.
TEXT_SCHEMA = ", ".join([*(f"{f} {'string' if f in TEXT_FIELDS else 'int'}" for f in FIELDS), "confidence_scores map<string,double>", "validation_errors array<string>"])


def to_json(records: DataFrame) -> DataFrame:
    """record_id and body, a record's fields, scores and errors as JSON (R5). records: scored."""
    scores = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f"s_{f}"))])
    return records.select("record_id", F.to_json(F.struct(*FIELDS, scores.alias("confidence_scores"), F.col("errors").alias("validation_errors"))).alias("body"))


def from_json(bodies: DataFrame) -> DataFrame:
    """record_id and the record's columns of JSON bodies (R5): unknown keys are dropped; missing texts are empty, numbers 0, scores and errors empty."""
    r = bodies.select("record_id", F.from_json("body", TEXT_SCHEMA).alias("r")).select("record_id", "r.*")
    plain = [F.coalesce(f, F.lit("") if f in TEXT_FIELDS else F.lit(0)).alias(f) for f in FIELDS]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return r.select("record_id", *plain, F.coalesce("confidence_scores", none).alias("confidence_scores"), F.coalesce("validation_errors", F.array().cast("array<string>")).alias("validation_errors"))


def with_penalty(scores: Column, fallback: Column, factor: float = 0.7) -> Column:
    """A map of scores, each times the factor where a fallback was used."""
    return F.when(fallback, F.transform_values(scores, lambda k, v: v * factor)).otherwise(scores)


def table_records(tables: DataFrame) -> DataFrame:
    """A map of header to cell for each row of tables (doc, headers, rows): short rows are padded, extra cells dropped."""
    padded = F.slice(F.concat("row", F.array_repeat(F.lit(""), F.size("headers"))), 1, F.size("headers"))
    return tables.select("doc", "headers", F.posexplode("rows").alias("i", "row")).select("doc", "i", F.map_from_arrays("headers", padded).alias("record"))
