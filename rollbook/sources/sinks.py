"""Outputs (S23 to S32): mapped CSV, plain CSV lines, reviewed exports, packages, record tables by session."""

from __future__ import annotations

import io
import json
import time
import zipfile
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rollbook.functions.common import fixed
from rollbook.functions.mapping import Mapping, export_rows
from rollbook.schema import FIELDS

# The plain CSV's columns.
SIMPLE = ("council", "reference", "hmo_address", "licence_start", "licence_expiry", "max_occupancy", "hmo_manager_name", "licence_holder_name", "extraction_method", "needs_review")


def write_csv(records: DataFrame, mappings: list[Mapping], path: str, compression: str = "none") -> None:
    """Mapped rows as CSV parts with a header each; quotes are doubled and only put where needed."""
    export_rows(records, mappings).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("compression", compression).csv(path)


def csv_lines(records: DataFrame, columns: tuple[str, ...] = SIMPLE) -> DataFrame:
    """record_id and line: unquoted values, commas as semicolons, line feeds as spaces, returns dropped; missing columns empty."""

    def cell(name: str) -> Column:
        c = F.col(name).cast("string") if name in records.columns else F.lit("")
        return F.regexp_replace(F.translate(F.coalesce(c, F.lit("")), ",\n", "; "), "\r", "")

    return records.select("record_id", F.concat_ws(",", *[cell(c) for c in columns]).alias("line"))


def download_rows(scored: DataFrame, with_confidence: bool = True, flagged: DataFrame | None = None) -> DataFrame:
    """Record fields and, if asked for, confidences with three decimals; only flagged records if their ids are given."""
    out = scored if flagged is None else scored.join(flagged.select("record_id"), "record_id", "left_semi")
    return out.select(*FIELDS, *([fixed(f"s_{f}", 3).alias(f"{f}_confidence") for f in FIELDS] if with_confidence else []))


def save_session(records: DataFrame, path: str) -> None:
    """Replaces the records of the sessions in `records` and of no other: Parquet by session_id, dynamic overwrite."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(path)


def load_session(spark: SparkSession, path: str, session: str) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("session_id") == session).orderBy("record_id")


def package(parts: dict[str, str], metadata: dict) -> bytes:
    """A zip of small texts and a metadata file (S27). For reports, which are small; data stay in write_csv's parts."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        z.writestr("metadata.json", json.dumps(metadata, sort_keys=True))
    return out.getvalue()


def complete_package(scored: DataFrame, folder: str, quality: DataFrame, now: datetime | None = None) -> bytes:
    """The whole export (S27): all records and the flagged ones as CSV parts below folder, and a zip of the quality report and the metadata, whose texts are small.

    quality: part and body, as quality.report_json gives them. The counts of the metadata are observed while the first part is written, and
    the second is written from the same, kept rows: records are computed once.
    """
    began = time.monotonic()
    seen = Observation("package")
    kept = scored.persist()
    counted = kept.observe(seen, F.count("*").alias("n"), F.coalesce(F.avg("overall"), F.lit(0.0)).alias("mean"), F.count_if("flagged").alias("flagged"))
    for name, rows in (("extracted_data", counted), ("flagged_records", kept.filter("flagged"))):
        download_rows(rows).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/{name}")
    kept.unpersist()
    report: dict[str, list] = {}
    for r in quality.collect():
        report.setdefault(r["part"], []).append(json.loads(r["body"]))
    about = {"total_records": seen.get["n"], "average_confidence": seen.get["mean"], "flagged_records_count": seen.get["flagged"], "processing_time": round(time.monotonic() - began, 3)}
    return package({"quality_report.json": json.dumps(report, sort_keys=True)}, about | ({"processing_timestamp": now.isoformat()} if now else {}))


def compression_ratio(compressed: int, original: int) -> float:
    return compressed / original if original else 1.0
