"""Documents from files (S1 to S13, S20 to S22): file checks as columns, word documents and PDF by the standard library, other formats by a pluggable function."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.functions import confidence, support, text
from rollbook.functions.common import strip
from rollbook.functions.headers import header_like
from rollbook.sources.pdf import read_pdf

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DC = "{http://purl.org/dc/elements/1.1/}"
_DCT = "{http://purl.org/dc/terms/}"
_CP = "{http://schemas.openxmlformats.org/package/2006/metadata/core-properties}"
#: Tables of a word document that are kept unless the caller says otherwise (None: all); a result says whether some were left out.
MAX_TABLES = 50
SCHEMA = (
    "path string, status string, text string, title string, creator string, subject string, created string, modified string, last_modified_by string, pages int, paragraphs int, table_count int,"
    " headings array<string>, heading_levels array<string>, heading_positions array<int>, headers array<string>, footers array<string>,"
    " tables array<struct<headers:array<string>,rows:array<array<string>>,page:int,accuracy:double,method:string>>, truncated boolean, errors array<string>, error string"
)
#: What reads the bytes of a document: gives the fields of SCHEMA but path, status and error, or some of them. None here reads pictures.
Reader = Callable[[bytes], dict]


def checked_files(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """path, length, type, message (why it can't be taken, or null), warning, signature_fits and, if asked for, content of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    p, n, c = F.col("path"), F.col("length"), F.col("content")
    out = files.select(
        "path", "length", support.document_type(p).alias("type"), support.file_message(p, n, c).alias("message"), support.size_warning(n).alias("warning"),
        support.signature_fits(p, c).alias("signature_fits"), F.sha2(c, 256).alias("sha256"), *(["content"] if with_content else []),
    )
    return out


def storage_stats(spark: SparkSession, path: str, quota: int) -> DataFrame:
    """For each folder: files, bytes, oldest, newest and percent of the quota (A23, H9). File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.min("modificationTime").alias("oldest"), F.max("modificationTime").alias("newest"), (100.0 * F.sum("length") / quota).alias("pct_quota"))


def _text(node: ElementTree.Element) -> str:
    parts = []
    for x in node.iter():
        if x.tag == f"{_W}t":
            parts.append(x.text or "")
        elif x.tag in (f"{_W}tab", f"{_W}br", f"{_W}cr"):
            parts.append("\t" if x.tag == f"{_W}tab" else "\n")
    return "".join(parts)


def _table(node: ElementTree.Element) -> dict | None:
    rows = [[_text(c).strip() for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
    if not rows:
        return None
    if header_like(rows[0]):
        return {"headers": rows[0], "rows": rows[1:]}
    return {"headers": [f"Column_{i + 1}" for i in range(max(map(len, rows)))], "rows": rows}


def read_docx(content: bytes, max_tables: int | None = MAX_TABLES) -> dict:
    """Paragraphs that aren't blank, joined by empty lines; headings with style and place among them, tables, headers, footers, core properties and counts.

    `truncated` says that tables were left out, `table_count` how many there are.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        parts = {kind: ["\n".join(t for p in ElementTree.fromstring(z.read(n)).iter(f"{_W}p") if (t := _text(p).strip())) for n in sorted(names) if re.fullmatch(rf"word/{kind}\d*\.xml", n)] for kind in ("header", "footer")}
        core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in names else None
    texts, headings, tables = [], [], []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p" and (text := _text(node).strip()):
            style = node.find(f"{_W}pPr/{_W}pStyle")
            if style is not None and (level := style.get(f"{_W}val") or "").startswith("Heading"):
                headings.append((text, level, len(texts)))
            texts.append(text)
        elif node.tag == f"{_W}tbl" and (table := _table(node)):
            tables.append(table)
    about = lambda tag: (core.findtext(tag) or None) if core is not None else None
    counts = {"paragraphs": len(body.findall(f"{_W}p")) if body is not None else 0, "table_count": len(body.findall(f"{_W}tbl")) if body is not None else 0}
    known = {"title": f"{_DC}title", "creator": f"{_DC}creator", "subject": f"{_DC}subject", "created": f"{_DCT}created", "modified": f"{_DCT}modified", "last_modified_by": f"{_CP}lastModifiedBy"}
    found = {"headings": [h[0] for h in headings], "heading_levels": [h[1] for h in headings], "heading_positions": [h[2] for h in headings], "headers": parts["header"], "footers": parts["footer"], "tables": tables[:max_tables], "truncated": max_tables is not None and len(tables) > max_tables}
    return {"text": "\n\n".join(texts)} | {k: about(tag) for k, tag in known.items()} | counts | found


def extracted(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """SCHEMA for each of checked_files: status is `completed`, `partial` (pages had errors), `failed` (with the error, never in the text) or `unsupported`.

    readers: by type; word documents are read by read_docx and PDF by read_pdf unless given otherwise. Files come in batches that Spark bounds in bytes.
    """
    known = {"docx": read_docx, "pdf": read_pdf} | (readers or {})
    kinds = files.sparkSession.createDataFrame([], SCHEMA).schema
    arrow = to_arrow_schema(kinds)
    empty = {f.name: [] if isinstance(f.dataType, T.ArrayType) else None for f in kinds if f.name not in ("path", "status", "error")} | {"text": ""}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {**empty, "path": row["path"], "status": "failed", "error": row["message"]}
                reader = known.get(row["type"])
                if row["message"] is None and reader is None:
                    out |= {"status": "unsupported", "error": f"no reader for {row['type']}"}
                elif row["message"] is None:
                    try:
                        out |= {**empty, **reader(row["content"]), "status": "completed", "error": None}
                        if out["errors"]:
                            out["status"] = "partial" if out["text"].strip() else "failed"
                    except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
                        out |= {"error": f"{type(e).__name__}: {e}"}
                yield pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) for f in arrow], names=kinds.names)

    return files.select("path", "type", "message", "content").mapInArrow(run, kinds)


def processed(extracts: DataFrame, recognised: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """The whole result of each extracted document (S8, S9, A31): path, type, status, text, tables, the basic data (X1), confidences of its parts (C10, C11), and what is counted over them.

    recognised: path and text of another attempt at documents that need it, kept where it has more text. flagged_fields: parts below the threshold;
    a part without finds has 0 and is one. processing_stats' columns: text_length, fields_extracted, fields_flagged, average_confidence, page_count, tables_found, error_count, ocr_used.
    """
    d = extracts.withColumn("type", support.document_type(F.col("path"))).withColumn("text", F.coalesce("text", F.lit("")))
    if recognised is None:
        d = d.withColumn("ocr_used", F.lit(False))
    else:
        d = d.join(recognised.select("path", F.col("text").alias("read")), "path", "left")
        better = text.needs_ocr(F.col("text")) & (F.length("read") > F.length("text")) & (F.col("type") == "pdf")
        d = d.withColumn("ocr_used", F.coalesce(better, F.lit(False))).withColumn("text", F.when(F.col("ocr_used"), F.col("read")).otherwise(F.col("text"))).drop("read")
    d = d.select("*", *[c.alias(n) for n, c in text.basic_data(F.col("text")).items()])
    counts = {n: F.size(n) for n in text.basic_data(F.col("text"))}
    tables, n = F.coalesce(F.size("tables"), F.lit(0)), F.length("text")
    mean = F.aggregate("tables", F.lit(0.0), lambda s, t: s + F.coalesce(t["accuracy"], F.lit(0.8)), lambda s: F.try_divide(s, tables))
    kinds = {k: confidence.document_confidence(k, n, counts, tables, mean if k != "docx" else None) for k in ("pdf", "ocr", "docx")}
    parts = [p for p in kinds["docx"] if p != "average"]
    score = lambda k, p: F.when(tables > 0, kinds[k][p]) if p == "tables" else kinds[k][p]  # noqa: E731  no tables are no part
    of = lambda k: F.filter(F.array(*[F.struct(F.lit(p).alias("part"), score(k, p).alias("score")) for p in parts if p in kinds[k]]), lambda x: x["score"].isNotNull())
    d = d.withColumn("parts", F.when(F.col("type") == "docx", of("docx")).when(F.col("ocr_used"), of("ocr")).otherwise(of("pdf")))
    low = F.transform(F.filter("parts", lambda x: x["score"] < threshold), lambda x: x["part"])
    scores = F.map_from_entries("parts")
    average = F.round(F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["score"]) / F.size("parts"), 3)
    found = sum((F.when(c > 0, 1).otherwise(0) for c in [*counts.values(), tables]), F.lit(0))
    errors = F.size("errors") + F.when(F.col("error").isNotNull(), 1).otherwise(0)
    return d.select(
        "path", "type", "status", "text", "tables", *counts, scores.alias("confidence_scores"), low.alias("flagged_fields"), n.alias("text_length"), found.alias("fields_extracted"), F.size(low).alias("fields_flagged"),
        average.alias("average_confidence"), F.col("pages").alias("page_count"), tables.alias("tables_found"), errors.alias("error_count"), "ocr_used", "truncated", "errors", "error",
    )


#: Pages of a PDF that are looked at before it is taken: a fixed value.
LOOKED_AT = 3


def upload_analysis(files: DataFrame) -> DataFrame:
    """What checked files hold, before they are taken (S22, H12): path, page_count, has_text, text_length, estimated_records, info, warnings and recommendations.

    Of a PDF the first pages are read, and all are counted; a word document is one page, its tables' cells count as text. What is estimated
    is 0 without text. Files that can't be taken or read have a warning.
    """
    few = extracted(files, {"pdf": lambda content: read_pdf(content, LOOKED_AT, with_tables=False)})
    kind, mb = support.document_type(F.col("path")), F.col("length") / (1 << 20)
    # cells of the tables, and of their headings where these are the document's own
    cells = F.flatten(F.transform("tables", lambda t: F.concat(F.when(t["headers"][0] == "Column_1", F.array().cast("array<string>")).otherwise(t["headers"]), F.flatten(t["rows"]))))
    body = F.coalesce("text", F.lit(""))
    word = F.concat(F.when(body == "", "").otherwise(F.concat(F.replace(body, F.lit("\n\n"), F.lit("\n")), F.lit("\n"))), F.array_join(F.transform(cells, lambda c: F.concat(c, F.lit(" "))), ""))
    d = files.select("path", "length").join(few, "path").withColumn("looked", F.when(kind == "docx", word).otherwise(F.replace(body, F.lit("\n\n"), F.lit(""))))
    paragraphs = F.when(body == "", 0).otherwise(F.size(F.split(body, "\n\n")))
    has = F.length(strip(F.col("looked"))) > 0
    d = d.select("path", mb.alias("mb"), kind.alias("type"), F.when(kind == "docx", 1).otherwise(F.coalesce("pages", F.lit(0))).alias("page_count"), has.alias("has_text"), F.length("looked").alias("text_length"),
                 F.when(has, text.estimated_records(F.col("looked"))).otherwise(0).alias("estimated_records"), paragraphs.alias("paragraphs"), F.coalesce("table_count", F.lit(0)).alias("table_count"), "errors", "error", "status")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and " " in p else F.col(p).cast("string") for p in parts])
    read = F.col("error").isNull()
    info = F.array_compact(F.array(
        F.when(read & (F.col("type") == "pdf"), say("PDF contains ", "page_count", " page(s)")), F.when(read & (F.col("type") == "docx"), say("Document contains ", "paragraphs", " paragraph(s) and ", "table_count", " table(s)")),
        F.when(F.col("has_text"), say("Extracted ", "text_length", " characters of text")), F.when(F.col("has_text"), say("Estimated ", "estimated_records", " potential record(s)")),
    ))
    none = F.when(F.col("type") == "pdf", "No readable text found. Document may be scanned or corrupted.").otherwise("No readable text found in document.")
    warnings = F.concat(F.coalesce("errors", F.array().cast("array<string>")), F.array_compact(F.array(F.when(~read, F.concat(F.upper("type"), F.lit(" analysis failed: "), "error")), F.when(read & ~F.col("has_text"), none))))
    advice = support.upload_advice(F.col("mb"), F.col("has_text"), F.col("estimated_records"), F.concat(F.lit("."), "type"), F.col("page_count"))
    return d.select("path", "page_count", "has_text", "text_length", "estimated_records", info.alias("info"), warnings.alias("warnings"), advice.alias("recommendations"))


def with_fallback(first: DataFrame, second: DataFrame) -> DataFrame:
    """Extraction results with a second attempt's text where the first failed and the second has more of it."""
    b = second.select("path", F.col("text").alias("text2"))
    better = (F.col("status") != "completed") & (F.length("text2") > F.length("text"))
    return first.join(b, "path", "left").withColumn("status", F.when(better, "partial").otherwise(F.col("status"))).withColumn("text", F.when(better, F.col("text2")).otherwise(F.col("text"))).drop("text2")


def page_confidence(words: DataFrame) -> DataFrame:
    """For each document of recognised words (path, page, text, conf): pages, pages with words, and the mean of their mean confidences."""
    kept = words.filter((F.trim("text") != "") & (F.col("conf") > 30)).groupBy("path", "page").agg(F.avg("conf").alias("mean"))
    every = words.groupBy("path").agg(F.countDistinct("page").alias("pages"))
    return every.join(kept.groupBy("path").agg(F.count("*").alias("pages_with_text"), F.avg("mean").alias("confidence")), "path", "left").select("path", "pages", F.coalesce("pages_with_text", F.lit(0)).alias("pages_with_text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def labelled_lines(extracts: DataFrame) -> DataFrame:
    """path, pos, label and text of the rule set's entities in the lines of extracted documents (S20's last step, X12)."""
    lines = extracts.filter(F.col("text") != "").select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("path", "pos", F.inline(text.ruler(F.col("line"))))


def word_confidence(words: DataFrame) -> DataFrame:
    """For each page of recognised words (page, text, conf): kept words, mean, least, most, population deviation, low and high ones."""
    kept = words.filter((F.trim("text") != "") & (F.col("conf") > 30))
    return kept.groupBy("page").agg(
        F.count("*").alias("n"), F.avg("conf").alias("mean"), F.min("conf").alias("least"), F.max("conf").alias("most"), F.stddev_pop("conf").alias("std"),
        F.count_if(F.col("conf") < 60).alias("low"), F.count_if(F.col("conf") > 80).alias("high"),
    )
