"""Support rules (H1, H4, H5, H7, H8, H10, H12, ST9) and file checks (S1 to S7), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollbook.functions.common import strip, when_first

# Limits, signatures and suffixes.
MAX_BYTES, WARN_BYTES, SMALL_BYTES = 100 << 20, 80 << 20, 1 << 10
PDF, ZIP, EMPTY_ZIP, OLE = "25504446", "504B0304", "504B0506", "D0CF11E0A1B11AE1"
#: Ordered: the first class of which all of the patterns are found counts.
ERROR_CLASSES = (
    (("file too large|size exceeds",), "file_too_large"), (("unsupported format|invalid file",), "unsupported_format"), (("corrupted|cannot read",), "corrupted_file"),
    (("pdf", "extract|read"), "pdf_extraction_failed"), (("ocr|tesseract",), "ocr_failed"), (("no text|empty document",), "no_text_extracted"),
    (("spacy|nlp",), "nlp_model_unavailable"), (("entity|extraction",), "entity_extraction_failed"), (("memory",), "memory_error"),
    (("disk|space",), "disk_space_error"), (("database|connection",), "database_error"), (("validation",), "validation_failed"),
)
STAGES = {
    "queued": 0.0, "processing": 0.1, "document_extraction": 0.2, "nlp_processing": 0.3, "entity_extraction": 0.4, "data_structuring": 0.5, "confidence_scoring": 0.6,
    "data_validation": 0.7, "quality_assessment": 0.8, "flagging_records": 0.85, "csv_generation": 0.9, "finalizing": 0.95, "completed": 1.0, "error": 0.0,
}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def document_type(path: Column) -> Column:
    """By the extension, or the kind of file that it stands for."""
    return when_first((suffix(path) == ".pdf", "pdf"), (suffix(path).isin(".docx", ".docm"), "docx"), other="unknown")


def _starts(content: Column, mark: str) -> Column:
    return F.hex(F.substring(content, 1, len(mark) // 2)) == mark


def signature_fits(path: Column, content: Column) -> Column:
    s = suffix(path)
    return F.when(s == ".pdf", _starts(content, PDF)).when(s == ".docx", _starts(content, ZIP) | _starts(content, EMPTY_ZIP)).when(s == ".doc", _starts(content, OLE)).otherwise(F.lit(False))


def file_message(path: Column, length: Column, content: Column | None = None) -> Column:
    """Why a file can't be taken; null if it can. The first reason counts. With content its first bytes must fit; without, as where a file's kind is guessed by its name alone, they needn't."""
    tests = [(length > MAX_BYTES, "file too large"), (length == 0, "file is empty"), (~suffix(path).isin(".pdf", ".docx", ".doc"), "unsupported file type")]
    if content is not None:
        tests.append((~signature_fits(path, content), "content does not match file type"))
    return when_first(*tests)


def size_warning(length: Column) -> Column:
    return when_first((length > MAX_BYTES, "error: over 100 MB"), (length > WARN_BYTES, "warning: large"), (length < SMALL_BYTES, "warning: small"), other="ok")


def memory_estimate(records: Column, batch_size: int) -> Column:
    """MB of a batch and of all records at 1 KB a record, and the batch size to take."""
    least = F.greatest(F.lit(100), F.floor(records / 10))
    return F.struct(F.lit(batch_size / 1024).alias("batch_memory_mb"), (records / 1024).alias("total_memory_mb"), F.least(F.lit(batch_size), least).cast("long").alias("recommended_batch_size"))


def upload_advice(size_mb: Column, has_text: Column, estimated_records: Column, extension: Column, pages: Column) -> Column:
    """The recommendations on an upload, in order; unknown values count as zero or false."""
    def number(c: Column) -> Column:
        return F.coalesce(c, F.lit(0))

    return F.array_compact(F.array(
        F.when(number(size_mb) > 50, "Consider splitting large documents for faster processing"),
        F.when(~F.coalesce(has_text, F.lit(False)), "Document appears to be scanned. OCR processing will be used, which may take longer"),
        F.when(number(estimated_records) == 0, "No HMO-related content detected. Please verify this is the correct document type"),
        F.when((extension == ".pdf") & (number(pages) > 20), "Large PDF detected. Consider using DOCX format for better processing speed"),
    ))


def stored_name(session: Column, content: Column, path: Column) -> Column:
    return F.concat(session, F.lit("_"), F.left(F.sha2(content, 256), F.lit(16)), suffix(path))


def error_class(message: Column) -> Column:
    low = F.lower(message)
    tests = []
    for patterns, name in ERROR_CLASSES:
        test = low.rlike(patterns[0])
        for p in patterns[1:]:
            test = test & low.rlike(p)
        tests.append((test, name))
    return when_first(*tests, other="unknown_error")


def large_file_plan(mb: Column) -> Column:
    """How to process a file of that many megabytes: a struct of switches and limits."""
    return F.struct(
        (mb > 50).alias("chunked"),
        F.least(F.lit(10.0), mb / 10).alias("chunk_mb"),
        (mb > 20).alias("watch_memory"),
        (mb > 100).alias("disk_cache"),
        (mb > 30).alias("concurrent"),
        when_first((mb > 100, 1024), (mb > 50, 1536), other=2048).alias("memory_limit_mb"),
        when_first((mb > 100, 5), (mb > 50, 10), other=20).alias("batch_size"),
    )


def safe_name(name: Column) -> Column:
    """A file name for exports: odd characters and white space become underscores; at most 100 characters."""
    plain = F.regexp_replace(strip(F.regexp_replace(name, r'[<>:"/\\\\|?*]', "_")), r"\s+", "_")
    return F.when(plain == "", "export").otherwise(F.left(plain, F.lit(100)))


def stored_file_name(path: Column) -> Column:
    """A file name for storage: no folders, odd characters become underscores; at most 255 characters, the extension kept."""
    plain = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r'[<>:"|?*\\]', "_")
    ending = F.regexp_extract(plain, r"[^.](\.[^.]*)$", 1)
    return F.when(F.length(plain) > 255, F.concat(F.left(plain, F.lit(255) - F.length(ending)), ending)).otherwise(plain)


def inside(path: Column, base: str) -> Column:
    """Whether a path, its dots resolved, lies in the folder base or is it (H8): by parts, so /base2 isn't inside /base."""
    part = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(part, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    folder = [x for x in base.split("/") if x and x != "."]
    return path.startswith("/") & (F.slice(kept, 1, max(1, len(folder))) == F.array(*map(F.lit, folder)) if folder else path.startswith("/"))


def cache_key(content: Column, options: Column) -> Column:
    """The key of a processed document's result (H4): by its content and options, not by name and size."""
    return F.md5(F.concat(F.sha2(content, 256), F.lit("|"), F.coalesce(options, F.lit(""))).cast("binary"))


def download_problem(known: Column, now: Column, expires: Column, downloads: Column, most: Column, exists: Column) -> Column:
    """Why a download token isn't good (ST9), the first reason; empty text if it is."""
    return when_first(
        (~F.coalesce(known, F.lit(False)), "Invalid download token"), (now > expires, "Download link has expired"),
        (F.coalesce(downloads, F.lit(0)) >= most, "Download limit exceeded"), (~F.coalesce(exists, F.lit(False)), "File no longer available"), other="",
    )


def clamp_progress(p: Column) -> Column:
    """Within 0 and 100; null, which is no progress given, stays null."""
    return F.when(p.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), p)))


def stage_progress(stage: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in STAGES.items() for x in p]), stage), F.lit(0.0))
