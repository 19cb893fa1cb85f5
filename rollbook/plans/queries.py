"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import confidence, mapping, scoring, sentences, support, text, validation
from rollbook.operators import asof, audit, entities, quality, records
from rollbook.schema import FIELDS
from rollbook.sources import cache, fixtures, sinks
from rollbook.streaming import inbox

#: The day that rules about old and future dates are held against.
AS_OF = date(2001, 8, 1)
#: What stands before a field in its text.
CONTEXT = {"council": "Council: ", "reference": "Licence reference no ", "hmo_address": "Property address: ", "licence_start": "Start date ", "hmo_manager_name": "HMO manager: ", "max_occupancy": ""}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, so that engines that add in another order agree."""
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.with_scores(fixtures.licence_records(spark, sf_dir))


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.with_validation(scored(spark, sf_dir), AS_OF)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.licence_documents(fixtures.licence_records(spark, sf_dir))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.licence_lines(fixtures.licence_records(spark, sf_dir))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.state(fixtures.review_log(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    out = o.groupBy(F.concat(F.lit("S"), (F.col("o_orderkey") % 7).cast("string")).alias("session_id")).agg(F.min("o_orderdate").alias("uploaded"), F.max("o_orderdate").alias("last"), F.count("*").alias("n_records"))
    status = F.element_at(F.array(*map(F.lit, ("completed", "processing", "failed"))), (F.substring("session_id", 2, 1).cast("int") % 3 + 1))
    return out.select("session_id", "uploaded", "n_records", status.alias("status"), F.when(status != "processing", F.col("last")).alias("finished"))


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as operations that took time and memory."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("operation_id"), F.col("event_type").alias("operation"), F.col("ts").alias("began"), (F.col("value") / 10).alias("seconds"), (F.col("user_id") % 300 + 20.5).alias("memory_mb"), (F.col("event_id") % 13 != 0).alias("success"))


def joined(a: Column | str) -> Column:
    return F.array_join(a, "|")


@query
def c08_council_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).groupBy("council").agg(F.count("*").alias("n"), F.avg("overall").alias("mean_overall"), F.count_if("flagged").alias("n_flagged")))


@query
def c01_record_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("record_id", *[f"s_{f}" for f in FIELDS], "overall", joined("errors").alias("errors"), "flagged"))


@query
def c12_extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = fixtures.licence_records(spark, sf_dir)
    made = [confidence.confidence(f, F.col(f).cast("string"), F.lit(c), F.lit("regex_pattern")).alias(f"k_{f}") for f, c in CONTEXT.items()]
    low = [confidence.is_low(f, F.col(f"k_{f}")).alias(f"low_{f}") for f in CONTEXT]
    return rounded(rec.select("record_id", *made).select("*", *low))


@query
def c10_found_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc", F.length("text").alias("len"), *[F.size(c).alias(n) for n, c in text.basic_data(F.col("text")).items()])
    return rounded(d.select("doc", *[confidence.found_score(F.col(n), F.col("len")).alias(n) for n in ("potential_references", "potential_addresses", "potential_dates", "potential_numbers")], confidence.found_score(F.col("potential_dates"), F.col("len"), 0.9, 0.4).alias("word_dates")))


@query
def v12_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(checked(spark, sf_dir).select("record_id", "v_score", "v_valid", joined("v_errors").alias("v_errors"), joined("v_warnings").alias("v_warnings"), F.size("v_suggestions").alias("n_suggestions")))


@query
def a01_field_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.field_metrics(checked(spark, sf_dir)))


@query
def a04_session_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.session_quality(checked(spark, sf_dir)))


@query
def a05_flag_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir).select("record_id", quality.flag_reasons().alias("reason")).filter("reason != ''")


@query
def a06_field_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.field_statistics(scored(spark, sf_dir)))


@query
def a06_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.distribution(scored(spark, sf_dir)))


@query
def a07_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.quartiles(scored(spark, sf_dir).select("overall")))


@query
def a08_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.completeness(fixtures.licence_records(spark, sf_dir)))


@query
def a08_record_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.record_completeness(fixtures.licence_records(spark, sf_dir)))


@query
def a09_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.message_counts(checked(spark, sf_dir))


@query
def a09_warning_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.message_counts(checked(spark, sf_dir), "v_warnings")


@query
def a10_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.recommendations(checked(spark, sf_dir))


@query
def a12_top_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_messages(checked(spark, sf_dir))


@query
def a12_validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.validation_summary(checked(spark, sf_dir)))


@query
def a13_session_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.session_metrics(scored(spark, sf_dir), sessions(spark, sf_dir).withColumnRenamed("uploaded", "started")))


@query
def a14_export_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.export_checks(fixtures.licence_records(spark, sf_dir), mapping.preset("standard"))


@query
def a14_export_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.export_summary(fixtures.licence_records(spark, sf_dir), mapping.preset("standard"))


@query
def a14_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.record_errors(fixtures.licence_records(spark, sf_dir), mapping.preset("standard"))


@query
def a16_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    results = s.select("record_id", F.inline(F.array(*[F.struct(v.alias("value"), c.alias("confidence")) for v, c in ((F.col("council"), F.col("s_council")), (F.upper("council"), F.lit(0.6)), (F.col("council"), F.lit(0.5)))])))
    return rounded(quality.ensemble(results, "record_id"))


@query
def a17_confidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.confidence_report(scored(spark, sf_dir)))


@query
def a17_document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.document_report(scored(spark, sf_dir)).withColumns({c: joined(c) for c in ("flagged_fields", "advice")}))


@query
def a18_session_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.session_summary(states(spark, sf_dir)))


@query
def a19_audit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.statistics(states(spark, sf_dir))


@query
def a20_reviewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.reviewer_report(states(spark, sf_dir))


@query
def a20_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.audit_report(states(spark, sf_dir)))


@query
def a20_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.top_reasons(states(spark, sf_dir))


@query
def a20_corrected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = fixtures.licence_records(spark, sf_dir)
    as_map = lambda cs: F.create_map(*[x for n, c in cs.items() for x in (F.lit(n), c)])
    names = ("council", "reference", "licence_holder_name")
    return audit.corrected_fields(rec.select(as_map({n: F.col(n) for n in names}).alias("before"), as_map({n: F.upper(n) for n in names} | {"other": F.lit("x")}).alias("after")))


@query
def a22_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.status_histogram(states(spark, sf_dir))


@query
def a24_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.performance(operations(spark, sf_dir)))


@query
def a24_last_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.last_operations(operations(spark, sf_dir)))


@query
def a26_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.buckets(scored(spark, sf_dir)))


@query
def a27_field_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = scored(spark, sf_dir).select(F.explode(scoring.score_map()).alias("field", "score"))
    return rounded(long.groupBy("field").agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.count("*").alias("n")))


@query
def a28_data_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.data_statistics(fixtures.licence_records(spark, sf_dir)))


@query
def a30_editor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).groupBy(quality.four_way(F.col("overall")).alias("status")).agg(F.count("*").alias("n"))


@query
def a30_edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record as an edit of one with upper-case texts and one storey more."""
    s = scored(spark, sf_dir)
    was = {f"was_{f}": F.upper(f) if t == "string" else F.col(f) + F.lit(int(f == "number_of_storeys")) for f, t in s.select(*FIELDS).dtypes}
    return rounded(quality.edit_summary(s.withColumns(was)))


@query
def a31_processing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is counted over each document as a PDF without tables: parts below 0.7 are flagged. documents.processed has this for files."""
    d = table(spark, sf_dir, "documents")
    found = text.basic_data(F.col("text"))
    sized = d.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n"), *[F.coalesce(F.size(c), F.lit(0)).alias(k) for k, c in found.items()])
    fields = sum((F.when(F.col(k) > 0, 1).otherwise(0) for k in found), F.lit(0))
    score = confidence.document_confidence("pdf", F.col("n"), {k: F.col(k) for k in found}, F.lit(0))
    parts = [p for p in score if p not in ("average", "tables")]
    low = F.array_compact(F.array(*[F.when(F.round(score[p], 9) < 0.7, p) for p in parts]))
    average = F.round(sum((score[p] for p in parts), F.lit(0.0)) / len(parts), 3)
    return sized.select("doc_id", F.col("n").alias("text_length"), fields.alias("fields_extracted"), text.needs_ocr(F.col("text")).alias("ocr_used"), average.alias("average_confidence"), F.array_join(low, ",").alias("flagged_fields"), F.size(low).alias("fields_flagged"))


@query
def a17_field_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.field_analysis(fixtures.licence_records(spark, sf_dir), CONTEXT))


@query
def h03_service_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' event streams as services: a check is good if its value is above 20, and fails itself if the event is an error."""
    e = table(spark, sf_dir, "events")
    checks = e.select(F.concat(F.lit("service_"), (F.col("user_id") % 40).cast("string")).alias("name"), "ts", F.when(F.col("event_type") != "error", F.col("value") > 20).alias("healthy"))
    return audit.service_health(checks, {f"service_{k}": f"fallback_{k}" for k in range(0, 40, 3)})


@query
def h10_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory that exports of each customer's orders take, a hundred records an order, in batches of a thousand."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg((F.count("*") * 100).alias("records"))
    return rounded(o.select("o_custkey", support.memory_estimate(F.col("records"), 1000).alias("m")).select("o_custkey", "m.*"))


@query
def h12_upload_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads: a hundred characters a page, a MB for each 500."""
    d = table(spark, sf_dir, "documents").withColumn("n", F.coalesce(F.length("text"), F.lit(0)))
    records = F.floor(F.size(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("licence|license"), F.lit(0))) / 5)
    advice = support.upload_advice(F.col("n") / 500, ~text.needs_ocr(F.col("text")), records, F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".docx"), F.floor(F.col("n") / 100))
    return d.select("doc_id", F.array_join(advice, "|").alias("advice"))


@query
def r04_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of three fields as a map, with the penalty for records of every third session, which are taken as read by a fallback."""
    fields = ("council", "reference", "hmo_address")
    s = scored(spark, sf_dir)
    scores = F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f"s_{f}").cast("double"))])
    out = s.select("record_id", records.with_penalty(scores, F.col("session_id").isin("S0", "S3", "S6")).alias("m"))
    return rounded(out.select("record_id", *[F.col("m")[f].alias(f) for f in fields]))


@query
def r06_table_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's brand as a table of three columns whose rows have one to four cells: short rows padded, cells too many dropped."""
    part = table(spark, sf_dir, "part")
    cells = F.slice(F.array("p_name", "p_type", F.col("p_size").cast("string"), F.lit("too many")), F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int"))
    tables = part.groupBy(F.col("p_brand").alias("doc")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", cells.alias("row")))), lambda x: x["row"]).alias("rows"))
    out = records.table_records(tables.select("doc", F.array(F.lit("name"), F.lit("type"), F.lit("size")).alias("headers"), "rows"))
    return out.select("doc", "i", *[F.col("record")[c].alias(c) for c in ("name", "type", "size")])


@query
def c10_document_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidences of documents' parts as PDF, recognised pictures and word documents, with up to two tables."""
    found = text.basic_data(F.col("text"))
    d = documents(spark, sf_dir).select("doc", F.length("text").alias("n"), (F.col("doc") % 3).cast("int").alias("tables"), (F.col("doc") % 7 / 7).alias("accuracy"), *[F.size(c).alias(k) for k, c in found.items()])
    parts = []
    for kind in ("pdf", "ocr", "docx"):
        made = confidence.document_confidence(kind, F.col("n"), {k: F.col(k) for k in found}, F.col("tables"), F.when(F.col("doc") % 2 == 0, F.col("accuracy")))
        parts += [made[k].alias(f"{kind}_{k}") for k in ("potential_references", "tables", "full_text", "average")]
    return rounded(d.select("doc", *parts))


@query
def x01_basic_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc", *[F.array_join(c.cast("array<string>"), "|").alias(n) for n, c in text.basic_data(F.col("text")).items()])


@query
def x03_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("doc", "pos", F.inline(text.address_candidates(F.col("line"))))
    return found.select("doc", "pos", F.col("text").alias("address"), "confidence")


@query
def x05_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = fixtures.licence_records(spark, sf_dir)
    body = F.concat_ws(" to ", "licence_start", "licence_expiry")
    return rec.select("record_id", F.array_join(text.dates(body), "|").alias("dates"), F.array_join(text.dates(body, compat=True), "|").alias("compat_dates"))


@query
def x06_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    return d.select("doc", F.array_join(text.references(F.col("text")), "|").alias("refs"), F.array_join(text.references(F.col("text"), True), "|").alias("distinct_refs"))


@query
def x08_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("doc", "pos", F.inline(text.names(F.col("line"))))
    return d.select("doc", "pos", F.col("text").alias("name"), "confidence")


@query
def x12_ruler(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("doc", "pos", F.inline(text.ruler(F.col("line"))))
    return rounded(d.select("doc", "pos", "label", F.col("text").alias("entity"), confidence.entity_confidence(F.col("label"), F.col("text")).alias("confidence")))


@query
def x11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's sentences and tokens: how many, the longest sentence and the digest of each list."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = d.select("doc_id", sentences.sentences(F.col("text")).alias("s"), sentences.tokens(F.col("text")).alias("t"))
    longest = F.coalesce(F.array_max(F.transform("s", F.length)), F.lit(0))
    return parts.select("doc_id", F.size("s").cast("long").alias("sentences"), F.size("t").cast("long").alias("tokens"), longest.cast("long").alias("longest"), F.md5(F.array_join("s", "|")).alias("sentence_md5"), F.md5(F.array_join("t", "|")).alias("token_md5"))


@query
def x11_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence documents and the documents table by a model that all licence documents trained: spans (label:begin:end), the persons (X15) and the addresses with the places."""
    licence = documents(spark, sf_dir).withColumn("source", F.lit("licence")).withColumnRenamed("doc", "id")
    model = entities.train(entities.training(licence))
    both = licence.select("source", "id", "text").union(fixtures.spread(table(spark, sf_dir, "documents").select(F.lit("documents"), "doc_id", "text")))
    found = entities.tagged(both.select(F.struct("source", "id", F.coalesce("text", F.lit("")).alias("text")).alias("of"), "text"), model, "of")
    kept = found.select("of.source", "of.id", F.col("of.text").alias("text"), "entities")
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["label"], e["begin"].cast("string"), e["end"].cast("string"))), ",")
    addresses = text.address_count(F.col("text")) + F.size(entities.places(F.col("entities")))
    return kept.select("source", "id", spans.alias("spans"), F.array_join(text.person_names(F.col("entities")), "|").alias("persons"), addresses.alias("addresses"))


@query
def x16_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("doc", "pos", F.inline(text.fallback(F.col("line"))))
    return d.select("doc", "pos", "kind", F.col("text").alias("entity"), "confidence")


@query
def x14_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(spark, sf_dir).select("doc", "pos", F.inline(text.entities(F.col("line"))))
    return d.select("doc", "pos", "label", F.col("text").alias("entity"), "confidence")


@query
def r01_entity_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = documents(spark, sf_dir).select(
        "doc", text.find_all(t, text.FALLBACK[0][1]).alias("councils"), text.references(t, True).alias("references"), text.find_all(t, text.STREET).alias("addresses"),
        text.dates(t).alias("dates"), F.transform(text.names(t), lambda n: n["text"]).alias("names"), text.find_all(t, text.BASIC_NUMBERS[2]).alias("occupancies"),
    )
    return records.from_entities(d)


@query
def r02_line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.from_lines(lines(spark, sf_dir)).withColumn("scores", F.to_json("scores"))


@query
def r03_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    split = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return records.with_default(docs.select(F.col("doc_id").alias("doc")), records.from_lines(split)).select("doc", "i", "council", "is_default", "extraction_note", "record_id", "needs_review")


@query
def r05_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = records.from_json(records.to_json(scored(spark, sf_dir)))
    return rounded(back.select("record_id", *FIELDS, F.element_at("confidence_scores", "council").alias("council_score"), joined("validation_errors").alias("errors")))


@query
def e01_mapping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.preset("detailed")
    return fixtures.licence_records(spark, sf_dir).select("record_id", *[m.error().alias(f"e_{m.source}") for m in found])


@query
def e04_export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mapping.preset("compact")
    found[1].default, found[5].default = "none", 1
    return fixtures.licence_records(spark, sf_dir).select("record_id", *[m.formatted().alias(m.source) for m in found])


@query
def e07_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records as each user preset shows them, its columns' values joined."""
    s = scored(spark, sf_dir)
    made = []
    for name, shown in mapping.UI_NAMES.items():
        view = mapping.ui_view(s, name)
        made.append(view.select(F.lit(name).alias("preset"), "record_id", F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in shown.values()]).alias("shown"), "level", "needs_review"))
    return made[0].unionByName(made[1]).unionByName(made[2])


@query
def s15_needs_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.needs_ocr(F.col("text")).alias("needs_ocr"), text.estimated_records(F.col("text")).alias("estimated_records"))


@query
def s01_file_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.element_at(F.array(*map(F.lit, (".pdf", ".DOCX", ".doc", ".txt"))), (F.col("page_id") % 4 + 1).cast("int"))).alias("path"), (F.length("html") * (F.col("page_id") % 11) * 9000).alias("n"))
    return p.select("page_id", support.document_type(F.col("path")).alias("type"), support.file_message(F.col("path"), F.col("n")).alias("message"), support.size_warning(F.col("n")).alias("warning"), support.safe_name(F.col("path")).alias("safe"))


@query
def h07_stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("up/"), F.regexp_replace("url", "/", "?"), F.repeat(F.lit("x"), (F.col("page_id") % 3 * 150).cast("int")), F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", support.stored_file_name(name).alias("stored"))


@query
def h08_safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, ("/base/a/b.pdf", "/base2/a", "/base/../etc", "/base/./x/../y", "base/a", "/", "/base"))), (F.col("page_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", support.inside(path, "/base").alias("safe"))


@query
def st09_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens made by signups, used by clicks of the same user (the download log), and why each view's token is good or not at its time, after the downloads before it."""
    e = table(spark, sf_dir, "events").withColumn("token", F.col("user_id") % 500)
    links = e.filter("event_type = 'signup'").groupBy("token").agg(F.min("ts").alias("created")).withColumn("exists", F.col("token") % 9 != 0)
    used = e.filter("event_type = 'click'").join(links, "token").filter("ts >= created")
    asked = asof.earlier_counts(e.filter("event_type = 'view'").select("event_id", "token", "ts"), used, "token", "ts", alias="downloads").join(links, "token", "left")
    known = F.coalesce(F.col("created") <= F.col("ts"), F.lit(False))
    problem = support.download_problem(known, F.col("ts"), F.col("created") + F.expr("interval 7 days"), F.col("downloads"), F.lit(10), F.col("exists"))
    return asked.select("event_id", "downloads", problem.alias("problem"))


@query
def h04_cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last day's events as cached results of up to 100 bytes a unit of value: which stay at a limit of 400 KB."""
    e = table(spark, sf_dir, "events").select(F.md5(F.col("event_id").cast("string")).alias("key"), F.col("ts").alias("stored_at"), (F.abs("value") * 100).cast("long").alias("bytes"))
    return cache.kept(cache.fresh(e, datetime(2024, 1, 30)), 400_000).select("key", "bytes")


@query
def s25_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.csv_lines(fixtures.licence_records(spark, sf_dir))


@query
def s26_download_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return sinks.download_rows(s, flagged=s.filter("flagged").select("record_id")).select("council", "reference", "council_confidence", "reference_confidence", "hmo_address_confidence")


@query
def s28_audited_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.audited_export(scored(spark, sf_dir), states(spark, sf_dir), include_rejected=True))


@query
def j01_sessions_flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sessions_flagged(sessions(spark, sf_dir), states(spark, sf_dir), 5)


@query
def j02_sessions_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sessions_completed(sessions(spark, sf_dir), states(spark, sf_dir))


@query
def j03_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.trail(states(spark, sf_dir), fixtures.review_log(spark, sf_dir))


@query
def j05_reviewed_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.export(fixtures.licence_records(spark, sf_dir), states(spark, sf_dir)).select("record_id", "council", "reference")


@query
def j07_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.orphans(fixtures.licence_records(spark, sf_dir), sessions(spark, sf_dir).filter("session_id < 'S5'")).select("record_id", "session_id")


@query
def w02_recent_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent_each(fixtures.review_log(spark, sf_dir)).select("record_id", "event_id", "nth")


@query
def w04_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.latest(fixtures.review_log(spark, sf_dir)).select("record_id", "event_id", "action")


@query
def w06_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.sliding(fixtures.review_log(spark, sf_dir)))


@query
def o04_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.review_list(states(spark, sf_dir), status="approved", low=10.0, high=60.0, sort="confidence").select("record_id", "status", "confidence", "corrections"))


@query
def o07_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.recent(fixtures.review_log(spark, sf_dir)).select("event_id", "record_id", "action", "reviewer")


@query
def o09_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return audit.retained(o, "o_orderdate", datetime(2001, 8, 1), 30).select("o_orderkey")


@query
def st07_review_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(states(spark, sf_dir).select("record_id", "session_id", "status", "reviewer", "corrections", "confidence", "events"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    action = F.element_at(F.create_map(*[F.lit(x) for p in (("signup", "enqueue"), ("view", "start"), ("purchase", "finish"), ("error", "fail"), ("click", "cancel")) for x in p]), F.col("event_type"))
    return e.select(F.concat(F.lit("J"), (F.col("event_id") % 1999).cast("string")).alias("job_id"), F.lit("S").alias("session_id"), action.alias("action"), F.when(F.col("event_id") % 3 > 0, F.col("user_id") % 200 - 40).cast("int").alias("progress"), "ts")


@query
def st02_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.job_states(jobs(spark, sf_dir)).select("job_id", "status", "progress")


@query
def st01_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.hourly(jobs(spark, sf_dir))


@query
def h01_error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = ("File too large: 120MB", "invalid file header", "Cannot read stream", "PDF could not be extracted", "tesseract missing", "No text on page", "spaCy model", "entity lost", "out of memory", "disk full", "database locked", "validation broke", "something else")
    message = F.element_at(F.array(*map(F.lit, said)), (F.col("event_id") % len(said) + 1).cast("int"))
    return table(spark, sf_dir, "events").groupBy(support.error_class(message).alias("class")).agg(F.count("*").alias("n"))


@query
def h03_system_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as services: healthy if less than a third of their events have a value below 10."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name")).agg((F.count_if(F.col("value") < 10) * 3 < F.count("*")).alias("good"))
    return audit.system_status(e.select("name", F.when((F.col("name") != "error") & F.col("good"), "healthy").otherwise("unavailable").alias("status")))


@query
def h13_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.efficiency(states(spark, sf_dir), fixtures.review_log(spark, sf_dir)))


@query
def h05_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = support.large_file_plan(F.col("o_totalprice") / 1000)
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", plan.alias("p")).select("o_orderkey", "p.*"))


@query
def t01_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.array("council", "reference", "hmo_address", "licence_holder_name")
    return fixtures.licence_records(spark, sf_dir).select("record_id", text.looks_like_header(row).alias("is_header"))


@query
def a11_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report_json(checked(spark, sf_dir))


@query
def a11_report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report_summary(checked(spark, sf_dir))


@query
def a15_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report_lines(fixtures.licence_records(spark, sf_dir), mapping.preset("standard"))


@query
def a21_database_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.database_stats(fixtures.licence_records(spark, sf_dir), states(spark, sf_dir))


@query
def a21_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.session_counts(sessions(spark, sf_dir))


@query
def a25_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.hit_rate(fixtures.review_log(spark, sf_dir), F.col("action") == "approved"))


@query
def j04_session_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).join(fixtures.licence_records(spark, sf_dir), "session_id").select("session_id", "n_records", "record_id", "reference")


@query
def w03_record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.indexed(fixtures.licence_records(spark, sf_dir)).select("record_id", "session_id", "place")


@query
def o01_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.list_sessions(sessions(spark, sf_dir), 4)


@query
def o02_sessions_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.list_sessions(sessions(spark, sf_dir), 100, "completed").select("session_id", "status")


@query
def o04_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(audit.review_list(states(spark, sf_dir), high=1e9, sort="status", descending=False, reason="reason 3").select("record_id", "status", "reason", "confidence"))


@query
def o08_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.newest(table(spark, sf_dir, "events"), "ts", "event_id", 25).select("event_id", "ts")


@query
def o05_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.preview(scored(spark, sf_dir), 0.85, ["council", "reference"])


@query
def o10_entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All references of both pattern sets, with their repeats; and those of one that the other lacks."""
    d = documents(spark, sf_dir)
    return d.select("doc", F.array_join(F.concat(text.references(F.col("text")), text.find_all(F.col("text"), text.FALLBACK[1][1])), "|").alias("bag"), F.array_join(F.array_except(text.references(F.col("text")), text.find_all(F.col("text"), text.FALLBACK[1][1])), "|").alias("only_first"))
