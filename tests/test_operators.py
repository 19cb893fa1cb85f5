"""Records, quality, audit, sources, sinks and streaming on small tables."""

from __future__ import annotations

import io
import json
import zipfile
import zlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollbook.functions import mapping, scoring, text
from rollbook.operators import audit, batches, quality, records
from rollbook.plans import queries
from rollbook.sources import documents, fixtures, sinks
from rollbook.sources.pdf import read_pdf
from rollbook.streaming import inbox


def test_records_from_lines(spark):
    lines = ["First line: property X", "", "A Council", "Reference: 1", "HMO Manager: Z", "Maximum Occupancy: 7 persons", "B Borough", "occupancy unknown", "address late", "address later"]
    d = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "nothing here"), (3, 0, None)], "doc int, pos int, line string")
    out = records.from_lines(d).orderBy("doc", "i").collect()
    assert [(r.council, r.reference, r.hmo_address, r.max_occupancy) for r in out] == [(None, None, "First line: property X", None), ("A Council", "HMO Manager: Z", None, 7), ("B Borough", None, "address later", None)]
    every = records.with_default(d.select("doc").distinct(), records.from_lines(d)).orderBy("doc", "i").collect()
    assert [(r.doc, r.council, r.reference) for r in every if r.is_default] == [(2, "Unknown Council", "EXTRACTED_2"), (3, "Unknown Council", "EXTRACTED_3")]


def test_records_from_entities(spark):
    kinds = "doc int, councils array<string>, references array<string>, addresses array<string>, dates array<string>, names array<string>, occupancies array<string>"
    rows = [(1, ["C"], ["r1", "r2"], [], ["d0", "d1", "d2"], ["n0"], ["4", "x"]), (2, [], [], [], ["d"], [], [])]
    out = records.from_entities(spark.createDataFrame(rows, kinds)).orderBy("doc", "i").collect()
    assert [tuple(r) for r in out] == [(1, 0, "C", "r1", "", "d0", "d1", "n0", "", 4), (1, 1, "", "r2", "", "d2", "", "", "", 0)]
    t = spark.createDataFrame([(1, ["a", "b"], [["1"], ["1", "2", "3"]])], "doc int, headers array<string>, rows array<array<string>>")
    assert [r.record for r in records.table_records(t).orderBy("i").collect()] == [{"a": "1", "b": ""}, {"a": "1", "b": "2"}]
    row = spark.range(1).select(records.with_penalty(F.create_map(F.lit("a"), F.lit(0.5)), F.lit(True)).alias("m")).first()
    assert round(row.m["a"], 6) == 0.35


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 11])
def test_quartiles(spark, n):
    xs = [float((i * 7) % 5) for i in range(n)]
    s = sorted(xs)
    r = quality.quartiles(spark.createDataFrame([(x,) for x in xs], "overall double")).first()
    q1, q3 = (s[n // 4], s[3 * n // 4]) if n >= 4 else (s[0], s[-1])
    assert (r.n, r.q1, r.q2, r.q3) == (n, q1, (s[(n - 1) // 2] + s[n // 2]) / 2, q3)


def test_ensemble(spark):
    rows = [("a", "x", 0.9), ("a", "x", 0.8), ("b", "x", 0.4), ("c", "x", 0.5), ("c", "y", 0.7), ("d", "x", 0.0), ("d", "x", 0.0)]
    out = {r.k: r for r in quality.ensemble(spark.createDataFrame(rows, "k string, value string, confidence double"), "k").collect()}
    assert round(out["a"].confidence, 6) == 0.952941 and out["b"].confidence == 0.4 and out["c"].value == "y" and round(out["d"].confidence, 6) == 0.1


def test_invariants(spark, data):
    s = scoring.with_scores(fixtures.licence_records(spark, data))
    low, high = F.least(*[f"s_{f}" for f in scoring.FIELDS]), F.greatest(*[f"s_{f}" for f in scoring.FIELDS])
    assert s.filter((F.col("overall") < low - 1e-9) | (F.col("overall") > high + 1e-9) | (F.col("overall") > 1)).count() == 0
    assert quality.buckets(s).agg(F.sum("n")).first()[0] == s.count() and quality.field_statistics(s).filter("populated > 0").count() == 15
    assert quality.field_statistics(s.filter("false")).count() == 0


def event(i, record, action, minute, who="r", c=0.5):
    return i, record, "S", who, datetime(2024, 1, 1) + timedelta(minutes=minute), action, c


def test_review_state(spark):
    rows = [event(1, 1, "flagged", 0), event(2, 1, "assigned", 5, "ann"), event(3, 1, "updated", 6), event(4, 1, "approved", 65, "bob"), event(5, 2, "commented", 1), event(6, 1, "updated", 70, c=0.9), event(7, 3, "rejected", 2), event(8, 3, "assigned", 3, "cy")]
    log = spark.createDataFrame(rows, "event_id long, record_id long, session_id string, reviewer string, ts timestamp, action string, confidence double")
    st = audit.state(log)
    out = {r.record_id: r for r in st.collect()}
    assert [(out[k].status, out[k].reviewer, out[k].corrections, out[k].confidence) for k in (1, 2, 3)] == [("approved", "ann", 2, 0.9), ("pending", None, 0, 0.5), ("in_review", "cy", 0, 0.5)]
    s = audit.session_summary(st).first()
    assert (s.total, s.n_approved, s.n_pending, s.n_needs_revision, s.corrections) == (3, 1, 1, 0, 2) and round(s.review_hours, 6) == round((1 + -1 / 60) / 2, 6)
    assert [r.event_id for r in audit.latest(log).orderBy("record_id").collect()] == [6, 5, 8] and audit.status_histogram(st).count() == 5
    assert [r.record_id for r in audit.review_list(st, high=0.6).collect()] == [3, 2] or audit.review_list(st, high=0.6).count() == 2
    assert [r.event_id for r in audit.recent(log, 2).collect()] == [6, 4] and audit.retained(log, "ts", datetime(2024, 1, 1, 1, 10), 10 / 1440).count() == 2
    assert audit.state(log.filter("false")).count() == 0


def docx(paragraphs, rows) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style=None: f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(p(*x) for x in paragraphs)}{table}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Top')}</w:hdr>")
        z.writestr("docProps/core.xml", '<c xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>T</dc:title></c>')
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(docx([("Licence register", "Heading1"), ("  ",), ("Town Council",)], [["Name", "Reference"], ["Alex"], ["Jo", "2", "3"]]))
    (tmp_path / "in/b.docx").write_bytes(b"PK\x03\x04 broken")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "in/d.txt").write_bytes(b"text")
    (tmp_path / "in/e.docx").write_bytes(b"no zip")
    files = documents.checked_files(spark, str(tmp_path / "in"))
    by = {r.path[-6:-5] if r.path.endswith("docx") else r.path[-5:-4]: r for r in documents.extracted(files).collect()}
    assert by["a"].text == "Licence register\n\nTown Council" and by["a"].headings == ["Licence register"] and by["a"].headers == ["Top"] and by["a"].title == "T"
    assert [r.record for r in records.table_records(spark.createDataFrame([(1, by["a"].tables[0].headers, by["a"].tables[0].rows)], "doc int, headers array<string>, rows array<array<string>>")).orderBy("i").collect()] == [{"Name": "Alex", "Reference": ""}, {"Name": "Jo", "Reference": "2"}]
    assert (by["a"].heading_levels, by["a"].heading_positions, by["a"].paragraphs, by["a"].table_count) == (["Heading1"], [0], 3, 1)
    assert (by["b"].status, by["c"].status, by["d"].status, by["e"].error) == ("failed", "completed", "failed", "content does not match file type") and by["b"].text == ""
    second = spark.createDataFrame([(by["b"].path, "recovered")], "path string, text string")
    fixed = {r.path: r for r in documents.with_fallback(documents.extracted(files), second).collect()}
    assert fixed[by["b"].path].status == "partial" and fixed[by["b"].path].text == "recovered" and fixed[by["a"].path].status == "completed"
    assert documents.storage_stats(spark, str(tmp_path), 1000).first().files == 5
    plugged = documents.extracted(files, {"pdf": lambda content: {"text": f"{len(content)} bytes"}}).filter("path like '%.pdf'").first()
    assert plugged.text == "10 bytes"


def pdf(pages: list[bytes], compressed: bool = False, packed: bool = False) -> bytes:
    """A small PDF with a content stream for each page; packed: pages and tree in an object stream."""
    stream = lambda data, extra=b"": b"<< %s /Length %d >>\nstream\n%s\nendstream" % (extra + (b" /Filter /FlateDecode" if compressed else b""), len(data), zlib.compress(data) if compressed else data)
    table = b"1 beginbfchar <0041> <00480069> endbfchar 1 beginbfrange <0061> <0063> <0078> endbfrange"
    kids = b" ".join(b"%d 0 R" % (10 + i) for i in range(len(pages)))
    plain = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F2 5 0 R >> >> >>" % (len(pages), kids), 5: b"<< /Type /Font /ToUnicode 6 0 R >>"}
    plain |= {10 + i: b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (50 + i) for i in range(len(pages))}
    rest = {6: stream(table), 7: b"<< /Title (A \\(small\\) file) /Producer (x) >>"} | {50 + i: stream(c) for i, c in enumerate(pages)}
    if packed:
        body, heads = b"", b""
        for n, x in plain.items():
            heads += b"%d %d " % (n, len(body))
            body += x + b" "
        rest[40] = stream(heads + body, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(heads)))
        plain = {}
    return b"%PDF-1.5\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in (plain | rest).items()) + b"trailer << /Root 1 0 R >>"


@pytest.mark.parametrize(("compressed", "packed"), [(False, False), (True, False), (True, True)])
def test_pdf_text(compressed, packed):
    first = b"BT /F1 12 Tf 1 0 0 1 72 700 Tm (Town \\(City\\) Council) Tj 1 0 0 1 72 680 Tm [(Refer) -20 (ence:) -300 (HMO12)] TJ T* <48692E> Tj ET"
    second = b"BT /F2 9 Tf 0 -14 Td <00410061> Tj 0 0 Td <0062> Tj (x) ' ET"
    out = read_pdf(pdf([first, second], compressed, packed))
    assert out["text"].split("\n\n")[0] == "Town (City) Council\nReference: HMO12\nHi." and out["text"].split("\n\n")[1].startswith("Hix y")
    assert out["pages"] == 2 and out["title"] == "A (small) file"
    assert read_pdf(b"%PDF-1.4 nothing")["text"] == ""
    for bad in (b"", b"text", b"%PDF-1.4 trailer << /Encrypt 9 0 R >>"):
        with pytest.raises(ValueError):
            read_pdf(bad)


def test_pages_and_labels(spark):
    w = spark.createDataFrame([("a", 1, "x", 90.0), ("a", 1, "y", 70.0), ("a", 2, "z", 40.0), ("a", 3, " ", 99.0), ("b", 1, "q", 10.0)], "path string, page int, text string, conf double")
    assert [tuple(r) for r in documents.page_confidence(w).orderBy("path").collect()] == [("a", 3, 2, 60.0), ("b", 1, 0, 0.0)]
    d = spark.createDataFrame([("a", "see HMO/1234\nfife council"), ("b", "")], "path string, text string")
    assert [(r.pos, r.label) for r in documents.labelled_lines(d).orderBy("pos").collect()] == [(0, "LICENSE_REF"), (1, "COUNCIL")]


def test_word_confidence(spark):
    w = spark.createDataFrame([(1, "a", 90.0), (1, "b", 50.0), (1, " ", 99.0), (1, "c", 30.0), (2, "d", 31.0)], "page int, text string, conf double")
    r = documents.word_confidence(w).orderBy("page").collect()
    assert (r[0].n, r[0].mean, r[0].least, r[0].most, r[0].std, r[0].low, r[0].high) == (2, 70.0, 50.0, 90.0, 20.0, 1, 1) and r[1].n == 1


def test_outputs(spark, data, tmp_path):
    rec = fixtures.licence_records(spark, data).filter("record_id < 40")
    sinks.write_csv(rec, mapping.preset("standard"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.count() == 40 and back.columns[2] == "HMO Address" and back.filter("`HMO Address` like '%, Town%'").count() > 30
    odd = rec.limit(1).withColumn("council", F.lit('q"u,o;\'&'))
    sinks.write_csv(odd, mapping.preset("compact"), str(tmp_path / "odd"), "gzip")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "odd")).first().Council == 'q"u,o;\'&'
    sinks.save_session(rec, str(tmp_path / "store"))
    sinks.save_session(rec.filter("session_id = 'S1'").withColumn("council", F.lit("new")), str(tmp_path / "store"))
    assert {r.council for r in sinks.load_session(spark, str(tmp_path / "store"), "S1").collect()} == {"new"} and spark.read.parquet(str(tmp_path / "store")).count() == 40
    with zipfile.ZipFile(io.BytesIO(sinks.package({"a.csv": "x"}, {"n": 1}))) as z:
        assert json.loads(z.read("metadata.json")) == {"n": 1}
    assert sinks.compression_ratio(5, 0) == 1.0 and sinks.csv_lines(rec).count() == 40


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "enqueue", 0, 0), ("a", "start", 120, 1), ("a", "finish", 100, 5), ("b", "enqueue", -5, 2), ("b", "cancel", 0, 3), ("c", "start", 7, 1), ("c", "cancel", 9, 2), ("a", "start", 120, 1)]
    (tmp_path / "in").mkdir()
    for i, (job, action, progress, minute) in enumerate(rows):
        (tmp_path / f"in/{i}.json").write_text(json.dumps({"job_id": job, "session_id": "S", "action": action, "progress": progress, "ts": f"2024-01-01T00:{minute:02d}:00Z"}))
    once = inbox.distinct_events(inbox.events(spark, str(tmp_path / "in"), 2))
    inbox.append_log(once, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(60)
    inbox.append_log(inbox.distinct_events(inbox.events(spark, str(tmp_path / "in"), 2)), str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination(60)
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 7
    out = {r.job_id: (r.status, r.progress) for r in inbox.job_states(log).collect()}
    assert out == {"a": ("completed", 100), "b": ("cancelled", 0), "c": ("processing", 9)}
    states = inbox.job_states(inbox.events(spark, str(tmp_path / "in")).dropDuplicates()).writeStream.format("memory").queryName("jobs").outputMode("complete").trigger(availableNow=True).start()
    states.awaitTermination(60)
    assert {r.job_id: (r.status, r.progress) for r in spark.table("jobs").collect()} == out
    assert inbox.hourly(log).first().n > 0


def test_documents_view(spark, data):
    d = fixtures.licence_documents(fixtures.licence_records(spark, data))
    assert d.filter(F.size(F.split("text", "\n")) == 30).count() == d.count() and d.select(text.estimated_records(F.col("text")).alias("n")).agg(F.min("n")).first()[0] >= 1


JOB_EVENTS = [
    ("a", "enqueue", 0), ("a", "finish", 1), ("a", "cancel", 2), ("b", "enqueue", 0), ("b", "fail", 1), ("b", "cancel", 2), ("c", "enqueue", 0), ("c", "cancel", 1), ("c", "cancel", 2), ("d", "cancel", 0),
    ("e", "enqueue", 0), ("e", "cancel", 1), ("e", "enqueue", 2), ("f", "enqueue", 0), ("f", "start", 1), ("f", "cancel", 2), ("f", "enqueue", 3), ("f", "cancel", 4), ("g", "cancel", 0), ("g", "enqueue", 1),
]
JOB_STATES = {"a": "completed", "b": "failed", "c": "cancelled", "e": "pending", "f": "cancelled", "g": "pending"}


def job_rows(spark):
    rows = [(j, "S", a, 10 * m, datetime(2024, 1, 1, 0, m)) for j, a, m in JOB_EVENTS]
    return spark.createDataFrame(rows, inbox.EVENT)


def test_cancellation_counts_for_pending_jobs_only(spark):
    assert {r.job_id: r.status for r in inbox.job_states(job_rows(spark)).collect()} == JOB_STATES
    folded: dict[str, str | None] = {}
    for job, action, _ in JOB_EVENTS:
        folded[job] = inbox.next_state(folded.get(job), action)
    assert {j: s for j, s in folded.items() if s} == JOB_STATES


def test_presets_and_package(spark, data, tmp_path):
    found = mapping.preset("detailed")
    mapping.save_preset(str(tmp_path), "mine", found, "gzip")
    assert mapping.load_preset(str(tmp_path), "mine") == (found, "gzip") and mapping.list_presets(str(tmp_path)) == ["mine"] and mapping.load_preset(str(tmp_path), "none") is None
    assert mapping.delete_preset(str(tmp_path), "mine") and not mapping.delete_preset(str(tmp_path), "mine")
    s = scoring.with_scores(fixtures.licence_records(spark, data)).filter("record_id < 60")
    report = spark.createDataFrame([("totals", '{"total": 60}')], "part string, body string")
    with zipfile.ZipFile(io.BytesIO(sinks.complete_package(s, str(tmp_path / "out"), report))) as z:
        assert json.loads(z.read("quality_report.json")) == {"totals": [{"total": 60}]} and json.loads(z.read("metadata.json"))["total_records"] == 60
    assert spark.read.option("header", True).csv(str(tmp_path / "out/extracted_data")).count() == 60
    back = records.from_json(spark.createDataFrame([(1, '{"council": "C", "odd": 1, "max_occupancy": 3}'), (2, "{}")], "record_id long, body string")).orderBy("record_id").collect()
    assert (back[0].council, back[0].max_occupancy, back[0].reference, back[0].confidence_scores, back[1].validation_errors) == ("C", 3, "", {}, [])


def test_report_of_nothing(spark, data):
    none = fixtures.licence_records(spark, data).filter("false")
    lines = [r.line for r in quality.report_lines(none, mapping.preset("standard")).orderBy("pos").collect()]
    assert lines[2] == "Total Records: 0" and "Validation Errors:" not in lines
    assert audit.audit_report(audit.state(fixtures.review_log(spark, data).filter("false"))).first().completion_rate == 0.0


def test_batches(spark):
    def root(batch):
        if (batch["x"] < 0).any():
            raise ValueError("negative")
        return batch["x"] ** 0.5

    out = {r.x: (r.result, r.failed) for r in batches.in_batches(spark.createDataFrame([(4.0,), (9.0,), (-1.0,)], "x double").coalesce(1), root, "double", 1).collect()}
    assert out == {4.0: (2.0, None), 9.0: (3.0, None), -1.0: (None, "ValueError: negative")}


def test_sliding_in_blocks(spark):
    rows = [(k, f"r{k % 2 if k > 20 else 0}", datetime(2024, 1, 1) + timedelta(hours=5 * (k // 3)), float(k * k % 17)) for k in range(90)]
    log = spark.createDataFrame(rows, "event_id long, reviewer string, ts timestamp, confidence double")
    want = {}
    for who in ("r0", "r1"):
        own = sorted((r for r in rows if r[1] == who), key=lambda r: (r[2], r[0]))
        want |= {r[0]: round(sum(x[3] for x in own[max(0, i - 6) : i + 1]) / min(7, i + 1), 9) for i, r in enumerate(own)}
    for block in (7, 10, 1000):
        assert {r.event_id: round(r.moving, 9) for r in audit.sliding(log, 7, block).collect()} == want


def test_report_runs_the_rules_once_and_stands_without_records(spark, data):
    checked = queries.checked(spark, data)
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("FileScan")
    assert scans(quality.report_json(checked)) == scans(checked)
    empty = quality.report_json(checked.filter("record_id is null")).collect()
    assert [tuple(r) for r in empty] == [("totals", '{"total":0,"valid":0,"invalid":0}')]
