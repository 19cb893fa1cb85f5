"""PDF layout and tables, the whole result of a document, as-of counts, against hand-made files and plain versions."""

from __future__ import annotations

import random
import zlib
from datetime import datetime, timedelta

import pytest

from rollbook.functions import text
from rollbook.functions.headers import header_like
from rollbook.operators import asof
from rollbook.sources import documents
from rollbook.sources.pdf import Pdf, read_pdf
from rollbook.sources.pdf_tables import clusters, columns_of, lines_of

ROWS = [("Reference", "Address", "Holder"), ("HMO/1234", "1 High Street", "Sam Patel"), ("HMO/9", "22 Mill Lane, Town", "Jo O'Connor"), ("HMO/77", "", "Alex Smith")]


def made(pages: list[bytes], objects: dict[int, bytes] | None = None, font: bytes = b"<< /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [%s] >>" % b" ".join([b"500"] * 95)) -> bytes:
    """A PDF with a compressed content stream for each page; stream data may hold any bytes."""
    kids = b" ".join(b"%d 0 R" % (100 + i) for i in range(len(pages)))
    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Count %d /Kids [%s] /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> >>" % (len(pages), kids), 5: font} | (objects or {})
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        out[100 + i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (500 + i)
        out[500 + i] = b"<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(data), data)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in out.items())


def put(x: float, y: float, s: str, size: float = 10) -> bytes:
    escaped = s.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    return b"BT /F1 %g Tf 1 0 0 1 %g %g Tm (%s) Tj ET\n" % (size, x, y, escaped)


def placed(rows, xs, top: float, step: float = 20) -> bytes:
    return b"".join(put(x, top - step * i, s) for i, row in enumerate(rows) for x, s in zip(xs, row, strict=True) if s)


def ruled(xs, ys, boxes: bool = False) -> bytes:
    if boxes:
        return b"".join(b"%g %g %g %g re S\n" % (a, c, b - a, d - c) for a, b in zip(xs, xs[1:], strict=False) for d, c in zip(ys, ys[1:], strict=False))
    return b"".join(b"%g %g m %g %g l S\n" % (xs[0], y, xs[-1], y) for y in ys) + b"".join(b"%g %g 0.5 %g re f\n" % (x, ys[-1], ys[0] - ys[-1]) for x in xs)


PROSE = "".join
XS, YS = [72, 172, 322, 472], [712, 692, 672, 652, 632]


@pytest.mark.parametrize("boxes", [False, True])
def test_ruled_tables(boxes):
    page = put(72, 750, "Register of licences") + ruled(XS, YS, boxes) + placed(ROWS, (76, 176, 326), 697) + put(72, 600, "Signed by the council")
    (t,) = read_pdf(made([page]))["tables"]
    assert (t["headers"], t["rows"], t["accuracy"], t["method"], t["page"]) == (list(ROWS[0]), [list(r) for r in ROWS[1:]], 1.0, "ruled", 1)


def test_ruled_cells_hold_several_lines_and_scaled_pages():
    """A cell's lines are joined; the page is drawn at half its size by the graphics matrix; text over a border costs accuracy."""
    cell = placed([["Licence", "Conditions"], ["HMO/1", "no pets"]], (76, 176), 697) + put(176, 668, "and no smoke")
    page = b"q 0.5 0 0 0.5 10 20 cm\n" + ruled([72, 172, 322], [712, 692, 660]) + cell + put(140, 680, "across the border") + b"Q\n"
    (t,) = read_pdf(made([page]))["tables"]
    assert t["headers"] == ["Licence", "Conditions"] and t["rows"] == [["HMO/1", "across the border no pets and no smoke"]] and t["accuracy"] == 0.8333


def test_spaced_tables():
    page = put(72, 750, "Prose that runs on for a line without any table in it at all") + placed(ROWS, (72, 172, 322), 700, 15) + put(72, 600, "More prose at the end of the page")
    (t,) = read_pdf(made([page]))["tables"]
    assert (t["headers"], t["rows"], t["method"]) == (list(ROWS[0]), [list(r) for r in ROWS[1:]], "spaced") and t["accuracy"] == 1.0


def test_prose_is_no_table():
    line = "words of prose that fill a column of the page here"
    columns = b"".join(put(72, 700 - 12 * i, line) + put(340, 700 - 12 * i, line) for i in range(20))
    single = b"".join(put(72, 700 - 12 * i, line * 2) for i in range(20))
    assert read_pdf(made([columns, single]))["tables"] == []


def test_a_page_with_both_kinds_and_two_grids():
    page = ruled([72, 172, 322], [712, 692, 672]) + placed([["Name", "Date"], ["a", "b"]], (76, 176), 697) + ruled([72, 172, 322], [612, 592, 572]) + placed([["1", "2"], ["3", "4"]], (76, 176), 597) + placed(ROWS, (72, 172, 322), 500)
    found = read_pdf(made([page]))["tables"]
    assert [(t["method"], len(t["rows"]), t["headers"][0]) for t in found] == [("ruled", 1, "Name"), ("ruled", 2, "Column_1"), ("spaced", 3, "Reference")]


def test_columns_equal_brute_force():
    """Columns are what is left of the page's width where no piece covers it, wide gaps only."""
    r = random.Random(4)
    for _ in range(50):
        rows = [[(x + r.randint(0, 9), x + r.randint(12, 40)) for x in (70, 150, 230, 310) if r.random() < 0.8] for _ in range(8)]
        block = [[documents_piece(a, b) for a, b in row] for row in rows if row]
        covered = sorted({p for row in rows for a, b in row for p in range(a * 10, b * 10 + 1)})
        want = [(c[0] / 10, c[-1] / 10) for c in clusters(covered, float, 59)]
        assert [tuple(c) for c in columns_of(block)] == want


def documents_piece(a: float, b: float):
    from rollbook.sources.pdf_tables import Piece

    return Piece("x", a, b, 0.0, 10.0)


def test_lines_join_letters_and_part_cells():
    page = put(72, 700, "Coun") + put(92, 700, "cil") + put(110, 700, "of Town") + put(300, 701, "HMO/1") + put(72, 680, "next")
    pdf = Pdf(made([page]))
    assert [[p.text for p in line] for line in lines_of(pdf.layout(pdf.pages()[0]).runs)] == [["Council of Town", "HMO/1"], ["next"]]
    assert pdf.text(pdf.pages()[0]) == "Council of Town HMO/1\nnext"


def test_streams_of_any_bytes_forms_and_errors():
    """Data that holds the words that end streams and objects, a form that draws text, one that draws itself, and a page that can't be read."""
    tricky = b"BT /F1 10 Tf 72 700 Td (endstream endobj 7 0 obj) Tj ET /X Do"
    form = b"<< /Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 -50] /Length 8 0 R >>\nstream\nBT /F1 10 Tf 72 700 Td (inside) Tj ET /X Do\nendstream"
    raw = b"<< /Length %d >>\nstream\n%s\nendstream" % (len(tricky), tricky)
    content = made([b""], {6: form, 8: b"43"}) + b"500 0 obj\n" + raw + b"\nendobj\n"
    assert read_pdf(content)["text"] == "endstream endobj 7 0 obj\ninside"
    bad = made([put(72, 700, "good"), b"BT /F1 10 Tf 1 0 0 1 72 700 Tm <4> Tj (x) Tj ET"], {5: b"<< /Type /Font /ToUnicode 9 0 R >>", 9: b"<< /Length 50 >>\nstream\n1 beginbfrange <0041> <0042> <zz> endbfrange\nendstream"})
    assert read_pdf(bad)["pages"] == 2


def test_pictures_inside_a_stream_are_passed_over():
    page = put(72, 700, "before the BI and ID words") + b"q BI /W 2 /H 2 /BPC 8 /CS /G ID (\x00Tj 1 0 0 1 9 9 Tm)( EI Q\n" + put(72, 680, "after")
    assert read_pdf(made([page]))["text"] == "before the BI and ID words\nafter"


def test_limits_are_parameters_and_are_told():
    content = made([put(72, 700, f"page {i}") for i in range(5)])
    few, all_ = read_pdf(content, max_pages=2), read_pdf(content, max_pages=None)
    assert (few["text"], few["truncated"], few["pages"]) == ("page 0\n\npage 1", True, 5) and (all_["text"].count("page"), all_["truncated"]) == (5, False)


def test_huge_streams_are_errors(monkeypatch):
    monkeypatch.setattr("rollbook.sources.pdf.MAX_STREAM", 100)
    out = read_pdf(made([put(72, 700, "x" * 500), put(72, 700, "fine")]))
    assert out["text"] == "\n\nfine" and out["errors"] == ["Page 1 text extraction failed: ValueError: stream too large"]


def test_whole_results(spark, tmp_path):
    """Text, tables, basic data, confidences and counts of each file (S8, A31), by hand."""
    (tmp_path / "in").mkdir()
    lines = ["Reference: HMO/1234 of 01/02/2023", "12 High Street, Town", "Occupancy: 5 persons"] + [f"The council keeps a register and writes line {i} of it here" for i in range(20)]
    page = b"".join(put(72, 750 - 12 * i, s) for i, s in enumerate(lines)) + placed(ROWS, (72, 172, 322), 400)
    (tmp_path / "in/a.pdf").write_bytes(made([page]))
    (tmp_path / "in/b.pdf").write_bytes(made([b""]))
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 9 0 R >>")
    extracts = documents.extracted(documents.checked_files(spark, str(tmp_path / "in")))
    read = spark.createDataFrame([(r.path, "read from the picture " * 9) for r in extracts.collect()], "path string, text string")
    out = {r.path[-5]: r for r in documents.processed(extracts, read).collect()}
    a, b, c = out["a"], out["b"], out["c"]
    n = len(a.text)
    quality = min(1.0, n / 1000)
    want = {k: (min(0.9, len(a[k]) * 0.2 + 0.3) * 0.8 * quality if a[k] else 0.0) for k in ("potential_references", "potential_addresses", "potential_dates", "potential_numbers")} | {"tables": 0.8, "full_text": 0.8 * quality}
    assert a.confidence_scores == pytest.approx(want) and sorted(a.flagged_fields) == sorted(k for k, v in want.items() if v < 0.7) and a.fields_flagged == len(a.flagged_fields)
    assert (a.status, a.text_length, a.page_count, a.tables_found, a.error_count, a.ocr_used, a.average_confidence) == ("completed", n, 1, 1, 0, False, round(sum(want.values()) / len(want), 3))
    assert a.fields_extracted == 1 + sum(bool(a[k]) for k in want if k.startswith("potential")) and a.tables[0].rows[0] == list(ROWS[1])
    assert (b.ocr_used, b.text[:9], b.tables_found) == (True, "read from", 0) and "tables" not in b.confidence_scores
    assert (c.status, c.error_count, c.error) == ("failed", 1, "ValueError: encrypted")


def test_upload_analysis(spark, tmp_path):
    """The first three of five pages, a scanned page, a word document with a table, a file that can't be read."""
    from test_operators import docx

    (tmp_path / "in").mkdir()
    said = "licence holder manager occupancy licence holder "
    (tmp_path / "in/a.pdf").write_bytes(made([put(72, 700, said + str(i)) for i in range(5)]))
    (tmp_path / "in/b.pdf").write_bytes(made([b""] * 25))
    (tmp_path / "in/c.docx").write_bytes(docx([("Licence register", "Heading1"), ("The holder",)], [["Name", "Reference"], ["hmo", "licence"]]))
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 9 0 R >>")
    out = {r.path.rsplit("/", 1)[1][0]: r for r in documents.upload_analysis(documents.checked_files(spark, f"file://{tmp_path}/in")).collect()}
    a, b, c, d = (out[k] for k in "abcd")
    n = 3 * len(said + "0")
    assert (a.page_count, a.has_text, a.text_length, a.estimated_records, a.warnings, a.recommendations) == (5, True, n, 18 // 5, [], [])
    assert a.info == ["PDF contains 5 page(s)", f"Extracted {n} characters of text", "Estimated 3 potential record(s)"]
    assert (b.page_count, b.has_text, b.estimated_records, b.warnings) == (25, False, 0, ["No readable text found. Document may be scanned or corrupted."])
    assert [x.split(" ", 2)[0] for x in b.recommendations] == ["Document", "No", "Large"]
    looked = "Licence register\nThe holder\nName Reference hmo licence "
    assert (c.page_count, c.text_length, c.estimated_records) == (1, len(looked), 1) and c.info[0] == "Document contains 2 paragraph(s) and 1 table(s)"
    assert (d.has_text, d.page_count, d.warnings) == (False, 0, ["PDF analysis failed: ValueError: encrypted"])


def test_header_rules_agree(spark):
    """The plain rule and the column rule for headings."""
    cells = ["Name", "AB", "ABC", "x:y", "12", "", "  ", "three plain words", "four plain words here", "licence holder 12", "a#", "Ünï Cödé", "a_b", "Ref 1"]
    r = random.Random(1)
    rows = [[r.choice(cells) for _ in range(r.randint(1, 5))] for _ in range(300)]
    df = spark.createDataFrame([(i, row) for i, row in enumerate(rows)], "i int, row array<string>")
    got = [x.h for x in df.select("i", text.looks_like_header(df["row"]).alias("h")).orderBy("i").collect()]
    assert got == [header_like(row) for row in rows]


@pytest.mark.parametrize("width", ["1 hour", "1 day", "100 days"])
def test_earlier_counts_equal_brute_force(spark, width):
    """A hot key, ties in time, keys on one side only, nulls."""
    r = random.Random(7)
    at = lambda: datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 200))
    asked = [(i, r.choice(["hot", "hot", "a", "b", "only asked", None]), at() if r.random() < 0.95 else None) for i in range(300)]
    happened = [(r.choice(["hot", "hot", "a", "b", "only happened", None]), at() if r.random() < 0.95 else None, "x") for _ in range(300)]
    left, right = spark.createDataFrame(asked, "k int, bucket string, at timestamp"), spark.createDataFrame(happened, "bucket string, at timestamp, n string")
    out = {x.k: x.earlier for x in asof.earlier_counts(left, right, "bucket", "at", width).collect()}
    assert out == {i: sum(k is not None and t is not None and hk == k and ht is not None and ht < t for hk, ht, _ in happened) for i, k, t in asked}
