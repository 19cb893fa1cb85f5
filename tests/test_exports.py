"""The export data source: what is read back equals the table, by plain readers; failed tasks and writes leave nothing."""

from __future__ import annotations

import csv
import gzip
import io
import json
import os
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from rollbook.operators import audit
from rollbook.plans import queries
from rollbook.sources import exports

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheet_rows(content: bytes) -> list[list]:
    """All rows of a workbook's sheets, by the format's own rules: places give the columns, types the values."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{M}sheet"):
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet.get('sheetId')}.xml")).iter(f"{M}row"):
                cells: dict[str, object] = {}
                for c in row.iter(f"{M}c"):
                    assert c.get("r").rstrip("0123456789") not in cells and c.get("r").endswith(row.get("r"))
                    v = c.findtext(f"{M}v")
                    cells[c.get("r").rstrip("0123456789")] = c.findtext(f"{M}is/{M}t") if c.get("t") == "inlineStr" else bool(int(v)) if c.get("t") == "b" else float(v)
                out.append(cells)
    return out


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(exports.Export)
    return spark


@pytest.fixture(scope="module")
def rows(source):
    data = [(i, f'text "{i}", with\nlines & <marks> é\x07', i / 3, i % 2 == 0, None if i % 5 == 0 else f"2024-01-{i % 28 + 1:02d}", [i, i + 1]) for i in range(53)]
    return source.createDataFrame(data, "id long, text string, score double, good boolean, day string, list array<int>").withColumn("day", F.col("day").cast("date")).repartition(3)


def parts(folder) -> list[bytes]:
    told = exports.manifest(f"file://{folder}")
    assert sorted(p["file"] for p in told["parts"]) == sorted(f for f in os.listdir(folder) if f.startswith("part-") and not f.endswith(".crc"))
    assert "_attempts" not in os.listdir(folder)
    return [(folder / p["file"]).read_bytes() for p in told["parts"]]


@pytest.mark.parametrize("compression", ["none", "gzip", "zip"])
@pytest.mark.parametrize("kind", ["json", "jsonl", "csv"])
def test_text_kinds(source, rows, tmp_path, kind, compression):
    path = tmp_path / "out"
    rows.write.format("register_export").mode("append").option("kind", kind).option("compression", compression).save(f"file://{path}")
    found: list[dict] = []
    for data in parts(path):
        if compression == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                data = z.read(z.namelist()[0])
        text = (gzip.decompress(data) if compression == "gzip" else data).decode()
        found += json.loads(text) if kind == "json" else [json.loads(x) for x in text.splitlines()] if kind == "jsonl" else list(csv.DictReader(io.StringIO(text, newline="")))
    want = [{k: str(v) if k == "day" and v is not None else v for k, v in r.asDict().items()} for r in rows.collect()]
    if kind == "csv":
        want = [{"id": str(r["id"]), "text": r["text"], "score": str(r["score"]), "good": str(r["good"]), "day": r["day"] or "", "list": json.dumps(r["list"])} for r in want]
    key = lambda r: int(r["id"])
    assert sorted(found, key=key) == sorted(want, key=key)
    told = exports.manifest(f"file://{path}")
    assert told["rows"] == 53 and all((p["ratio"] < 1) == (compression != "none") for p in told["parts"])


def test_spreadsheets(source, rows, tmp_path, monkeypatch):
    path = tmp_path / "out"
    rows.coalesce(1).write.format("register_export").mode("append").option("kind", "xlsx").option("sheet", "A & B").save(f"file://{path}")
    (data,) = parts(path)
    head, *found = sheet_rows(data)
    assert list(head.values()) == rows.columns and len(found) == 53
    for got, r in zip(sorted(found, key=lambda x: x["A"]), rows.orderBy("id").collect(), strict=True):
        want = {"A": float(r.id), "B": r.text.replace("\x07", ""), "C": r.score, "D": r.good, "E": str(r.day) if r.day else None, "F": json.dumps(r.list)}
        assert got == {k: v for k, v in want.items() if v is not None}
    out = io.BytesIO()
    sheets = exports.Sheets(out, ["n"], "S", rows=10)
    for i in range(25):
        sheets.write([i])
    sheets.close()
    assert [r["A"] for r in sheet_rows(out.getvalue())] == ["n", *map(float, range(9)), "n", *map(float, range(9, 18)), "n", *map(float, range(18, 25))]
    assert [exports.column(i) for i in (0, 25, 26, 51, 52, 701, 702)] == ["A", "Z", "AA", "AZ", "BA", "ZZ", "AAA"]


def test_failed_writes_leave_nothing(source, rows, tmp_path):
    """A cell too long for its format in one task, and a broken task: no part, no attempt; what was there before stays."""
    path = tmp_path / "out"
    save = lambda df, kind, mode="append": df.write.format("register_export").mode(mode).option("kind", kind).save(f"file://{path}")
    with pytest.raises(Exception, match="32767"):
        save(rows.withColumn("text", F.when(F.col("id") == 7, F.repeat(F.lit("x"), 40_000)).otherwise("y")), "xlsx")
    assert not path.exists() or not [f for f in os.listdir(path)]
    save(rows, "json")
    before = sorted(os.listdir(path))
    broken = rows.withColumn("text", F.when(F.col("id") == 50, F.raise_error(F.lit("broken"))).otherwise(F.col("text")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            save(broken, "json", mode)
        assert sorted(os.listdir(path)) == before
    with pytest.raises(Exception, match="no export of kind"):
        save(rows, "pdf")


def test_append_overwrite_and_parts(source, rows, tmp_path):
    path = tmp_path / "out"
    save = lambda df, mode, **o: df.write.format("register_export").mode(mode).options(kind="jsonl", **o).save(f"file://{path}")
    save(rows, "append", rows_per_part=10)
    assert exports.manifest(f"file://{path}")["rows"] == 53 and max(p["rows"] for p in exports.manifest(f"file://{path}")["parts"]) == 10
    save(rows.limit(5), "append")
    assert sum(len(p.splitlines()) for p in parts(path)) == 58
    save(rows.limit(3), "overwrite")
    assert sum(len(p.splitlines()) for p in parts(path)) == 3
    save(rows.filter("false"), "overwrite")
    assert exports.manifest(f"file://{path}")["rows"] == 0


def test_a_second_attempt_counts_once(tmp_path, rows):
    """Two attempts of one task write; the driver hears of one."""
    w = exports.ExportWriter({"path": str(tmp_path / "out"), "kind": "json"}, rows.schema, False)
    some = rows.limit(4).collect()
    w.write(iter(some[:2]))
    w.commit([w.write(iter(some)), None])
    assert sum(len(json.loads((tmp_path / "out" / f).read_text())) for f in os.listdir(tmp_path / "out") if f.startswith("part-")) == 4 and "_attempts" not in os.listdir(tmp_path / "out")


def test_reviewed_export(source, data, tmp_path):
    """The reviewed records of S28 through the data source."""
    path = tmp_path / "out"
    out = audit.audited_export(queries.scored(source, data), queries.states(source, data))
    out.write.format("register_export").mode("append").option("kind", "xlsx").save(f"file://{path}")
    found = [r for p in parts(path) for r in sheet_rows(p)[1:]]
    at = exports.column(out.columns.index("audit_record_id"))
    assert sorted(r[at] for r in found) == sorted(float(r.audit_record_id) for r in out.select("audit_record_id").collect())
