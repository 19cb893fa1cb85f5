"""Exports as a Spark data source (S28, S29): JSON, CSV and spreadsheet files that appear all or not at all.

    spark.dataSource.register(exports.Export)
    df.write.format("register_export").mode("append").option("kind", "xlsx").save("file:///shared/exports/july")

Each task writes one part below `_attempts/` in the target folder, under a name of its own; when all have done so the driver moves the parts that the
tasks report to their places and writes `_MANIFEST.json` (rows, bytes and bytes before compression of each part), the
last thing to appear. A failed or repeated task's parts, and those of a write that is given up, are never moved, and are deleted. The folder must be shared;
any file system that pyarrow knows by its address will do. With mode overwrite the parts of the manifest before are
deleted once the new ones are in place.

Options: kind (json: an array of objects; jsonl: an object a line; csv; xlsx), compression (none; gzip; zip with one entry; not for xlsx,
which is compressed itself), sheet (its name), rows_per_part (a task starts a new part after so many rows; default none).

A spreadsheet has a heading row; a sheet that is full (1,048,576 rows) is followed by another. Numbers and booleans are such cells,
null is no cell, dates and everything else are text; characters that XML forbids are dropped. Cells hold 32,767 characters at most by the format:
longer texts are an error, not a cut.
"""

from __future__ import annotations

import csv
import datetime
import decimal
import gzip
import io
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, BinaryIO
from xml.sax.saxutils import escape, quoteattr

import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

KINDS = ("json", "jsonl", "csv", "xlsx")
# Fixed values of the spreadsheet format.
SHEET_ROWS, CELL_CHARS = 1 << 20, 32_767
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACK = "http://schemas.openxmlformats.org/package/2006"
_SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_FORBIDDEN = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def plain(value: Any) -> Any:
    """A value as JSON can hold it: rows become objects, times and decimals text."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    if isinstance(value, datetime.date | decimal.Decimal | datetime.timedelta):
        return str(value)
    return value


def place_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address and the path in it; a plain path is a local, or mounted, one."""
    return pyarrow.fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:", path) else (pyarrow.fs.LocalFileSystem(), path)


class _Counted(io.RawIOBase):
    """Passes bytes on and counts them."""

    def __init__(self, to: BinaryIO) -> None:
        self.to, self.n = to, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.n += len(data)
        self.to.write(bytes(data))
        return len(data)


class Sheets:
    """Writes a workbook row by row."""

    def __init__(self, out: BinaryIO, names: list[str], sheet: str, rows: int = SHEET_ROWS) -> None:
        self.zip, self.names, self.sheet, self.rows = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED), names, sheet, rows
        self.count, self.at, self.part = 0, 0, None
        self._next()

    def _next(self) -> None:
        if self.part:
            self._end()
        self.count, self.at = self.count + 1, 0
        self.part = self.zip.open(f"xl/worksheets/sheet{self.count}.xml", "w", force_zip64=True)
        self.part.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
        self._put(self.names)

    def _end(self) -> None:
        self.part.write(b"</sheetData></worksheet>")
        self.part.close()

    def _put(self, cells: list) -> None:
        self.at += 1
        self.part.write(f'<row r="{self.at}">{"".join(_cell(f"{column(i)}{self.at}", v) for i, v in enumerate(cells) if v is not None)}</row>'.encode())

    def write(self, cells: list) -> None:
        if self.at >= self.rows:
            self._next()
        self._put(cells)

    def close(self) -> None:
        self._end()
        ids = range(1, self.count + 1)
        names = [self.sheet if i == 1 else f"{self.sheet[:25]}_{i}" for i in ids]
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_PACK}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_SHEET}.sheet.main+xml"/>'
            + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_SHEET}.worksheet+xml"/>' for i in ids) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{_PACK}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(ids, names, strict=True)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PACK}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in ids) + "</Relationships>",
        }
        for name, text in parts.items():
            self.zip.writestr(name, _HEAD + text)
        self.zip.close()


def column(i: int) -> str:
    """A column's letters: A is 0, Z 25, AA 26."""
    out = ""
    i += 1
    while i:
        i, k = divmod(i - 1, 26)
        out = chr(65 + k) + out
    return out


def _cell(place: str, value: Any) -> str:
    if isinstance(value, bool):
        return f'<c r="{place}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f'<c r="{place}"><v>{value!r}</v></c>'
    value = plain(value)
    text = _FORBIDDEN.sub("", value if isinstance(value, str) else json.dumps(value, ensure_ascii=False))
    if len(text) > CELL_CHARS:
        raise ValueError(f"cell {place}: {len(text)} characters, a spreadsheet's cell holds {CELL_CHARS}")
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


class _Part:
    """One part being written: rows go through a writer of the kind and a compression to a file."""

    def __init__(self, out: BinaryIO, names: list[str], kind: str, compression: str, sheet: str) -> None:
        self.raw, self.kind, self.names, self.rows = _Counted(out), kind, names, 0
        self.outer: Any = None
        if compression == "gzip":
            self.outer = gzip.GzipFile(fileobj=self.raw, mode="wb", mtime=0)
            self.inner = _Counted(self.outer)
        elif compression == "zip":
            self.outer = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_DEFLATED)
            self.entry = self.outer.open(f"data.{kind}", "w", force_zip64=True)
            self.inner = _Counted(self.entry)
        else:
            self.inner = self.raw
        self.sheets = Sheets(self.inner, names, sheet) if kind == "xlsx" else None
        self.text = io.StringIO()
        self.csv = csv.writer(self.text, lineterminator="\n")
        if kind == "csv":
            self.csv.writerow(names)
        elif kind == "json":
            self.text.write("[")

    def add(self, row: Row) -> None:
        if self.sheets:
            self.sheets.write(list(row))
        elif self.kind == "csv":
            self.csv.writerow(["" if v is None else v if isinstance(v, str | int | float) else plain(v) if not isinstance(plain(v), list | dict) else json.dumps(plain(v), ensure_ascii=False) for v in row])
        else:
            lead = ("\n" if self.rows == 0 else ",\n") if self.kind == "json" else ""
            self.text.write(lead + json.dumps(dict(zip(self.names, map(plain, row), strict=True)), ensure_ascii=False) + ("\n" if self.kind == "jsonl" else ""))
        self.rows += 1
        if self.text.tell() > 1 << 20:
            self._flush()

    def _flush(self) -> None:
        self.inner.write(self.text.getvalue().encode())
        self.text.seek(0)
        self.text.truncate()

    def close(self) -> tuple[int, int, int]:
        """Rows, bytes and bytes before compression."""
        if self.kind == "json":
            self.text.write("\n]\n" if self.rows else "]\n")
        self._flush()
        if self.sheets:
            self.sheets.close()
        if self.outer is not None:
            if hasattr(self, "entry"):
                self.entry.close()
            self.outer.close()
        return self.rows, self.raw.n, self.inner.n


@dataclass
class Written(WriterCommitMessage):
    """A task's parts: (name below _attempts, rows, bytes, bytes before compression)."""

    parts: list[tuple[str, int, int, int]]


class ExportWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool) -> None:
        self.path, self.kind, self.compression = options["path"], options.get("kind", "json"), options.get("compression", "none")
        if self.kind not in KINDS or self.compression not in ("none", "gzip", "zip") or self.kind == "xlsx" and self.compression != "none":
            raise ValueError(f"no export of kind {self.kind} with compression {self.compression}")
        self.sheet, self.most, self.names, self.overwrite = options.get("sheet", "Audit_Data"), int(options.get("rows_per_part", 0)), schema.names, overwrite
        self.job = uuid.uuid4().hex
        self.suffix = {"none": self.kind, "gzip": f"{self.kind}.gz", "zip": f"{self.kind}.zip"}[self.compression]

    def write(self, rows: Iterator[Row]) -> Written:
        fs, base = place_of(self.path)
        fs.create_dir(f"{base}/_attempts/{self.job}", recursive=True)
        context = TaskContext.get()
        task = f"{context.partitionId():05d}-{context.taskAttemptId()}" if context else uuid.uuid4().hex
        out: list[tuple[str, int, int, int]] = []
        rows = iter(rows)
        row = next(rows, None)
        while row is not None:
            name = f"{self.job}/{task}-{len(out):03d}.{self.suffix}"
            with fs.open_output_stream(f"{base}/_attempts/{name}", compression=None) as f:
                part = _Part(f, self.names, self.kind, self.compression, self.sheet)
                while row is not None and (not self.most or part.rows < self.most):
                    part.add(row)
                    row = next(rows, None)
                out.append((name, *part.close()))
        return Written(out)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = place_of(self.path)
        fs.create_dir(base, recursive=True)
        before = self._manifest(fs, base)
        told = [p for m in messages if m for p in m.parts]
        if not told and self.kind != "jsonl":  # an export of no rows is a file without any
            fs.create_dir(f"{base}/_attempts/{self.job}", recursive=True)
            with fs.open_output_stream(f"{base}/_attempts/{self.job}/empty.{self.suffix}", compression=None) as f:
                told = [(f"{self.job}/empty.{self.suffix}", *_Part(f, self.names, self.kind, self.compression, self.sheet).close())]
        parts = []
        for i, (name, rows, size, whole) in enumerate(told):
            to = f"part-{self.job[:8]}-{i:05d}.{self.suffix}"
            fs.move(f"{base}/_attempts/{name}", f"{base}/{to}")
            parts.append({"file": to, "rows": rows, "bytes": size, "bytes_before": whole})
        kept = [] if self.overwrite else before
        with fs.open_output_stream(f"{base}/_MANIFEST.json", compression=None) as f:
            f.write(json.dumps({"kind": self.kind, "columns": self.names, "rows": sum(p["rows"] for p in kept + parts), "parts": kept + parts}, indent=1).encode())
        for p in before if self.overwrite else ():
            fs.delete_file(f"{base}/{p['file']}")
        self._sweep(fs, base)

    def abort(self, messages: list[Written | None]) -> None:
        self._sweep(*place_of(self.path))

    def _manifest(self, fs: pyarrow.fs.FileSystem, base: str) -> list[dict]:
        if fs.get_file_info(f"{base}/_MANIFEST.json").type != pyarrow.fs.FileType.File:
            return []
        with fs.open_input_stream(f"{base}/_MANIFEST.json", compression=None) as f:
            return json.loads(f.read())["parts"]

    def _sweep(self, fs: pyarrow.fs.FileSystem, base: str) -> None:
        """Deletes this write's attempts, and the folder of attempts if no other write has any."""
        if fs.get_file_info(f"{base}/_attempts/{self.job}").type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(f"{base}/_attempts/{self.job}")
        if fs.get_file_info(f"{base}/_attempts").type == pyarrow.fs.FileType.Directory and not fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/_attempts")):
            fs.delete_dir(f"{base}/_attempts")


class Export(DataSource):
    """The data source; write only."""

    @classmethod
    def name(cls) -> str:
        return "register_export"

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(dict(self.options), schema, overwrite)


def manifest(path: str) -> dict:
    """What an export holds: kind, columns, rows and its parts with their compression ratio (S29; 1 for an empty part)."""
    fs, base = place_of(path)
    with fs.open_input_stream(f"{base}/_MANIFEST.json", compression=None) as f:
        out = json.loads(f.read())
    for p in out["parts"]:
        p["ratio"] = p["bytes"] / p["bytes_before"] if p["bytes_before"] else 1.0
    return out
