"""Text and tables of PDF files by the standard library (S8, S14, S17's text side): objects, object streams, Flate streams, content streams.

Reads what most programs write: text in content streams and form objects, plain or compressed by Flate, with simple fonts or fonts that name their
characters in a ToUnicode table. Encrypted files, pictures of text and other filters give no text, so that recognition can be tried.

A content stream is run with its graphics and text matrices, so every piece of text has a place on its page, and so have the lines drawn.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field
from typing import NamedTuple

from rollbook.sources.pdf_tables import tables_of

#: Pages that are read unless the caller says otherwise (None: all); a result says whether pages were left out.
MAX_PAGES = 100
#: Bytes that a stream may have when decoded; one of more is an error of its page.
MAX_STREAM = 256 << 20
_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb">>\s*stream(?:\r\n|\n|\r)")
_LENGTH = re.compile(rb"/Length\s+(\d+)(?:\s+(\d+)\s+R)?")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_STRING = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)"
_PIECE = re.compile(rb"(" + _STRING + rb")|<([0-9A-Fa-f\s]*)>|(\[)|(\])|(/[^\s/<>\[\]()]+)|([-+]?\d*\.?\d+)|([A-Za-z'\"*]+)|<<|>>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Pdf:
    """The objects of a file by number, as bytes, and the streams of those that have one."""

    def __init__(self, content: bytes) -> None:
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF header")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", content):
            raise ValueError("encrypted")
        self.objects: dict[int, bytes] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        while m := _OBJECT.search(content, at):
            at = self._add(int(m[1]), content, m.end())
        for number in [n for n, body in self.objects.items() if re.search(rb"/Type\s*/ObjStm\b", body)]:
            self._unpack(number)

    def _add(self, number: int, content: bytes, start: int) -> int:
        """Takes the object whose body begins at `start`; where it ends. A stream ends after its /Length, or where that is wrong at its `endstream`."""
        end = content.find(b"endobj", start)
        end = len(content) if end < 0 else end
        m = _STREAM.search(content, start, end)
        self.streams.pop(number, None)
        if not m:
            self.objects[number] = content[start:end]
            return end
        self.objects[number] = about = content[start : m.start() + 2]
        length = None
        if known := _LENGTH.search(about):
            length = int(known[1])
            if known[2] is not None:
                held = re.search(rb"(?<!\d)%d\s+%d\s+obj\s+(\d+)" % (length, int(known[2])), content)
                length = int(held[1]) if held else None
        if length is not None and content[m.end() + length : m.end() + length + 20].lstrip().startswith(b"endstream"):
            stop = m.end() + length
        else:
            stop = content.find(b"endstream", m.end())
            stop = len(content) if stop < 0 else stop
        data = content[m.end() : stop]
        self.streams[number] = data if length is not None and len(data) == length else data.removesuffix(b"\n").removesuffix(b"\r")
        return max(stop, content.find(b"endobj", stop))

    def _unpack(self, number: int) -> None:
        data = self.stream(number)
        count, first = (int(m[1]) if (m := re.search(rb"/%s\s+(\d+)" % key, self.objects[number])) else 0 for key in (b"N", b"First"))
        heads = [int(x) for x in data[:first].split()[: 2 * count]]
        places = [*heads[1::2], len(data) - first]
        for inner, a, b in zip(heads[::2], places, places[1:], strict=False):
            self.objects.setdefault(inner, data[first + a : first + b])

    def stream(self, number: int) -> bytes:
        """The decoded stream of an object; empty if it has none or one that isn't plain or Flate."""
        data, about = self.streams.get(number, b""), self.objects.get(number, b"")
        filters = re.findall(rb"/(\w+Decode)\b", about)
        if not filters:
            return data
        if filters != [b"FlateDecode"]:
            return b""
        unpack = zlib.decompressobj()
        try:
            out = unpack.decompress(data, MAX_STREAM)
        except zlib.error:
            return b""
        if unpack.unconsumed_tail:
            raise ValueError("stream too large")
        return out

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a dictionary's entry refers to: one, or those of an array, in order."""
        m = re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
        if not m:
            return []
        found = [int(x) for x in _REF.findall(m[1])]
        if len(found) == 1 and not m[1].startswith(b"[") and (inner := self.objects.get(found[0], b"").strip()).startswith(b"["):
            return [int(x) for x in _REF.findall(inner)]
        return found

    def pages(self) -> list[int]:
        """The pages in reading order; those of a damaged tree in the order of their numbers."""
        roots = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", body)]
        out: list[int] = []
        todo = [k for n in roots[-1:] for k in self.refs(self.objects[n], b"Pages")]
        seen: set[int] = set()
        while todo:
            n = todo.pop(0)
            if n in seen:
                continue
            seen.add(n)
            kids = self.refs(self.objects.get(n, b""), b"Kids")
            if kids:
                todo = kids + todo
            elif re.search(rb"/Type\s*/Page\b", self.objects.get(n, b"")):
                out.append(n)
        return out or sorted(n for n, body in self.objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", body))

    def _dictionary(self, body: bytes, key: bytes) -> bytes:
        """The text of a dictionary entry, in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*(<<|\d+\s+\d+\s+R)", body)
        if not m:
            return b""
        if m[1] != b"<<":
            return self.objects.get(int(m[1].split()[0]), b"")
        depth, at = 1, m.end()
        while depth and (n := re.compile(rb"<<|>>").search(body, at)):
            depth, at = depth + (1 if n[0] == b"<<" else -1), n.end()
        return body[m.end() : at]

    def resources(self, number: int) -> bytes:
        """The resources of a page or form, or of a parent that has them."""
        body = self.objects[number]
        for _ in range(20):
            if b"/Resources" in body or not (parent := self.refs(body, b"Parent")):
                break
            body = self.objects.get(parent[0], b"")
        return self._dictionary(body, b"Resources")

    def fonts(self, resources: bytes) -> dict[bytes, Font]:
        """The fonts of resources by name."""
        out = {}
        for name, number in _NAMED.findall(self._dictionary(resources, b"Font")):
            body, font = self.objects.get(int(number), b""), Font()
            for table in self.refs(body, b"ToUnicode"):
                font.table = characters(self.stream(table))
            for inner in self.refs(body, b"DescendantFonts"):
                below = self.objects.get(inner, b"")
                font.default = float(m[1]) if (m := re.search(rb"/DW\s+([\d.]+)", below)) else 1000.0
                font.widths, font.wide = _listed_widths(self._array(below, b"W")), True
            if first := re.search(rb"/FirstChar\s+(\d+)", body):
                font.widths = {int(first[1]) + i: float(w) for i, w in enumerate(re.findall(rb"[\d.]+", self._array(body, b"Widths")))}
            out[name] = font
        return out

    def _array(self, body: bytes, key: bytes) -> bytes:
        """The text of an array entry, in place or referred to."""
        m = re.search(rb"/" + key + rb"\s*(\[|\d+\s+\d+\s+R)", body)
        if not m:
            return b""
        if m[1] != b"[":
            return self.objects.get(int(m[1].split()[0]), b"").strip()
        depth, at = 1, m.end()
        while depth and (n := re.compile(rb"[\[\]]").search(body, at)):
            depth, at = depth + (1 if n[0] == b"[" else -1), n.end()
        return body[m.end() - 1 : at]

    def layout(self, page: int) -> Layout:
        """The pieces of text and the lines of a page, in the order they are drawn in."""
        content = b"\n".join(self.stream(n) for n in self.refs(self.objects[page], b"Contents"))
        if b"ID" in content:  # pictures inside the stream, whose bytes are no operators
            content = _INLINE.sub(b" ", content)
        out = Layout()
        _Drawing(self, out).run(content, self.resources(page), (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), ())
        return out

    def text(self, page: int) -> str:
        """The text of a page, a line for each change of the baseline."""
        return self.layout(page).text()


@dataclass
class Font:
    """Characters of codes (None: the code is the character), widths of codes in thousandths, and whether codes have two bytes."""

    table: dict[int, str] | None = None
    widths: dict[int, float] = field(default_factory=dict)
    default: float = 500.0
    wide: bool = False


class Run(NamedTuple):
    """A piece of text from (x, y) to (end, y) on its baseline; fresh: a new line was asked for before it."""

    text: str
    x: float
    y: float
    end: float
    size: float
    fresh: bool = False


class Rule(NamedTuple):
    """A line that is drawn across or down, from (x0, y0) to (x1, y1), the lesser first."""

    x0: float
    y0: float
    x1: float
    y1: float


class Placed(NamedTuple):
    """A picture's object and the box it fills on the page."""

    number: int
    x0: float
    y0: float
    x1: float
    y1: float


@dataclass
class Layout:
    runs: list[Run] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    pictures: list[Placed] = field(default_factory=list)

    def text(self) -> str:
        out: list[str] = []
        last = None
        for r in self.runs:
            if last is not None:
                if r.fresh or abs(r.y - last.y) > 0.3 * max(r.size, last.size):
                    out.append("\n")
                elif r.x - last.end > 0.15 * r.size or last.end - r.x > 0.5 * r.size:
                    out.append(" ")
            out.append(r.text)
            last = r
        lines = (re.sub(r"[ \t]+", " ", line).strip() for line in "".join(out).split("\n"))
        return "\n".join(line for line in lines if line)


Matrix = tuple[float, float, float, float, float, float]


def _times(m: Matrix, n: Matrix) -> Matrix:
    """m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _at(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


#: Forms inside forms that are followed, and a rectangle's side, in points, below which it is a line.
_DEEP, _THIN = 8, 2.5
_UNIT = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class _Drawing:
    """Runs content streams and puts down what they draw."""

    def __init__(self, pdf: Pdf, out: Layout) -> None:
        self.pdf, self.out = pdf, out
        self.font, self.size, self.lead, self.rise, self.scale, self.char, self.word = Font(), 0.0, 0.0, 0.0, 1.0, 0.0, 0.0
        self.fresh = False

    def run(self, content: bytes, resources: bytes, base: Matrix, inside: tuple[int, ...]) -> None:
        fonts, ctm, kept = self.pdf.fonts(resources), base, []
        text = line = _UNIT
        path: list[tuple[float, float, float, float]] = []
        boxes: list[tuple[float, float, float, float]] = []
        pen = start = (0.0, 0.0)
        held: list[re.Match] = []
        for m in _PIECE.finditer(content):
            if m[7] is None:
                held.append(m)
                continue
            op, numbers = m[7], [float(x[6]) for x in held if x[6]]
            n = len(numbers)
            if op == b"q":
                kept.append(ctm)
            elif op == b"Q":
                ctm = kept.pop() if kept else ctm
            elif op == b"cm" and n >= 6:
                ctm = _times(tuple(numbers[-6:]), ctm)
            elif op == b"BT":
                text = line = _UNIT
            elif op == b"Tf" and n:
                self.font, self.size = next((fonts[x[5][1:]] for x in held if x[5] and x[5][1:] in fonts), Font()), numbers[-1]
            elif op in (b"Tc", b"Tw", b"TL", b"Tz", b"Ts") and n:
                name, value = {b"Tc": "char", b"Tw": "word", b"TL": "lead", b"Tz": "scale", b"Ts": "rise"}[op], numbers[-1]
                setattr(self, name, value / 100 if name == "scale" else value)
            elif op in (b"Td", b"TD") and n >= 2:
                self.lead = -numbers[-1] if op == b"TD" else self.lead
                text = line = _times((1.0, 0.0, 0.0, 1.0, numbers[-2], numbers[-1]), line)
            elif op == b"Tm" and n >= 6:
                text = line = tuple(numbers[-6:])
            elif op in (b"T*", b"'", b'"', b"Tj", b"TJ"):
                if op not in (b"Tj", b"TJ"):
                    text = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -self.lead), line)
                    self.fresh = True
                if op == b'"' and n >= 2:
                    self.word, self.char = numbers[-2], numbers[-1]
                for x in held if op != b"T*" else ():
                    if x[1] is not None or x[2] is not None:
                        raw = _literal(x[1]) if x[1] is not None else bytes.fromhex(_even(x[2]))
                        text = self._show(raw, text, ctm)
                    elif op == b"TJ" and x[6]:
                        text = _times((1.0, 0.0, 0.0, 1.0, -float(x[6]) / 1000 * self.size * self.scale, 0.0), text)
            elif op == b"m" and n >= 2:
                pen = start = (numbers[-2], numbers[-1])
            elif op == b"l" and n >= 2:
                path.append((*pen, numbers[-2], numbers[-1]))
                pen = (numbers[-2], numbers[-1])
            elif op == b"h":
                path.append((*pen, *start))
            elif op == b"re" and n >= 4:
                boxes.append(tuple(numbers[-4:]))
            elif op in (b"S", b"s", b"f", b"F", b"f*", b"B", b"B*", b"b", b"b*", b"n"):
                if op != b"n":
                    self._draw(path, boxes, ctm, op in (b"S", b"s", b"B", b"B*", b"b", b"b*"))
                path, boxes = [], []
            elif op == b"Do":
                self._form(next((x[5][1:] for x in held if x[5]), b""), resources, ctm, inside)
            held = []

    def _show(self, raw: bytes, text: Matrix, ctm: Matrix) -> Matrix:
        """Puts down a string; the text matrix after it."""
        font, whole = self.font, _times(text, ctm)
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if font.wide or _two_bytes(raw, font.table) else list(raw)
        wide = sum(font.widths.get(c, font.default) for c in codes) / 1000 * self.size + self.char * len(codes) + self.word * (codes.count(32) if len(codes) == len(raw) else 0)
        string, wide = _decoded(raw, font.table), wide * self.scale
        x, y = _at(whole, 0.0, self.rise)
        end, _ = _at(whole, wide, self.rise)
        if string:
            self.out.runs.append(Run(string, x, y, end, abs(self.size * (whole[3] or whole[1])) or 1.0, self.fresh))
            self.fresh = False
        return _times((1.0, 0.0, 0.0, 1.0, wide, 0.0), text)

    def _draw(self, path: list, boxes: list, ctm: Matrix, stroked: bool) -> None:
        lines = list(path) if stroked else []
        for x, y, w, h in boxes:
            if abs(h) < _THIN or abs(w) < _THIN:
                lines.append((x, y, x + w, y) if abs(h) < abs(w) else (x, y, x, y + h))
            elif stroked:
                lines += [(x, y, x + w, y), (x, y + h, x + w, y + h), (x, y, x, y + h), (x + w, y, x + w, y + h)]
        for x0, y0, x1, y1 in lines:
            (a, b), (c, d) = _at(ctm, x0, y0), _at(ctm, x1, y1)
            if (abs(a - c) < 1) != (abs(b - d) < 1):
                self.out.rules.append(Rule(min(a, c), min(b, d), max(a, c), max(b, d)))

    def _form(self, name: bytes, resources: bytes, ctm: Matrix, inside: tuple[int, ...]) -> None:
        number = next((int(k) for x, k in _NAMED.findall(self.pdf._dictionary(resources, b"XObject")) if x == name), None)
        body = self.pdf.objects.get(number, b"")
        if number is not None and re.search(rb"/Subtype\s*/Image\b", body):
            corners = [_at(ctm, x, y) for x in (0.0, 1.0) for y in (0.0, 1.0)]
            xs, ys = zip(*corners, strict=True)
            self.out.pictures.append(Placed(number, min(xs), min(ys), max(xs), max(ys)))
            return
        if number is None or number in inside or len(inside) >= _DEEP or not re.search(rb"/Subtype\s*/Form\b", body):
            return
        m = [float(x) for x in re.findall(rb"[-+]?\d*\.?\d+", self.pdf._array(body, b"Matrix"))]
        own = self.pdf._dictionary(body, b"Resources") or resources
        self.run(self.pdf.stream(number), own, _times(tuple(m), ctm) if len(m) == 6 else ctm, (*inside, number))


_INLINE = re.compile(rb"(?<![^\s])BI\s+/[^()]*?\sID\s.*?\sEI(?![^\s])", re.S)
_NAMED = re.compile(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R")


def _listed_widths(array: bytes) -> dict[int, float]:
    """Widths of codes: a first code and a list, or a first and a last code and one width, and so on."""
    out: dict[int, float] = {}
    for first, many, last, one in re.findall(rb"(\d+)\s*(?:\[([^\]]*)\]|\s(\d+)\s+([\d.]+))", array[1:]):
        if one:
            out |= dict.fromkeys(range(int(first), min(int(last), int(first) + 0xFFFF) + 1), float(one))
        else:
            out |= {int(first) + i: float(w) for i, w in enumerate(many.split())}
    return out


def _even(digits: bytes) -> str:
    plain = re.sub(rb"\s", b"", digits).decode()
    return plain + "0" * (len(plain) % 2)


def _literal(token: bytes) -> bytes:
    def one(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def _two_bytes(raw: bytes, table: dict[int, str] | None) -> bool:
    return bool(table) and (max(table) > 255 or len(raw) % 2 == 0 and raw[:1] == b"\0")


def _decoded(raw: bytes, table: dict[int, str] | None) -> str:
    if table:
        codes = [int.from_bytes(raw[i : i + 2], "big") for i in range(0, len(raw) - 1, 2)] if _two_bytes(raw, table) else list(raw)
        return "".join(table.get(c, "") for c in codes)
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def characters(table: bytes) -> dict[int, str]:
    """The characters of codes, of a ToUnicode table."""
    out: dict[int, str] = {}
    text = lambda x: bytes.fromhex(_even(x)).decode("utf-16-be", "replace")
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", part):
            out[int(code, 16)] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
        for low, high, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            a, b = int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF)
            if to:
                first = text(to)
                out |= {c: first[:-1] + chr(ord(first[-1]) + c - a) for c in range(a, b + 1) if first}
            else:
                out |= dict(zip(range(a, b + 1), map(text, re.findall(rb"<([0-9A-Fa-f\s]+)>", many)), strict=False))
    return out


def read_pdf(content: bytes, max_pages: int | None = MAX_PAGES, with_tables: bool = True) -> dict:
    """The text of up to max_pages pages, joined by empty lines, their tables, the title and the author.

    A page that can't be read is empty text and one of `errors`; `truncated` says that pages were left out, `pages` how many there are.
    """
    pdf, texts, tables, errors = Pdf(content), [], [], []
    pages = pdf.pages()
    for number, page in enumerate(pages[:max_pages], 1):
        try:
            layout = pdf.layout(page)
            texts.append(layout.text())
            if with_tables:
                tables += [{"page": number, **t} for t in tables_of(layout)]
        except (ValueError, IndexError, KeyError, zlib.error, RecursionError) as e:
            texts.append("")
            errors.append(f"Page {number} text extraction failed: {type(e).__name__}: {e}")
    info = next((body for body in pdf.objects.values() if b"/Producer" in body or b"/Title" in body and b"/Type" not in body), b"")

    def about(key: bytes) -> str | None:
        m = re.search(rb"/" + key + rb"\s*(" + _STRING + rb")", info, re.S)
        return _decoded(_literal(m[1]), None) or None if m else None

    return {"text": "\n\n".join(texts), "title": about(b"Title"), "creator": about(b"Author"), "pages": len(pages), "truncated": max_pages is not None and len(pages) > max_pages, "tables": tables, "table_count": len(tables), "errors": errors}
