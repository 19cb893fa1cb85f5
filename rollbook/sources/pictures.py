"""Pictures on PDF pages and their preparation for recognition (S17, S19), with numpy inside tasks; a recogniser is the caller's.

Pictures are rows of page, place and samples. Flate streams are decoded, with PNG's and TIFF's predictors, grey, RGB, CMYK and indexed colours of 1
to 16 bits, masks and reversed ranges; pictures in other encodings (JPEG and the like) come as their bytes with the encoding's name.

Preparation: grey levels, a median of 3 by 3, the skew's angle by projection profiles and turning back if it exceeds half a degree, a threshold by the
mean of a window (integral images), contrast. Upright lines are told from sideways ones by the same profiles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from rollbook.sources.pdf import MAX_PAGES, Pdf

PICTURE = "path string, page int, x0 double, y0 double, x1 double, y1 double, width int, height int, channels int, encoding string, samples binary, error string"
PREPARED = "path string, page int, width int, height int, angle double, sideways boolean, samples binary"
WORDS = "path string, page int, text string, conf double"
#: Threshold window and offset, contrast and the least angle that is corrected: fixed values.
WINDOW, OFFSET, CONTRAST, LEAST_ANGLE = 11, 2, 1.5, 0.5
#: Degrees that are searched for skew, and pixels that decide it.
WIDEST, DECIDE = 15.0, 200_000


def _number(about: bytes, key: bytes, default: int) -> int:
    m = re.search(rb"/" + key + rb"\s+(\d+)", about)
    return int(m[1]) if m else default


def unpredicted(data: bytes, predictor: int, channels: int, bits: int, columns: int) -> bytes:
    """The bytes before PNG's (10 to 15) or TIFF's (2) predictor."""
    if predictor < 2:
        return data
    step, width = max(1, channels * bits // 8), -(-channels * bits * columns // 8)
    if predictor == 2:
        if bits != 8:
            raise ValueError("TIFF predictor of other than 8 bits")
        rows = np.frombuffer(data[: len(data) // width * width], np.uint8).reshape(-1, columns, channels)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out = []
    before = bytearray(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        if kind == 2:
            row = bytearray(((np.frombuffer(row, np.uint8) + np.frombuffer(before, np.uint8)) & 255).astype(np.uint8).tobytes())
        elif kind:
            for i in range(width):
                left, up, corner = (row[i - step] if i >= step else 0), before[i], (before[i - step] if i >= step else 0)
                if kind == 1:
                    guess = left
                elif kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                row[i] = (row[i] + guess) & 255
        out.append(bytes(row))
        before = row
    return b"".join(out)


def _unpacked(data: bytes, bits: int, per_row: int, rows: int) -> np.ndarray:
    """Samples of that many bits, rows padded to bytes, as they are."""
    width = -(-per_row * bits // 8)
    raw = np.frombuffer(data[: width * rows].ljust(width * rows, b"\0"), np.uint8).reshape(rows, width)
    if bits == 8:
        return raw[:, :per_row]
    if bits == 16:
        return raw[:, : 2 * per_row : 2]  # the high byte
    ones = np.unpackbits(raw, axis=1)[:, : per_row * bits].reshape(rows, per_row, bits)
    return (ones * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)


def samples_of(pdf: Pdf, number: int) -> np.ndarray:
    """A picture's samples, height by width by 1 (grey) or 3 (RGB), 0 to 255."""
    about = pdf.objects[number]
    width, height = _number(about, b"Width", 0), _number(about, b"Height", 0)
    mask = re.search(rb"/ImageMask\s+true", about) is not None
    bits = 1 if mask else _number(about, b"BitsPerComponent", 8)
    space = pdf._array(about, b"ColorSpace") or (m[1] if (m := re.search(rb"/ColorSpace\s*(/\w+)", about)) else b"/DeviceGray")
    palette = None
    if space.startswith(b"[") and b"/Indexed" in space:
        base = 4 if b"/DeviceCMYK" in space else 1 if b"/DeviceGray" in space else 3
        if m := re.search(rb"<([0-9A-Fa-f\s]+)>\s*\]", space):
            table = bytes.fromhex(re.sub(rb"\s", b"", m[1]).decode())
        else:
            table = pdf.stream(int(re.findall(rb"(\d+)\s+\d+\s+R", space)[-1]))
        palette, channels = np.frombuffer(table[: len(table) // base * base], np.uint8).reshape(-1, base), 1
    elif b"/ICCBased" in space:
        channels = _number(pdf.objects.get(int(re.findall(rb"(\d+)\s+\d+\s+R", space)[-1]), b""), b"N", 3)
    else:
        channels = 4 if b"CMYK" in space else 3 if b"RGB" in space else 1
    parms = pdf._dictionary(about, b"DecodeParms")
    data = unpredicted(pdf.stream(number), _number(parms, b"Predictor", 1), _number(parms, b"Colors", 1), _number(parms, b"BitsPerComponent", 8), _number(parms, b"Columns", 1))
    values = _unpacked(data, bits, width * channels, height).reshape(height, width, channels)
    if palette is not None:
        values = palette[np.minimum(values[:, :, 0], len(palette) - 1)]
    elif bits < 8:
        values = (values.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    if re.search(rb"/Decode\s*\[\s*1(?:\.0)?\s+0", about):
        values = 255 - values
    if values.shape[2] == 4:
        ink = values.astype(np.uint16)
        values = ((255 - ink[:, :, :3]) * (255 - ink[:, :, 3:]) // 255).astype(np.uint8)
    return np.ascontiguousarray(values)


def pictures_of(content: bytes, max_pages: int | None = MAX_PAGES) -> Iterator[tuple]:
    """PICTURE's values, from page on, of each picture drawn on each page."""
    pdf = Pdf(content)
    for page, number in enumerate(pdf.pages()[:max_pages], 1):
        for p in pdf.layout(number).pictures:
            about = pdf.objects[p.number]
            filters = re.findall(rb"/(\w+Decode)\b", about)
            size = (_number(about, b"Width", 0), _number(about, b"Height", 0))
            if filters not in ([], [b"FlateDecode"]):
                yield (page, *p[1:], *size, 0, filters[-1].decode(), pdf.streams.get(p.number, b""), None)
                continue
            try:
                found = samples_of(pdf, p.number)
                yield (page, *p[1:], *size, found.shape[2], "samples", found.tobytes(), None)
            except (ValueError, IndexError) as e:
                yield (page, *p[1:], *size, 0, "samples", b"", f"{type(e).__name__}: {e}")


def _mapped(df: DataFrame, each: Callable[..., Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for out in each(*row):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, out, strict=True))], arrow)

    kinds = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(kinds)
    return df.select(*columns).mapInArrow(run, kinds)


def page_pictures(files: DataFrame) -> DataFrame:
    """PICTURE rows of checked files that are PDF and can be taken; a file that can't be read is a row with its error."""

    def each(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for x in pictures_of(content):
                yield (path, *x)
        except Exception as e:  # noqa: BLE001  a bad file is a row, not a failed job
            yield (path, *[None] * 9, b"", f"{type(e).__name__}: {e}")

    return _mapped(files.filter("type = 'pdf' and message is null"), each, ["path", "content"], PICTURE)


def grey(values: np.ndarray) -> np.ndarray:
    """Grey levels of height by width by 1 or 3."""
    return values[:, :, 0] if values.shape[2] == 1 else np.rint(values @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def median(picture: np.ndarray) -> np.ndarray:
    """The median of each pixel and its eight neighbours, edges repeated."""
    wide = np.pad(picture, 1, mode="edge")
    h, w = picture.shape
    return np.median(np.stack([wide[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(np.uint8)


def threshold(picture: np.ndarray, window: int = WINDOW, offset: int = OFFSET) -> np.ndarray:
    """255 where a pixel is brighter than the mean of its window less the offset, else 0; by integral images, so the window's size costs nothing."""
    r = window // 2
    sums = np.pad(np.pad(picture.astype(np.int64), r, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h, w = picture.shape
    total = sums[window : window + h, window : window + w] - sums[:h, window : window + w] - sums[window : window + h, :w] + sums[:h, :w]
    return np.where(picture.astype(np.int64) * window * window > total - offset * window * window, 255, 0).astype(np.uint8)


def _sharpness(x: np.ndarray, y: np.ndarray, degrees: float) -> float:
    """How much the number of dark pixels changes from line to line across that direction."""
    a = np.deg2rad(degrees)
    line = np.rint(y * np.cos(a) - x * np.sin(a)).astype(np.int64)
    counts = np.bincount(line - line.min()).astype(float)
    return float((np.diff(counts) ** 2).sum())


def _ink(picture: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.nonzero(threshold(picture) == 0)
    step = max(1, len(x) // DECIDE)
    return x[::step].astype(float), y[::step].astype(float)


def skew(picture: np.ndarray) -> float:
    """The angle, in degrees, of the lines' direction to the horizontal, downward to the right positive; 0 of a picture without ink. Searched in steps of 1, then 0.1."""
    x, y = _ink(picture)
    if len(x) < 2:
        return 0.0
    best = max(np.arange(-WIDEST, WIDEST + 0.5, 1.0), key=lambda d: (_sharpness(x, y, d), -abs(d)))
    return round(float(max(np.arange(best - 1, best + 1.05, 0.1), key=lambda d: (_sharpness(x, y, d), -abs(d)))), 2)


def sideways(picture: np.ndarray) -> bool:
    """Whether lines run down the page: the sharpest profile along the other side is sharper."""
    x, y = _ink(picture)
    angles = np.arange(-WIDEST, WIDEST + 0.5, 1.0)
    return len(x) > 1 and max(_sharpness(y, x, d) for d in angles) > max(_sharpness(x, y, d) for d in angles)


def turned(picture: np.ndarray, degrees: float) -> np.ndarray:
    """The picture turned about its middle so that lines of that angle become level; bilinear, edges repeated."""
    h, w = picture.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w]
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sx = np.clip(x * np.cos(a) - y * np.sin(a) + (w - 1) / 2, 0, w - 1)
    sy = np.clip(x * np.sin(a) + y * np.cos(a) + (h - 1) / 2, 0, h - 1)
    x0, y0 = np.minimum(sx.astype(int), max(0, w - 2)), np.minimum(sy.astype(int), max(0, h - 2))
    fx, fy = sx - x0, sy - y0
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    p = picture.astype(float)
    return np.rint(p[y0, x0] * (1 - fx) * (1 - fy) + p[y0, x1] * fx * (1 - fy) + p[y1, x0] * (1 - fx) * fy + p[y1, x1] * fx * fy).astype(np.uint8)


def contrast(picture: np.ndarray, factor: float = CONTRAST) -> np.ndarray:
    """Differences from the mean grey times the factor, within 0 and 255."""
    mean = round(float(picture.mean())) if picture.size else 0
    return np.clip(mean + factor * (picture.astype(float) - mean), 0, 255).astype(np.uint8)


def prepare(values: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """A picture ready for recognition, the angle it was turned by and whether it was turned a quarter first."""
    picture = median(grey(values))
    quarter = sideways(picture)
    if quarter:
        picture = np.rot90(picture)
    angle = skew(picture)
    if abs(angle) > LEAST_ANGLE:
        picture = turned(picture, angle)
    else:
        angle = 0.0
    return contrast(threshold(picture)), angle, quarter


def prepared(pictures: DataFrame) -> DataFrame:
    """PREPARED rows of PICTURE rows that have samples: one byte a pixel."""

    def each(path: str, page: int, width: int, height: int, channels: int, samples: bytes) -> Iterator[tuple]:
        out, angle, quarter = prepare(np.frombuffer(samples, np.uint8).reshape(height, width, channels))
        yield (path, page, out.shape[1], out.shape[0], angle, quarter, out.tobytes())

    return _mapped(pictures.filter("encoding = 'samples' and error is null and width > 0 and height > 0"), each, ["path", "page", "width", "height", "channels", "samples"], PREPARED)


def recognised(ready: DataFrame, recognise: Callable[[np.ndarray], list[tuple[str, float]]]) -> DataFrame:
    """Words with their confidences, as documents.page_confidence and word_confidence take them, by a function of the caller's."""

    def each(path: str, page: int, width: int, height: int, samples: bytes) -> Iterator[tuple]:
        for word, conf in recognise(np.frombuffer(samples, np.uint8).reshape(height, width)):
            yield (path, page, word, float(conf))

    return _mapped(ready, each, ["path", "page", "width", "height", "samples"], WORDS)
