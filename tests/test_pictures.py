"""Pictures in PDF: round trips of synthetic ones; preparation against brute force and known angles."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.sources import documents, pictures
from test_sources import made

R = np.random.default_rng(8)


def png_rows(values: np.ndarray, kinds: list[int]) -> bytes:
    """Rows under PNG's predictors, by their definitions."""
    flat = values.reshape(len(values), -1).astype(int)
    step, out = values.shape[2], b""
    for y, row in enumerate(flat):
        up = flat[y - 1] if y else np.zeros_like(row)
        left, corner = np.concatenate([np.zeros(step, int), row[:-step]]), np.concatenate([np.zeros(step, int), up[:-step]])
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = [0 * row, left, up, (left + up) // 2, paeth][kinds[y % len(kinds)]]
        out += bytes([kinds[y % len(kinds)]]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    return out


def pdf_with(data: bytes, about: bytes, compress: bool = True, more: dict[int, bytes] | None = None) -> bytes:
    data = zlib.compress(data) if compress else data
    head = b"<< /Type /XObject /Subtype /Image %s /Length %d %s>>" % (about, len(data), b"/Filter /FlateDecode " if compress else b"")
    return made([b"q 200 0 0 100 50 60 cm /X Do Q"], {6: head + b"\nstream\n" + data + b"\nendstream"} | (more or {}))


def first(content: bytes) -> tuple:
    (out,) = pictures.pictures_of(content)
    return out


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize("how", ["plain", "png", "tiff", "raw"])
def test_round_trips(channels, how):
    values = R.integers(0, 256, (9, 13, channels), np.uint8)
    space = b"/Width 13 /Height 9 /BitsPerComponent 8 /ColorSpace %s" % (b"/DeviceGray" if channels == 1 else b"/DeviceRGB")
    parms = b" /DecodeParms << /Predictor %d /Colors %d /BitsPerComponent 8 /Columns 13 >>"
    if how == "png":
        content = pdf_with(png_rows(values, [0, 1, 2, 3, 4]), space + parms % (15, channels))
    elif how == "tiff":
        content = pdf_with(np.diff(values.astype(int), axis=1, prepend=0).astype(np.uint8).tobytes(), space + parms % (2, channels))
    else:
        content = pdf_with(values.tobytes(), space, how == "plain")
    page, x0, y0, x1, y1, width, height, n, encoding, samples, error = first(content)
    assert (page, x0, y0, x1, y1, width, height, n, encoding, error) == (1, 50, 60, 250, 160, 13, 9, channels, "samples", None)
    assert np.array_equal(np.frombuffer(samples, np.uint8).reshape(9, 13, channels), values)


@pytest.mark.parametrize("bits", [1, 2, 4, 16])
def test_other_depths(bits):
    levels = R.integers(0, 1 << min(bits, 8), (5, 11), np.uint8)
    if bits == 16:
        data = np.stack([levels, levels], axis=2).tobytes()
        want = levels
    else:
        rows = np.unpackbits(levels[:, :, None], axis=2)[:, :, 8 - bits :].reshape(5, -1)
        data, want = np.packbits(rows, axis=1).tobytes(), (levels.astype(int) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    got = first(pdf_with(data, b"/Width 11 /Height 5 /BitsPerComponent %d /ColorSpace /DeviceGray" % bits))
    assert np.array_equal(np.frombuffer(got[9], np.uint8).reshape(5, 11), want)
    if bits == 1:
        mask = first(pdf_with(data, b"/Width 11 /Height 5 /ImageMask true /Decode [1 0]"))
        assert np.array_equal(np.frombuffer(mask[9], np.uint8).reshape(5, 11), 255 - want)


def test_colours_and_other_encodings():
    palette = R.integers(0, 256, (4, 3), np.uint8)
    places = R.integers(0, 4, (3, 6), np.uint8)
    got = first(pdf_with(places.tobytes(), b"/Width 6 /Height 3 /BitsPerComponent 8 /ColorSpace [/Indexed /DeviceRGB 3 <%s>]" % palette.tobytes().hex().encode()))
    assert np.array_equal(np.frombuffer(got[9], np.uint8).reshape(3, 6, 3), palette[places])
    ink = np.array([[[0, 0, 0, 0], [255, 0, 0, 0], [0, 0, 0, 255], [0, 255, 255, 0]]], np.uint8)
    got = first(pdf_with(ink.tobytes(), b"/Width 4 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK"))
    assert np.frombuffer(got[9], np.uint8).reshape(4, 3).tolist() == [[255, 255, 255], [0, 255, 255], [0, 0, 0], [255, 0, 0]]
    jpeg = pdf_with(b"\xff\xd8 bytes", b"/Width 4 /Height 1 /Filter /DCTDecode", False)
    assert first(jpeg)[8:10] == ("DCTDecode", b"\xff\xd8 bytes")


def lines(angle: float, h: int = 240, w: int = 320) -> np.ndarray:
    """Dark dashes in rows that run at that angle, downward to the right."""
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - h / 2, x - w / 2
    a = np.deg2rad(angle)
    v, u = y * np.cos(a) - x * np.sin(a), y * np.sin(a) + x * np.cos(a)
    dark = (np.mod(v, 16) < 6) & (np.mod(u + 7 * np.floor(v / 16), 23) < 15) & (abs(v) < 0.4 * h) & (abs(u) < 0.4 * w)
    return np.where(dark, 30, 225).astype(np.uint8)


@pytest.mark.parametrize("angle", [-12.0, -5.3, -1.0, 0.0, 0.8, 3.7, 9.4])
def test_known_angles_are_found_and_undone(angle):
    picture = lines(angle)
    assert abs(pictures.skew(picture) - angle) <= 0.5
    assert abs(pictures.skew(pictures.turned(picture, angle))) <= 0.5
    assert not pictures.sideways(picture) and pictures.sideways(np.rot90(picture))
    out, turned, quarter = pictures.prepare(np.rot90(picture, -1)[:, :, None])
    assert quarter and abs(turned - angle) <= 0.5 + pictures.LEAST_ANGLE and set(np.unique(out)) <= {0, 255}


def test_filters_equal_brute_force():
    picture = R.integers(0, 256, (14, 17), np.uint8)
    wide, seen = np.pad(picture, 1, mode="edge"), np.pad(picture, 5, mode="edge").astype(int)
    for y in range(14):
        for x in range(17):
            assert pictures.median(picture)[y, x] == sorted(wide[y : y + 3, x : x + 3].ravel())[4]
            assert (pictures.threshold(picture)[y, x] == 255) == (picture[y, x] > seen[y : y + 11, x : x + 11].mean() - 2)
    assert pictures.contrast(np.array([[100, 200]], np.uint8)).tolist() == [[75, 225]]
    assert pictures.grey(np.array([[[255, 0, 0], [0, 255, 0]]], np.uint8)).tolist() == [[76, 150]]
    assert pictures.skew(np.full((20, 20), 200, np.uint8)) == 0.0


def test_from_files_to_confidences(spark, tmp_path):
    (tmp_path / "in").mkdir()
    about = b"/Width 320 /Height 240 /BitsPerComponent 8 /ColorSpace /DeviceGray"
    (tmp_path / "in/a.pdf").write_bytes(pdf_with(lines(3.7).tobytes(), about))
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF-1.4 trailer << /Encrypt 9 0 R >>")
    found = pictures.page_pictures(documents.checked_files(spark, f"file://{tmp_path}/in"))
    assert {(r.path[-5], r.width, r.error) for r in found.collect()} == {("a", 320, None), ("b", None, "ValueError: encrypted")}
    ready = pictures.prepared(found)
    (r,) = ready.collect()
    assert abs(r.angle - 3.7) <= 0.5 and not r.sideways and len(r.samples) == r.width * r.height
    words = pictures.recognised(ready, lambda p: [("dark", 100.0 * float((p == 0).mean() > 0.05)), ("faint", 10.0)])
    out = documents.page_confidence(words).withColumn("name", F.substring("path", -5, 1)).collect()
    assert [(x.name, x.pages, x.pages_with_text, x.confidence) for x in out] == [("a", 1, 1, 100.0)]
