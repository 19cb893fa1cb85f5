"""Interleaved document sequences with resolved media.

HTML is parsed into an ordered sequence of text and media-reference items. A media item has its position, its reference, the
digest the reference names (`media:sha256/<hex>`) and its caption (the figure's caption, else the alternative text). Payloads
are kept once stored as a media column: greyscale PNG pictures of 8-bit samples, 64 wide, lossless. References are resolved by
an equality join on the digest; items keep their place and caption, resolved or not.

Scale: payloads are written once to the shared folder and read back where they lie; only descriptors (digest, sizes, feature)
are shuffled, combined by digest before the join, so a payload that a third of all documents refer to is one row there.
Batches are bounded in bytes; a picture never leaves its row.

Defined cases: null and empty texts have a payload of 64 zero bytes; null and empty html gives no item; references without a
digest or to unknown digests stay unresolved (nulls); repeated rows are kept; equal texts have equal media.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import map_batches, staged, utf8

WIDTH = 64
#: Digests that a task remembers.
SEEN = 1 << 16
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_DIGEST = re.compile(r"media:sha256/([0-9a-f]{64})$")
ITEM = "struct<position:int,kind:string,text:string,ref:string,digest:string,caption:string>"


def payload_of(text: bytes | None) -> bytes:
    """The text's bytes with zero bytes up to a positive multiple of 64."""
    raw = text or b""
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """A greyscale picture of 8-bit samples, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    plain = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(plain, 1)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> np.ndarray:
    """The samples, a row for each row of the picture, of what to_png makes; anything else is a ValueError."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, head, body = 8, b"", []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.pack(">I", zlib.crc32(kind + part)) != data[at + 8 + n : at + 12 + n]:
            raise ValueError("a chunk is damaged")
        if kind == b"IHDR":
            head = part
        elif kind == b"IDAT":
            body.append(part)
        at += 12 + n
    width, height, *form = struct.unpack(">IIBBBBB", head)
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if form != [8, 0, 0, 0, 0] or rows[:, 0].any():
        raise ValueError("not 8-bit grey without filters")
    return rows[:, 1:]


def feature_of(samples: np.ndarray) -> str:
    """Mean, standard deviation and entropy of the samples and a 64-bit average hash over an 8 x 8 grid of means."""
    flat = samples.reshape(-1)
    n = np.bincount(flat, minlength=256)
    share = n[n > 0] / len(flat)
    level = np.arange(256)
    mean = float(n @ level) / len(flat)
    spread = max(0.0, float(n @ (level * level)) / len(flat) - mean * mean) ** 0.5
    columns = [np.concatenate([[0], np.cumsum(samples[:, 8 * i : 8 * i + 8].sum(1, dtype=np.int64))]) for i in range(8)]
    edge = np.arange(9) * len(samples) // 8
    low, high = edge[:-1], np.maximum(edge[1:], np.minimum(edge[:-1] + 1, len(samples)))
    grid = np.array([(c[high] - c[low]) / (high - low) / 8 for c in columns]).T
    bits = int("".join("01"[int(x)] for x in (grid > grid.mean()).reshape(-1)), 2)
    return f"mean={mean:.4f};std={spread:.4f};entropy={-(share * np.log2(share)).sum() + 0.0:.4f};hash={bits:016x}"


class _Sequence(HTMLParser):
    """Collects items: text blocks end at block tags and at media."""

    media = {"img", "video", "audio", "source", "embed", "object"}
    silent = {"script", "style", "template", "noscript", "head", "title"}
    inline = {"a", "abbr", "b", "cite", "code", "em", "i", "kbd", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "time", "u", "wbr", "font"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.hidden: list[str] = []
        self.figure: list[int] = []  # where the items of open figures begin
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self._add("text", text=text)

    def _add(self, kind: str, **parts: str | None) -> None:
        self.items.append({"position": len(self.items), "kind": kind, "text": None, "ref": None, "digest": None, "caption": None} | parts)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in self.silent:
            self.hidden.append(tag)
        if self.hidden or tag in self.inline:
            return
        if tag == "figcaption":
            self.flush()
            self.caption = []
            return
        if self.caption is None:
            self.flush()
        if tag == "figure":
            self.figure.append(len(self.items))
        known = dict(attrs)
        ref = known.get("src") or known.get("data")
        if tag in self.media and ref:
            found = _DIGEST.match(ref)
            self._add("media", ref=ref, digest=found[1] if found else None, caption=known.get("alt") or None)

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure[-1] if self.figure else len(self.items) :]:
                if item["kind"] == "media" and text:
                    item["caption"] = text
            self.caption = None
        elif tag not in self.inline and self.caption is None:
            self.flush()
            if tag == "figure" and self.figure:
                self.figure.pop()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def items_of(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.items


def sequences(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key and `items`, the ordered text and media-reference structs, of each row."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = pa.struct([("position", pa.int32()), *((n, pa.string()) for n in ("kind", "text", "ref", "digest", "caption"))])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([items_of(h) for h in batch.column(1).to_pylist()], pa.list_(text))], names=[key, "items"])

    return map_batches(pages.select(F.col(key), F.col(html).alias("html")), each, f"`{key}` {pages.schema[key].dataType.simpleString()}, items array<{ITEM}>")


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest and the media column of each row's payload, written to the shared folder and read from there."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digest, media = [], [], []
        for text in batch.column(1).to_pylist():
            payload = payload_of(text)
            n.append(len(text or b""))
            digest.append(hashlib.sha256(payload).hexdigest())
            media.append(to_png(payload))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "digest", "media"])

    return staged(map_batches(docs.select(F.col("doc_id").cast("long"), utf8("text").alias("text")), each, "doc_id long, n_bytes long, digest string, media binary"), "media")


def described(media: DataFrame) -> DataFrame:
    """For each digest what its stored bytes, read back, come to. A task describes a copy it has seen just before no second time."""
    seen: set[str] = set()  # of a task, since each task gets its own copy

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for digest, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if digest in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
            samples = from_png(data)
            payload = samples.tobytes()
            out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(media.select("digest", "media"), each, schema).dropDuplicates(["digest"])


def resolved(items: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """A row for each item, with key, its fields and the columns of `media` (unique by digest) where its digest is known there."""
    flat = items.select(key, F.explode("items").alias("i")).select(key, "i.*")
    return flat.join(media, "digest", "left")


def report(docs: DataFrame) -> DataFrame:
    """Each document's payload through its interleaved sequence: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, caption and position."""
    media = stored(docs)
    html = F.concat(F.lit('<article><p>Text of '), F.col("n_bytes"), F.lit(' bytes</p><figure><img src="media:sha256/'), F.col("digest"), F.lit('" alt="payload"><figcaption>'), F.col("n_bytes"), F.lit(" bytes as samples</figcaption></figure></article>"))
    pages = media.select(F.struct("doc_id", "n_bytes").alias("key"), html.alias("html"))
    # written first, so that the join has two plain sides, which Spark can split at a hot digest
    known = staged(described(media), "described")
    return resolved(sequences(pages, "key"), "key", known).filter("kind = 'media'").select("key.doc_id", "key.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption", "position")
