"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words: A-Z lower-cased, then runs of characters that are ASCII letters, digits or not ASCII. A window is 10 consecutive words
of a benchmark item; an item of fewer words, but not none, is one window. A document's token windows are scanned with rolling
hashes against a bitmap and the sorted hash set of the test windows; hits are verified word by word. The words inside verified
hits are the spans to remove; or whole documents with hits go.

Scale: one pass over the documents, no shuffle. The broadcast set has a fixed bound: the benchmark is streamed to the driver in
blocks of at most BLOCK_WINDOWS windows, BLOCK_IDS item ids and BLOCK_BYTES bytes. A larger benchmark takes further blocks, each
its own broadcast and scan over the rows that the scan before has written; a window that more items share than a block takes
comes again in the next block with the others. Texts are scanned in bounded pieces.

Defined cases: null and empty texts have no words and are clean; null and wordless items have no window; items that share a
window all count; a null item_id is skipped in the item list but its windows hit; repeated rows are kept; an empty benchmark
leaves every document clean; other columns, whatever their names, are carried through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import WORD_HASH, map_batches, once, plain, staged, utf8, window_hashes

WINDOW = 10
BLOCK_WINDOWS, BLOCK_IDS, BLOCK_BYTES = 1 << 18, 1 << 20, 1 << 26
_WORD_BYTES = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_BITS = 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def windows_of(words: list[bytes]) -> Iterator[bytes]:
    size = min(WINDOW, len(words))
    for i in range(len(words) - size + 1 if size else 0):
        yield b" ".join(words[i : i + size])


def _blocks(benchmark: DataFrame) -> Iterator[dict[bytes, list[str]]]:
    """The benchmark's windows with their items' ids, in blocks below the bounds."""
    block: dict[bytes, list[str]] = {}
    ids = size = 0
    for item, text in benchmark.select(F.col("item_id").cast("string"), utf8("text")).toLocalIterator():
        for window in windows_of(words_of(bytes(text) if text is not None else None)):
            if (window not in block and len(block) >= BLOCK_WINDOWS) or ids >= BLOCK_IDS or size >= BLOCK_BYTES:
                yield block
                block, ids, size = {}, 0, 0
            size += 0 if window in block else len(window)
            own = block.setdefault(window, [])
            if item is not None and (not own or own[-1] != item):
                own.append(item)
                ids, size = ids + 1, size + len(item)
    yield block


def _lookup(block: dict[bytes, list[str]]) -> list[tuple[int, np.ndarray, np.ndarray, dict[bytes, list[str]]]]:
    """For each window length: bitmap, sorted hashes, windows."""
    by_length: dict[int, dict[bytes, list[str]]] = {}
    for window, ids in block.items():
        by_length.setdefault(window.count(b" ") + 1, {})[window] = ids
    made = []
    for length, windows in sorted(by_length.items()):
        hashes = np.unique(np.concatenate([window_hashes(WORD_HASH.of(w.split(b" ")), length) for w in windows]))
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[hashes >> np.uint64(64 - _BITS)] = True
        made.append((length, bitmap, hashes, windows))
    return made


def find_hits(words: list[bytes], tables: list) -> tuple[list[tuple[int, int]], set[str]]:
    """Spans [start, end) of word positions in verified hits, not merged, and the ids of the items hit."""
    spans, items = [], set()
    if words and tables:
        hashed = WORD_HASH.of(words)
        for length, bitmap, hashes, windows in tables:
            found = window_hashes(hashed, length)
            at = np.flatnonzero(bitmap[found >> np.uint64(64 - _BITS)])
            if len(at):
                at = at[hashes[np.minimum(np.searchsorted(hashes, found[at]), len(hashes) - 1)] == found[at]]
            for i in at.tolist():
                if (ids := windows.get(b" ".join(words[i : i + length]))) is not None:
                    spans.append((i, i + length))
                    items.update(ids)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 ... by place, and words (how many), spans (merged word spans that are hit, as start, end, start, end ...) and items (sorted ids of items hit)."""
    inner, names = plain(docs)
    spark = docs.sparkSession
    rows = inner.select("*", utf8(names["text"]).alias("bytes"), F.lit(0).cast("long").alias("words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    kinds, before = rows.schema, None
    for block in _blocks(benchmark):
        if before is not None:  # one scan in a worker at a time, and one broadcast
            rows = staged(rows, "scanned")
            before.destroy()
        before = shared = spark.sparkContext.broadcast(block)

        def each(batch: pa.RecordBatch, shared: Broadcast = shared) -> pa.RecordBatch:
            tables = once(shared, _lookup)
            n, spans, items = [], [], []
            k = batch.num_columns - 4
            for text, old_spans, old_items in zip(batch.column(k).to_pylist(), batch.column(k + 2).to_pylist(), batch.column(k + 3).to_pylist(), strict=True):
                words = words_of(text)
                found, ids = find_hits(words, tables)
                found += zip(old_spans[::2], old_spans[1::2], strict=True)
                n.append(len(words))
                spans.append([x for s in merged(found) for x in s])
                items.append(sorted(ids.union(old_items)))
            made = [pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([*batch.columns[: k + 1], *made], names=batch.schema.names)

        rows = map_batches(rows, each, kinds)
    return rows.drop("bytes")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row."""
    hit = F.aggregate(F.sequence(F.lit(0), F.expr("greatest(size(spans) div 2 - 1, 0)")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(F.get("spans", i * 2 + 1) - F.get("spans", i * 2), F.lit(0)))
    digest = F.sha2(F.array_join("items", ","), 256)
    rows = scan(docs.select("doc_id", "text"), benchmark)
    return rows.select(F.col("c0").alias("doc_id"), F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that have a hit."""
    inner, _ = plain(docs)
    return scan(docs, benchmark).filter("size(spans) = 0").select(*inner.columns).toDF(*docs.columns)


def without_spans(text: str | None, spans: list[int]) -> str | None:
    """text without its words of the spans; what separates words stays, and so do the words around."""
    if text is None or not spans:
        return text
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit spans cut from text; a column n_chars, where there is one, follows."""
    inner, _ = plain(docs)
    scanned = scan(docs, benchmark)
    k = docs.columns.index("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = batch.column(batch.num_columns - 2).to_pylist()
        texts = [without_spans(t, s) for t, s in zip(batch.column(k).to_pylist(), spans, strict=True)]
        columns = batch.columns
        columns[k] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = map_batches(scanned, each, scanned.schema).select(*inner.columns).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
