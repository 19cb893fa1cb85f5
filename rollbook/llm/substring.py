"""Substring deduplication by prefix-partitioned suffix trees.

A window is 50 consecutive words of one document; a word goes if a window that covers it also starts in a document with a
smaller doc_id. Such windows lie below the deep nodes (50 words or more) of the suffix tree of all texts.

Which suffixes. The tree is sparse: a run of neighbouring suffixes whose first 50 words have the same least 12-gram (by hash) is
dealt out as one, the suffix that starts with this 12-gram, together with the words before and behind it that the run's windows
need. Equal windows have the same least 12-gram, so no repeat of 50 words is missed, and a suffix isn't sent with 50 words of its
own (24 times the input) but a run of about 20 with 90.

Partitioning by prefix. The first prefix is those 12 words. Prefixes of one document only hold no repeat and end there. Equal
segments of a prefix group are one leaf with its least and largest doc_id, combined before the shuffle, so copies and hot
passages cost one leaf. Groups of up to GROUP words of distinct segments fit a task's memory. The prefixes of larger groups are
lengthened to 50 words: then all suffixes of a group are below one deep node, of which only the least doc_id matters; Spark
combines it by the digest of the path, whatever the group's size.

Subtrees. A group's suffix tree is its suffix array with the lengths of common prefixes of neighbours (up to DEEP words), by prefix
doubling over the group's words, each segment ended by a word of its own. Runs of neighbours with 50 common words or more are the
topmost deep internal nodes; the shortest common prefix in a run is the node's depth, and so the repeat's length.

Scale: anchors (about one word in 20) are shuffled as two longs; segments only for repeated anchors. These are picked while the
texts are read, by a sieve of the repeated anchors, and the few that it lets pass besides fall out as groups of one document. With
more than ANCHORS repeated anchors, which a sieve can't tell apart, texts are joined with theirs by doc_id. Only texts that may lose
words meet their cuts in a join. Joins on hot keys are sort-merge joins of written tables, which adaptive execution splits. Tables
of a step are deleted when the next ones are written.

Defined cases: null, empty and short texts have no window; rows without doc_id neither lose words nor take any; rows that
repeat a doc_id count as one document; an empty table gives an empty result; other columns, whatever their names, are carried
by remove_repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import SIEVE_MOST, WORD_HASH, bound_batches, discard, give_back, held, holds, map_batches, plain, sieve, staged, utf8, window_hashes

WINDOW, ANCHOR = 50, 12
#: Words of a prefix group that one subtree takes; words of the groups that are ranked together; windows of a segment.
GROUP, CHUNK_WORDS, SEGMENT = 100_000, 100_000, 512
#: The most repeated anchors that are told by a sieve.
ANCHORS = SIEVE_MOST // 8
#: Depth to which trees are built: the power of two from WINDOW on.
DEEP = 64


def anchors_of(words: list[bytes]) -> np.ndarray:
    """The anchor of each window of a text, as signed longs."""
    if len(words) < WINDOW:
        return np.empty(0, np.int64)
    least, width, whole = window_hashes(WORD_HASH.of(words), ANCHOR), 1, WINDOW - ANCHOR + 1
    while width < whole:
        step = min(width, whole - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least.view(np.int64)


def tree_of(segments: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the segments, put end to end with an end of its own after each, and the common prefix of each suffix with the one before it, up to DEEP words."""
    number: dict[bytes, int] = {}
    words = [number.setdefault(w, len(number)) for s in segments for w in (*s, None)]
    rank = np.array(words, np.int64)
    ends = np.flatnonzero(rank == number.get(None, -1))
    rank[ends] = len(number) + np.arange(len(ends))
    levels, depth = [rank], 1
    while depth < DEEP and len(rank):
        later = np.zeros(len(rank), np.int64)
        later[:-depth] = rank[depth:] + 1
        rank = np.unique(rank * (int(rank.max()) + 2) + later, return_inverse=True)[1]
        levels.append(rank)
        depth *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(len(order), np.int64)
    if len(order) > 1:
        common[1:][rank[order][1:] == rank[order][:-1]] = DEEP
        at = np.flatnonzero(common[1:] == 0)
        i, j, n = order[:-1][at], order[1:][at], np.zeros(len(at), np.int64)
        for k in range(len(levels) - 2, -1, -1):  # the common prefix's binary digits, from the highest
            x, y = i + n, j + n
            inside = (x < len(order)) & (y < len(order))
            same = np.zeros(len(at), bool)
            same[inside] = levels[k][x[inside]] == levels[k][y[inside]]
            n += same * (1 << k)
        common[1:][at] = n
    return order, common


def deep_nodes(order: np.ndarray, common: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The topmost internal nodes of at least that depth: where in the array their leaves begin, where they end, and their depths."""
    deep = np.concatenate([common >= depth, [False]])
    begin = np.flatnonzero(deep[1:] & ~deep[:-1])
    end = np.flatnonzero(deep[:-1] & ~deep[1:]) + 1
    return begin, end, np.array([common[a + 1 : b].min() for a, b in zip(begin.tolist(), end.tolist(), strict=True)], np.int64)


def repeats_of(leaves: list[tuple[int, int, list[bytes]]]) -> Iterator[tuple[int, int, int, int]]:
    """leaves: least and largest doc_id and words of distinct segments. Gives leaf, first and past last window and the least doc_id of these windows, where it is below the leaf's largest."""
    order, common = tree_of([words for _, _, words in leaves])
    size = np.array([len(words) for _, _, words in leaves], np.int64)
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    low, high = (np.array([x[i] for x in leaves], np.int64) for i in (0, 1))
    own = np.repeat(np.arange(len(leaves)), size + 1)
    least = low[own]  # of each suffix: by itself the leaf's own
    begin, end, _ = deep_nodes(order, common)
    if len(begin):
        of_order = least[order]
        edges = np.stack([begin, end], 1).reshape(-1)
        edges = edges[:-1] if edges[-1] == len(order) else edges
        node = np.minimum.reduceat(of_order, edges)[::2]
        inside = np.concatenate([np.arange(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
        least[order[inside]] = np.repeat(node, end - begin)
    place = np.arange(len(own)) - first[own]
    hit = np.flatnonzero((least < high[own]) & (place <= (size - WINDOW)[own]))
    if not len(hit):
        return
    new = np.concatenate([[True], (np.diff(hit) != 1) | (own[hit][1:] != own[hit][:-1]) | (least[hit][1:] != least[hit][:-1])])
    for a, b in zip(hit[new].tolist(), hit[np.append(new[1:], True)].tolist(), strict=True):
        yield int(own[a]), int(place[a]), int(place[b]) + 1, int(least[a])


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """anchor and doc_id, once for each document and anchor."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.unique(anchors_of((t or b"").split())) for t in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64()), pa.array(ids, pa.int64())], names=["anchor", "doc_id"])

    return map_batches(docs, each, "anchor long, doc_id long")


def _segments(docs: DataFrame, bits: Broadcast | None = None) -> DataFrame:
    """The segments of documents with repeated anchors: anchor, leaf (the segment's digest), doc_id, text_key, the first word's place, the words and how many.

    The repeated anchors are those that the sieve keeps; without one, those in the column `repeated`.
    """
    schema = "anchor long, leaf binary, doc_id long, text_key long, start long, body binary, n long"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        own = batch.column(3).to_pylist() if bits is None else [None] * batch.num_rows
        for doc, key, text, repeated in zip(*(batch.column(i).to_pylist() for i in range(3)), own, strict=True):
            words = text.split()
            anchor = anchors_of(words)
            if not len(anchor):
                continue
            turn = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            wanted = np.isin(anchor[turn], repeated) if bits is None else holds(bits.value, anchor[turn])
            for a, b, want in zip(turn.tolist(), [*turn[1:].tolist(), len(anchor)], wanted.tolist(), strict=True):
                for i in range(a, b, SEGMENT) if want else ():
                    part = words[i : min(b, i + SEGMENT) + WINDOW - 1]
                    body = b" ".join(part)
                    out.append((int(anchor[a]), xxhash.xxh3_128_digest(body), doc, key, i, body, len(part)))
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["anchor", "leaf", "doc_id", "text_key", "start", "body", "n"])

    return map_batches(docs, each, schema)


_FOUND = "anchor long, leaf binary, first long, past long, least long"


def _batch(found: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["anchor", "leaf", "first", "past", "least"])


def _subtrees(leaves: DataFrame) -> DataFrame:
    """anchor, leaf, first and past last window and their least doc_id, of leaves (anchor, leaf, low, high, body) by one suffix tree for each few prefix groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[tuple[int, bytes]] = []
        rows: list[tuple[int, int, list[bytes]]] = []
        words, last = 0, None

        def done() -> pa.RecordBatch:
            return _batch([(*names[k], a, b, least) for k, a, b, least in repeats_of(rows)])

        for batch in batches:
            for anchor, leaf, low, high, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if anchor != last and words >= CHUNK_WORDS:
                    yield done()
                    names, rows, words = [], [], 0
                last = anchor
                names.append((anchor, leaf))
                rows.append((low, high, body.split()))
                words += len(rows[-1][2])
        if rows:
            yield done()
        names, rows = [], []
        give_back()

    bound_batches(leaves.sparkSession)
    dealt = leaves.select("anchor", "leaf", "low", "high", "body").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, _FOUND)


def _lengthened(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The same of leaves whose prefixes are lengthened to WINDOW words: the least doc_id below each node of that depth, which is known by its path's digest. Also the tables that it reads."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for anchor, leaf, low, high, body in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            words = body.split()
            out += [(xxhash.xxh3_128_digest(b" ".join(words[i : i + WINDOW])), anchor, leaf, i, low, high) for i in range(len(words) - WINDOW + 1)]
        kinds = [pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["node", "anchor", "leaf", "first", "low", "high"])

    suffixes = staged(map_batches(leaves.select("anchor", "leaf", "low", "high", "body"), each, "node binary, anchor long, leaf binary, first long, low long, high long"), "suffixes")
    nodes = suffixes.groupBy("node").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most").select("node", "least")
    nodes = staged(nodes, "deep-nodes")
    found = suffixes.join(nodes, "node").filter("high > least")
    return found.select("anchor", "leaf", "first", (F.col("first") + 1).alias("past"), "least"), [suffixes, nodes]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and the bytes of the text. The key tells apart texts of rows that repeat a doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8("text").alias("text"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and `cuts`, the ranges of word places to remove (start, end; they may overlap), of documents that have any; staged."""
    known = _keyed(docs).filter("doc_id is not null and text is not null")
    anchors = staged(_anchor_rows(known.select("doc_id", "text")), "anchors")
    # written first, here and below, so that joins have two plain sides, which Spark can split at a hot key
    repeated = staged(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor"), "repeated")
    if repeated.count() <= ANCHORS:
        pieces = _segments(known, sieve(repeated))
    else:
        shared = anchors.join(repeated, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("repeated"))
        pieces = _segments(known.join(shared, "doc_id").select("doc_id", "text_key", "text", "repeated"))
    pieces = staged(pieces, "segments")
    discard(anchors, repeated)
    leaves = pieces.groupBy("anchor", "leaf").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("body").alias("body"), F.first("n").alias("n"))
    leaves = staged(leaves, "leaves")
    groups = leaves.groupBy("anchor").agg(F.sum("n").alias("words"), F.min("low").alias("a"), F.max("high").alias("b"))
    large = staged(groups.filter(F.col("words") > GROUP).select("anchor", "a", "b"), "large-groups")
    deep, read = _lengthened(leaves.join(large.filter("a < b"), "anchor", "left_semi"))
    found = _subtrees(leaves.join(large, "anchor", "left_anti")).union(deep)
    # a row for each leaf, which has SEGMENT windows at most, so that the join gives no more rows than there are segments
    found = staged(found.groupBy("anchor", "leaf").agg(F.collect_list(F.struct("first", "past", "least")).alias("windows")), "found")
    discard(leaves, large, *read)
    cuts = pieces.select("anchor", "leaf", "doc_id", "text_key", "start").join(found, ["anchor", "leaf"])
    hit = F.filter("windows", lambda w: w["least"] < F.col("doc_id"))
    cut = F.transform(hit, lambda w: F.struct((F.col("start") + w["first"]).alias("start"), (F.col("start") + w["past"] + (WINDOW - 1)).alias("end")))
    cuts = cuts.select("doc_id", "text_key", cut.alias("cuts")).filter("size(cuts) > 0")
    cuts = staged(cuts.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cuts")).alias("cuts")), "cuts")
    discard(pieces, found)
    return cuts


def _kept(words: list[bytes], cuts: list[dict]) -> list[bytes]:
    if not cuts:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, [c["start"] for c in cuts], 1)
    np.add.at(edge, [c["end"] for c in cuts], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


def _parted(rows: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows (with id and text_key) that may lose words, each with its cuts or null, and the other rows, which pass no shuffle."""
    bound_batches(rows.sparkSession)
    touched = held(sieve(cuts.select(F.xxhash64("doc_id", "text_key"))), F.xxhash64("id", "text_key"))
    return rows.filter(touched).join(cuts.withColumnRenamed("doc_id", "id"), ["id", "text_key"], "left"), rows.filter(~touched)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each row."""
    cuts = repeated_ranges(docs)
    cut, whole = _parted(_keyed(docs).withColumnRenamed("doc_id", "id"), cuts)
    rows = cut.select("id", "text", "cuts").union(whole.select("id", "text", F.lit(None).cast(cuts.schema["cuts"].dataType)))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        total, gone, digest = [], [], []
        for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or b"").split()
            kept = _kept(words, cuts)
            total.append(len(words))
            gone.append(len(words) - len(kept))
            digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return map_batches(rows, each, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words removed: a text that loses words is its kept words joined by one space, others stay as they are.

    A column n_chars, where there is one, follows the text.
    """
    inner, names = plain(docs)
    cuts = repeated_ranges(docs.select("doc_id", "text"))
    cut, whole = _parted(inner.select("*", F.col(names["doc_id"]).cast("long").alias("id"), F.xxhash64(names["text"]).alias("text_key")), cuts)
    rows = cut.select(*inner.columns, "cuts")
    k = docs.columns.index("text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        cuts = batch.column(batch.num_columns - 1).to_pylist()
        texts = [b" ".join(_kept(t.encode().split(), c)).decode() if c else t for t, c in zip(batch.column(k).to_pylist(), cuts, strict=True)]
        columns = batch.columns
        columns[k] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = map_batches(rows, each, rows.schema).select(*inner.columns).union(whole.select(*inner.columns)).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
