"""SimHash near-duplicates by deletion-variant signatures.

A text's words are the runs of bytes other than ASCII white space, A-Z lower-cased; its features are the 3-word shingles,
repeats included (of fewer words, the whole sequence). A fingerprint bit is 1 where more than half of the features' XXH64
values (seed 42) have it. Fingerprints of 64 bits link at 3 or fewer differing bits.

Search: a fingerprint is cut into two segments of 32 bits. Of 3 differing bits at most one falls into one of the segments, so
two linked fingerprints agree in a segment but for one position. Each distinct fingerprint is indexed under its 64 segment
variants, each with one position as a wildcard; an equality join on the variants gives candidates, which the full distance
verifies. A pair is taken only at the first variant that it shares, so each link comes once.

Hot variants: where more than HOT fingerprints share a variant, of which few may be near, the variant is lengthened by those of
the other segment, cut in two: of 3 differing bits at most one falls into one of its halves. So a hot variant emits no pairs that
agree in that segment alone.

Scale: equal fingerprints are one node, so copies cost nothing but the final lookup; a node has 64 index rows of two longs;
joins are sort-merge joins, whose hot keys adaptive execution splits. Links of one fingerprint are bounded by the 43,744
fingerprints within 3 bits. Components come by rounds of large-star and small-star on the links alone, each staged; what a round
has read is deleted then, and no round comes after the one that leaves stars only.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a null id is kept and never the
smallest unless its component has no other; repeated rows are kept; an empty table gives an empty result; other columns of
the input, whatever their names, are ignored by near_duplicates and carried by keep_one, which picks rows and not ids: rows
that share an id or have none are told apart by their texts. keep_one shuffles the texts of rows that may go, and no others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import bound_batches, delete, discard, held, map_batches, plain, sieve, staged, utf8

SHINGLE, SEED, DISTANCE, SEGMENTS = 3, 42, 3, 2
HOT = 2000
_BLOCK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text."""
    return fingerprint_of((text or b"").lower().split())


def fingerprint_of(words: list[bytes]) -> int:
    """The same of a text's words."""
    if not words:
        return 0
    if len(words) < SHINGLE:
        words = [b" ".join(words), b"", b""]
    total, bits = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, total, _BLOCK):
        part = words[at : at + _BLOCK + SHINGLE - 1]
        shingles = map(b" ".join, zip(part, part[1:], part[2:], strict=False)) if total > 1 or words[1] else part[:1]
        found = b"".join([digest(x, SEED) for x in shingles])
        bits += np.unpackbits(np.frombuffer(found, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > total).tobytes(), "big")


def _each(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["doc_id", "text_key", "fp"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (a hash of the text, which tells apart rows that share an id) and the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), utf8("text").alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key and fp, the fingerprint as a signed long, of each row."""
    return map_batches(keyed(docs), _each, "doc_id long, text_key long, fp long")


def variants(nodes: DataFrame) -> DataFrame:
    """The one-wildcard segment variants of each fp: variant v blanks bit v % 32 of segment v // 32; both are in `key`."""
    segment = F.when(F.col("v") < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    blank = F.expr("shiftleft(1L, v % 32)")
    key = F.expr("shiftleft(cast(v as long), 32)").bitwiseOR(segment.bitwiseAND(F.bitwise_not(blank)))
    return nodes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select("fp", key.alias("key"))


def lengthened(index: DataFrame) -> DataFrame:
    """The rows of variants with `more`: each one-wildcard variant of the two halves of the segment that isn't in the key."""
    other = F.when(F.shiftright("key", 32) < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    spread = index.select("fp", "key", other.alias("other"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w"))
    half = F.when(F.col("w") < 16, F.shiftrightunsigned("other", 16)).otherwise(F.col("other").bitwiseAND(F.lit(0xFFFF)))
    more = F.expr("shiftleft(cast(w as long), 16)").bitwiseOR(half.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, w % 16)"))))
    return spread.select("fp", "key", more.alias("more"))


def links(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fps at DISTANCE or fewer bits, each once."""
    index = variants(nodes)
    first = F.expr(
        "case when bit_count(shiftrightunsigned(a ^ b, 32)) = 0 then 0"
        " when bit_count(shiftrightunsigned(a ^ b, 32)) = 1 then bit_count(shiftrightunsigned(a ^ b, 32) - 1)"
        " when (a ^ b) & 4294967295L = 0 then 32"
        " else 32 + bit_count(((a ^ b) & 4294967295L) - 1) end"
    )
    near = (F.col("a") < F.col("b")) & (F.expr("bit_count(a ^ b)") <= DISTANCE) & (F.shiftright("key", 32) == first)

    def joined(rows: DataFrame, on: list[str]) -> DataFrame:
        # merge: Spark's estimate takes the rows before they are exploded, and by it would broadcast the whole index
        return rows.withColumnRenamed("fp", "a").hint("merge").join(rows.withColumnRenamed("fp", "b"), on).filter(near).select("a", "b")

    hot = staged(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("key"), "hot-variants")
    if hot.isEmpty():
        return joined(index, ["key"])
    return joined(index.join(hot, "key", "left_anti"), ["key"]).union(joined(lengthened(index.join(hot, "key", "left_semi")), ["key", "more"]).distinct())


def _forest(edges: DataFrame) -> bool:
    """Whether edges (a, b), a > b, each once, are stars: no a has two edges or is another's b."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return not odd.agg(F.count("*")).first()[0]


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b), staged, of every node a of the undirected edges to b, the smallest node of its component, which has none.

    Alternates large-star and small-star until only stars are left, which takes about log of the longest path rounds; stars take none.
    """
    edges = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _forest(edges):
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # a row for each edge at most
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        last, edges = edges, staged(small.filter("a != b").distinct(), "edges")
        delete(last)
    return edges


def rooted(found: DataFrame) -> DataFrame:
    """node and root of every node of stars."""
    return found.select(F.col("a").alias("node"), F.col("b").alias("root")).union(found.select("b", "b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """node and root of every node of the undirected edges (a, b): the root is the smallest node of its component."""
    return rooted(stars(edges))


def labelled(marked: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """marked (doc_id, text_key, fp) with component, a fp that stands for the row's component, and component_id, its smallest doc_id.

    nodes: fp and its first_id; found: the stars of the links of fps, which go.
    """
    member = rooted(found)
    grouped = member.join(nodes, member.node == nodes.fp).select("fp", "root", "first_id")
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    label = grouped.join(least, "root").select("fp", "root", "component_id")
    label = nodes.join(label, "fp", "left").select("fp", F.coalesce("root", "fp").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    label = staged(label, "labels")
    delete(found)
    return marked.join(label, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (signed long), component and component_id, the smallest doc_id reachable over links, of each row."""
    marked = staged(fingerprints(docs), "fingerprints")
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    out = labelled(marked, nodes, stars(links(nodes)))
    discard(nodes)
    return out


def keep_one(docs: DataFrame, find: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """docs with one row for each component that `find` gives: that of the smallest doc_id, a null one last, then of the least text_key.

    Of rows that repeat both, the one whose other columns have the least hash stays.
    """
    inner, names = plain(docs)
    bound_batches(docs.sparkSession)
    rows = inner.select("*", F.col(names["doc_id"]).cast("long").alias("id"), F.xxhash64(names["text"]).alias("text_key"))
    found = find(inner.select(F.col(names["doc_id"]).alias("doc_id"), F.col(names["text"]).alias("text")))
    found = staged(found.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n")), "rows")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("m"))
    first = staged(first.select("component", F.col("m.doc_id").alias("of_id"), F.col("m.text_key").alias("of_key")), "first")
    # most rows are the first of their component and repeat no other: they stay where they are, only the others meet in a join
    least = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    bits = sieve(found.join(first, "component").filter(~least | (F.col("n") > 1)).select(F.xxhash64("doc_id", "text_key")))
    unsure = held(bits, F.xxhash64("id", "text_key"))
    kept = rows.filter(unsure).join(first, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")), "left_semi")
    sortable = [c for c, t in inner.dtypes if not t.startswith(("map", "variant")) and "map<" not in t]
    nth = F.row_number().over(Window.partitionBy("id", "text_key").orderBy(F.xxhash64(*sortable))).alias("nth")
    kept = kept.select("*", nth).filter("nth = 1").select(*inner.columns)
    return rows.filter(~unsure).select(*inner.columns).union(kept).toDF(*docs.columns)
