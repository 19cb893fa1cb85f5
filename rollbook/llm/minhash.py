"""Near copies by SimHash and MinHash bands, verified on the sets of shingles.

A text's words are as in simhash; its set is the hashes of its 5-word shingles (of fewer words, the whole sequence). Two texts
link if their sets have a Jaccard similarity of 0.8 or more.

Candidates come from two searches. The first is operator 7's: SimHash fingerprints linked by deletion variants, each component of
which is a bucket. It finds close copies. Alone it isn't enough: two texts of similarity 0.8 differ in about 10 of 64 fingerprint
bits, some in 17, and a search by one-wildcard segments at that distance would need segments of 7 bits, which all texts share. So
the second takes buckets of MinHash bands.

Bands: BANDS bands of ROWS minima each; texts that agree in a band are in one bucket. A pair of similarity 0.8 shares one of 16
bands of 4 with probability 1 - (1 - 0.8^4)^16 = 0.9998, a closer one with more. In a bucket a text is compared with the
members of each cluster until one links, so a bucket of near copies costs one comparison each, and its components are those of
all pairs. Every link is verified; none is taken from the fingerprints or bands alone.

The buckets are taken in three turns: the fingerprints' first, then two halves of the bands, of which the first links a pair of
similarity 0.8 with probability 0.985. After the first turn only those buckets count whose members are in several components, so
most groups of copies are compared once and not in every band. Buckets of the same members count once, in the earliest turn.
A turn's links join the stars that the turns before have left, so components aren't found anew.

Hot buckets: a bucket with more than BUCKET shingles is dealt out, by a hash that differs from band to band, into groups below
that bound, which are compared each in itself. A large group of near copies is then one component already, through its other
bands. What is left are members that aren't in the component most members are in: in blocks below the bound they are compared
with every member of the bucket that passes by. Of two members in different components one at least is such, so no link is lost.

Scale: texts of the same words are one node; a node has BANDS index rows and those of its fingerprint. Texts are never shuffled:
those of nodes in buckets of several are picked by a sieve while all are read again, and only their sets move. A task holds about
BUCKET shingles, or one text's. Tables of a step are deleted when the next ones are written.

Defined cases: as in simhash, but that null, empty and blank texts are one node that links to no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm import simhash
from rollbook.llm.common import WORD_HASH, bound_batches, delete, discard, give_back, held, map_batches, sieve, staged, window_hashes
from rollbook.llm.simhash import keyed, labelled, rooted, stars

SHINGLE, BANDS, ROWS = 5, 16, 4
NEAR, OF = 4, 5  # the least similarity, 4 / 5
BUCKET = 1 << 18
_BLOCK = 1 << 12
_MIX = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64) | np.uint64(1)


def shingles(words: list[bytes]) -> np.ndarray:
    """The hashes of a text's shingles, sorted, each once."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(WORD_HASH.of(words), min(SHINGLE, len(words))))


def bands(found: np.ndarray) -> list[int]:
    """A signed key for each band of a set of shingles; none of the empty set."""
    if not len(found):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), _BLOCK):
        mixed = (found[at : at + _BLOCK] ^ _MIX[0]) * _MIX[1]
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(31)).min(1))
    keys = [xxhash.xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _node(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words))


def _mark(batch: pa.RecordBatch) -> pa.RecordBatch:
    nodes, sizes, prints, keys = [], [], [], []
    for text in batch.column(2).to_pylist():
        words = _words(text)
        found = shingles(words)
        nodes.append(_node(words))
        sizes.append(len(found))
        prints.append(simhash.fingerprint_of(words))
        keys.append(bands(found))
    longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, sizes, prints)]
    made = [*batch.columns[:2], *longs, pa.array(keys, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(made, names=["doc_id", "text_key", "fp", "n", "print", "bands"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    words = [_words(t) for t in batch.column(2).to_pylist()]
    nodes = np.array([_node(x) for x in words], np.uint64).view(np.int64)
    found = [shingles(x).view(np.int64) for x in words]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found, pa.list_(pa.int64()))], names=["fp", "shingles"])


def near(a: np.ndarray, b: np.ndarray) -> bool:
    if OF * min(len(a), len(b)) < NEAR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= NEAR * (len(a) + len(b) - both)


def _bucket_links(bucket: pa.Table) -> pa.Table:
    """Links (a, b) whose components are those of all similar pairs of the bucket."""
    clusters: list[list[tuple[int, np.ndarray]]] = []
    a, b = [], []
    for fp, found in zip(bucket.column("fp").to_pylist(), bucket.column("shingles"), strict=True):
        own = found.values.to_numpy()
        home, kept = None, []
        for cluster in clusters:
            other = next((x for x, theirs in cluster if near(own, theirs)), None)
            if other is not None:
                a.append(fp)
                b.append(other)
            if other is None or home is None:
                kept.append(cluster)
                home = home if other is None else cluster
            else:
                home.extend(cluster)
        if home is None:
            kept.append([(fp, own)])
        else:
            home.append((fp, own))
        clusters = kept
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _block_links(blocks: DataFrame) -> DataFrame:
    """Links (a, b) of the asked rows of each block with its other rows of another root.

    blocks: key, block, asked, root, fp and shingles; the asked rows of a block fit in memory, the others only pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        of = None
        for batch in batches:
            a, b = [], []
            plain = (batch.column(i).to_pylist() for i in range(5))
            for key, block, asked, root, fp, found in zip(*plain, batch.column(5), strict=True):
                if (key, block) != of:
                    of, held = (key, block), []
                own = found.values.to_numpy()
                for other, theirs, set_ in held:
                    if theirs != root and near(own, set_):
                        a.append(fp)
                        b.append(other)
                if asked:
                    held.append((fp, root, own.copy()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        give_back()

    bound_batches(blocks.sparkSession)
    dealt = blocks.select("key", "block", "asked", "root", "fp", "shingles").repartition("key", "block").sortWithinPartitions("key", "block", F.desc("asked"))
    return dealt.mapInArrow(run, "a long, b long")


def _across(members: DataFrame, sets: DataFrame, found: DataFrame) -> DataFrame:
    """The stars found and the links within hot buckets, whose members these are, that their groups don't hold, as far as they join these stars: all as stars again."""
    label = rooted(found).select(F.col("node").alias("fp"), "root")
    hot = staged(members.join(label, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root")), "hot")
    most = hot.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).filter("roots > 1")
    most = staged(most, "most")
    rest = hot.join(most, "key").withColumn("asked", F.col("root") != F.col("main"))
    blocks = staged(rest.filter("asked").groupBy("key").agg(F.ceil(F.sum("n") / BUCKET).cast("int").alias("blocks")), "blocks")
    rows = rest.join(blocks, "key").select("key", "fp", "root", "asked", "blocks", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int").alias("own"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).withColumn("asked", F.col("asked") & (F.col("block") == F.col("own")))
    out = stars(found.union(_block_links(rows.join(sets, "fp"))))
    delete(hot, most, blocks, found)
    return out


def _prints(nodes: DataFrame) -> DataFrame:
    """Stars of the nodes' SimHash fingerprints, by the links that operator 7 finds."""
    prints = staged(nodes.filter("n > 0").select(F.col("print").alias("fp")).distinct(), "prints")
    found = stars(simhash.links(prints))
    delete(prints)
    return found


def _print_buckets(nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """key, fp and n of the nodes, where key stands for the component of their SimHash fingerprints."""
    root = rooted(prints).withColumnRenamed("node", "print")
    own = nodes.filter("n > 0").select("fp", "n", "print")
    return own.join(root, "print", "left").select(F.xxhash64(F.coalesce("root", "print")).alias("key"), "fp", "n")


def _links(members: DataFrame, sets: DataFrame, before: DataFrame | None) -> DataFrame:
    """Stars of the verified links of texts in common buckets of members (key, fp, n, salts, salt) and of the stars before: their components are those of all similar pairs there.

    A bucket whose members are in one component of the stars before holds nothing new and is left out.
    """
    if before is not None:
        label = rooted(before)
        roots = members.join(label.select(F.col("node").alias("fp"), "root"), "fp", "left").select("key", F.coalesce("root", "fp").alias("root"))
        news = roots.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
        members = staged(members.join(news, "key", "left_semi"), "members")
    found = members.select("key", "salt", "fp").join(sets, "fp").groupBy("key", "salt").applyInArrow(_bucket_links, "a long, b long")
    found = stars(found if before is None else before.union(found))
    hot = members.filter("salts > 1")
    if not hot.isEmpty():
        found = _across(hot, sets, found)
    if before is not None:
        discard(members, before)
    return found


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp (a hash of the words), component and component_id, the smallest doc_id reachable over links, of each row."""
    marked = staged(map_batches(keyed(docs), _mark, "doc_id long, text_key long, fp long, n long, print long, bands array<long>"), "marked")
    # equal words have equal values, so those of any row stand for a node's; `one` is a row of it
    values = [F.first(c).alias(c) for c in ("n", "print", "bands")]
    nodes = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("one"), *values), "nodes")
    index = nodes.select("fp", "n", F.posexplode("bands").alias("band", "key")).select("key", "fp", "n", F.when(F.col("band") < BANDS // 2, 1).otherwise(2).alias("turn"))
    prints = _prints(nodes)
    index = staged(_print_buckets(nodes, prints).select("*", F.lit(0).alias("turn")).union(index.select("key", "fp", "n", "turn")), "index")
    several = index.groupBy("key", "turn").agg(F.count("*").alias("c"), F.sum("n").alias("size"), F.bit_xor(F.xxhash64("fp")).alias("mark"), F.min("fp").alias("low")).filter("c > 1")
    buckets = several.groupBy("c", "size", "mark", "low").agg(F.min(F.struct("turn", "key")).alias("m")).select("m.turn", "m.key", F.ceil(F.col("size") / BUCKET).cast("int").alias("salts"))
    buckets = staged(buckets, "buckets")
    members = index.join(buckets, ["key", "turn"]).withColumn("salt", F.pmod(F.xxhash64("key", "fp"), F.col("salts")))
    members = staged(members, "members")
    discard(prints, index, buckets)
    again = members.select("fp").distinct().join(nodes, "fp").select(F.xxhash64("one.doc_id", "one.text_key"))
    sets = keyed(docs).filter(held(sieve(again), F.xxhash64("doc_id", "text_key")))
    sets = staged(map_batches(sets, _sets, "fp long, shingles array<long>").dropDuplicates(["fp"]), "sets")
    found = None
    for turn in range(3):
        found = _links(members.filter(F.col("turn") == turn).drop("turn"), sets, found)
    discard(members, sets)
    out = labelled(marked.select("doc_id", "text_key", "fp"), nodes.select("fp", "first_id"), found)
    discard(nodes)
    return out
