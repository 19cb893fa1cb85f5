"""A Merkle manifest of a dataset, built by mountain-range stacks over indexed partitions.

A row is a leaf: the SHA-256 (lowercase hex, as all digests here) of its fields, each its UTF-8 length, a colon and its value, or `-`
for null. Within a group leaves stand in the order of a key. While several nodes remain, each run of FANOUT consecutive ones (the last may be shorter, even
one) becomes the digest of their hex digests, with no padding; what remains is the group's subroot. Subroots in the order of their groups
are the leaves of another such tree, whose top is the root.

Building: leaves are range-partitioned by group, key and leaf, so a group may span any number of partitions, and cut into segments
of at most 2^SEGMENT_BITS rows. The segments' counts, one row for each, give every segment the index of its first leaf. Then each
segment climbs its mountain range with a stack: nodes enter in index order, a run that is whole becomes its parent and carries
to the next level; what can't be finished there, the nodes at the segment's unaligned edges and its peaks, comes out as open. 2^MERGE_BITS
neighbouring segments' open nodes, in index order, climb in the same way, and so on, until one open node for each group is left. A segment leaves at most
14 open nodes a level, so merging moves little.

Proofs: a leaf's proof is the list of the other nodes of its run, level by level. Runs inside a segment are rebuilt there; those
that cross its edges, at most two a level, are joined to it by (group, level, run). So proofs cost one more shuffle of
leaf digests, and no row meets more than its own segment.

Scale: texts are read once and hashed in the JVM; what is shuffled is digests, twice. A hot group is many segments; rows that
repeat are spread by the partition they were read in. Python holds one segment.

Defined cases: null fields are `-`; null keys come first; rows of equal keys stand in the order of their leaves and repeated rows
are each a leaf; the null group is a group and the first; an empty table has no rows and no root; other columns, whatever their
names, are ignored. A row without doc_id is not tampered with.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import bound_batches, give_back, staged

#: Children of a node, as bits; rows of a segment and segments merged at a time, likewise.
FANOUT_BITS, SEGMENT_BITS, MERGE_BITS = 3, 17, 8
FANOUT, WIDTH = 1 << FANOUT_BITS, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "grp string, seg long, level int, index long, hash string, total long, open boolean, made boolean"
_BATCH = 4096


def field(value: Column | str) -> Column:
    """A field's part of a leaf: `-`, or UTF-8 bytes, a colon and the value."""
    s = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def token(group: Column | str) -> Column:
    """A group's name as a string that is never null and sorts as the group does, null first."""
    g = (F.col(group) if isinstance(group, str) else group).cast("string")
    return F.coalesce(F.concat(F.lit("="), g), F.lit(""))


def digest(run: str) -> str:
    return hashlib.sha256(run.encode()).hexdigest()


class Tree(NamedTuple):
    """One tree for each group, as tables.

    placed: grp, key, leaf, other, part (its segment) and place in it. heads: grp, part, first (place of its first row), n, seg (segments of a
    group numbered from 0), start (index of its first leaf), total (leaves of the group). nodes: every inner node. ladder: nodes of
    runs that no segment holds whole. tops: grp, the subroot's hash and total.
    """

    placed: DataFrame
    heads: DataFrame
    nodes: DataFrame
    ladder: DataFrame
    tops: DataFrame


class _Range:
    """The stack of one mountain range: of each level the run that is being filled. `out` gets (level, index, hash, open, made)."""

    def __init__(self, total: int, out: list) -> None:
        self.out, self.counts = out, [total]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // FANOUT))
        self.runs: list[tuple[int, list]] = [(-1, []) for _ in self.counts]

    def push(self, level: int, index: int, h: str) -> None:
        """Nodes come in the order of the leaves below them. Those that enter come out again only if they stay open; those made here always do."""
        made = False
        while self.counts[level] > 1:
            parent = index // FANOUT
            if self.runs[level][0] != parent:
                self._leave(level)
                self.runs[level] = (parent, [])
            run = self.runs[level][1]
            run.append((index, h, made))
            if len(run) < min(FANOUT, self.counts[level] - parent * FANOUT):
                return
            self.runs[level] = (-1, [])
            self.out.extend((level, i, x, False, True) for i, x, m in run if m)
            level, index, h, made = level + 1, parent, digest("".join([x for _, x, _ in run])), True
        self.out.append((level, index, h, True, made))

    def _leave(self, level: int) -> None:
        self.out.extend((level, i, x, True, m) for i, x, m in self.runs[level][1])

    def close(self) -> None:
        for level in range(len(self.runs)):
            self._leave(level)


def _rows(out: list, grp: str, seg: int, total: int) -> pa.RecordBatch:
    kinds = {"grp": pa.string(), "seg": pa.int64(), "level": pa.int32(), "index": pa.int64(), "hash": pa.string(), "total": pa.int64(), "open": pa.bool_(), "made": pa.bool_()}
    columns = ([grp] * len(out), [seg] * len(out), *([o[i] for o in out] for i in range(3)), [total] * len(out), *([o[i] for o in out] for i in (3, 4)))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def climb(entering: DataFrame) -> DataFrame:
    """Node rows of what each (grp, unit) makes of the nodes that enter it: grp, unit, seg, level, index, hash, total.

    A row of level -1 says for the leaves of its unit, which have places for indices, what to add to these, and their seg and total.
    """
    bound_batches(entering.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, state, shift, out, about = None, None, 0, [], ()
        for batch in batches:
            for grp, u, seg, level, index, h, total in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if unit != (grp, u):
                    if state:
                        state.close()
                        yield _rows(out, *about)
                    unit, shift, out, about = (grp, u), index if level < 0 else 0, [], (grp, seg, total)
                    state = _Range(total, out)
                if level >= 0:
                    state.push(level, index + shift, h)
                if len(out) >= _BATCH:
                    yield _rows(out, *about)
                    out.clear()
        if state:
            state.close()
            yield _rows(out, *about)
        give_back()

    at = F.when(F.col("level") < 0, -1).otherwise(F.expr(f"shiftleft(index, {FANOUT_BITS} * level)"))
    keyed = entering.select("grp", "unit", "seg", "level", "index", "hash", "total", at.alias("at")).repartition("grp", "unit")
    return keyed.sortWithinPartitions("grp", "unit", "at").mapInArrow(run, _NODES)


def build(leaves: DataFrame, label: str) -> Tree:
    """The trees of `leaves`: grp (never null), key, leaf and other, which is carried."""
    order = [F.col("grp"), F.col("key").asc_nulls_first(), F.col("leaf"), F.col("spread")]
    ranged = leaves.withColumn("spread", F.spark_partition_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = ranged.withColumn("id", F.monotonically_increasing_id())
    part, place = F.shiftright("id", SEGMENT_BITS), F.col("id").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    placed = staged(numbered.select("grp", "key", "leaf", "other", part.alias("part"), place.alias("place")), f"{label}-placed")
    before, whole = Window.partitionBy("grp").orderBy("part"), Window.partitionBy("grp")
    sizes = placed.groupBy("grp", "part").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    counted = sizes.select("*", (F.row_number().over(before) - 1).cast("long").alias("seg"), (F.sum("n").over(before) - F.col("n")).alias("start"), F.sum("n").over(whole).alias("total"))
    heads = staged(counted, f"{label}-heads")
    null = F.lit(None)
    start = heads.select("grp", F.col("part").alias("unit"), "seg", F.lit(-1).alias("level"), (F.col("start") - F.col("first")).alias("index"), null.cast("string").alias("hash"), "total")
    enter = placed.select("grp", F.col("part").alias("unit"), null.cast("long").alias("seg"), F.lit(0).alias("level"), F.col("place").alias("index"), F.col("leaf").alias("hash"), null.cast("long").alias("total"))
    rounds = [staged(climb(start.union(enter)), f"{label}-nodes")]
    most = heads.agg(F.max("seg")).first()[0] or 0
    while most:
        most >>= MERGE_BITS
        rounds.append(staged(climb(rounds[-1].filter("open").withColumn("unit", F.shiftright("seg", MERGE_BITS * len(rounds)))), f"{label}-nodes"))
    nodes, ladder = rounds[0].filter("made"), rounds[0].filter("open")
    for later in rounds[1:]:
        nodes, ladder = nodes.union(later.filter("made")), ladder.union(later.filter("made"))
    return Tree(placed, heads, nodes, ladder, rounds[-1].filter("open").select("grp", "hash", "total"))


def _rungs(tree: Tree) -> DataFrame:
    """grp, part and `rungs`, the nodes (level, index, hash) of the runs that cross the segment's edges or lie above it: at most two runs a level."""
    levels = tree.heads.select("*", F.explode(F.sequence(F.lit(0), F.lit(63 // FANOUT_BITS - 1))).alias("level")).filter(f"shiftright(total - 1, {FANOUT_BITS} * level) > 0")
    above = f"{FANOUT_BITS} * (level + 1)"
    wanted = levels.select("grp", "part", "level", F.explode(F.expr(f"array_distinct(array(shiftright(start, {above}), shiftright(start + n - 1, {above})))")).alias("run"))
    steps = tree.ladder.select("grp", "level", F.shiftright("index", FANOUT_BITS).alias("run"), "index", "hash")
    return wanted.join(steps, ["grp", "level", "run"]).groupBy("grp", "part").agg(F.collect_list(F.struct("level", "index", "hash")).alias("rungs"))


class _Segment:
    """The leaves of a segment and the runs around and above them: paths of leaves to the subroot."""

    def __init__(self, start: int, total: int, rungs: list[dict], leaves: list[str]) -> None:
        self.start, self.counts = start, [total]
        while self.counts[-1] > 1:
            self.counts.append(-(-self.counts[-1] // FANOUT))
        self.runs: dict[tuple[int, int], str] = {}
        for level, index, h in sorted((r["level"], r["index"], r["hash"]) for r in rungs):
            self.runs[level, index // FANOUT] = self.runs.get((level, index // FANOUT), "") + h
        index, nodes = start, leaves
        for level, count in enumerate(self.counts[:-1]):
            first, ups, above = -(-index // FANOUT), [], None
            for parent in range(index // FANOUT, (index + len(nodes) - 1) // FANOUT + 1 if nodes else 0):
                low, high = parent * FANOUT - index, min((parent + 1) * FANOUT, count) - index
                if low >= 0 and high <= len(nodes):
                    run = self.runs[level, parent] = "".join(nodes[low:high])
                    above = parent if above is None else above
                    ups.append(digest(run))
            index, nodes = first if above is None else above, ups

    def path(self, level: int, index: int) -> list[tuple[int, str]]:
        """(place, run) of the node and of those above it, to the subroot."""
        out = []
        while level < len(self.counts) - 1:
            out.append((index % FANOUT, self.runs[level, index // FANOUT]))
            level, index = level + 1, index // FANOUT
        return out


def siblings(path: list[tuple[int, str]]) -> str:
    """The other nodes of each run, in order."""
    return "".join([run[: p * WIDTH] + run[p * WIDTH + WIDTH :] for p, run in path])


def fold(h: str, path: list[tuple[int, str]]) -> str:
    """The top that a leaf leads to with the siblings of a path."""
    for p, run in path:
        h = digest(run[: p * WIDTH] + h + run[p * WIDTH + WIDTH :])
    return h


def proofs(tree: Tree, upper: DataFrame | None = None) -> DataFrame:
    """key, leaf and what proves every leaf.

    Without `upper`: `path`, its place and run (concatenated digests) level by level to the subroot. With `upper` (grp, subroot, path from there on, root): subroot,
    root, proof_sha256 (of all siblings), folded_root (where `other`, or if that is null the leaf, leads to with these siblings) and verified.
    """
    bound_batches(tree.placed.sparkSession)
    key = tree.placed.schema["key"].dataType
    heads = tree.heads.join(_rungs(tree), ["grp", "part"], "left")
    fields = ["start", "total", "rungs"]
    if upper is not None:
        heads, fields = heads.join(upper, "grp"), [*fields, "subroot", "path", "root"]
    null = F.lit(None)
    top = heads.select("grp", "part", F.lit(-1).cast("long").alias("place"), null.cast(key).alias("key"), null.cast("string").alias("leaf"), null.cast("string").alias("other"), F.struct(*fields).alias("head"))
    rows = tree.placed.select("grp", "part", "place", "key", "leaf", "other", null.cast(top.schema["head"].dataType).alias("head"))
    ordered = top.union(rows).repartition("grp", "part").sortWithinPartitions("grp", "part", "place").select("key", "leaf", "other", "head")
    full = upper is None

    def emit(head: dict, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        leaves, others = table.column(1).to_pylist(), table.column(2).to_pylist()
        segment = _Segment(head["start"], head["total"], head["rungs"] or [], leaves)
        above = [] if full else [(r["place"], r["run"]) for r in head["path"]]
        parent, rest, tail, found = -1, [], "", []
        for i, (h, other) in enumerate(zip(leaves, others, strict=True), head["start"]):
            own = segment.path(0, i)[:1]
            if i // FANOUT != parent:
                parent = i // FANOUT
                rest = segment.path(1, parent) + above if own else above
                tail = siblings(rest)
            if full:
                found.append([{"place": p, "run": r} for p, r in own + rest])
            else:
                found.append((digest(siblings(own) + tail), fold(h if other is None else other, own + rest)))
        if full:
            proven = {"path": pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("run", pa.string())])))}
        else:
            n, folded = len(leaves), [f for _, f in found]
            proven = {"subroot": pa.array([head["subroot"]] * n), "root": pa.array([head["root"]] * n), "proof_sha256": pa.array([p for p, _ in found]), "folded_root": pa.array(folded), "verified": pa.array([f == head["root"] for f in folded])}
        out = pa.table({"key": table.column(0), "leaf": table.column(1), **proven})
        yield from out.to_batches(max_chunksize=_BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, held = None, []
        for batch in batches:
            marks = batch.column(3)
            starts = [i for i in range(batch.num_rows) if marks[i].is_valid] if marks.null_count < batch.num_rows else []
            for low, high in zip([0, *starts], [*starts, batch.num_rows], strict=True):
                if low in starts:
                    if held:
                        yield from emit(head, held)
                    head, held, low = marks[low].as_py(), [], low + 1
                if low < high:
                    held.append(batch.slice(low, high - low))
        if held:
            yield from emit(head, held)
        give_back()

    kind = f"key {key.simpleString()}, leaf string"
    return ordered.mapInArrow(run, f"{kind}, path array<struct<place:int,run:string>>" if full else f"{kind}, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(df: DataFrame, group: str = "lang", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, other: Column | None = None) -> tuple[Tree, Tree]:
    """The trees of the groups of df, and the tree of their subroots. `other` is another digest to fold instead of a row's leaf, where it isn't null."""
    kept = df.select(token(group).alias("grp"), F.col(key).alias("key"), leaf(*fields).alias("leaf"), (F.lit(None) if other is None else other).cast("string").alias("other"))
    # written first: sorting by range reads its input twice
    tree = build(staged(kept, "merkle-leaves"), "merkle")
    return tree, build(tree.tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("hash").alias("leaf"), F.lit(None).cast("string").alias("other")), "merkle-crown")


def audit(tree: Tree, crown: Tree) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root and verified of every row of a manifest."""
    root = crown.tops.first()
    upper = proofs(crown).select(F.col("key").alias("grp"), F.col("leaf").alias("subroot"), "path", F.lit(root.hash if root else None).cast("string").alias("root"))
    return proofs(tree, staged(upper, "merkle-upper"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document; every third, by the checksum of its id, is tampered with: its text's A-Z are lower-cased."""
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(*(lowered if c == "text" else c for c in FIELDS)))
    return audit(*manifest(docs, other=tampered)).withColumnRenamed("key", "doc_id")
