"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by a key: the text's digest, doc_id, then a number that tells repeated rows apart, so equal texts lie together
and a hot text or row still has many keys. A record weighs its bytes plus the mean of all records, so that many small records
count as well as few large ones. Splitters: a sample of keys, each drawn with a chance in proportion to its weight (deterministic,
by a hash), gives quantile boundaries of RANGES ranges of nearly equal weight; records are range-partitioned by binary search over
the boundaries. Exact sizes of all ranges are then counted, and overfull ranges, with more than twice their share, are subdivided
by splitters from a denser sample of their own into as many ranges as they have shares, until none is left. The ranges' running
totals give every record its place in the key order, in bytes and in rows, without a global sort; a record's shard is the eighth
of all bytes in which its middle byte lies.

Law: `bytes`. A shard's bytes differ from an eighth of the total by less than the size of the largest record.

Scale: sample and boundaries are bounded by SAMPLE and RANGES whatever the input; texts are read once and reduced to keys of
48 bytes, which are staged; the keys are shuffled once, by range, and sorted there with spilling.

Defined cases: null texts have size 1 and the checksum of no bytes, like empty texts; null ids sort first; repeated rows are
all kept, next to each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.llm.common import staged, utf8

SHARDS = 8
#: Ranges and the expected number of sampled keys.
RANGES, SAMPLE = 1024, 16384


Key = tuple[int, int, int]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the key of each row: h, the first 60 bits of the text's MD5, doc_id and a number of the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.conv(F.substring(F.md5(utf8(text)), 1, 15), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(utf8(text)).alias("text_crc32"),
        h.alias("h"), F.monotonically_increasing_id().alias("row"),
    )


def _id() -> Column:
    return F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))


def _boundaries(drawn: list, parts: int) -> list[Key]:
    """Keys that cut the drawn ones (key and weight) into parts of nearly equal weight."""
    drawn = sorted(drawn)
    whole, run, out = sum(w for _, w in drawn), 0.0, []
    for key, w in drawn:
        run += w
        while len(out) < parts - 1 and run >= whole * (len(out) + 1) / parts:
            out.append(key)
    return sorted(set(out))


def _sample(keys: DataFrame, mean: float, total: float) -> list[tuple[Key, float]]:
    """About SAMPLE of the keys, by weight. mean: what a record weighs beside its bytes; total: the weight of all keys."""
    chance = (F.col("size") + F.lit(mean)) * F.lit(SAMPLE / max(1.0, total))
    draw = F.pmod(F.xxhash64("h", _id(), "row", F.lit("splitters")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [((r[0], r[1], r[2]), r[3]) for r in keys.filter(draw < chance).select("h", _id(), "row", F.greatest(F.lit(1.0), chance)).collect()]


def range_of(boundaries: list[Key]) -> Column:
    """How many boundaries lie below the key, by binary search."""
    depth = len(boundaries).bit_length()
    padded = boundaries + [((1 << 63) - 1,) * 3] * ((1 << depth) - 1 - len(boundaries))
    literal = F.from_json(F.lit(json.dumps([{"h": h, "i": i, "r": r} for h, i, r in padded])), "array<struct<h:bigint,i:bigint,r:bigint>>")
    key = F.struct(F.col("h"), _id().alias("i"), F.col("row").alias("r"))
    steps = F.array(*[F.lit(1 << k) for k in range(depth - 1, -1, -1)]) if depth else F.array().cast("array<int>")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(literal, at + step - 1) < key, at + step).otherwise(at))


def _sizes(keys: DataFrame, boundaries: list[Key]) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each range that has any."""
    return {r.r: (r.b, r.n) for r in keys.groupBy(range_of(boundaries).alias("r")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}


def split(keys: DataFrame, total: int, rows: int) -> tuple[list[Key], dict[int, tuple[int, int]]]:
    """Boundaries of ranges none of which is overfull, and the bytes and rows of each range."""
    mean = total / max(1, rows)
    share = 2 * total / RANGES  # of the weight of all records, which is twice their bytes
    boundaries = _boundaries(_sample(keys, mean, 2 * total), RANGES)
    while True:
        sizes = _sizes(keys, boundaries)
        weight = {r: b + n * mean for r, (b, n) in sizes.items()}
        over = {r: math.ceil(w / share) for r, w in weight.items() if w > 2 * share and sizes[r][1] > 1}
        drawn: dict[int, list] = {}
        if over:  # a denser sample of the overfull ranges alone
            for key, w in _sample(keys.filter(range_of(boundaries).isin(list(over))), mean, sum(weight[r] for r in over)):
                drawn.setdefault(bisect.bisect_left(boundaries, key), []).append((key, w))
        finer = sorted({*boundaries, *(b for r, parts in over.items() for b in _boundaries(drawn.get(r, []), parts))})
        if finer == boundaries:  # none is left, or only records that are larger than a range's share
            return boundaries, sizes
        boundaries = finer


def shard_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row."""
    keys = staged(keyed(docs), "keys")
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    boundaries, sizes = split(keys, total, rows)
    bytes_before, rows_before = [0], [0]
    for r in range(len(boundaries) + 1):
        b, n = sizes.get(r, (0, 0))
        bytes_before.append(bytes_before[-1] + b)
        rows_before.append(rows_before[-1] + n)

    def of(values: list[int], index: str) -> Column:
        return F.get(F.from_json(F.lit(json.dumps(values)), "array<bigint>"), F.col(index))

    order = Window.partitionBy("r").orderBy("h", _id(), "row")
    run = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = of(bytes_before, "r") + F.sum("size").over(run) - F.col("size") + F.floor(F.col("size") / 2)
    place = of(rows_before, "r") + F.row_number().over(order) - 1
    shard = F.expr(f"cast(middle * {shards} div {max(1, total)} as int)")
    placed = keys.withColumn("r", range_of(boundaries)).withColumns({"middle": middle, "place": place}).withColumn("shard", shard)
    placed = staged(placed.select("doc_id", "size", "text_crc32", "shard", "place"), "placed")
    first = {r.shard: r.p for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("place") - of([first.get(k, 0) for k in range(shards)], "shard")).alias("slot"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    return shard_bytes(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
