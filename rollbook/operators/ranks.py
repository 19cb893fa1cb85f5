"""Exact order statistics without ordering all rows anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts a range of values is cut into in a pass, and distinct values that are few enough to be fetched.
BINS, FEW = 1024, 4096


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> dict[int, float]:
    """The values at these places (from 0) of the rows in order, of a column of finite doubles; nulls are left out.

    Distributed selection: each place has a range of values that holds it. A pass counts the range's rows in BINS equal parts, with each part's
    least and greatest value, and the part that holds the place is the next range, until it is one value or has few rows, which are fetched
    as values and counts. Each pass is one aggregation for all places together; what comes to the driver is BINS rows for each, or FEW values.
    """
    # kept, or every pass would work the values out again
    rows = df.select(F.col(value).cast("double").alias("v")).persist()
    try:
        return _select(rows, ranks)
    finally:
        rows.unpersist()


def _select(rows: DataFrame, ranks: list[int]) -> dict[int, float]:
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks {ranks} of {n} rows")
    found: dict[int, float] = {}
    ranges = dict.fromkeys(ranks, (low, high, 0, n))  # least, greatest, rows before it and rows in it
    while ranges:
        for r, (a, b, _, _) in list(ranges.items()):
            if a == b:
                found[r] = a
                del ranges[r]
        small = {r: x for r, x in ranges.items() if x[3] <= FEW}
        if small:
            inside = " or ".join(f"v between cast('{a!r}' as double) and cast('{b!r}' as double)" for a, b, _, _ in small.values())
            counted = sorted((x.v, x.c) for x in rows.filter(inside).groupBy("v").agg(F.count("*").alias("c")).collect())
            for r, (a, b, before, _) in small.items():
                for v, c in counted:
                    if a <= v <= b:
                        before += c
                        if before > r:
                            found[r] = v
                            break
                del ranges[r]
        wide = sorted(set(ranges.values()))
        if wide:
            parts = [F.when(F.col("v").between(a, b), F.struct(F.lit(k).alias("range"), F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BINS)).cast("int").alias("bin"))) for k, (a, b, _, _) in enumerate(wide)]
            counts = rows.select("v", F.inline(F.array_compact(F.array(*parts)))).groupBy("range", "bin").agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
            bins = sorted((x.range, x.bin, x.a, x.b, x.c) for x in counts.collect())
            for r, was in list(ranges.items()):
                before = was[2]
                for k, _, a, b, c in bins:
                    if wide[k] == was:
                        if before + c > r:
                            ranges[r] = (a, b, before, c)
                            break
                        before += c
    return found
