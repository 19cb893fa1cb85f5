"""As-of joins: what had happened before a moment (ST9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def earlier_counts(asked: DataFrame, happened: DataFrame, key: str, ts: str, width: str = "1 day", alias: str = "earlier") -> DataFrame:
    """asked with, for each row, how many rows of happened have its key and an earlier time (not the same).

    Both sides are one union, numbered within (key, time bucket of `width`), with the counts of the key's buckets before carried
    in. So a hot key is as many tasks as it has buckets, and no row meets more than its bucket; what is carried is one row for each bucket.
    Null keys and times have no earlier rows.
    """
    columns = F.struct(*asked.columns)
    bucket = F.window(F.col("at"), width)["start"].alias("bucket")
    left = asked.select(F.col(key).alias("k"), F.col(ts).alias("at"), F.lit(0).alias("n"), columns.alias("row"))
    right = happened.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("k"), F.col(ts).alias("at"), F.lit(1).alias("n"), F.lit(None).cast(asked.select(columns).schema[0].dataType).alias("row"))
    known = left.filter("k is not null and at is not null").union(right).withColumn("bucket", bucket)
    carried = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = known.groupBy("k", "bucket").agg(F.sum("n").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(carried), F.lit(0)).alias("carried"))
    # of rows of one time those that ask come first
    inside = F.sum("n").over(Window.partitionBy("k", "bucket").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0))
    counted = known.withColumn("inside", inside).filter("row is not null").join(before, ["k", "bucket"])
    out = counted.select("row.*", (F.col("inside") + F.col("carried")).cast("long").alias(alias))
    return out.union(asked.filter(F.col(key).isNull() | F.col(ts).isNull()).withColumn(alias, F.lit(0).cast("long")))
