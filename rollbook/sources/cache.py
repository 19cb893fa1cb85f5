"""A cache of extraction results (H4): what has been read once isn't read again, by content and not by name.

The cache is a Parquet table: key, stored_at, bytes and the result, in generations. Extraction joins the files' keys to the rows that still count and
reads only the others, copies once; their results are appended. A row counts for HOURS after it was stored. Where the rows that count
have more bytes than the limit, the oldest go until SHARE of the limit is left; `evict` writes those that stay as the next generation,
and readers take the last. Earlier generations are left to the folder's retention.

Which rows stay is a running sum from the newest on. It is taken within buckets (minute and first two digits of the key) and over the buckets'
totals, of which there are 1,441 x 256 at most since rows older than a day don't count, so no task orders all rows.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.functions import support
from rollbook.sources import documents

HOURS, LIMIT, SHARE = 24, 500 << 20, 0.8
_RESULT = "result struct<{}>".format(", ".join(f"{name}:{kind}" for name, kind in (x.strip().split(" ", 1) for x in documents.SCHEMA.split(", ")) if name != "path"))
CACHE = f"key string, stored_at timestamp, bytes long, {_RESULT}"


def fresh(rows: DataFrame, now: datetime, hours: int = HOURS) -> DataFrame:
    """The rows that count: those stored in the last hours, of rows of one key the last."""
    inner = F.struct("stored_at", *[c for c in rows.columns if c not in ("key", "stored_at")])
    live = rows.filter((F.col("stored_at") > F.lit(now - timedelta(hours=hours)).cast("timestamp")) & (F.col("stored_at") <= F.lit(now).cast("timestamp")))
    return live.groupBy("key").agg(F.max_by(inner, F.struct("stored_at", "bytes")).alias("r")).select("key", "r.*").select(*rows.columns)


def kept(rows: DataFrame, limit: int = LIMIT, share: float = SHARE) -> DataFrame:
    """The rows (key, stored_at, bytes) that stay: all if their bytes are within the limit, else the newest while their sum is within a share of it.

    Age is counted in minutes; of one minute the greater key counts as newer. Keys are hexadecimal digests.
    """
    place = ("minute", "part")
    placed = rows.select("*", F.date_trunc("minute", "stored_at").alias("minute"), F.substring("key", 1, 2).alias("part"))
    totals = placed.groupBy(*place).agg(F.sum("bytes").alias("b"))
    newer = Window.orderBy(F.desc("minute"), F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*place, F.coalesce(F.sum("b").over(newer), F.lit(0)).alias("before"), "b", F.sum("b").over(Window.partitionBy()).alias("all"))
    joined = placed.join(before, list(place))
    sure = (F.col("all") <= limit) | (F.col("before") + F.col("b") <= share * limit)
    cut = joined.filter(~sure & (F.col("before") <= share * limit))  # the one bucket that the cut goes through
    inside = Window.partitionBy(*place).orderBy(F.desc("key")).rowsBetween(Window.unboundedPreceding, 0)
    some = cut.withColumn("run", F.col("before") + F.sum("bytes").over(inside)).filter(F.col("run") <= share * limit)
    return joined.filter(sure).select(*rows.columns).union(some.select(*rows.columns))


def last_generation(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """The cache's rows and the number of their generation; the table is made if it isn't there."""
    spark.createDataFrame([], CACHE).withColumn("g", F.lit(0)).coalesce(1).write.mode("append").partitionBy("g").parquet(path)
    all_ = spark.read.schema(f"{CACHE}, g int").parquet(path)
    g = all_.agg(F.max("g")).first()[0] or 0
    return all_.filter(F.col("g") == g).drop("g"), g


def extracted(files: DataFrame, path: str, now: datetime, options: str = "", readers: dict[str, documents.Reader] | None = None) -> DataFrame:
    """documents.extracted of checked files, by way of the cache at path: files whose content and options are known aren't read."""
    spark = files.sparkSession
    rows, g = last_generation(spark, path)
    keyed = files.withColumn("key", support.cache_key(F.col("content"), F.concat_ws("|", "type", F.coalesce("message", F.lit("")), F.lit(options))))
    missing = keyed.join(fresh(rows, now).select("key"), "key", "left_anti").dropDuplicates(["key"])
    read = documents.extracted(missing.select(F.col("key").alias("path"), "type", "message", "content"), readers)
    result = F.struct(*[c for c in read.columns if c != "path"])
    new = read.select(F.col("path").alias("key"), F.lit(now).cast("timestamp").alias("stored_at"), F.length(F.to_json(result)).cast("long").alias("bytes"), result.alias("result"))
    new.withColumn("g", F.lit(g)).write.mode("append").partitionBy("g").parquet(path)
    known = fresh(last_generation(spark, path)[0], now)
    return keyed.select("path", "key").join(known.select("key", "result"), "key").select("path", "result.*")


def evict(spark: SparkSession, path: str, now: datetime, limit: int = LIMIT, share: float = SHARE) -> int:
    """Writes the rows that stay as the next generation, if any go; how many went."""
    rows, g = last_generation(spark, path)
    live = fresh(rows, now)
    stay = live.join(kept(live.select("key", "stored_at", "bytes"), limit, share).select("key"), "key", "left_semi")
    n, m = rows.count(), stay.count()
    if m < n:
        stay.withColumn("g", F.lit(g + 1)).write.mode("append").partitionBy("g").parquet(path)
    return n - m
