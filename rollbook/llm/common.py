"""What several operators share: staged tables, bounded Arrow batches, sieves of keys, word and window hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest Arrow batch handed to Python, in bytes and rows: long texts make small batches.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
#: Bits of a sieve for each key and at most, which are 16 MB; bits that a key sets.
SIEVE_BITS, SIEVE_MOST, SIEVE_HASHES = 12, 1 << 27, 4


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session (tests) gets a temporary one; a cluster is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="rollbook-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors, computes df once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rollbook/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(*tables: DataFrame) -> None:
    """Deletes staged tables, once all that reads them is written."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """The same, and has the driver collect its garbage, upon which Spark deletes the shuffles that nothing can read any more."""
    delete(*tables)
    gc.collect()  # plans are held from Python, and shuffles by plans
    tables[0].sparkSession._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's two Arrow bounds, unless the session has its own."""
    own = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))


def give_back() -> None:
    """Returns freed memory to the system: Python workers wait for their next task for a while."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """mapInArrow, batch by batch; batches are bounded in bytes and rows."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)


def sieve(hashes: DataFrame) -> Broadcast:
    """A Bloom filter of the 64-bit hashes in the only column, for `held` and `holds`: it keeps every row whose hash it was given and few others.

    Only its bitmap comes to the driver, of SIEVE_MOST bits at most. With more than SIEVE_MOST / 8 hashes it keeps ever more other rows, so an exact
    join must follow; what it saves is the shuffle of wide rows that no join needs.
    """
    hashes, size, part = hashes.toDF("h"), 1 << 15, 1 << 15  # the bits of one bitmap of Spark's
    wanted = min(SIEVE_MOST, SIEVE_BITS * hashes.count())
    while size < wanted:
        size *= 2
    places = [F.expr(f"((h & 4294967295L) + {k}L * (shiftrightunsigned(h, 32) | 1L)) & {size - 1}L") for k in range(SIEVE_HASHES)]
    rows = hashes.select(F.explode(F.array(*places)).alias("at")).select(F.expr(f"at div {part}").alias("part"), (F.col("at") % part).alias("at"))
    made = np.zeros(size // 8, np.uint8)
    for row in rows.repartition("part").groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits")).collect():
        made[row.part * part // 8 :][: len(row.bits)] = np.frombuffer(row.bits, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(made.tobytes())


def holds(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (signed longs) a sieve's bitmap keeps."""
    made, h = np.frombuffer(bits, np.uint8), hashes.view(np.uint64)
    low, high, last = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1), np.uint64(len(made) * 8 - 1)
    found = np.ones(len(h), bool)
    for k in range(SIEVE_HASHES):
        at = (low + np.uint64(k) * high) & last
        found &= (made[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def held(bits: Broadcast, hashes: Column) -> Column:
    """Whether a sieve keeps a row by its hash."""

    def run(found: pa.Array) -> pa.Array:
        return pa.array(holds(bits.value, found.to_numpy(zero_copy_only=False)))

    return F.arrow_udf(run, "boolean")(hashes)


def plain(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by their places, so that no name clashes with inner ones, and which name stands for which column."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names, strict=True))


def utf8(text: Column | str) -> Column:
    """The bytes of a text; null stays null."""
    return F.encode(F.col(text) if isinstance(text, str) else text, "utf-8")


def id_crc(doc_id: Column | str) -> Column:
    """crc32 of the decimal text of an id; null ids count as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")))


class WordHash(dict):
    """64-bit hash of a word, remembered for up to `most` words of up to `longest` bytes."""

    most, longest = 1 << 16, 32

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: One for all operators: a worker may serve several.
WORD_HASH = WordHash()

_BASE = 0x9E3779B97F4A7C15
_BLOCK = 1 << 16
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, 1 << 12)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0][:n], _powers[1][:n]


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of `length` word hashes, in blocks, so that memory follows the block and not the text."""
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.empty(n, np.uint64)
    for at in range(0, n, _BLOCK):
        part = words[at : at + _BLOCK + length - 1]
        up, down = _power(len(part))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * down, dtype=np.uint64)])
        h = (sums[length:] - sums[:-length]) * up[: len(part) - length + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        out[at : at + len(h)] = h
    return out


_made: list[tuple] = []


def once(shared: Broadcast, make: Callable) -> object:
    """make(the broadcast's value), made once in each Python worker. A worker keeps one such thing, the last, since it lives on."""
    value = shared.value
    if not _made or _made[0][0] is not make or _made[0][1] is not value:
        _made.clear()
        WORD_HASH.clear()
        _made.append((make, value, make(value)))
    return _made[0][2]
