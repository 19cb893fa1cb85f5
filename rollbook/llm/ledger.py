"""Secret scans by an incremental ledger of blobs.

Every version of a text is a blob, addressed by the SHA-256 of its UTF-8 bytes, whatever paths (rows) hold it. The ledger keeps for
each blob which rules it has been scanned with, by name and version, and the spans they found. `ingest` takes versions, leaves out the pairs of blob and
rule version that the ledger has, scans the others once for each blob, and returns the ledger's new rows; `locate` joins the
ledger's findings back to every path that holds the blob. A changed rule gets a new version: then its pairs alone are scanned again.

Scale: a task emits a blob it has seen before not again, so copies combine before the shuffle, which moves each blob compressed and
once a task, by digest; the scan streams its partition in digest order and holds one text at a time. The join back moves digests and spans of
blobs that have any; adaptive execution splits it at a hot digest, whose other side is one row. All rules take linear time.

Spans are of whole matches, in code points, end exclusive; matches of a rule are leftmost and don't overlap, those of different
rules may. A text that is not valid Unicode can't occur in a string column.

Defined cases: a null text is the empty blob; repeated rows, null and repeated ids are paths like any other and each gets the blob's
spans; an empty table gives an empty ledger and no rows; other columns are carried by `locate`, whatever their names. Rows that a failed
run appended to the ledger twice count once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import bound_batches, give_back, map_batches, plain, staged, utf8

SPAN = "struct<begin:bigint,rank:int,end:bigint,kind:string,version:int>"
LEDGER = f"digest binary, rules array<string>, spans array<{SPAN}>"
#: Digests a task remembers so as not to emit a blob twice.
SEEN = 1 << 16


class Rule(NamedTuple):
    """A pattern; `group` of a match must have `least` characters. A new version of a rule is scanned anew."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base kinds come first; then what this library adds. A run that is maximal has its length in its pattern.
BASE = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("hub", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~-]+@"),
)


def spans_of(text: str, rules: tuple[tuple[int, Rule, re.Pattern], ...]) -> list[tuple[int, int, int, str, int]]:
    """(begin, rank, end, kind, version) of each span, in that order."""
    return sorted((m.start(), rank, m.end(), rule.kind, rule.version) for rank, rule, pattern in rules for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least)


def digest_of(text: Column | str) -> Column:
    """The blob's address; a null text is the empty blob."""
    return F.unhex(F.sha2(F.coalesce(utf8(text), F.lit(b"")), 256))


def blobs(versions: DataFrame, text: str) -> DataFrame:
    """digest and the compressed blob, a few times at most from each task."""
    seen: set[bytes] = set()  # of a task, since each task gets its own copy

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        pack, digests, packed = zstandard.ZstdCompressor(1).compress, [], []
        for data in batch.column(0).to_pylist():
            digest = hashlib.sha256(data or b"").digest()
            if digest in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
            digests.append(digest)
            packed.append(pack(data or b""))
        return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(packed, pa.binary())], names=["digest", "blob"])

    return map_batches(versions.select(utf8(text).alias("data")), each, "digest binary, blob binary")


def ingest(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows: digest, the rules (name@version) that the blob has now been scanned with for the first time, and their spans."""
    bound_batches(versions.sparkSession)
    found = blobs(versions, text).repartition("digest")
    if ledger is None:
        found = found.withColumn("seen", F.lit(None).cast("array<string>"))
    else:
        known = ledger.select("digest", F.explode("rules").alias("r")).groupBy("digest").agg(F.collect_set("r").alias("seen"))
        found = found.join(known, "digest", "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(rank, rule, re.compile(rule.pattern)) for rank, rule in enumerate(rules)]
        unpack, last = zstandard.ZstdDecompressor().decompress, None
        for batch in batches:
            out = []
            for digest, blob, seen in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                unseen = tuple(c for c in compiled if not seen or c[1].name not in seen)
                if digest != last and unseen:
                    spans = spans_of(unpack(blob).decode(), unseen)
                    out.append((digest, [c[1].name for c in unseen], [dict(zip(("begin", "rank", "end", "kind", "version"), s, strict=True)) for s in spans]))
                last = digest
            span = pa.struct([("begin", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string()), ("version", pa.int32())])
            kinds = (pa.binary(), pa.list_(pa.string()), pa.list_(span))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["digest", "rules", "spans"])
        batch = out = None
        give_back()

    return found.select("digest", "blob", "seen").sortWithinPartitions("digest").mapInArrow(scan, LEDGER)


def locate(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row of versions with `spans`, those that the current version of a rule has found in its blob; the list is empty where there are none. A column named spans is replaced."""
    current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    live = ledger.select("digest", F.filter("spans", lambda s: F.array_contains(current, F.struct(s["kind"].alias("kind"), s["version"].alias("version")))).alias("spans")).filter(F.size("spans") > 0)
    merged = live.groupBy("digest").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"))
    inner, names = plain(versions)
    found = inner.withColumn("digest", digest_of(names[text])).join(merged, "digest", "left")
    kept = [F.col(names[c]).alias(c) for c in versions.columns if c != "spans"]
    return found.select(*kept, F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def update(versions: DataFrame, path: str, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Brings the ledger at `path` up to date with versions and returns `locate` on it. The first call makes the ledger."""
    spark = versions.sparkSession
    spark.createDataFrame([], LEDGER).coalesce(1).write.mode("append").parquet(path)
    staged(ingest(versions, text, spark.read.schema(LEDGER).parquet(path), rules), "ledger").write.mode("append").parquet(path)
    return locate(versions, spark.read.schema(LEDGER).parquet(path), text, rules)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each document, from a ledger that begins empty."""
    paths = docs.select("doc_id", "text")
    found = locate(paths, staged(ingest(paths), "ledger"))
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{r.kind}'))").cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
