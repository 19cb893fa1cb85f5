"""Order statistics, the result cache and the observed package against plain versions."""

from __future__ import annotations

import hashlib
import io
import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rollbook.operators import quality, ranks
from rollbook.sources import cache, documents, sinks

NOW = datetime(2024, 1, 2, 12)


@pytest.mark.parametrize("kind", ["normal", "ties", "one", "wild", "tiny"])
@pytest.mark.parametrize("few", [4096, 20])
def test_order_statistics(spark, kind, few, monkeypatch):
    """Unrounded doubles, many ties, a single value, values of all magnitudes; with few values fetched the ranges narrow further."""
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "BINS", 1024 if few > 20 else 7)
    r = random.Random(5)
    make = {"normal": lambda: r.gauss(0, 1), "ties": lambda: r.choice([0.1, 0.1, 0.2, 0.30000000000000004]), "one": lambda: 7.5, "wild": lambda: r.choice([-1, 1]) * 10 ** r.uniform(-300, 300), "tiny": lambda: 1 + r.random() * 1e-13}[kind]
    xs = [make() for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double").repartition(3)
    places = [0, 124, 125, 250, 375, 499]
    assert ranks.order_statistics(df, "x", places) == {k: sorted(xs)[k] for k in places}


def test_no_window_over_all_rows(spark, data):
    from rollbook.plans import queries

    plan = quality.distribution(queries.scored(spark, data))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
    assert quality.quartiles(spark.createDataFrame([], "overall double")).first().n is None
    with pytest.raises(ValueError, match="ranks"):
        ranks.order_statistics(spark.range(3), "id", [3])


def test_kept_rows_equal_a_plain_queue(spark):
    """The oldest go until the rest is within the share; ages in minutes, then by key."""
    r = random.Random(9)
    for n, limit in ((300, 5000), (300, 10**9), (1, 10), (50, 0)):
        rows = [(hashlib.md5(str(i).encode()).hexdigest(), NOW - timedelta(seconds=r.choice([5, 30, 100, 4000, r.randint(0, 80_000)])), r.randint(1, 100)) for i in range(n)]
        queue = sorted(rows, key=lambda x: (x[1].replace(second=0), x[0]))
        total = sum(x[2] for x in rows)
        if total > limit:
            while queue and total > 0.8 * limit:
                total -= queue.pop(0)[2]
        got = cache.kept(spark.createDataFrame(rows, "key string, stored_at timestamp, bytes long"), limit).select("key").collect()
        assert sorted(x.key for x in got) == sorted(x[0] for x in queue)


def test_only_new_files_are_read(spark, tmp_path):
    """A second run reads what is new; a copy under another name isn't; after a day everything is read again."""
    (tmp_path / "in").mkdir()
    reads = spark.sparkContext.accumulator(0)

    def reader(content: bytes) -> dict:
        reads.add(1)
        return {"text": content.decode("latin-1")}

    def run(now: datetime) -> dict[str, str]:
        files = documents.checked_files(spark, f"file://{tmp_path}/in")
        return {r.path.rsplit("/", 1)[1]: r.text for r in cache.extracted(files, f"file://{tmp_path}/cache", now, readers={"pdf": reader}).collect()}

    for name, body in (("a.pdf", b"%PDF a"), ("b.pdf", b"%PDF b"), ("copy.pdf", b"%PDF a"), ("c.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(body)
    first = run(NOW)
    assert first == {"a.pdf": "%PDF a", "b.pdf": "%PDF b", "copy.pdf": "%PDF a", "c.txt": ""} and reads.value == 2
    (tmp_path / "in/d.pdf").write_bytes(b"%PDF d")
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF changed")
    second = run(NOW + timedelta(hours=1))
    assert second == first | {"d.pdf": "%PDF d", "a.pdf": "%PDF changed"} and reads.value == 4
    assert run(NOW + timedelta(hours=2)) == second and reads.value == 4
    assert run(NOW + timedelta(hours=26)) == second and reads.value == 8


def test_eviction(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    kinds = spark.createDataFrame([], cache.CACHE).schema["result"].dataType
    rows = spark.range(40).select(F.md5(F.col("id").cast("string")).alias("key"), (F.lit(NOW) - F.make_interval(mins=F.col("id"))).alias("stored_at"), F.lit(100).cast("long").alias("bytes"), F.lit(None).cast(kinds).alias("result"))
    rows.withColumn("g", F.lit(0)).write.partitionBy("g").parquet(path)
    assert cache.evict(spark, path, NOW, limit=10_000) == 0 and cache.last_generation(spark, path)[1] == 0
    assert cache.evict(spark, path, NOW, limit=2000) == 24 and cache.last_generation(spark, path)[1] == 1
    assert sorted(r.stored_at for r in cache.last_generation(spark, path)[0].collect()) == [NOW - timedelta(minutes=i) for i in range(15, -1, -1)]
    assert cache.evict(spark, path, NOW, limit=2000) == 0


def test_the_package_computes_records_once(spark, data, tmp_path):
    from rollbook.plans import queries

    calls = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    plain = queries.scored(spark, data).filter("record_id < 50").withColumn("flagged", F.col("record_id") % 5 == 0)
    s = plain.mapInArrow(through, plain.schema)
    report = spark.createDataFrame([("totals", "{}")], "part string, body string")
    with zipfile.ZipFile(io.BytesIO(sinks.complete_package(s, f"file://{tmp_path}/out", report, NOW))) as z:
        about = json.loads(z.read("metadata.json"))
    assert calls.value == 50 and about["total_records"] == 50 and about["processing_timestamp"] == NOW.isoformat() and about["processing_time"] > 0
    assert about["average_confidence"] == pytest.approx(plain.agg(F.avg("overall")).first()[0]) and about["flagged_records_count"] == plain.filter("flagged").count() == spark.read.option("header", True).csv(f"file://{tmp_path}/out/flagged_records").count()
