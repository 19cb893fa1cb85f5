"""Sharding and media columns against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import media, queries, sharding


@pytest.mark.parametrize("ranges", [1024, 4])
def test_shards_equal_brute_force(docs, rows, none, ranges, monkeypatch):
    monkeypatch.setattr(sharding, "RANGES", ranges)
    out = sharding.report(docs).collect()
    keyed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), -(1 << 63) if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    total, run, want, slots = sum(k[2] for k in keyed), 0, Counter(), Counter()
    for _, i, size, crc in keyed:
        shard = (run + size // 2) * 8 // total
        run += size
        want[None if i == -(1 << 63) else i, size, crc, "bytes", shard, slots[shard], None] += 1
        slots[shard] += 1
    assert Counter(map(tuple, out)) == want and sharding.report(none).count() == 0


def test_shards_are_even(spark):
    rows = queries.op5_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    sizes = [r["sum(size)"] for r in rows]
    assert sorted(r.shard for r in rows) == list(range(8)) and all(r["max(slot)"] == r["count(1)"] - 1 for r in rows)
    assert max(sizes) - min(sizes) < 0.05 * sum(sizes) / 8


def test_a_hot_text_is_split(spark):
    d = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 > 0 then 'the same text' else cast(id as string) end as text", "1 as h", "2 as r")
    sizes = [r["sum(size)"] for r in sharding.report(d).groupBy("shard").sum("size").collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 28


def test_ranges_are_even_in_rows(spark, monkeypatch):
    """Half of the texts empty, a third of the rows the same: no range has many times its share of the rows."""
    monkeypatch.setattr(sharding, "RANGES", 64)
    monkeypatch.setattr(sharding, "SAMPLE", 4096)
    d = spark.range(24000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "case when id % 2 = 0 or id % 3 = 0 then '' else repeat(cast(id as string), 40) end as text")
    keys = sharding.staged(sharding.keyed(d), "keys")
    total, n = keys.groupBy().sum("size").first()[0], keys.count()
    boundaries, sizes = sharding.split(keys, total, n)
    assert max(r for _, r in sizes.values()) < 5 * n / 64 and max(b for b, _ in sizes.values()) < 5 * total / 64 and len(boundaries) < 200
    out = sharding.report(d).groupBy("shard").agg({"size": "sum", "slot": "max", "*": "count"}).collect()
    assert sum(r["count(1)"] for r in out) == n and all(r["max(slot)"] == r["count(1)"] - 1 for r in out)


def test_media_round_trip(docs, rows, none):
    out = media.report(docs).collect()
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media.to_png(p)).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256) for r in out) == want
    by_text: dict[str, set] = {}
    for r in out:
        by_text.setdefault(r.payload_sha256, set()).add((r.feature, r.media_bytes, r.media_sha256))
    assert all(len(v) == 1 for v in by_text.values()) and media.report(none).count() == 0


def test_png_is_whole_and_damage_is_seen():
    payload = bytes(range(256)) * 3
    png = media.to_png(payload)
    assert media.from_png(png).tobytes() == payload
    with pytest.raises(ValueError):
        media.from_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(ValueError):
        media.from_png(b"nothing")
    assert media.feature_of(np.zeros((1, 64), np.uint8)).startswith("mean=0.0000;std=0.0000;entropy=0.0000")


def test_sequences_keep_places_and_captions(spark):
    digest = "ab" * 32
    page = f"<title>no</title><p>First &amp; <b>bold</b></p><figure><img src='media:sha256/{digest}' alt=x><figcaption>The  caption</figcaption></figure>after<img src='plain.png' alt='alt text'><img><script>x</script>"
    items = media.items_of(page)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["digest"], i["caption"]) for i in items] == [
        (0, "text", "First & bold", None, None, None),
        (1, "media", None, f"media:sha256/{digest}", digest, "The caption"),
        (2, "text", "after", None, None, None),
        (3, "media", None, "plain.png", None, "alt text"),
    ]
    pages = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "")], "page_id long, html string")
    known = spark.createDataFrame([(digest, 7)], "digest string, payload int")
    out = media.resolved(media.sequences(pages, "page_id"), "page_id", known).collect()
    assert Counter((r.page_id, r.position, r.payload) for r in out) == Counter({(1, 0, None): 2, (1, 1, 7): 2, (1, 2, None): 2, (1, 3, None): 2})
