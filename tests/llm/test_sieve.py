"""Sieves: bounded filters of keys, and stages that shuffle no text that they leave as it is."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollbook.llm import common, minhash, simhash, substring


@pytest.mark.parametrize("most", [1 << 27, 1 << 15])
def test_sieve_keeps_all_keys_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "SIEVE_MOST", most)
    rows = spark.range(40_000).withColumn("h", F.xxhash64("id"))
    bits = common.sieve(rows.filter("id % 4 = 0").select("h"))
    got = rows.filter(common.held(bits, F.col("h"))).groupBy((F.col("id") % 4 == 0).alias("own")).count().collect()
    count = {x.own: x["count"] for x in got}
    assert count[True] == 10_000 and (count.get(False, 0) < 600 or most == 1 << 15) and len(bits.value) * 8 <= most
    assert rows.filter(common.held(common.sieve(rows.filter("false").select("h")), F.col("h"))).count() == 0


def test_texts_that_stay_are_not_shuffled(spark):
    """Both stages are a union of rows that meet no other and of those that the sieve keeps."""
    r = random.Random(5)
    texts = [" ".join(f"w{r.randint(0, 99999)}" for _ in range(300)) for _ in range(200)]
    texts += [f"{texts[k]} tail" for k in range(5)] + [" ".join(f"v{r.randint(0, 99999)}" for _ in range(100)) + " " + texts[9][:900]]
    docs = common.staged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "docs")
    kept, cut = simhash.keep_one(docs, minhash.near_copies), substring.remove_repeats(docs)
    assert kept.count() == 201 and cut.count() == 206 and sum(x.text not in texts for x in cut.collect()) == 6
    for out in (kept, cut):
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        second = next(k for k, x in enumerate(lines) if x.startswith("+- "))
        branches = ["\n".join(lines[1:second]), "\n".join(lines[second:])]
        assert lines[0].startswith("Union") and any("Relation" in b and "Join" not in b and "Window" not in b for b in branches)


def test_a_full_sieve_changes_nothing(spark, docs, monkeypatch):
    """With a sieve that keeps every row, and with repeated anchors joined, the results are the same."""

    def results():
        near = Counter((x.doc_id, x.text) for x in simhash.keep_one(docs, minhash.near_copies).collect())
        return near, Counter(map(tuple, substring.report(docs).collect())), Counter((x.doc_id, x.text) for x in substring.remove_repeats(docs).collect())

    want = results()
    monkeypatch.setattr(common, "SIEVE_BITS", 0)
    monkeypatch.setattr(common, "SIEVE_MOST", 8)
    monkeypatch.setattr(substring, "ANCHORS", 0)
    assert results() == want
