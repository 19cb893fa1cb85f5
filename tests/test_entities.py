"""Sentences, tokens and the model of entities: rules by example, Viterbi and training against plain versions, held-out accuracy."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollbook.functions import sentences, text
from rollbook.operators import entities as E
from rollbook.sources import fixtures

TEXTS = {
    "One. Two! Three?": ["One.", "Two!", "Three?"],
    "Dr. Brown met Mr. Green. They spoke.": ["Dr. Brown met Mr. Green.", "They spoke."],
    "No. 5 High St. Town is let. 3 rooms.": ["No. 5 High St. Town is let.", "3 rooms."],
    "a line\nanother line \n\n third": ["a line", "another line", "third"],
    'He said "Stop." (Then he left.)': ['He said "Stop." (Then he left.)'],
    "version 1.5 is out. it works": ["version 1.5 is out. it works"],
    " \n ": [], "": [], "Élan! Évian.": ["Élan!", "Évian."],
}


def test_sentences_and_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "t string")
    out = {r.t: (r.s, r.k) for r in df.select("t", sentences.sentences(F.col("t")).alias("s"), sentences.tokens(F.col("t")).alias("k")).collect()}
    assert {t: s for t, (s, _) in out.items() if t is not None} == TEXTS and out[None] == (None, None)
    assert all(k == E._TOKEN.findall(t) for t, (_, k) in out.items() if t is not None)
    assert E._TOKEN.findall("Jo O'Connor's 12/03/2024, £5 (re-let).") == ["Jo", "O'Connor's", "12/03/2024", ",", "£", "5", "(", "re-let", ")", "."]


def test_the_two_splitters_agree(spark, data):
    """The column's sentences and those that tagging walks through, on real texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("text", sentences.sentences(F.col("text")).alias("s")).collect()
    for r in docs:
        assert [x for x in (s.strip(" \t\n\x0b\f\r") for s in E._BREAK.split(r.text or "")) if x] == (r.s or [])


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(2)
    m = E.Model(r.normal(size=(1 << E.BITS, 7)), r.normal(size=(8, 7)) * 3)
    for words in (["One"], ["Mary", "Jones", "of"], ["The", "Kent", "County", "Council", "."]):
        found = E.features(words)
        scores = m.weights[found].sum(axis=1)
        best = max(itertools.product(range(7), repeat=len(words)), key=lambda p: scores[range(len(words)), p].sum() + m.steps[(7, *p[:-1]), p].sum())
        assert m.tags(found) == list(best)


def test_gold_and_variations():
    words = E._TOKEN.findall("HMO Manager: Jo Green, Kent County Council")
    tags = E.gold(words, [("PERSON", "Jo Green"), ("ORG", "Kent County Council"), ("GPE", "Kent")])
    assert tags == [0, 0, 0, 1, 2, 0, 3, 4, 4]
    for nth in range(20):
        w, t = E.variation(words, tags, nth)
        assert [k for k in t if k] == [1, 2, 3, 4, 4] and (w, t) == E.variation(words, tags, nth) and w[t.index(3) + 1 : t.index(3) + 3] == ["County", "Council"] and len(w) == len(t)


@pytest.fixture(scope="module")
def licence(spark, data):
    return fixtures.licence_documents(fixtures.licence_records(spark, data)).cache()


@pytest.fixture(scope="module")
def examples(licence):
    return E.training(licence.filter("doc % 4 <> 2")).cache()


def test_training_equals_one_machine(examples):
    """Parameter mixing over Spark's shards and in one loop: the same weights, however the rows are dealt."""
    rows = sorted((r.shard, r.h, r.sentence, [(x.label, x.text) for x in r.labels]) for r in examples.collect())
    copies = E.copies_of(examples)
    model, total = E.Model.empty(), E.Model.empty()
    for k in range(2):
        changes = [E.one_pass(model, ((s, labels) for shard, _, s, labels in rows if shard == n), copies, k) for n in range(E.SHARDS)]
        for name in ("weights", "steps"):
            parts = np.array([getattr(c, name) for c in changes])
            touched = np.maximum(1, parts.any(axis=2).sum(axis=0))[:, None]
            getattr(model, name)[:] += parts.sum(axis=0) / touched
        total = E.Model(total.weights + model.weights, total.steps + model.steps)
    spread = E.train(examples.repartition(7), rounds=2)
    assert np.array_equal(spread.weights, total.weights / 2) and np.array_equal(spread.steps, total.steps / 2)


def test_held_out_accuracy_and_spans(spark, licence, examples):
    model = E.train(examples)
    held = licence.filter("doc % 4 = 2")
    found = E.tagged(held, model, "doc").join(held, "doc")
    f1 = {r.label: r.f1 for r in E.scores(found, "doc").collect()}
    assert set(f1) == {"PERSON", "ORG", "GPE"} and min(f1.values()) > 0.95
    for r in found.collect():
        assert all(r.text[e.begin : e.end] == e.text for e in r.entities)
    prose = "Owner: Peter Green\nHe wrote to the Kent County Council. The house stands at 12 High Street, Manchester"
    rows = spark.createDataFrame([(1, prose), (2, None), (3, ""), (1, prose), (None, " \n ")], "k int, text string")
    out = E.tagged(rows, model, "k").collect()
    assert len(out) == 5 and sorted(len(r.entities) for r in out)[:3] == [0, 0, 0] and out[0].entities == out[3].entities
    said = {(e.label, e.text) for e in out[0].entities}
    assert ("PERSON", "Peter Green") in said and ("GPE", "Manchester") in said and any(label == "ORG" and t.endswith("Council") for label, t in said)
    lists = E.tagged(rows, model, "k").filter("k = 1").select(text.person_names(F.col("entities")).alias("p"), E.places(F.col("entities")).alias("g")).first()
    assert lists.p == ["Peter Green"] and [(g.text, g.confidence) for g in lists.g] == [("Manchester", 0.7)]
    assert E.tagged(rows.filter("false"), model, "k").count() == 0


def test_long_texts_are_linear():
    model = E.Model.empty()
    r = random.Random(1)
    long = " ".join(r.choice(["word", "Word.", "12,5", "x"]) for _ in range(100_000))
    assert E.spans_of(long, model) == []


def test_a_sentence_is_tagged_once(monkeypatch):
    """Forms repeat their lines: equal sentences have equal tags, wherever they stand."""
    r = np.random.default_rng(5)
    model = E.Model(r.normal(size=(1 << E.BITS, 7)), r.normal(size=(8, 7)))
    calls = []
    monkeypatch.setattr(E.Model, "tags", lambda self, found, of=E.Model.tags: calls.append(len(found)) or of(self, found))
    one = "Manager: Jo Green\nKent County Council\n"
    alone, many = E.spans_of(one, model), E.spans_of("  " + one * 50, model)
    assert alone and many[: len(alone)] != alone and len(calls) <= 2 + 3
    assert [(k, t, a - 2, b - 2) for k, t, a, b in many[-len(alone) :]] == [(k, t, a + 49 * len(one), b + 49 * len(one)) for k, t, a, b in alone]


def test_training_takes_every_sentence(spark):
    """More sentences than were once taken, and a long one."""
    docs = spark.range(0, 21_000, 100).select(F.array_join(F.transform(F.sequence("id", F.col("id") + 99), lambda k: F.concat(F.lit("Reference: HMO"), k.cast("string"))), "\n").alias("text"))
    long = spark.createDataFrame([("word " * 600 + "end",)], "text string")
    assert E.training(docs.union(long).union(docs)).count() == 21_001


def test_the_query_trains_on_all_documents(spark, data, monkeypatch):
    from rollbook.plans import queries

    seen = []
    monkeypatch.setattr(E, "training", lambda docs: seen.append(docs.count()))
    monkeypatch.setattr(E, "train", lambda examples: E.Model.empty())
    assert queries.x11_entities(spark, data).filter("source = 'licence'").count() == seen[0] == fixtures.licence_documents(fixtures.licence_records(spark, data)).count()


def test_blocks_equal_one_by_one():
    """Features, tags and a pass by blocks against those of single sentences, whatever the sizes."""
    r, g = random.Random(3), np.random.default_rng(3)
    word = lambda: r.choice(["HMO", "Town", "Élan", "O'Connor", "ªº", "12/3", "x" * 30 + "Y1", ":", str(r.randrange(999)), "Street", ","])
    many = [[word() for _ in range(r.choice([1, 2, 3, 5, 40]))] for _ in range(700)]
    words = E.Words()
    words.most = 50
    found = [E.features(w) for w in many]
    assert np.array_equal(np.concatenate(found), np.concatenate([words.features(some) for some in E.parts(many, 200)]))
    for m in (E.Model(g.normal(size=(1 << E.BITS, 7)), g.normal(size=(8, 7))), E.Model(g.integers(-1, 2, (1 << E.BITS, 7)) * 1.0, g.integers(-1, 2, (8, 7)) * 1.0)):
        assert [t for f in found for t in m.tags(f)] == m.tags_of(np.concatenate(found), np.array([len(w) for w in many])).tolist()
    examples = [(" ".join(w), [("GPE", "Town")] if "Town" in w else [("PERSON", "O'Connor")] if "O'Connor" in w else []) for w in many]
    start, copies = E.Model(g.normal(size=(1 << E.BITS, 7)), g.normal(size=(8, 7))), {"GPE": 1, "PERSON": 2}
    now, change = E.Model(start.weights.copy(), start.steps.copy()), E.Model.empty()
    for words_, right in (x for e in examples for x in E._examples(*e, copies, 1)):
        f, said = E.features(words_), now.tags(E.features(words_))
        if said != right:
            for m in (now, change):
                for tags, sign in ((right, 1.0), (said, -1.0)):
                    np.add.at(m.weights, (f, np.array(tags)[:, None]), sign)
                    np.add.at(m.steps, ([len(E.TAGS), *tags[:-1]], tags), sign)
    out = E.one_pass(start, iter(examples), copies, 1)
    assert np.array_equal(out.weights, change.weights) and np.array_equal(out.steps, change.steps)


def test_addresses_are_counted_as_found(spark):
    r = random.Random(4)
    part = lambda: r.choice(["St", "street", "ROAD", "Rd", " ", "\n", "12", "7 ", "Oak ", ", ", "a", "way", "Placeclose", "ſt", "é"])
    rows = [("".join(part() for _ in range(r.randint(0, 25))),) for _ in range(1500)]
    d = spark.createDataFrame(rows, "t string").select(text.address_count(F.col("t")).alias("n"), F.size(F.filter(text.entities(F.col("t")), lambda e: e["label"] == "ADDRESS")).alias("m"))
    assert d.filter("n <> m").count() == 0 and d.agg(F.sum("n")).first()[0] > 1000
    long = spark.range(1).select(F.repeat(F.lit("of the and on "), 40_000).alias("t"))
    assert long.select(text.address_count(F.col("t"))).first()[0] == 0


def test_lines_first_splits_the_same():
    r = random.Random(6)
    for _ in range(20_000):
        t = "".join(r.choice(["Mr", "St", ".", "!", "?", " ", "\t", "\n", "\r", "\x0b", "A", "b", "(", "\x85"]) for _ in range(r.randint(0, 14)))
        out, at = [], 0
        for m in E._BREAK.finditer(t):
            out.append((t[at : m.start()], at))
            at = m.end()
        assert E._split(t) == [*out, (t[at:], at)]
