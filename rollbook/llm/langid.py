"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: letters lower-cased, runs of anything else one space; 1- to 3-grams of code points hashed to BUCKETS; term frequency
is 1 + ln of the count, inverse document frequency is counted over all training texts, and each text has Euclidean length 1. Training: multinomial
logistic loss, follow-the-regularised-leader with per-coordinate rates and elastic-net (L1 and L2) penalties; then a temperature
that minimises the loss on a part of the sample that training did not see.

The fit takes a stratified sample of SAMPLE distinct labelled texts, drawn by a hash of the text with the same share for each
language (all texts of languages that have fewer); document frequencies cover all training texts; prediction reads every text whole.

Scale: two maps over the texts and small aggregates; no text is shuffled. What is broadcast is BUCKETS x languages weights; what
is collected is the sample's sparse features, bounded by SAMPLE x BUCKETS whatever the texts' length.

Defined cases: null texts and texts without a letter are `und` with score 0, and so is every text if nothing can be learnt; rows
with null lang teach nothing; null ids belong to the fold of the empty text's crc32; repeated rows are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import give_back, id_crc, map_batches, once, plain

BUCKETS, GRAMS = 1 << 16, 3
SAMPLE, EPOCHS = 4000, 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
UNKNOWN = "und"
#: The pipeline rejects texts without a language, or with less than this probability for the best one.
LEAST_SCORE = 0.3
_PART = 1 << 18
_alpha: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _alpha:
        _alpha.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _alpha[0]


def code_points(text: str | None) -> np.ndarray:
    """Lower-case letters, with one space for each run of others; empty if there is no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.uint32)
    points = np.where(letter, points, np.uint32(32))
    return points[letter | np.concatenate([[True], letter[:-1]])]


def buckets(points: np.ndarray) -> list[np.ndarray]:
    """Buckets of the n-grams of each length."""
    wide = points.astype(np.uint64)
    out, h = [], np.zeros(len(wide), np.uint64)
    for n in range(1, GRAMS + 1):
        if len(wide) < n:
            break
        h = (h[: len(wide) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + wide[n - 1 :] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        out.append((h >> np.uint64(8) & np.uint64(BUCKETS - 1)).astype(np.int64))
    return out


def _parts(points: np.ndarray):
    """Buckets of a text in pieces that overlap so that each n-gram comes once."""
    for at in range(0, max(1, len(points)), _PART):
        for found in buckets(points[at : at + _PART + GRAMS - 1]):
            yield found[:_PART]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams, rising, and how often each occurs."""
    points = code_points(text)
    if len(points) <= _PART:
        found = buckets(points)
        return np.unique(np.concatenate(found).astype(np.uint16) if found else np.empty(0, np.uint16), return_counts=True)
    total = np.zeros(BUCKETS, np.int64)
    for found in _parts(points):
        total += np.bincount(found, minlength=BUCKETS)
    index = np.flatnonzero(total)
    return index, total[index]


def tf_idf(index: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[index]
    return value / np.sqrt(value @ value)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS and a bias x languages
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        index, count = counts(text)
        if not len(index) or not self.langs:
            return UNKNOWN, 0.0
        share = probabilities((tf_idf(index, count, self.idf) @ self.weights[index] + self.weights[-1]) / self.temperature)
        best = int(share.argmax())
        return self.langs[best], float(share[best])


def probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def follow_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> np.ndarray:
    """Weights, the last row being the bias, of FTRL-proximal on rows of (buckets, values, class)."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for index, value, label in rows:
            w = weights(index)
            error = probabilities(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    return weights(np.arange(BUCKETS + 1))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least mean negative log-likelihood, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        return -np.log(np.maximum(probabilities(logits / np.exp(log_t))[np.arange(len(labels)), labels], 1e-300)).mean()

    if not len(labels):
        return 1.0
    a, b, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of the texts each bucket occurs."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(BUCKETS, np.int64)
        for text in batch.column(0).to_pylist():
            total[counts(text)[0]] += 1
        at = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    found = map_batches(texts.select("text"), each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def train(docs: DataFrame, training: Column) -> Model:
    """The model of the rows of docs for which `training` holds and lang is known."""
    rows = docs.select("doc_id", "text", "lang", training.alias("training")).filter("training and lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    total = sum(sizes.values())
    idf = np.log((1 + total) / (1 + document_frequencies(rows))) + 1

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        index, count = [], []
        for text in batch.column(1).to_pylist():
            own, n = counts(text)
            index.append(own.astype(np.int64))
            count.append(n)
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(index, kind), pa.array(count, kind)], names=["draw", "lang", "index", "count"])

    draw = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 30))
    share = {lang: min(1.0, SAMPLE / len(langs) / n) for lang, n in sizes.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, int(share[lang] * (1 << 30)))]), F.col("lang"))
    sample = map_batches(rows.select(draw.alias("draw"), "text", "lang").filter(F.col("draw") < limit).dropDuplicates(["lang", "text"]), features, "draw long, lang string, index array<long>, count array<long>")
    data, labels = [], []
    found = sample.toArrow()  # as rows it would take some hundred MB of the driver's memory
    keys = list(zip(found.column("draw").to_pylist(), found.column("lang").to_pylist(), strict=True))
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        index, count = (found.column(c)[i].values.to_numpy() for c in ("index", "count"))
        if len(index):
            data.append((np.append(index, BUCKETS), np.append(tf_idf(index, count.astype(float), idf), 1.0)))
            labels.append(langs.index(keys[i][1]))
    del found
    if not data:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    held = [i for i in range(len(data)) if i % 5 == 4]
    fit = [(*data[i], labels[i]) for i in range(len(data)) if i % 5 != 4]
    w = follow_leader(fit, len(langs))
    temperature = best_temperature(np.array([data[i][1] @ w[data[i][0]] for i in held]).reshape(-1, len(langs)), np.array([labels[i] for i in held], int))
    return Model(langs, idf, w, temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its columns named c0, c1 ... by place, lang_pred and score."""
    give_back()  # what training took of the driver
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner, names = plain(docs)
    k = docs.columns.index("text")
    rows = inner.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = once(shared, _same)
        found = [own.predict(t) for t in batch.column(k).to_pylist()]
        made = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=batch.schema.names)

    return map_batches(rows, each, rows.schema)


def _same(model: Model) -> Model:
    return model


def is_training(doc_id: str = "doc_id") -> Column:
    return id_crc(doc_id) % 4 != 2


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row; learns from the rows that are not held out."""
    model = train(docs, is_training())
    found = predict(docs.select("doc_id", "text", (~is_training()).alias("held_out")), model)
    return found.select(F.col("c0").alias("doc_id"), F.col("c2").alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """docs without the texts that have no language, or none with at least LEAST_SCORE."""
    inner, _ = plain(docs)
    found = predict(docs, train(docs.select("doc_id", "text", "lang"), is_training()))
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*inner.columns).toDF(*docs.columns)
