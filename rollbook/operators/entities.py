"""Named entities by a model (X11, and with it the places of X14 and the persons of X15): a linear-chain perceptron.

The model learns from weak labels: the names after a manager's or holder's heading (X8), councils (X12), towns after a street (X14). It is a structured perceptron
over hashed features of a token and its neighbours and over pairs of tags, decoded by Viterbi. Training is iterative parameter
mixing: in each round every shard of the training sentences makes one pass from the shared weights, and a feature's changes are averaged over
the shards that have any. A shard is streamed in a fixed order, so the weights depend on the sentences alone and not on how Spark deals them.
So that few names teach more than themselves, a labelled sentence is followed by variations: made-up words for its entities' words and
around them, other headings.

Scale: training takes every distinct sentence. Their features are kept for all rounds, and a pass goes by blocks: it tags a block with the
weights that it has, and up to the first wrong sentence these are the tags that one by one would give. What is collected and broadcast is
one row for each hashed feature, 2^BITS at most. Shards are SHARDS, and more where they would be of more than PART sentences. Tagging is a map over the documents.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.functions import confidence, text as rules
from rollbook.functions.sentences import BREAK, LETTER, TOKEN, sentences

FEATURE = np.uint16  # of BITS bits
TAGS = ("O", "B-PERSON", "I-PERSON", "B-ORG", "I-ORG", "B-GPE", "I-GPE")
SHARDS, PART, ROUNDS, BITS = 8, 1 << 21, 6, 16
#: Tokens whose features are made at once, about; sentences that a pass tags at once, after a wrong one and at most.
TOKENS, BLOCKS = 1 << 16, (16, 4096)
#: Characters of the texts whose sentences are tagged together, about.
CHARACTERS = 1 << 21
_TOKEN, _BREAK, _CASE, _FEEDS = re.compile(TOKEN), re.compile(BREAK), re.compile(f"[{LETTER}]"), re.compile(r"\n[ \t\n\x0b\f\r]*")
#: Variations of a sentence at most; words that name a body, which stay; the headings of names (X8), of which one stands for another.
COPIES = 64
HEADINGS = ("manager", "holder", "owner", "landlord", "contact", "name", "person")
BODIES = {"council", "authority", "borough", "county", "city", "district", "town"}
ENTITY = "array<struct<label:string,text:string,begin:int,end:int,confidence:double>>"
#: Weak labels: patterns whose first group is an entity of the label.
WEAK = (
    ("PERSON", rules.NAMES[0]), ("PERSON", rules.NAMES[1]),
    ("ORG", r"((?:[A-Z][\w'&-]*\s+){1,5}(?:Council|Authority))\b"),
    ("GPE", rf"(?:{'|'.join(s.capitalize() for s in rules.SUFFIXES)})\s*,\s*([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"),
)


def weak_labels(sentence: Column) -> Column:
    """(label, text) of what the weak rules find in a sentence; names must look like names."""
    def made(label: str, pattern: str) -> Column:
        found = rules.find_all(sentence, pattern)
        return F.transform(F.filter(found, rules.is_name) if label == "PERSON" else found, lambda t: F.struct(F.lit(label).alias("label"), t.alias("text")))

    return F.array_distinct(F.concat(*[made(*w) for w in WEAK]))


def training(docs: DataFrame, text: str = "text") -> DataFrame:
    """shard, h, sentence and its weak labels: all distinct sentences."""
    s = docs.select(F.explode(sentences(F.col(text))).alias("sentence")).distinct().withColumn("h", F.xxhash64("sentence"))
    return s.select(F.pmod(F.col("h"), F.lit(SHARDS)).cast("int").alias("shard"), "h", "sentence", weak_labels(F.col("sentence")).alias("labels"))


class _Hash(dict):
    """The hashed feature of a kind and a word, remembered."""

    def __missing__(self, key: tuple[str, str]) -> int:
        if len(self) > 1 << 17:
            self.clear()
        out = self[key] = zlib.crc32(f"{key[0]}|{key[1]}".encode()) >> (32 - BITS)
        return out


_HASH = _Hash()


class _Kinds(dict):
    """A character's code point to A, a or 9, if it is a capital, small letter or digit."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = self[point] = "A" if c.isupper() else "a" if c.islower() else "9" if c.isdigit() else c
        return out


_KINDS, _RUNS = _Kinds(), re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    """Capitals, small letters and digits as A, a and 9, each run once."""
    return _RUNS.sub(r"\1", word[:12].translate(_KINDS))


def features(words: list[str]) -> np.ndarray:
    """The hashed features of each word, a row each."""
    low = ["<s>", *(w.lower() for w in words), "</s>"]
    shapes = ["<", *map(_shape, words), ">"]
    h = _HASH
    return np.array([[h["w", low[i]], h["s", shapes[i]], h["p", low[i][:3]], h["q", low[i][-3:]], h["l", low[i - 1]], h["m", shapes[i - 1]], h["r", low[i + 1]], h["t", shapes[i + 1]], h["a", f"{shapes[i - 1]} {shapes[i]}"], h["b", f"{shapes[i]} {shapes[i + 1]}"], h["c", f"{low[i - 2] if i > 1 else ''} {low[i - 1]}"], h["f", str(min(i, 3))]] for i in range(1, len(words) + 1)], np.int64).reshape(len(words), 12)


class Words(dict):
    """Numbers of words, by which the features of many sentences are made at once: for each word what its neighbours don't change."""

    most = 1 << 17

    def __init__(self) -> None:
        super().__init__()
        self.begin()

    def begin(self) -> None:
        self.clear()
        self.low, self.new, self.shapes, self.known = [], [], {}, np.empty((0, 9), np.int32)
        for low, shape in (("", ""), ("<s>", "<"), ("</s>", ">")):  # what stands around a sentence
            self.add(low, shape)

    def add(self, low: str, shape: str) -> int:
        h, crc, shift = _HASH, zlib.crc32, 32 - BITS
        word = low.encode()
        self.new.append((crc(b"w|" + word) >> shift, h["s", shape], h["p", low[:3]], h["q", low[-3:]], crc(b"l|" + word) >> shift, h["m", shape], crc(b"r|" + word) >> shift, h["t", shape], self.shapes.setdefault(shape, len(self.shapes))))
        self.low.append(low)
        return len(self.low) - 1

    def __missing__(self, word: str) -> int:
        out = self[word] = self.add(word.lower(), _shape(word))
        return out

    def features(self, many: list[list[str]]) -> np.ndarray:
        """`features` of each of these sentences, one below the other."""
        if len(self) > self.most:
            self.begin()
        ids: list[int] = []
        for words in many:
            ids += (0, 1)
            ids += map(self.__getitem__, words)
            ids.append(2)
        if self.new:
            self.known, self.new = np.concatenate([self.known, np.array(self.new, np.int32)]), []
        n = np.array([len(words) for words in many], np.int64)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.arange(n.sum()) + np.repeat(3 * np.arange(len(n)) + 2, n)
        ids = np.array(ids, np.int64)
        word, left, right, second = ids[at], ids[at - 1], ids[at + 1], ids[at - 2]
        shape, shapes, low, k = self.known[:, 8].astype(np.int64), list(self.shapes), self.low, self.known

        def pairs(kind: str, a: np.ndarray, b: np.ndarray, names: list[str]) -> np.ndarray:
            some, which = np.unique(a * len(names) + b, return_inverse=True)
            return np.array([_HASH[kind, f"{names[x // len(names)]} {names[x % len(names)]}"] for x in some.tolist()], np.int32)[which]

        out = np.empty((len(at), 12), FEATURE)
        out[:, :4] = k[word, :4]
        out[:, 4:6], out[:, 6:8] = k[left, 4:6], k[right, 6:8]
        out[:, 8], out[:, 9] = pairs("a", shape[left], shape[word], shapes), pairs("b", shape[word], shape[right], shapes)
        out[:, 10] = pairs("c", second, left, low)
        out[:, 11] = np.array([_HASH["f", str(i)] for i in (1, 2, 3)], np.int32)[np.minimum(nth, 2)]
        return out


def parts(many: Iterable, size: int, length: Callable = len) -> Iterator[list]:
    """The items in turn, in groups of about so much length."""
    some: list = []
    held = 0
    for one in many:
        some.append(one)
        held += length(one)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


class Model(NamedTuple):
    """weights: of features and tags; steps: of pairs of tags, the last row for a sentence's first."""

    weights: np.ndarray
    steps: np.ndarray

    @classmethod
    def empty(cls) -> Model:
        return cls(np.zeros((1 << BITS, len(TAGS))), np.zeros((len(TAGS) + 1, len(TAGS))))

    def tags(self, found: np.ndarray) -> list[int]:
        """The best tags of a sentence (Viterbi); of equal ones the first."""
        scores = self.weights[found].sum(axis=1)
        best, back = scores[0] + self.steps[-1], []
        for row in scores[1:]:
            paths = best[:, None] + self.steps[:-1]
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + row
        out = [int(best.argmax())]
        for came in reversed(back):
            out.append(int(came[out[-1]]))
        return out[::-1]

    def tags_of(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """`tags` of many sentences, of n tokens (one at least) each, one below the other: the same sums in the same order."""
        scores = self.weights[found[:, 0]]
        for k in range(1, found.shape[1]):
            scores += self.weights[found[:, k]]
        order = np.argsort(-n, kind="stable")
        first, longest = (np.cumsum(n) - n)[order], int(n.max())
        active = np.searchsorted(-n[order], -np.arange(longest), side="left")  # sentences that have an nth token
        best = scores[first] + self.steps[-1]
        back = np.zeros(scores.shape, np.int8)
        for nth in range(1, longest):
            now = first[: active[nth]]
            came = best[: len(now)]
            most, which = came[:, :1] + self.steps[0], np.zeros((len(now), len(TAGS)), np.int8)
            for tag in range(1, len(TAGS)):
                path = came[:, tag : tag + 1] + self.steps[tag]
                which[path > most] = tag
                np.maximum(most, path, out=most)
            back[now + nth] = which
            best[: len(now)] = most + scores[now + nth]
        tag, out = best.argmax(axis=1), np.empty(len(found), np.int8)
        for nth in range(longest - 1, -1, -1):
            now = first[: active[nth]] + nth
            here = tag[: len(now)]
            out[now] = here
            tag[: len(now)] = back[now, here] if nth else here
        return out


def gold(words: list[str], labels: list[tuple[str, str]]) -> list[int]:
    """The tags that labelled texts mean for a sentence's words; where two claim a word the first has it."""
    out = [0] * len(words)
    for label, text in labels:
        parts = _TOKEN.findall(text)
        for i in range(len(words) - len(parts) + 1 if parts else 0):
            if words[i : i + len(parts)] == parts and not any(out[i : i + len(parts)]):
                first = TAGS.index(f"B-{label}")
                out[i : i + len(parts)] = [first] + [first + 1] * (len(parts) - 1)
    return out


def variation(words: list[str], tags: list[int], nth: int) -> tuple[list[str], list[int]]:
    """The nth variation of a sentence, always the same: other words for those of entities, but for what names a body, other headings and streets, more words around."""
    chance = random.Random(zlib.crc32(f"{nth} {' '.join(words)}".encode()))
    word = lambda: "".join(chance.choice("bcdfghlmnprstvw") + chance.choice("aeiou") for _ in range(chance.randint(1, 3))) + chance.choice(["", "n", "s", "l"])
    out, marks = [], []
    for i in range(chance.randint(0, 5)):
        out.append(word().capitalize() if i == 0 else word())
        marks.append(0)
    for w, tag in zip(words, tags, strict=True):
        low = w.lower()
        if tag and low not in BODIES and w[:1].isupper():
            w = word().capitalize()
        elif not tag and low in HEADINGS:
            w = chance.choice(HEADINGS).capitalize()
        elif not tag and low in rules.SUFFIXES:
            w = chance.choice(rules.SUFFIXES).capitalize()
        out.append(w)
        marks.append(tag)
    for _ in range(chance.randint(0, 3)):
        out.append(word())
        marks.append(0)
    return out, marks


def _examples(sentence: str, labels: list[tuple[str, str]], copies: dict[str, int], nth_round: int) -> Iterator[tuple[list[str], list[int]]]:
    words = _TOKEN.findall(sentence)
    if words:
        tags = gold(words, labels)
        yield words, tags
        for nth in range(max((copies.get(label, 1) for label, _ in labels), default=0)):
            yield variation(words, tags, nth_round * COPIES + nth)  # new words each round, so that none is learned by heart


class _Pass:
    """A perceptron's pass over sentences, in their order: the changes that it makes from a model's weights."""

    def __init__(self, model: Model) -> None:
        self.now, self.change, self.step = Model(model.weights.copy(), model.steps.copy()), Model.empty(), BLOCKS[0]

    def learn(self, found: np.ndarray, right: np.ndarray, n: np.ndarray) -> None:
        """Takes sentences of n tokens (one at least) each, with their right tags."""
        ends = np.cumsum(n)
        i = 0
        while i < len(n):
            j = min(i + self.step, len(n))
            a, b = ends[i] - n[i], ends[j - 1]
            said = self.now.tags_of(found[a:b], n[i:j])
            wrong = np.flatnonzero(said != right[a:b])
            if not len(wrong):
                i, self.step = j, min(2 * self.step, BLOCKS[1])
                continue
            k = int(np.searchsorted(ends, a + wrong[0], side="right"))
            self._correct(found[ends[k] - n[k] : ends[k]], right[ends[k] - n[k] : ends[k]], said[ends[k] - n[k] - a : ends[k] - a])
            i, self.step = k + 1, BLOCKS[0]

    def _correct(self, found: np.ndarray, right: np.ndarray, said: np.ndarray) -> None:
        for m in (self.now, self.change):
            for tags, sign in ((right, 1.0), (said, -1.0)):
                np.add.at(m.weights, (found, tags[:, None]), sign)
                np.add.at(m.steps, (np.concatenate([[len(TAGS)], tags[:-1]]), tags), sign)


def one_pass(model: Model, examples: Iterator[tuple[str, list[tuple[str, str]]]], copies: dict[str, int], nth_round: int) -> Model:
    """The changes that a perceptron's pass over (sentence, labels) makes, from the model's weights."""
    run = _Pass(model)
    _learn(run, Words(), (x for example in examples for x in _examples(*example, copies, nth_round)))
    return run.change


def _learn(run: _Pass, words: Words, examples: Iterable[tuple[list[str], list[int]]]) -> None:
    for some in parts(examples, TOKENS >> 3, lambda x: len(x[0])):
        run.learn(words.features([w for w, _ in some]), np.array([t for _, tags in some for t in tags], np.int8), np.array([len(w) for w, _ in some], np.int64))


def copies_of(examples: DataFrame) -> dict[str, int]:
    """How many variations a sentence of a label gets: so many that rare labels come about as often as the most frequent one, COPIES at most."""
    counts = {r.label: r.n for r in examples.select(F.explode("labels.label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).collect()}
    return {label: max(1, min(COPIES, max(counts.values()) // n)) for label, n in counts.items()}


def _prepared(examples: DataFrame, shards: int) -> DataFrame:
    """shard, the features of a sentence without labels, or else the sentence and its labels; in the order of the passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Words()
        for batch in batches:
            for part in (batch.slice(at, 4096) for at in range(0, batch.num_rows, 4096)):
                sentence, labels = part.column(1).to_pylist(), part.column(2).to_pylist()
                plain = [_TOKEN.findall(s) for s, found in zip(sentence, labels, strict=True) if not found]
                rows = (x for some in parts(plain, TOKENS) for x in np.split(made.features(some), np.cumsum([len(w) for w in some])[:-1]))
                features = pa.array([None if found else next(rows).tobytes() for found in labels], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), features, pa.array([s if found else None for s, found in zip(sentence, labels, strict=True)], pa.string()), part.column(2)], names=["shard", "features", "sentence", "labels"])

    dealt = examples.withColumn("shard", F.pmod(F.col("h"), F.lit(shards)).cast("int")).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "sentence")
    return dealt.select("shard", "sentence", "labels").mapInArrow(run, "shard int, features binary, sentence string, labels array<struct<label:string,text:string>>")


def _changes(prepared: DataFrame, model: Model, copies: dict[str, int], nth_round: int) -> DataFrame:
    """feature (steps come after the weights) and a change for each tag, of each shard."""
    shared = prepared.sparkSession.sparkContext.broadcast(model)
    size = 12 * np.dtype(FEATURE).itemsize

    def rows(change: Model) -> pa.RecordBatch:
        table = np.concatenate([change.weights, change.steps])
        some = np.flatnonzero(table.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, k]) for k in range(len(TAGS)))], names=["feature", *(f"d{k}" for k in range(len(TAGS)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        all_rows = (row for batch in batches for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
        for _, part in groupby(all_rows, lambda x: x[0]):
            one = _Pass(shared.value)
            for plain, some in groupby(part, lambda x: x[1] is not None):
                if plain:
                    for found in parts((x[1] for x in some), TOKENS * size):
                        n = np.array([len(x) for x in found], np.int64) // size
                        one.learn(np.frombuffer(b"".join(found), FEATURE).reshape(-1, 12), np.zeros(n.sum(), np.int8), n)
                else:
                    _learn(one, words, (x for _, _, s, labels in some for x in _examples(s, [(e["label"], e["text"]) for e in labels], copies, nth_round)))
            yield rows(one.change)

    return prepared.mapInArrow(run, "feature int, " + ", ".join(f"d{k} double" for k in range(len(TAGS))))


def train(examples: DataFrame, rounds: int = ROUNDS) -> Model:
    """The mean of the weights after each round of parameter mixing over `training`'s rows."""
    examples = examples.persist()
    copies = copies_of(examples)
    prepared = _prepared(examples, SHARDS * max(1, -(-examples.count() // (SHARDS * PART)))).persist()
    model, total = Model.empty(), Model.empty()
    for nth_round in range(rounds):
        mixed = _changes(prepared, model, copies, nth_round).groupBy("feature").agg(F.count("*").alias("n"), *[F.sum(f"d{k}").alias(f"d{k}") for k in range(len(TAGS))])
        for r in mixed.collect():
            change = np.array(r[2:]) / r.n
            if r.feature < 1 << BITS:
                model.weights[r.feature] += change
            else:
                model.steps[r.feature - (1 << BITS)] += change
        total = Model(total.weights + model.weights, total.steps + model.steps)
        if not nth_round:
            examples.unpersist()
    prepared.unpersist()
    return Model(total.weights / rounds, total.steps / rounds)


def _spans(sentence: str, tags: Iterable[int]) -> list[tuple[str, int, int]]:
    """(label, begin, end) of what a sentence's tags mean."""
    found = list(_TOKEN.finditer(sentence))
    out, begin, label = [], None, None
    for i, tag in enumerate([*(TAGS[k] for k in tags), "O"]):
        if begin is not None and tag != f"I-{label}":
            out.append((label, found[begin].start(), found[i - 1].end()))
            begin = None
        if tag != "O" and begin is None:
            begin, label = i, tag[2:]
    return out


class Spans(dict):
    """The spans (label, begin, end) of a sentence by a model, remembered for up to `most` sentences of up to `longest` characters: they depend on the sentence alone, and forms repeat theirs."""

    most, longest = 1 << 16, 256

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model, self.words = model, Words()

    def keep(self, sentence: str, spans: list[tuple[str, int, int]]) -> None:
        if len(sentence) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[sentence] = spans

    def of(self, many: Iterable[str]) -> dict[str, list[tuple[str, int, int]]]:
        """The spans of each of these sentences; those that aren't known are tagged together."""
        out, asked = {}, []
        for sentence in many:
            if sentence not in out:
                out[sentence] = known = self.get(sentence)
                if known is None:
                    out[sentence] = []
                    if _CASE.search(sentence):
                        asked.append(sentence)
                    else:
                        self.keep(sentence, [])
        at = 0
        for some in parts(map(_TOKEN.findall, asked), TOKENS):
            n = np.array([len(words) for words in some], np.int64)
            tags = self.model.tags_of(self.words.features(some), n)
            ends = np.cumsum(n)
            any_of = np.logical_or.reduceat(tags > 0, ends - n).tolist()
            for i, (sentence, entity) in enumerate(zip(asked[at : at + len(some)], any_of, strict=True)):
                if entity:
                    out[sentence] = _spans(sentence, tags[ends[i] - n[i] : ends[i]].tolist())
                self.keep(sentence, out[sentence])
            at += len(some)
        return out


def _split(text: str) -> list[tuple[str, int]]:
    """The sentences of a text by BREAK, and where they begin: lines first, so that only lines with a closing mark are searched for more."""
    out, at = [], 0
    for end, after in [*((m.start(), m.end()) for m in _FEEDS.finditer(text)), (len(text), len(text))]:
        line = text[at:end]
        if after > end:
            line = line.rstrip(" \t\x0b\f\r")
        begin = 0
        if "." in line or "!" in line or "?" in line:
            for m in _BREAK.finditer(line):
                out.append((line[begin : m.start()], at + begin))
                begin = m.end()
        out.append((line[begin:], at + begin))
        at = after
    return out


def spans_of(text: str, model: Model | Spans) -> list[tuple[str, str, int, int]]:
    """(label, text, begin, end) of the entities of a text, in its order; offsets in code points, end exclusive."""
    seen = model if isinstance(model, Spans) else Spans(model)
    return next(_spans_of_texts([text], seen))


def _spans_of_texts(texts: list[str], seen: Spans) -> Iterator[list[tuple[str, str, int, int]]]:
    split = [_split(t) for t in texts]
    known = seen.of(s for sentences_ in split for s, _ in sentences_)
    for found in split:
        yield [(label, s[a:b], at + a, at + b) for s, at in found for label, a, b in known[s]]


def tagged(docs: DataFrame, model: Model, key: str, text: str = "text") -> DataFrame:
    """key and `entities` of each row, with the confidences of their labels (X13); null and blank texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Spans(shared.value)
        kind = (pa.string(), pa.string(), pa.int32(), pa.int32())
        for batch in batches:
            keys, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            for some in parts((t or "" for t in texts), CHARACTERS):
                found = list(_spans_of_texts(some, seen))
                columns = [*zip(*chain.from_iterable(found), strict=True)] or [()] * 4
                flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kind, strict=True)], ["label", "text", "begin", "end"])
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(some)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["key", "found"])
                at += len(some)

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, found array<struct<label:string,text:string,begin:int,end:int>>")
    scored = F.transform("found", lambda e: F.struct(*[e[k].alias(k) for k in ("label", "text", "begin", "end")], confidence.entity_confidence(e["label"], e["text"]).alias("confidence")))
    return out.select(F.col("key").alias(key), scored.cast(ENTITY).alias("entities"))


def places(found: Column) -> Column:
    """The places among a model's entities as addresses (X14): (label, text, confidence)."""
    return F.transform(F.filter(found, lambda e: e["label"].isin("GPE", "LOC")), lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text"), e["confidence"].alias("confidence")))


def scores(found: DataFrame, key: str, text: str = "text") -> DataFrame:
    """label, right, said, labelled and f1: the model's entities of `found` (key, text, entities) against the weak labels of the same texts, entity by entity of a text."""
    weak = F.flatten(F.transform(sentences(F.col(text)), weak_labels))
    both = found.select(key, F.array_distinct(F.transform("entities", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))).alias("said"), F.array_distinct(weak).alias("meant"))
    rows = both.select(key, F.explode(F.array_union("said", "meant")).alias("e"), "said", "meant")
    counted = rows.select(F.col("e.label").alias("label"), F.array_contains("said", F.col("e")).cast("int").alias("s"), F.array_contains("meant", F.col("e")).cast("int").alias("m"))
    return counted.groupBy("label").agg(F.sum(F.col("s") * F.col("m")).alias("right"), F.sum("s").alias("said"), F.sum("m").alias("labelled")).withColumn("f1", 2 * F.col("right") / (F.col("said") + F.col("labelled")))
