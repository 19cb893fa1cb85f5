"""Chat formatting: roles of a transcript's lines by a hidden Markov model, then canonical turns.

A transcript is a conversation's rows in the order of `turn`, each with one or more lines of raw text. Each line has features:
the role its speaker marker names, if any (`User:`, `### Assistant`, `<|system|>`, `[bot]` ...), whether it opens a row, whether
it is blank, asks, and how long it is. Hidden states are role and position (begins a turn, or goes on). Start, transition and
emission probabilities are counted, with add-one smoothing, on a sample of labelled conversations bounded by SAMPLE; Viterbi
gives the likeliest states. Turns are then rendered as `<|role|>`, the text without markers, `<|end|>`, a line each.

Scale: rows are range-partitioned and sorted by conversation, turn and text, and numbered; a chunk is a run of up to CHUNK_ROWS
rows and CHUNK_BYTES bytes of one conversation, so a conversation that holds a third of all rows is many chunks. Viterbi is exact
across chunks: each chunk gives its max-plus matrix (best log probability from state to state); matrices are multiplied in runs of
FAN, and the products again, until a conversation has FAN or fewer; then the states at the borders are chained from the top level
down, and the chunks are decoded independently between them. A task holds one chunk, or FAN matrices, at a time.

Defined cases: each row without conv_id is a conversation of its own; null turns come first; rows that repeat a turn are ordered
by their text; null and blank texts are one blank line, take the role that the sequence gives them and render an empty turn; roles
outside the three known ones teach nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.llm.common import bound_batches, give_back, map_batches, staged

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # role and, at odd places, going on
SAMPLE, CHUNK_ROWS, CHUNK_BYTES, FAN = 20_000, 512, 1 << 22, 512
# The names that speaker markers use.
SPEAKERS = {
    "system": 1, "instruction": 1, "instructions": 1, "context": 1,
    "user": 2, "human": 2, "customer": 2, "question": 2, "q": 2, "prompt": 2, "me": 2,
    "assistant": 3, "ai": 3, "bot": 3, "agent": 3, "answer": 3, "a": 3, "gpt": 3, "model": 3, "response": 3,
}
_MARKER = re.compile(r"\s*(?:<\|(?:im_start\|>)?\s*(?P<a>\w+)\s*(?:\|>)?|\[(?P<b>\w+)\]\s*:?|#{1,4}\s*(?P<c>\w+)\s*:?(?=\s|$)|\*\*(?P<d>\w+)\s*:?\*\*\s*:?|(?P<e>\w+)\s*:(?!/))\s*", re.I)
#: How many values each feature takes: marker, opens a row, blank, asks, length.
SIZES = (4, 2, 2, 2, 4)


def marker_of(line: str) -> tuple[int, str]:
    """The number of the role that a line's marker names (0: none) and the line without it."""
    if (m := _MARKER.match(line)) and (role := SPEAKERS.get(next(x for x in m.groups() if x).lower(), 0)):
        return role, line[m.end() :]
    return 0, line


def features_of(text: str | None) -> np.ndarray:
    """A row of feature values for each line."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        marker, rest = marker_of(line)
        bare = rest.strip()
        out.append((marker, int(k == 0), int(not bare), int(bare.endswith("?")), min(3, len(bare).bit_length() // 3)))
    return np.array(out, np.int64)


class Hmm:
    """Log probabilities of starts, transitions and, for each feature, emissions."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]) -> None:
        self.start, self.step, self.emit = start, step, emit

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return sum(e[:, features[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, features: np.ndarray) -> np.ndarray:
        """Best log probability of the lines, from the state before them (rows) to the last one's (columns)."""
        total = None
        for e in self.emissions(features):
            one = self.step + e
            total = one if total is None else (total[:, :, None] + one[None]).max(1)
        return total

    def decode(self, features: np.ndarray, before: int, last: int) -> list[int]:
        """The likeliest states between the state before (-1: the start) and the last one (-1: any)."""
        e = self.emissions(features)
        best, back = (self.start if before < 0 else self.step[before]) + e[0], []
        for row in e[1:]:
            ways = best[:, None] + self.step
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        path = [int(best.argmax()) if last < 0 else last]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]


def counts_of(role: str, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a row's lines add to the emissions, one after the other by feature, and how many steps it has inside: its first line begins its turn, the others go on."""
    emit, state = [np.zeros((STATES, n), np.int64) for n in SIZES], 2 * ROLES.index(role)
    for k, e in enumerate(emit):
        e[state] += np.bincount(features[:1, k], minlength=SIZES[k])
        e[state + 1] += np.bincount(features[1:, k], minlength=SIZES[k])
    return np.concatenate([e.ravel() for e in emit]), np.array([min(1, len(features) - 1), max(0, len(features) - 2)])


def fit(rows: list[tuple]) -> Hmm:
    """From (conversation, role, counts_of) of rows in order."""
    start, step = np.ones(STATES), np.ones((STATES, STATES))
    emit = np.concatenate([np.ones(STATES * n) for n in SIZES])
    last_key, last = None, -1
    for key, name, (lines, inner) in rows:
        role = ROLES.index(name)
        if key != last_key:
            start[2 * role] += 1
        else:
            step[last, 2 * role] += 1
        step[2 * role, 2 * role + 1] += inner[0]
        step[2 * role + 1, 2 * role + 1] += inner[1]
        emit += lines
        last_key, last = key, 2 * role + int(inner[0] > 0)
    tables = [e.reshape(STATES, n) for e, n in zip(np.split(emit, np.cumsum([STATES * n for n in SIZES])[:-1]), SIZES, strict=True)]
    return Hmm(np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True)), [np.log(e / e.sum(1, keepdims=True)) for e in tables])


def learn(transcripts: DataFrame) -> Hmm:
    """The model of a sample of whole conversations of transcripts (conv_id, turn, role, text), about SAMPLE rows at most.

    What goes to the driver of a row are its counts, some hundred numbers, whatever its length.
    """
    known = transcripts.filter(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    share = min(1.0, SAMPLE / max(1, known.count()))
    draw = F.pmod(F.xxhash64("conv_id", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))
    nth = F.pmod(F.xxhash64("conv_id", "turn", "text"), F.lit(1 << 30)) < int(share * (1 << 30))
    # a conversation as large as the sample itself is thinned by rows instead, so the bound holds
    large = known.groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > SAMPLE // 10).select("conv_id")
    taken = known.join(large, "conv_id", "left_anti").filter(draw).union(known.join(large, "conv_id", "left_semi").filter(nth))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [counts_of(role, features_of(text)) for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        counts = pa.array([np.concatenate(f).tolist() for f in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), batch.column(2), counts], names=["conv_id", "turn", "h", "role", "counts"])

    columns = taken.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", F.xxhash64("text").alias("h"))
    rows = map_batches(columns, each, "conv_id string, turn long, h long, role string, counts array<long>").collect()
    rows.sort(key=lambda r: (r.conv_id, r.turn if r.turn is not None else -1, r.h, r.role, r.counts))
    return fit([(r.conv_id, r.role, (np.array(r.counts[:-2]), r.counts[-2:])) for r in rows])


def render(text: str | None, states: list[int]) -> tuple[str, list[str]]:
    """Canonical turns of a row's lines, and their roles."""
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip((text or "").split("\n"), states, strict=True):
        role, rest = ROLES[state // 2], marker_of(line)[1]
        if not turns or state % 2 == 0 or role != turns[-1][0]:
            turns.append((role, []))
        turns[-1][1].append(rest)
    return "\n".join(f"<|{role}|>\n{'\n'.join(lines).strip()}\n<|end|>" for role, lines in turns), [role for role, _ in turns]


def numbered(ordered: DataFrame, order: str, size: str, into: str, most: int, bytes_: int) -> DataFrame:
    """ordered, which is sorted by key and order within partitions, with `into`: the order of the first row of the run that a row is in.

    A run is of one key and partition, of up to `most` rows and, but for a single row, `bytes_` bytes by the column `size`.
    """
    bound_batches(ordered.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, first, rows, total = None, 0, 0, 0
        for batch in batches:
            column = batch.schema.get_field_index
            out = []
            for key, place, n in zip(*(batch.column(column(c)).to_pylist() for c in ("key", order, size)), strict=True):
                if key != of or rows >= most or total + n > bytes_:
                    of, first, rows, total = key, place, 0, 0
                rows, total = rows + 1, total + n
                out.append(first)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], names=[*batch.schema.names, into])
        give_back()

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField(into, T.LongType())]))


def chunked(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, text, and: key of the conversation, place in the order, chunk."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("conv_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id()))
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text", key.alias("key"), F.xxhash64(text).alias("digest"))
    ordered = rows.repartitionByRange("key", "turn", "digest").sortWithinPartitions("key", "turn", "digest").withColumn("place", F.monotonically_increasing_id())
    ordered = ordered.select("conv_id", "turn", "text", "key", "place", F.octet_length(text).cast("long").alias("size"))
    return staged(numbered(ordered, "place", "size", "chunk", CHUNK_ROWS, CHUNK_BYTES).drop("size"), "chunks")


def _matrix(values: list[float]) -> np.ndarray:
    return np.array(values).reshape(STATES, STATES)


def _after(best: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (best[..., :, None] + m).max(-2)


def _product(table: pa.Table) -> pa.Table:
    """The matrices of a run made one."""
    parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    total, opening = _matrix(parts[0]["matrix"]), np.array(parts[0]["opening"])
    for r in parts[1:]:
        m = _matrix(r["matrix"])
        total, opening = _after(total, m), _after(opening, m)
    return pa.table({"key": pa.array([parts[0]["key"]]), "chunk": pa.array([parts[0]["run"]], pa.int64()), "matrix": pa.array([total.reshape(-1).tolist()]), "opening": pa.array([opening.tolist()])})


def _chain(table: pa.Table) -> pa.Table:
    """key, chunk, before and last of the parts of a run: the states before their first and at their last line (-1: none before)."""
    parts = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    before, last = parts[0]["before"], parts[0]["last"]
    best, back = np.array(parts[0]["opening"]) if before < 0 else _matrix(parts[0]["matrix"])[before], []
    for r in parts[1:]:
        ways = best[:, None] + _matrix(r["matrix"])
        back.append(ways.argmax(0))
        best = ways.max(0)
    states = [int(best.argmax()) if last < 0 else last]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    states = states[::-1]
    found = [(r["key"], r["chunk"], a, b) for r, a, b in zip(parts, [before, *states], states, strict=False)]
    return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("key", pa.string()), ("chunk", pa.int64()), ("before", pa.int32()), ("last", pa.int32())))})


def _borders(matrices: DataFrame) -> DataFrame:
    """key, chunk, before and last of the chunks of matrices (key, chunk, matrix, opening)."""
    schema = "key string, chunk long, before int, last int"
    if matrices.groupBy("key").count().filter(F.col("count") > FAN).isEmpty():
        whole = matrices.withColumns({"before": F.lit(-1), "last": F.lit(-1)})
        return whole.groupBy("key").applyInArrow(_chain, schema)
    ordered = matrices.repartitionByRange("key", "chunk").sortWithinPartitions("key", "chunk").withColumn("size", F.lit(0).cast("long"))
    runs = staged(numbered(ordered, "chunk", "size", "run", FAN, 1).drop("size"), "runs")
    products = staged(runs.groupBy("key", "run").applyInArrow(_product, "key string, chunk long, matrix array<double>, opening array<double>"), "products")
    above = _borders(products).withColumnRenamed("chunk", "run")
    return runs.join(above, ["key", "run"]).groupBy("key", "run").applyInArrow(_chain, schema)


def roles(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, turn, place, roles (of the row's turns in order), role (of the first) and rendered of each row of transcripts."""
    shared = transcripts.sparkSession.sparkContext.broadcast(model)
    rows = chunked(transcripts)
    several = rows.groupBy("key").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).filter("a < b").select("key")

    def measure(table: pa.Table) -> pa.Table:
        ordered = sorted(table.to_pylist(), key=lambda r: r["place"])
        features = np.concatenate([features_of(r["text"]) for r in ordered])
        model: Hmm = shared.value
        first = model.start + model.emissions(features[:1])[0]
        opening = first if len(features) == 1 else (first[:, None] + model.matrix(features[1:])).max(0)
        return pa.table({"key": pa.array([ordered[0]["key"]]), "chunk": pa.array([ordered[0]["chunk"]], pa.int64()), "matrix": pa.array([model.matrix(features).reshape(-1).tolist()]), "opening": pa.array([opening.tolist()])})

    spread = rows.join(several, "key", "left_semi").select("key", "chunk", "place", "text")
    matrices = spread.groupBy("key", "chunk").applyInArrow(measure, "key string, chunk long, matrix array<double>, opening array<double>")
    borders = _borders(staged(matrices, "matrices"))
    whole = rows.join(borders, ["key", "chunk"], "left").select("conv_id", "turn", "text", "key", "place", "chunk", "before", "last")
    bound_batches(transcripts.sparkSession)
    sorted_rows = whole.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Hmm = shared.value
        held: list[dict] = []
        out: list[tuple] = []

        def decode() -> None:
            features = [features_of(r["text"]) for r in held]
            before, last = held[0]["before"], held[0]["last"]
            states = model.decode(np.concatenate(features), -1 if before is None else before, -1 if last is None else last)
            at = 0
            for r, f in zip(held, features, strict=True):
                rendered, found = render(r["text"], states[at : at + len(f)])
                out.append((r["conv_id"], r["turn"], r["place"], found, found[0], rendered))
                at += len(f)

        def made() -> pa.RecordBatch:
            kinds = [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int64()), ("roles", pa.list_(pa.string())), ("role", pa.string()), ("rendered", pa.string())]
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])
            out.clear()
            return batch

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["key"], row["chunk"]) != (held[-1]["key"], held[-1]["chunk"]):
                    decode()
                    held = []
                held.append(row)
            if out:
                yield made()
        if held:
            decode()
            yield made()
        give_back()

    return sorted_rows.mapInArrow(run, "conv_id long, turn long, place long, roles array<string>, role string, rendered string")


def raw_transcript(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and raw text: speakers' markers in one of four styles for each conversation, every fourth turn without."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    role = F.coalesce("role", F.lit("user"))
    marker = (
        F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)) == 0, "")
        .when(style == 0, F.concat(F.initcap(role), F.lit(": ")))
        .when(style == 1, F.concat(F.lit("### "), F.initcap(role), F.lit(":\n")))
        .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n")))
        .otherwise(F.concat(F.element_at(F.create_map(*[F.lit(x) for pair in (("system", "[system] "), ("user", "Human: "), ("assistant", "AI: ")) for x in pair]), role)))
    )
    return conversations.select("conv_id", "turn", "role", F.concat(F.coalesce(marker, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


def report(conversations: DataFrame) -> DataFrame:
    """Each conversation as a raw transcript, its roles recovered and its turns rendered: conv_id, turn, role_pred, n_turns, rendered."""
    raw = raw_transcript(conversations)
    return roles(raw.select("conv_id", "turn", "text"), learn(raw)).select("conv_id", "turn", F.col("role").alias("role_pred"), F.size("roles").cast("long").alias("n_turns"), "rendered")
