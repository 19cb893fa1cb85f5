"""Language-model scores by prediction by partial matching (PPM, escape method D with symbol exclusion).

The text that is scored is the token sequence: words (runs of bytes other than ASCII white space, A-Z lower-cased) with one
space between, and an end symbol. The model is a trie of byte contexts of up to 5 bytes, learnt from the training documents: a
context's node has the counts of the symbols that follow. A symbol is coded in the longest context in the trie; if that hasn't
seen it, an escape (half the distinct symbols / total; a seen symbol has its count less a half) leads to the context one byte shorter, where the symbols already
ruled out are excluded from the counts; below the empty context all symbols left are equally likely.

Counting covers every training text: 6-byte grams are counted in each batch, combined by Spark, and the shorter contexts are
their marginals. The model is the whole trie, which grows with the corpus; what is broadcast is a cache of at most NODES symbol
nodes: the contexts whose total reaches the least power of two, from OFTEN on, at which the bound holds, each with all its
symbols, so totals, escapes and exclusions are exact, and with every context the cache has all shorter ones. A symbol whose longest context is in
the cache is scored there; any other meets its score in a shuffled join with `rare_logs`, which has the score of each symbol
that training has in a context outside the cache, and of each that only the held-out texts have there. These are worked out in
blocks of the trie: contexts that end in the same two bytes have all their shorter ones of two bytes or more in one block, and
those of no or one byte are sent to all. The unigram base splits the same way: the counts of the HEAD most frequent tokens are
broadcast, the rest meets its counts in a shuffled join. So every count takes part, and NODES, OFTEN and HEAD change no score.

Scale: partial counts are shuffled; scoring is a map with vectorised trie lookups; only rare tokens and symbols in rare
contexts are shuffled again, by symbol and context and not by block, so that a hot one can be split. A block has about BLOCK
nodes of the highest order; a two-byte ending with more is dealt out by four-byte endings.

Defined cases: null and empty texts have the end token only; null ids count as training rows (crc32 of empty text); repeated
rows count as often as they occur; without training rows all symbols are equally likely; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import bound_batches, give_back, id_crc, map_batches, once, staged, utf8

ORDER = 5
NODES, HEAD = 1 << 20, 1 << 17
BLOCK, OFTEN = 1 << 18, 64
PAD, END = 0xFE, 0xFF  # bytes that no UTF-8 text has
SYMBOLS = 255  # all byte values but PAD
END_TOKEN = b"\xff"
_PART = 1 << 20
#: Counts that a task holds before it hands them on; frequent symbols whose scores a worker remembers.
HELD, REMEMBERED = 1 << 19, 1 << 19
_STEP = 1 << 17


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _grams(symbols: np.ndarray) -> np.ndarray:
    """For each position from ORDER on, the symbol and the ORDER before it as one number, the symbol lowest."""
    wide = symbols.astype(np.uint64)
    n = len(wide) - ORDER
    out = wide[ORDER:].copy()
    for back in range(1, ORDER + 1):
        out |= wide[ORDER - back : ORDER - back + n] << np.uint64(8 * back)
    return out


def _sequence(texts: list[list[bytes]]) -> np.ndarray:
    return np.frombuffer(b"".join(x for t in texts for x in (bytes([PAD]) * ORDER, b" ".join(t), END_TOKEN)), np.uint8)


def _together(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys made one, their counts added."""
    key, own = np.unique(key, return_inverse=True)
    return key, np.bincount(own, n, len(key)).astype(np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """gram and n: how often each symbol follows each context of ORDER bytes, over all rows of docs (text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["gram", "n"])

        for batch in batches:
            symbols = _sequence([tokens_of(t) for t in batch.column(0).to_pylist()])
            for at in range(0, len(symbols) - ORDER, 4 * _PART):
                part = symbols[at : at + 4 * _PART + ORDER]
                more = np.unique(_grams(part)[part[ORDER:] != PAD], return_counts=True)
                key, n = _together(np.concatenate([key, more[0]]), np.concatenate([n, more[1]]))
                if len(key) > HELD:
                    yield made()
                    key, n = key[:0], n[:0]
        if len(key):
            yield made()
        give_back()

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_tokens(docs: DataFrame) -> DataFrame:
    """token and n over all rows of docs (text as bytes), the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(tokens_of(text))
            seen[END_TOKEN] += batch.num_rows
            if len(seen) > HELD // 2:
                yield made()
                seen.clear()
        if seen:
            yield made()
        seen.clear()
        give_back()

    bound_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _least_power(sizes: list[tuple[int, int]], most: int) -> int:
    """The least power of two such that what has at least that total comes to `most` or less. sizes: log2 of the total, how much."""
    left, power = sum(n for _, n in sizes), 0
    for log, n in sorted(sizes):
        if left <= most:
            break
        left, power = left - n, log + 1
    return 1 << power


def _log2(n: str) -> Column:
    return F.length(F.bin(F.col(n))) - 1


@dataclass
class Trie:
    """Levels of the trie, as sorted keys with the order in the top byte, and what coding needs of each node."""

    cell: np.ndarray  # a context and a symbol
    seen_first: np.ndarray  # log10 of the symbol's probability where coding starts in this context
    seen_count: np.ndarray  # log10 of the symbol's count less a half
    context: np.ndarray
    escape_first: np.ndarray  # log10 of the escape where coding starts in this context
    escape_later: np.ndarray  # log10 of the escape from the context one byte shorter, entered from this one
    later_total: np.ndarray  # log10 of the shorter context's counts that aren't excluded, entered from this one
    left: float  # log10 of a symbol's probability below the empty context
    least: int = 1  # contexts with a lower total aren't in the trie


def build_trie(levels: list[tuple[np.ndarray, np.ndarray]]) -> Trie:
    """levels: for each order from 0 on the keys (context and symbol) and counts, sorted by key."""
    out: list[list[np.ndarray]] = [[] for _ in range(7)]
    before: tuple | None = None
    with np.errstate(divide="ignore", invalid="ignore"):
        for order, (key, n) in enumerate(levels):
            context, starts, own = np.unique(key >> np.uint64(8), return_index=True, return_inverse=True)
            total = np.add.reduceat(n, starts) if len(n) else n
            distinct = np.diff(np.append(starts, len(key)))
            tag = np.uint64((order + 1) << 56)
            out[0].append(key | tag)
            out[1].append(np.log10(n - 0.5) - np.log10(total[own]))
            out[2].append(np.log10(n - 0.5))
            out[3].append(context | tag)
            out[4].append(np.log10(distinct / 2) - np.log10(total))
            later = rest = np.zeros(len(context))
            if before and len(key):
                b_key, b_n, b_context, b_total, b_distinct = before
                mask = np.uint64((1 << 8 * order) - 1)
                shared = np.add.reduceat(b_n[np.searchsorted(b_key, key & mask)], starts)
                parent = np.searchsorted(b_context, context & np.uint64((1 << 8 * (order - 1)) - 1))
                free = b_distinct[parent] - distinct
                whole = b_total[parent] - shared
                later = np.where(whole > 0, np.log10(free / 2) - np.log10(whole), 0.0)
                rest = np.where(whole > 0, np.log10(whole), 0.0)
            out[5].append(later)
            out[6].append(rest)
            before = key, n, context, total, distinct
    known = len(levels[0][0]) if levels else 0
    flat = [np.concatenate(x) if x else np.empty(0) for x in out]
    return Trie(*(x.astype(np.uint64 if i in (0, 3) else np.float32) for i, x in enumerate(flat)), float(-np.log10(max(1, SYMBOLS - known))))


class Lookup:
    """An open hash table from 64-bit keys to places, with vectorised probes."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.shift, self.mask = keys, np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        rest = np.arange(len(keys), dtype=np.int32)
        at = self._start(keys)
        while len(rest):
            free = self.slot[at] < 0
            self.slot[at[free]] = rest[free]
            put = self.slot[at] == rest
            rest, at = rest[~put], (at[~put] + 1) & self.mask

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ keys >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys; -1 for unknown ones."""
        at = self._start(keys)
        place = self.slot[at]
        if not len(self.keys):
            return place
        todo = np.flatnonzero((place >= 0) & (self.keys[place] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            place[todo] = self.slot[at[todo]]
            todo = todo[(place[todo] >= 0) & (self.keys[place[todo]] != keys[todo])]
        return place


class Scorer:
    """log10 probabilities of symbols after their contexts."""

    def __init__(self, trie: Trie) -> None:
        self.trie, self.cells, self.contexts = trie, Lookup(trie.cell), Lookup(trie.context)
        self.gram, self.log = np.full(REMEMBERED, -1, np.int64).view(np.uint64), np.zeros(REMEMBERED)

    def remembered(self, grams: np.ndarray) -> np.ndarray:
        """As logs, by way of a small table of the grams that came last, one for each hash: frequent ones are mostly there."""
        out = np.empty(len(grams))
        for k in range(0, len(grams), _STEP):
            part = grams[k : k + _STEP]
            slot = ((part ^ part >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) & np.uint64(REMEMBERED - 1)).astype(np.int64)
            logs = self.log[slot]
            at = np.flatnonzero(self.gram[slot] != part)
            new = part[at]
            logs[at] = found = self.logs(new)
            self.gram[slot[at]], self.log[slot[at]] = new, found
            out[k : k + _STEP] = logs
        return out

    def logs(self, grams: np.ndarray) -> np.ndarray:
        """NaN where the longest context isn't in a trie that lacks some."""
        t = self.trie
        out = np.zeros(len(grams))
        at, gram = np.arange(len(grams)), grams
        started = np.zeros(len(grams), bool)
        later, rest = np.zeros(len(grams), np.float32), np.zeros(len(grams), np.float32)
        for order in range(ORDER, -1, -1):
            tag = np.uint64((order + 1) << 56)
            cell = self.cells.find(gram & np.uint64((1 << 8 * (order + 1)) - 1) | tag)
            seen = cell >= 0
            hit, s = cell[seen], started[seen]
            out[at[seen]] += np.where(s, t.seen_count[hit] - rest[seen], t.seen_first[hit]) if len(hit) else 0.0
            miss = ~seen
            at, gram, started, later, rest = at[miss], gram[miss], started[miss], later[miss], rest[miss]
            if not len(at):
                return out
            place = self.contexts.find((gram >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1) | tag)
            there = place >= 0
            if order == ORDER and t.least > 1:
                out[at[~there]] = np.nan
                at, gram, started, later, rest, place = at[there], gram[there], started[there], later[there], rest[there], place[there]
                there = there[there]
            if there.any():
                p, s = place[there], started[there]
                out[at[there]] += np.where(s, later[there], t.escape_first[p])
                later[there], rest[there] = t.escape_later[p], t.later_total[p]
                started |= there
        out[at] += t.left
        return out

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 of the probability of each token sequence but for some grams; the places of their texts, rising; these grams."""
        symbols = _sequence(texts)
        ends = np.flatnonzero(symbols == END)
        first = np.concatenate([[0], ends[:-1] + 1 - ORDER])  # where each text's grams begin, its padding included
        total = np.zeros(len(texts))
        where, which = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for at in range(0, len(symbols) - ORDER, _PART):
            part = symbols[at : at + _PART + ORDER]
            grams = _grams(part)
            logs = np.where(part[ORDER:] == PAD, 0.0, self.remembered(grams))
            rare = np.flatnonzero(np.isnan(logs))
            logs[rare] = 0.0
            where.append(np.searchsorted(first, rare + at, "right") - 1)
            which.append(grams[rare])
            low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(grams))
            total[low:high] += np.add.reduceat(logs, np.maximum(first[low:high] - at, 0))
        return total, np.concatenate(where), np.concatenate(which)


def learn(docs: DataFrame, grams: DataFrame | None = None, often: int = 1) -> Trie:
    """The trie of the rows of docs (text as bytes), without contexts of a total under often and the rarer ones beyond NODES nodes.

    grams: count_grams of docs, if there already.
    """
    grams = staged(count_grams(docs), "grams") if grams is None else grams
    levels = [staged(grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("cell")).agg(F.sum("n").alias("n")), f"level{k}") if k < ORDER else grams.withColumnRenamed("gram", "cell") for k in range(ORDER + 1)]
    totals = [level.groupBy(F.shiftright("cell", 8).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d")) for level in levels[1:]]
    sizes = [(r.log, r.d) for x in totals for r in x.groupBy(_log2("t").alias("log")).agg(F.sum("d").alias("d")).collect()]
    low = levels[0].orderBy("cell").collect()  # at most 255 rows
    least = max(often, _least_power(sizes, NODES))
    taken = [(np.array([r.cell for r in low], np.uint64), np.array([r.n for r in low], np.int64))]
    for level, total in zip(levels[1:], totals, strict=True):
        if least > 1:
            frequent = total.filter(F.col("t") >= least).select("context")
            level = level.withColumn("context", F.shiftright("cell", 8)).join(frequent, "context", "left_semi")
        got = level.select("cell", "n").toArrow()
        key, n = got.column(0).to_numpy().astype(np.uint64), got.column(1).to_numpy()
        order = np.argsort(key)
        taken.append((key[order], n[order]))
    trie = build_trie(taken)
    trie.least = least
    return trie


def _marginal(key: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys and counts of a shorter order."""
    cell, own = np.unique(key & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
    return cell, np.bincount(own, n, len(cell)).astype(np.int64)


def rare_logs(grams: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """gram and log, the symbol's log10 probability: all grams in contexts of a total under least, and those asked that grams lacks.

    grams: count_grams of the training texts; asked: grams in contexts that have a total under least or none.

    A task takes the grams of some endings (the last two bytes of a context), so all counts of orders 2 and more are its own; those of orders 0 and 1 are broadcast.
    An ending of more than BLOCK grams is dealt out by two bytes more, of which a value has 65,536 grams at most; its parts get the counts of orders 2 and 3 along.
    """
    short = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 16) - 1)).alias("cell")).agg(F.sum("n").alias("n")).toArrow()  # at most 65,535 rows
    key, n = short.column(0).to_numpy().astype(np.uint64), short.column(1).to_numpy()
    low = grams.sparkSession.sparkContext.broadcast([_marginal(key, n, k) for k in (0, 1)])
    ending = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 16) - 1))
    new_ones = staged(asked.select("gram").distinct(), "asked")
    both = grams.select("gram", "n", F.lit(ORDER).alias("order")).union(new_ones.select("gram", F.lit(0).cast("long"), F.lit(ORDER)))
    endings = staged(both.groupBy(ending.alias("ending")).agg(F.count("*").alias("c")), "endings")  # at most 65,536 rows
    blocks = 1 + (endings.agg(F.sum("c")).first()[0] or 0) // BLOCK
    parts = F.broadcast(endings.select("ending", F.when(F.col("c") > BLOCK, F.ceil(F.col("c") / BLOCK)).otherwise(0).cast("int").alias("parts")))

    def each(block: pa.Table) -> pa.Table:
        key, n, of = block.column("gram").to_numpy().view(np.uint64), block.column("n").to_numpy(), block.column("order").to_numpy()
        levels: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(2, 4):
            cell = np.flatnonzero(of == k)
            cell = cell[np.argsort(key[cell])]
            levels.append((key[cell], n[cell]))
        new, order = np.unique(key[(of == ORDER) & (n == 0)]), np.flatnonzero((of == ORDER) & (n > 0))
        order = order[np.argsort(key[order])]
        key, n = key[order], n[order]
        trie = build_trie([*low.value, *(levels[k - 2] if k < 4 and len(levels[k - 2][0]) else _marginal(key, n, k) for k in range(2, ORDER)), (key, n)])
        _, starts, own = np.unique(key >> np.uint64(8), return_index=True, return_inverse=True)
        rare = np.add.reduceat(n, starts)[own] < least if len(n) else np.empty(0, bool)
        at = np.searchsorted(key, new)
        new = new[key[np.minimum(at, len(key) - 1)] != new] if len(key) else new
        logs = np.concatenate([trie.seen_first[len(trie.cell) - len(key) :][rare], Scorer(trie).logs(new)])
        return pa.table({"gram": np.concatenate([key[rare], new]).view(np.int64), "log": logs.astype(np.float64)})

    dealt = both.withColumn("ending", ending).join(parts, "ending")
    longer = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 32) - 1))
    block = F.when(F.col("parts") > 0, -1 - F.col("ending")).otherwise(F.pmod(F.xxhash64("ending"), F.lit(blocks))).cast("long")
    rows = dealt.select("gram", "n", "order", block.alias("block"), F.when(F.col("parts") > 0, F.pmod(F.xxhash64(longer), F.col("parts"))).otherwise(0).cast("int").alias("part"))
    split = dealt.filter("parts > 0 and n > 0")
    for k in (2, 3):
        cells = split.groupBy("ending", "parts", F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        rows = rows.union(cells.select("gram", "n", F.lit(k), (-1 - F.col("ending")).cast("long"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    return rows.groupBy("block", "part").applyInArrow(each, "gram long, log double")


def _ready(model: tuple[Trie, dict[bytes, int]]) -> tuple[Scorer, dict[bytes, int]]:
    return Scorer(model[0]), model[1]


def scores(docs: DataFrame, training: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row.

    training: which rows to learn from; those whose crc32(doc_id as text) mod 5 is not 1 unless given.
    """
    training = id_crc("doc_id") % 5 != 1 if training is None else training
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), training.alias("training"))
    train = rows.filter("training")
    counts = staged(count_tokens(train), "tokens")
    known, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    base = total + 0.5 * (known + 1)
    sizes = [(r.log, r.n) for r in counts.groupBy(_log2("n").alias("log")).agg(F.count("*").alias("n")).collect()]
    often = counts.filter(F.col("n") >= _least_power(sizes, HEAD)).toArrow()
    head = dict(zip(often.column(0).to_pylist(), often.column(1).to_pylist(), strict=True))
    grams = staged(count_grams(train), "grams")
    trie = learn(train, grams, OFTEN)
    shared = docs.sparkSession.sparkContext.broadcast((trie, head))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer, head = once(shared, _ready)
        texts = [tokens_of(t) for t in batch.column(1).to_pylist()]
        flat = [x for t in texts for x in (*t, END_TOKEN)]
        sizes = np.array([len(t) + 1 for t in texts])
        first = np.cumsum(sizes) - sizes
        c = np.fromiter(map(head.get, flat, repeat(0)), np.int64, len(flat))
        sums = np.add.reduceat(np.where(c > 0, np.log10((c + 0.5) / base), 0.0), first)
        seen = np.add.reduceat((c > 0).astype(np.int64), first)
        unknown = np.flatnonzero(c == 0)
        edges = pa.array(np.searchsorted(unknown, [*first, len(flat)]).astype(np.int32))
        rare = pa.ListArray.from_arrays(edges, pa.array([flat[i] for i in unknown.tolist()], pa.binary()))
        score, where, which = scorer.score(texts)
        unscored = pa.ListArray.from_arrays(pa.array(np.searchsorted(where, np.arange(len(texts) + 1)).astype(np.int32)), pa.array(which.view(np.int64)))
        made = [pa.array(sizes), pa.array(seen), pa.array(sums), pa.array(score), rare, unscored]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *made], names=["doc_id", "training", "n_tokens", "seen", "sums", "score", "rare", "unscored"])

    schema = "doc_id long, training boolean, n_tokens long, seen long, sums double, score double, rare array<binary>, unscored array<long>"
    scored = staged(map_batches(rows, each, schema).withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = scored.select("row", F.explode("rare").alias("token")).join(counts, "token", "left")
    c = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10((c + 0.5) / base)).alias("rare_sums"), F.count_if(c > 0).alias("rare_seen"))
    out = scored.drop("rare", "unscored").join(rare, "row", "left").withColumn("rest", F.lit(0.0))
    if trie.least > 1:
        asked = scored.filter("not (training <=> true)").select(F.explode("unscored").alias("gram"))
        logs = staged(rare_logs(grams, asked, trie.least), "rare-logs")
        rest = scored.select("row", F.explode("unscored").alias("gram")).join(logs, "gram").groupBy("row").agg(F.sum("log").alias("rest"))
        out = out.drop("rest").join(rest, "row", "left")
    return out.select(
        "doc_id",
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        (F.col("seen") + F.coalesce("rare_seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("sums") + F.coalesce("rare_sums", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("rest", F.lit(0.0))).alias("score"),
    )
