"""The corpus pipeline on a small table: every stage takes effect and keeps clean documents."""

from __future__ import annotations

import random
import re
from collections import Counter

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from rollbook.llm import bpe, minhash
from rollbook.llm.common import staged


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, data), name)
        n.append(docs.count())
        if name != "tokens":
            assert docs.columns == columns
    assert n[1] == n[0] > n[2] == n[3] > n[4] == n[5] > 0.7 * n[0]
    assert corpus_pipeline.run(spark, data).count() == n[-1]


def test_near_copies_are_caught(spark):
    r = random.Random(4)
    texts: list[list[str]] = []
    for _ in range(60):  # originals, and each with one to nine words changed
        base = [f"w{r.randint(0, 9999)}" for _ in range(150)]
        texts.append(base)
        for changes in (1, 2, 3, 5, 9):
            at = set(r.sample(range(150), changes))
            texts.append([f"x{r.randint(0, 9999)}" if k in at else x for k, x in enumerate(base)])
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert kept == {top(i) for i in range(len(texts))} and len(kept) < len(texts)


def test_close_copies_without_a_common_band(spark):
    """Operator 7's search takes part: texts of similarity 0.8 that no MinHash band holds together, 3 fingerprint bits apart at most."""
    r = random.Random(112274)
    a = [f"w{r.randint(0, 9999)}" for _ in range(50)]
    b = [*a[:25], f"x{r.randint(0, 9999)}", *a[26:]]
    of = [minhash.shingles([w.encode() for w in x]) for x in (a, b)]
    assert minhash.near(*of) and not set(minhash.bands(of[0])) & set(minhash.bands(of[1]))
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "another text of its own")], "doc_id long, text string")
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}


def test_stages_equal_brute_force(spark, data):
    """Each stage on what the one before has kept, held against a plain version; odd rows among them."""
    r = random.Random(11)
    bench = [x.text for x in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    words = [f"{a}{b}" for a in ("the", "and", "with", "river", "stone") for b in ("", "s", "ing", "ed", "ly")]
    fresh = lambda n: " ".join(r.choices(words, k=n))
    passage, base = fresh(60), [fresh(90) for _ in range(5)]
    texts = [(k, x) for k, x in enumerate(base)] + [(100 + k, f"{fresh(30)} {passage} {fresh(20)}") for k in range(4)] + [(200 + k, x) for k, x in enumerate(base[:3])]
    texts += [(300, None), (301, ""), (302, "1234 !!"), (None, fresh(40)), (None, fresh(45)), (400, f"{fresh(15)} {bench[0]}"), (401, f"{base[0]} tail"), (401, fresh(50)), (401, fresh(50))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    rows = lambda df: Counter((x.doc_id, x.text) for x in df.collect())

    kept = staged(corpus_pipeline.language_id(spark, docs, data), "a")
    assert rows(kept) == Counter(x for x in texts if any(c.isalpha() for c in x[1] or ""))

    left = list(rows(kept).elements())
    grams = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in left]
    group = list(range(len(left)))
    for _ in left:
        for i, a in enumerate(grams):
            for j, b in enumerate(grams):
                if 5 * len(a & b) >= 4 * len(a | b):
                    group[i] = group[j] = min(group[i], group[j])
    unique = staged(corpus_pipeline.near_duplicates(spark, kept, data), "b")
    last = 1 << 62
    best = {g: min(last if x[0] is None else x[0] for x, h in zip(left, group, strict=True) if h == g) for g in set(group)}
    got = rows(unique)
    assert not got - Counter(left) and sorted(best.values()) == sorted(last if i is None else i for i, _ in got.elements())

    first: dict[tuple, int] = {}
    for i, t in got:
        for k in range(len(t.split()) - 49 if i is not None else 0):
            window = tuple(t.split()[k : k + 50])
            first[window] = min(first.get(window, last), i)
    want: Counter = Counter()
    for i, t in got.elements():
        w = t.split()
        gone = {p for k in range(len(w) - 49 if i is not None else 0) if first[tuple(w[k : k + 50])] < i for p in range(k, k + 50)}
        want[i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t] += 1
    cut = staged(corpus_pipeline.repeated_passages(spark, unique, data), "c")
    assert rows(cut) == want and want != got

    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(split(b)[k : k + 10]) for b in bench for k in range(max(1, len(split(b)) - 9))}
    leaks = lambda t: any(tuple(split(t)[k : k + 10]) in windows for k in range(len(split(t)) - 9))
    clean = Counter({x: n for x, n in want.items() if not leaks(x[1])})
    safe = staged(corpus_pipeline.benchmark_leaks(spark, cut, data), "d")
    assert rows(safe) == clean and clean != want

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(bpe.VOCABULARY)), special_tokens={})
    ids = corpus_pipeline.tokens(spark, safe, data).collect()
    assert Counter((x.doc_id, tuple(x.ids)) for x in ids) == Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in clean.elements())


def test_odd_rows(spark, docs, none, data):
    small = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for rows in (small, none.select(*small.columns)):
        out, counts = rows, [rows.count()]
        for name, stage in corpus_pipeline.STAGES:
            out = staged(stage(spark, out, data), name)
            counts.append(out.count())
        assert counts == sorted(counts, reverse=True) and counts[1] <= sum(any(c.isalpha() for c in x.text or "") for x in rows.collect())
