"""Decontamination, tokens, SimHash, substrings: against brute force on small tables with all odd cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash

from rollbook.llm import bpe, decontam, langid, minhash, queries, simhash, substring


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- decontamination


def brute_scan(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    hit, ids = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(body))
        k = min(10, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_decontamination_equals_brute_force(spark, docs, rows, monkeypatch):
    items = [(1, rows[14][1][30:200]), (2, "ONE two"), (3, None), (4, "!!"), (5, rows[14][1][30:200]), (12, "中文"), (7, " ".join(rows[20][1].split()[:25]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter((i, *brute_scan(t, items)) for i, t in rows)
    assert Counter(map(tuple, decontam.report(docs, bench).collect())) == want
    monkeypatch.setattr(decontam, "BLOCK_WINDOWS", 5)  # a benchmark larger than a broadcast may be
    assert Counter(map(tuple, decontam.report(docs, bench).collect())) == want
    kept = decontam.remove_documents(docs, bench)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(w[0] for w in want.elements() if not w[-1])
    cut = {r.doc_id: r for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[5].text == "" and cut[4].text == "one" and cut[2].text == "" and cut[1].text is None and cut[5].n_chars == 0


def test_decontamination_of_nothing(docs, none, spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert not decontam.report(docs, empty).filter("contaminated").count() and decontam.report(none, empty).count() == 0


# --- tokens


def test_bpe_equals_the_library_and_decodes(docs, rows, none):
    ranks = bpe.read_ranks(P.path(bpe.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == want
    encoded = bpe.encode(docs)
    assert Counter((r.doc_id, r.text) for r in bpe.decode(encoded).collect()) == Counter((i, t or "") for i, t in rows)
    assert bpe.digests(none).count() == 0


def test_perfect_hash_is_minimal():
    own = bpe.codec(P.path(bpe.VOCABULARY), P.PATTERN)
    keys = list(bpe.vocabulary(P.path(bpe.VOCABULARY))[0])
    assert all(own.whole.find(k) == i for i, k in enumerate(keys)) and sorted(own.whole.index_at) == list(range(len(keys)))
    assert own.whole.find(b"no such entry") == -1 and bpe.PerfectHash([]).find(b"x") == -1


def test_encoder_on_random_text():
    own = bpe.codec(P.path(bpe.VOCABULARY), P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.vocabulary(P.path(bpe.VOCABULARY))[0], special_tokens={})
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(chr(r.choice((r.randint(0, 0x24F), r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF), 32, 10, 39))) for _ in range(r.randint(0, 12)))
        assert library.encode_ordinary(text) == np.frombuffer(own.encode(text), "<u4").tolist()


# --- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered(text)) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark, docs, rows, none):
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = defaultdict(lambda: None)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            k = top(i)
            least[k] = doc if least[k] is None else min(least[k], doc)
    want = Counter((doc, prints[i], least[top(i)]) for i, (doc, _) in enumerate(rows))
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == want
    kept = simhash.keep_one(docs).collect()
    groups = {top(i) for i in range(len(rows))}
    assert len(kept) == len(groups) and simhash.keep_one(none).count() == 0 and kept[0].asDict().keys() == docs.first().asDict().keys()


@pytest.mark.parametrize("hot", [2000, 3])
def test_links_at_every_distance(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    r = random.Random(8)
    base = [r.getrandbits(64) for _ in range(40)]
    base += [base[0] >> 32 << 32 | r.getrandbits(32) for _ in range(30)] + [base[1] & 0xFFFFFFFF | r.getrandbits(32) << 32 for _ in range(30)]  # halves that many share
    near = [b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (1, 2, 3, 4, 5)]
    every = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    got = Counter(map(tuple, simhash.links(spark.createDataFrame([(x,) for x in every], "fp long")).collect()))
    want = Counter((a, b) for k, a in enumerate(every) for b in every[k + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3)
    assert got == want


def test_links_never_broadcast_the_exploded_index(spark):
    """Spark's estimate of the 64 rows of a node is that of one row, so a join that it chooses may send all to the driver."""
    plan = simhash.links(spark.range(2000).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id + 1 as a", "id as b").union(spark.createDataFrame([(900, 950), (950, 930), (7, 7)], "a long, b long"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys((900, 930, 950), 900)}


# --- substrings


def brute_repeats(rows):
    first: dict[tuple, int] = {}
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t in rows]
    for (doc, _), words in zip(rows, split, strict=True):
        if doc is not None:
            for i in range(len(words) - 49):
                w = tuple(words[i : i + 50])
                first[w] = min(first.get(w, doc), doc)
    out = Counter()
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        if doc is not None:
            for i in range(len(words) - 49):
                if first[tuple(words[i : i + 50])] < doc:
                    gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substrings_equal_brute_force(docs, rows, none, monkeypatch):
    want = brute_repeats(rows)
    assert sum(n for (_, _, gone, _), n in want.items() if gone) >= 10
    assert Counter(map(tuple, substring.report(docs).collect())) == want
    monkeypatch.setattr(substring, "GROUP", 1)  # every prefix group overfull: whole windows as prefixes
    assert Counter(map(tuple, substring.report(docs).collect())) == want
    assert substring.report(none).count() == 0


def test_removed_texts(docs, rows):
    out = {(r.doc_id, r.text): r for r in substring.remove_repeats(docs).collect()}
    assert docs.columns == substring.remove_repeats(docs).columns and (1, None) in out and (3, " \t\n ") in out
    assert any(i == 40 and t == "" and r.n_chars == 0 for (i, t), r in out.items())


def test_suffix_tree():
    r = random.Random(1)
    for _ in range(60):
        period = r.choice((1, 3, 400))
        segments = [[b"a" if r.random() < 0.02 else b"x%d" % (i % period) for i in range(r.randint(0, 130))] for _ in range(r.randint(1, 6))]
        order, common = substring.tree_of(segments)
        place = [(s, i) for s in range(len(segments)) for i in range(len(segments[s]) + 1)]
        suffix = [segments[s][i:] for s, i in (place[k] for k in order)]
        assert sorted(order.tolist()) == list(range(len(place)))
        for k in range(1, len(order)):
            n = 0
            while n < substring.DEEP and n < min(len(suffix[k - 1]), len(suffix[k])) and suffix[k - 1][n] == suffix[k][n]:
                n += 1
            assert n == common[k]
        begin, end, depth = substring.deep_nodes(order, common)
        for a, b, d in zip(begin, end, depth, strict=True):
            assert b - a > 1 and d >= 50 and len({tuple(x[:50]) for x in suffix[a:b]}) == len({tuple(x[:d]) for x in suffix[a:b]}) == 1
        leaves = [(low := r.randint(0, 5), low + r.randint(0, 3), s) for s in segments]
        got = {(k, w): least for k, a, b, least in substring.repeats_of(leaves) for w in range(a, b)}
        first: dict[tuple, int] = {}
        for low, _, words in leaves:
            for i in range(len(words) - 49):
                first[tuple(words[i : i + 50])] = min(first.get(tuple(words[i : i + 50]), 99), low)
        want = {(k, i): first[tuple(words[i : i + 50])] for k, (_, high, words) in enumerate(leaves) for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < high}
        assert got == want


def test_long_periodic_texts(spark):
    """A million words of one word, and of a short period, in several documents: one leaf or few for each prefix."""
    n = 1_000_000
    texts = [(1, "a " * n), (2, "a " * n), (3, "b a c " * (n // 3)), (4, "a c b " * (n // 3)), (5, "a " * 49)]
    out = {r.doc_id: r for r in substring.report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [out[k].n_removed for k in (1, 2, 3, 4, 5)] == [0, n, 0, n // 3 * 3, 0]


def test_stages_keep_columns_of_any_name(spark):
    """Rows by row and not by id: repeated and null ids with different texts; columns named like inner ones."""
    names = "__key __nth __text __words __spans __items __id __cuts bytes words spans items cuts text_key id nth c0 c1 key n fp row".split()
    made = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{x}` int" for x in names)

    def rows(*pairs):
        return spark.createDataFrame([(i, t, "en", len(t), *range(len(names))) for i, t in pairs], made)

    six = [(i, " ".join(random.Random(k).choices("abcdefghijklmnopqrstuvwxyz", k=40))) for k, i in enumerate((5, 5, 6, None, None, None))]
    a, b = six[0][1], six[1][1]
    for find in (simhash.near_duplicates, minhash.near_copies):
        assert Counter((r.doc_id, r.text) for r in simhash.keep_one(rows(*six), find).collect()) == Counter(six)
        assert Counter((r.doc_id, r.text) for r in simhash.keep_one(rows((3, a), (5, a), (5, b), (5, b)), find).collect()) == Counter([(3, a), (5, b)])
    bench = spark.createDataFrame([(1, a)], "item_id long, text string")
    docs = rows(*six)
    for out in (simhash.keep_one(docs), decontam.remove_documents(docs, bench), decontam.remove_spans(docs, bench), substring.remove_repeats(docs), langid.keep_identified(docs)):
        assert out.columns == docs.columns and out.dtypes == docs.dtypes and all(r[4:] == tuple(range(len(names))) for r in out.collect())
    assert decontam.remove_documents(docs, bench).count() == 5


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    """Buckets dealt out in small groups find the components that whole buckets have."""
    r = random.Random(2)
    base = [f"w{r.randint(0, 999)}" for _ in range(90)]
    texts = [(k, " ".join(x if r.random() > 0.012 * (k % 3) else f"y{k}" for x in base)) for k in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = Counter((x.doc_id, x.component_id) for x in minhash.near_copies(docs).collect())
    for bound in (300, 1):
        monkeypatch.setattr(minhash, "BUCKET", bound)
        assert Counter((x.doc_id, x.component_id) for x in minhash.near_copies(docs).collect()) == want


def test_a_window_in_all_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_IDS", 30)
    window = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(k, f"{window} item{k}") for k in range(100)], "item_id long, text string")
    out = decontam.report(spark.createDataFrame([(1, f"so {window} it"), (2, "clean")], "doc_id long, text string"), bench).orderBy("doc_id").collect()
    assert (out[0].n_items, out[0].n_hit, out[0].items_sha256) == (100, 10, hashlib.sha256(",".join(sorted(map(str, range(100)))).encode()).hexdigest()) and not out[1].contaminated


def test_registered(spark, data):
    for name in ("op4_decontamination", "op6_byte_bpe", "op7_simhash", "op8_substring_dedup"):
        out = queries.QUERIES[name](spark, data)
        assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
