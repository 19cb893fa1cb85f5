"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split by the tokenizer's pattern. First tier: a minimal perfect hash over the vocabulary (hash and displace: n slots
for n entries, no empty slot) resolves every pre-token that is an entry as a whole. Second tier: other pre-tokens merge over
linked bytes, a heap giving the pair of lowest rank, leftmost first. Results of both tiers are remembered per worker for a
bounded number of pre-tokens of bounded length.

Scale: a map over the documents, no shuffle. The broadcast is the vocabulary with its hash, whose size the file fixes.

Defined cases: null and empty texts encode to no ids; repeated rows are kept; any valid UTF-8 encodes, and decoding returns
the same bytes; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
import struct
from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import map_batches, once

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers, twice over, and their greatest length.
REMEMBERED, LONGEST = 1 << 18, 48


class PerfectHash:
    """A minimal perfect hash of byte strings: bucket by one hash, displace each bucket until its keys fall on free slots."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        where: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            bucket, a, b = self._hashes(key)
            where[bucket].append((i, a, b))
        self.shift = [0] * self.buckets
        self.key_at: list[bytes] = [b""] * self.n
        self.index_at = [-1] * self.n
        free = iter(range(self.n))
        for bucket in sorted(range(self.buckets), key=lambda k: -len(where[k])):
            own = where[bucket]
            if len(own) == 1:  # a slot for itself: the shift names it
                slot = next(s for s in free if self.index_at[s] < 0)
                self.shift[bucket] = -1 - slot
                self._put(slot, own[0][0], keys)
                continue
            shift = 0
            while own:
                slots = [((a + shift * b) & 0xFFFFFFFF) * self.n >> 32 for _, a, b in own]
                if len(set(slots)) == len(slots) and all(self.index_at[s] < 0 for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for slot, (i, _, _) in zip(slots if own else [], own, strict=True):
                self._put(slot, i, keys)

    def _put(self, slot: int, i: int, keys: list[bytes]) -> None:
        self.index_at[slot], self.key_at[slot] = i, keys[i]

    def _hashes(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) * self.buckets >> 32, h >> 32 & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF | 1

    def find(self, key: bytes) -> int:
        """The index of a key; -1 for what is none."""
        if not self.n:
            return -1
        bucket, a, b = self._hashes(key)
        shift = self.shift[bucket]
        slot = -1 - shift if shift < 0 else ((a + shift * b) & 0xFFFFFFFF) * self.n >> 32
        return self.index_at[slot] if self.key_at[slot] == key else -1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


#: The members of the pattern's classes up to U+024F, for the standard library's faster matcher.
_LATIN_TOP = "\u024f"
_LATIN = {r"\s": "\\t-\\r \\x85\\xa0", r"\p{L}": "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f", r"\p{N}": "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"}


#: Code points that the matcher here takes for letters or numbers and the tokenizer's library (Unicode 16) does not.
_NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 "
    "10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 "
    "187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 "
    "1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e "
    "2cea2-2cead 323b0-33479 3d000-3fc3f"
)


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function that gives a text's pre-tokens; white space is Unicode's property, as in the tokenizer's library."""
    newer = "".join("-".join(f"\\U{int(x, 16):08x}" for x in run.split("-")) for run in _NEWER.split())
    names = {r"\s": r"\p{White_Space}", r"\S": r"\P{White_Space}", r"\p{L}": rf"[\p{{L}}--[{newer}]]", r"\p{N}": rf"[\p{{N}}--[{newer}]]"}
    full = regex.compile(functools.reduce(lambda x, k: x.replace(k, names[k]), names, pattern), regex.V1).findall
    inside = re.sub(r"\[[^\]]*\]", lambda m: functools.reduce(lambda x, k: x.replace(k, _LATIN[k]), _LATIN, m[0]), pattern)
    outside = functools.reduce(lambda x, k: x.replace(k, f"[{_LATIN[k]}]"), _LATIN, inside).replace(r"\S", f"[^{_LATIN[r'\s']}]")
    if re.search(r"\\[a-zA-Z](?![0-9a-f])", outside.replace(r"\t-\r", "")):  # a class that has no Latin form here
        return full
    latin, beyond = re.compile(outside).findall, re.compile(f"[^\0-{_LATIN_TOP}]").search
    return lambda text: full(text) if beyond(text) else latin(text)


class Codec(dict):
    """Encodes and decodes; as a dict, the remembered ids of pre-tokens as packed little-endian 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash, pattern: str) -> None:
        self.whole, self.number = whole, list(ranks.values())
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.byte_rank = [ranks.get(bytes([b]), -1) for b in range(256)]
        self.width = max(self.number, default=0) + 1
        #: rank of a merge by the ranks of its two parts, as left * width + right
        self.pair = {ranks[t[:i]] * self.width + ranks[t[i:]]: rank for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.split = _splitter(pattern)
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode()
            at = self.whole.find(raw)
            ids = [self.number[at]] if at >= 0 else self.merge(raw)
            found = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found

    def merge(self, raw: bytes) -> list[int]:
        """Ranks of the parts that are left when no pair of neighbours is in the vocabulary."""
        get, width, n = self.pair.get, self.width, len(raw)
        part = [self.byte_rank[b] for b in raw]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        joint = [get(a * width + b, -1) for a, b in pairwise(part)] + [-1]  # rank of a part with the next
        heap = [r << 40 | i for i, r in enumerate(joint) if r >= 0]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            if joint[i] != rank:
                continue  # one of the two has merged since
            part[i], joint[after[i]] = rank, -1
            k = after[i] = after[after[i]]
            joint[i] = -1
            if k < n:
                before[k] = i
                if (r := get(rank * width + part[k], -1)) >= 0:
                    joint[i] = r
                    heapq.heappush(heap, r << 40 | i)
            if (h := before[i]) >= 0:
                joint[h] = r = get(part[h] * width + rank, -1)
                if r >= 0:
                    heapq.heappush(heap, r << 40 | h)
        out, i = [], 0
        while i < n:
            out.append(part[i])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.split(text or "")))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def vocabulary(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    ranks = read_ranks(path)
    return ranks, PerfectHash(list(ranks))


def codec(path: str, pattern: str) -> Codec:
    return Codec(*vocabulary(path), pattern)


def _codec_of(model: tuple) -> Codec:
    return Codec(*model)


def _share(docs: DataFrame, path: str | None):
    path = path or public_tokenizers.path(VOCABULARY)
    return docs.sparkSession.sparkContext.broadcast((*vocabulary(path), public_tokenizers.PATTERN))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes they decode to, of each row."""
    shared = _share(docs, path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = once(shared, _codec_of)
        n, of_ids, of_bytes = [], [], []
        for text in batch.column(1).to_pylist():
            ids = own.encode(text)
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) and the SHA-256 of the bytes they decode to, of each row."""
    shared = _share(docs, path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = once(shared, _codec_of)
        packed = [own.encode(t) for t in batch.column(1).to_pylist()]
        ids = pa.array([np.frombuffer(x, "<i4") for x in packed], pa.list_(pa.int32()))
        digest = [hashlib.sha256(own.decode(x)).hexdigest() for x in packed]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), ids, pa.array(digest)], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), each, "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of `encode`; bytes that are no UTF-8 become replacement characters."""
    shared = _share(encoded, path)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = once(shared, _codec_of)
        texts = [own.decode(np.array(x or [], "<u4").tobytes()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>")), each, "doc_id long, text string")
