"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token. Tier two: for
the rest, a heap over a linked list of the pre-token's bytes merges the adjacent pair of least rank, leftmost
first, until none is left. Both tiers sit behind a bounded memo of pieces already encoded in this worker.

Texts are cut by the vocabulary's pattern. With the public tokenizers' pattern, cutting first at white space and caching
the pieces between is exact: it never matches across those cuts. With any other pattern, texts are cut by it alone.
Null texts are empty and have no tokens; every UTF-8 text decodes to itself; repeated rows are encoded alike, each on
its own. Of adjacent pairs of equal rank the leftmost is merged first.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from millrace.llm.common import append_columns

#: Entries of the worker's memo; when it is full it starts anew.
MEMO_ENTRIES = 900_000

_MASK = (1 << 64) - 1
_SPREAD, _MULTIPLY = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, slots 0 to n - 1.

    Keys are dealt to buckets of four on average. A bucket of several keys stores the displacement that moves
    all of them to free slots, found largest bucket first; a bucket of one stores its slot itself.
    """

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        if len(np.unique(hashes)) != n:
            raise ValueError("keys repeat")
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(edges)
        displacement = np.zeros(self.buckets, np.int64)
        slot_of = np.full(n, -1, np.int64)
        taken = np.zeros(n, bool)
        tries = np.arange(256, dtype=np.uint64)[:, None]
        for b in np.argsort(-size, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            base = 0
            while True:
                moved = (hashes[own] ^ (tries + np.uint64(base)) * np.uint64(_SPREAD)) * np.uint64(_MULTIPLY)
                slots = ((moved >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
                fits = ~taken[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                fits &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fits.any():
                    d = int(np.argmax(fits))
                    displacement[b] = base + d
                    slot_of[own] = slots[d]
                    taken[slots[d]] = True
                    break
                base += len(tries)
                if base > 64 * n + 4096:
                    raise ValueError("no displacement found")
        alone = np.flatnonzero(size == 1)
        free = np.flatnonzero(~taken)
        displacement[alone] = -1 - free[: len(alone)]
        slot_of[order[edges[alone]]] = free[: len(alone)]
        self.displacement = displacement.tolist()
        self.slot_of = slot_of

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.buckets]
        if d < 0:
            return -1 - d
        return (((h ^ (d * _SPREAD & _MASK)) * _MULTIPLY & _MASK) >> 32) % self.n


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys, self.ids = [b""] * len(keys), [0] * len(keys)
        for key, slot in zip(keys, self.hash.slot_of.tolist(), strict=True):
            self.keys[slot], self.ids[slot] = key, ranks[key]
        self.name = hashlib.sha256(repr((pattern, sorted(ranks.items()))).encode()).hexdigest()

    def whole(self, piece: bytes) -> int | None:
        """The id of a piece that is a token."""
        slot = self.hash.slot(piece)
        return self.ids[slot] if self.keys[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """The ids of a piece by merging its bytes."""
        ranks, n = self.ranks, len(piece)
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        alive = [True] * (n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or after[after[i]] != end:
                continue
            middle = after[i]
            alive[middle] = False
            after[i] = end
            if end <= n:
                before[end] = i
            if end < n:
                rank = ranks.get(piece[i : after[end]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            left = before[i]
            if left >= 0:
                rank = ranks.get(piece[left:end])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out


#: A white-space run but its last space, a space with what follows, or the rest of a run.
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space to Python's re alone.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f")


def _public_pattern() -> str | None:
    """The pattern for which the coarse cut is known to be exact."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return public_tokenizers.PATTERN


class Encoder(dict):
    """A memo from pieces of text to their ids, as decimal numbers joined by commas."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.tokens = {str(i): key for key, i in vocabulary.ranks.items()}
        self.inner: dict[str, str] = {}
        self.coarse = vocabulary.pattern == _public_pattern()

    def __missing__(self, piece: str) -> str:
        if len(self) + len(self.inner) >= MEMO_ENTRIES:
            self.clear()
            self.inner.clear()
        found = []
        for token in self.find(piece):
            ids = self.inner.get(token)
            if ids is None:
                data = token.encode()
                one = self.vocabulary.whole(data)
                ids = str(one) if one is not None else ",".join(map(str, self.vocabulary.merged(data)))
                if len(token) < 64:
                    self.inner[token] = ids
            found.append(ids)
        ids = ",".join(found)
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> str:
        """The ids of a whole text as decimal numbers joined by commas."""
        pieces = _COARSE.findall(text) if self.coarse and not any(c in text for c in _ODD) else self.find(text)
        return ",".join(map(self.__getitem__, pieces))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(","))) if ids else b""


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder of a vocabulary."""
    if vocabulary.name not in _encoders:
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``ids``, the token ids of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        e = encoder(shared.value)
        return lambda column: [pa.array([[int(i) for i in e.encode(t).split(",") if i] for t in column.to_pylist()], pa.list_(pa.int32()))]

    return append_columns(docs, "ids array<int>", make, text, keep)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes that the ids stand for; null ids are none."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    from pyspark.sql import functions as F

    def make():
        e = encoder(shared.value)
        return lambda column: [pa.array([e.decode(t) for t in column.to_pylist()], pa.binary())]

    joined = df.withColumn("_ids", F.array_join(F.col(ids).cast("array<string>"), ","))
    return append_columns(joined, "decoded binary", make, "_ids", keep=df.columns)


def digests(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the number of tokens of each text, the sha256 of its ids and of the bytes they decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        e = encoder(shared.value)

        def f(column: pa.LargeStringArray) -> list[pa.Array]:
            n, ids_sha, decoded_sha = [], [], []
            for t in column:
                ids = e.encode(t.as_py())
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(e.decode(ids)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]

        return f

    return append_columns(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, text, keep)


def op9_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    vocabulary = Vocabulary(read_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, keep=["doc_id"])
