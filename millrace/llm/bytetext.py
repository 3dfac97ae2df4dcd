"""Vector operations on the UTF-8 bytes of many texts at once.

An Arrow string column already holds its texts as one byte buffer with offsets, so words, lines and
n-grams of a whole batch are found by array operations on that buffer. A batch is worked off in blocks
of about ``BLOCK_BYTES``; a longer text makes a block of its own, so no text is ever cut.

Null texts count as empty. Equality of words and n-grams is equality of 64-bit hashes: two given words that differ have
the same one with a chance of 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BLOCK_BYTES = 1 << 19

_rng = np.random.default_rng(20240611)
_NGRAM_MULTIPLIERS = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LANE = np.uint64(0x9FB21C651E98DF25)
#: A word's last bytes among the 8 that are read at once.
_FIRST_BYTES = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
#: Words of more bytes are hashed one at a time.
LONG_WORD = 256

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of words of letters and digits: ASCII ones and every byte of other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Consecutive texts of a batch: rows ``first`` to ``first + len(starts)`` of it."""

    first: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def sizes(self) -> np.ndarray:
        return self.ends - self.starts

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text of a value per byte."""
        total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.ends] - total[self.starts]


def text_column(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.LargeStringArray:
    column = batch.column(batch.schema.get_field_index(name))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def blocks(column: pa.LargeStringArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, n)
        base = offsets[first]
        edges = offsets[first : last + 1] - base
        yield Block(first, data[base : offsets[last]], edges[:-1], edges[1:])
        first = last
    given_back()


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def given_back() -> None:
    """A worker lives on after its task: what the batches before took, by Arrow or by numpy, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:  # glibc
        _trim(0)


@dataclass
class Words:
    """The words of a block in order; ``doc`` is the row within the block, ``bounds[d]:bounds[d + 1]`` its words."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray


def spans(block: Block, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True bytes that don't cross texts."""
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.empty(n, bool)
    begin[0] = True
    np.logical_not(member[:-1], out=begin[1:])
    edges = block.starts[block.starts < n]
    begin[edges] = True
    begin &= member
    end = np.empty(n, bool)
    end[-1] = True
    np.logical_not(member[1:], out=end[:-1])
    end[edges[edges > 0] - 1] = True
    end &= member
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs, equal for equal runs wherever they stand.

    Eight bytes of all runs are taken in at a time by two lanes, each a bijection of its state and those bytes with
    nothing linear in it; a run of up to eight bytes is told from any other of its length with certainty. Runs of
    more than ``LONG_WORD`` bytes are hashed by XXH3. Memory is in proportion to the runs and not to the longest text.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), np.uint64, buffer=padded, strides=(1,))
    size = ends - starts
    a = mix64((eight[starts] & _FIRST_BYTES[np.minimum(size, 8)]) ^ mix64(size.astype(np.uint64)))
    live = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    lanes, alive, at = mix64(a[live] ^ _LANE), np.arange(len(live)), 8
    while len(alive):
        own = live[alive]
        taken = eight[starts[own] + at] & _FIRST_BYTES[np.minimum(size[own] - at, 8)]
        a[own] = mix64(a[own] ^ taken)
        lanes[alive] = mix64((lanes[alive] + taken) * _LANE)
        at += 8
        alive = alive[size[own] > at]
    a[live] = mix64(a[live] ^ (lanes << np.uint64(17) | lanes >> np.uint64(47)))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        a[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return a


def words(block: Block, member: np.ndarray = NOT_SPACE, lower: bool = True, hashed: bool = True) -> Words:
    data = LOWER[block.data] if lower else block.data
    starts, ends = spans(block, member[block.data])
    bounds = np.searchsorted(starts, np.append(block.starts, len(block.data)))
    doc = np.repeat(np.arange(len(block)), np.diff(bounds))
    return Words(starts, ends, doc, bounds, hash_spans(data, starts, ends) if hashed else np.zeros(0, np.uint64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; positions near the end that have no n words are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out += hashes[j : j + m] * _NGRAM_MULTIPLIERS[j]
    return mix64(out)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Which of the n-grams over all words of a block lie within one text."""
    m = len(doc) - n + 1
    return doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)
