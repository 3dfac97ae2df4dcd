"""Best-fit packing of token sequences by linear grouping.

Texts become token ids with an end id; only those longer than the capacity are cut. The counts of pieces by length,
at most ``capacity`` numbers, reach the driver and are packed there as counts:

1. Large lengths, over a third of the capacity, are sorted and dealt to ``GROUPS`` groups of equal cardinality; each is
   rounded up to its group's largest, so few sizes are left.
2. Over those sizes the configurations of a bin are optimised: a linear program that covers all counts with the
   fewest bins, whose configurations are generated as they pay, by a knapsack over the sizes' dual prices. Its whole
   parts are used; the rest of the counts is packed by the fullest choice for the largest size left.
3. The pieces' own lengths replace the rounded ones, group by group, which frees what rounding had added.
4. Small lengths, largest first, go to the bins that they fill best; those left over get bins of their own.

The plan is a list of runs, bins of equal content, as long as there are lengths and configurations and not longer
with more pieces. Each piece then looks up its place by its length and its rank within its length. Ranks come from
counts by (length, part); a length has as many parts, by a hash of the piece, as it needs of ``RANK_ROWS`` pieces, so a
length that many pieces share is never in one task.

Null and empty texts are one piece, the end id alone. Repeated rows are packed each on their own. Pieces of equal length
are interchangeable: which of them takes which place may differ from run to run, the number of sequences doesn't.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bytetext import blocks, text_column
from millrace.llm.common import checkpointed

CAPACITY = 2048
#: Groups of equal cardinality; lengths up to capacity / SMALL are packed last.
GROUPS = 64
SMALL = 3
#: Pieces of one length that are ranked in one task, about.
RANK_ROWS = 20_000
MEMO_ENTRIES = 1_000_000


# --- tokens


#: Lower-case letters of ASCII and Latin-1 in UTF-8, which no normalization changes, and what may follow them.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([.,;:!?*#$%&|]*)")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class WordEncoder(dict):
    """A memo from words to their ids, as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and nothing it does reaches across ASCII white space, so a text's ids are those
    of its words one after another. ASCII letters are folded to lower case first, as the tokenizer would, but not
    where its special tokens could be meant. A word of plain letters, with or without signs after it, is one or two
    pre-tokens, which go to the tokenizer's model directly; any other word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        self.parts: dict[bytes, bytes] = {}
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}

    def part(self, letters: bytes) -> bytes:
        """The ids of one pre-token."""
        found = self.parts.get(letters)
        if found is None:
            symbols = letters.decode() if letters.isascii() else letters.decode("latin-1").translate(self.symbols)
            ids = [t.id for t in self.model.tokenize(symbols)]
            found = self.parts[letters] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def __missing__(self, word: bytes) -> bytes:
        if len(self) + len(self.parts) >= MEMO_ENTRIES:
            self.clear()
            self.parts.clear()
        plain = _PLAIN.fullmatch(word)
        if plain:
            found = self.part(plain[1]) + self.part(plain[2]) if plain[2] else self.part(plain[1])
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
            found = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = found
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text."""
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


_encoders: dict[int, WordEncoder] = {}

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_json: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each whole text: (doc_id, piece, start, length, ids_crc32) and, if asked, its ids."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)
    schema = T.StructType.fromDDL(PIECE + (", ids array<long>" if with_ids else ""))
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _encoders:
            _encoders[key] = WordEncoder(shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for block in blocks(text_column(batch)):
                for i in range(len(block)):
                    data = _encoders[key].encode(block.text(i)) + last
                    for k, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        row = (ids[block.first + i], k, k * capacity, len(part) // 4, zlib.crc32(part))
                        for values, v in zip(out, row, strict=False):
                            values.append(v)
                        if with_ids:
                            out[5].append(np.frombuffer(part, "<u4").astype(np.int64))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=False)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


# --- the plan

Run = tuple[int, int]  # a length and how many


def _grouped(large: list[Run], groups: int) -> list[list[Run]]:
    """Runs of descending lengths dealt to at most ``groups`` groups of equal cardinality."""
    total = sum(n for _, n in large)
    size = max(1, -(-total // groups))
    out: list[list[Run]] = [[]]
    room = size
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return [g for g in out if g]


def _fullest(room: int, sizes: list[int], left: list[int]) -> dict[int, int]:
    """Which sizes, given by place and how many of each, fill the room best; large ones where that is equal."""
    reach, seen = 1, []
    mask = (1 << (room + 1)) - 1
    for j, s in enumerate(sizes):
        if not left[j] or s > room:
            continue
        before = reach
        for _ in range(min(left[j], room // s)):
            more = (reach | reach << s) & mask
            if more == reach:
                break
            reach = more
        seen.append((j, s, before))
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    use: dict[int, int] = {}
    for j, s, before in reversed(seen):
        while not before >> at & 1:
            at -= s
            use[j] = use.get(j, 0) + 1
    return use


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, {place of a size: how many in a bin}) until all counts are used; sizes descend."""
    left, out = list(counts), []
    for j, s in enumerate(sizes):
        while left[j]:
            left[j] -= 1
            use = _fullest(capacity - s, sizes, left)
            left[j] += 1
            use[j] = use.get(j, 0) + 1
            times = min(left[k] // m for k, m in use.items())
            for k, m in use.items():
                left[k] -= times * m
            out.append((times, use))
    return out


def _best_column(sizes: list[int], price: np.ndarray, capacity: int) -> np.ndarray:
    """The configuration of highest price: how many of each size."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    size = np.array(sizes)
    for c in range(int(size.min()), capacity + 1):
        fits = np.flatnonzero(size <= c)
        value = worth[c - size[fits]] + price[fits]
        k = int(np.argmax(value))
        if value[k] > worth[c - 1] + 1e-12:
            worth[c], last[c] = value[k], fits[k]
        else:
            worth[c] = worth[c - 1]
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            out[last[c]] += 1
            c -= sizes[last[c]]
    return out


def optimised(sizes: list[int], counts: list[int], capacity: int, rounds: int = 1000) -> list[tuple[int, dict[int, int]]]:
    """(how often, {place of a size: how many in a bin}): the whole parts of the linear program's configurations.

    The revised simplex method: every basis covers the counts, so stopping after ``rounds`` costs bins and no piece.
    """
    if not sizes:
        return []
    need = np.array(counts, float)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        amount = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(len(sizes)))
        column = _best_column(sizes, price, capacity)
        if price @ column <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, column)
        up = np.flatnonzero(change > 1e-9)
        ratio = np.maximum(amount[up], 0) / change[up]
        basis[:, up[int(np.argmin(ratio))]] = column
    amount = np.linalg.solve(basis, need)
    left, out = list(counts), []
    for column, x in zip(basis.T, amount, strict=True):
        use = {int(j): int(column[j]) for j in np.flatnonzero(column)}
        times = min([int(x + 1e-6), *(left[j] // m for j, m in use.items())])
        if times > 0:
            out.append((times, use))
            for j, m in use.items():
                left[j] -= times * m
    return out + configurations(sizes, left, capacity)


Plan = list[tuple[int, int, list[int]]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> Plan:
    """Runs of bins, (first bin, how many, the lengths in each of them), that hold all pieces of the counted lengths.

    Where there are few pieces, the linear program's fractions cost more than it gains, so the plan that takes every
    configuration by the fullest choice is made too, and the one of fewer bins is returned.
    """
    made = [_planned(counts, capacity, groups, small, way) for way in (optimised, configurations)]
    return min(made, key=lambda runs: sum(n for _, n, _ in runs))


def _planned(counts: dict[int, int], capacity: int, groups: int, small: int, configured) -> Plan:
    limit = capacity // small
    large = sorted(((s, n) for s, n in counts.items() if s > limit and n), reverse=True)
    minor = sorted(((s, n) for s, n in counts.items() if s <= limit and n), reverse=True)
    grouped = _grouped(large, groups)
    by_size: dict[int, list[Run]] = {}
    for g in grouped:
        by_size.setdefault(g[0][0], []).extend(g)
    sizes = sorted(by_size, reverse=True)
    todo = [list(reversed(by_size[s])) for s in sizes]
    bins: list[tuple[int, list[int]]] = []
    for times, use in configured(sizes, [sum(n for _, n in by_size[s]) for s in sizes], capacity):
        slots = []
        for j, m in sorted(use.items()):
            for _ in range(m):
                need, slot = times, []
                while need:
                    length, n = todo[j].pop()
                    take = min(n, need)
                    slot.append((length, take))
                    need -= take
                    if n > take:
                        todo[j].append((length, n - take))
                slots.append(slot)
        cuts = sorted({c for slot in slots for c in np.cumsum([n for _, n in slot]).tolist()})
        at, before = [0] * len(slots), 0
        ends = [np.cumsum([n for _, n in slot]).tolist() for slot in slots]
        for cut in cuts:
            content = []
            for k, slot in enumerate(slots):
                while ends[k][at[k]] <= before:
                    at[k] += 1
                content.append(slot[at[k]][0])
            bins.append((cut - before, content))
            before = cut
    return _with_small(bins, minor, capacity)


def _with_small(bins: list[tuple[int, list[int]]], minor: list[Run], capacity: int) -> list[tuple[int, int, list[int]]]:
    free: dict[int, list[tuple[int, list[int]]]] = {}
    for n, content in bins:
        free.setdefault(capacity - sum(content), []).append((n, content))
    slacks = sorted(free)
    rest: list[Run] = []

    def put(slack: int, run: tuple[int, list[int]]) -> None:
        if slack not in free:
            free[slack] = []
            bisect.insort(slacks, slack)
        free[slack].append(run)

    for s, n in minor:
        while n:
            k = bisect.bisect_left(slacks, s)
            if k == len(slacks):
                break
            slack = slacks[k]
            have, content = free[slack].pop()
            if not free[slack]:
                del free[slack]
                slacks.pop(k)
            if have > n:
                put(slack, (have - n, content))
                have = n
            # Where a whole run has room for several, they go in together.
            m = max(1, min(slack // s, n // have)) if slack >= 2 * s else 1
            put(slack - m * s, (have, content + [s] * m))
            n -= m * have
        if n:
            rest.append((s, n))
    made = [run for runs in free.values() for run in runs]
    sizes = [s for s, _ in rest]
    made += [(times, [sizes[j] for j, m in sorted(use.items()) for _ in range(m)]) for times, use in configurations(sizes, [n for _, n in rest], capacity)]
    out, first = [], 0
    for n, content in made:
        out.append((first, n, content))
        first += n
    return out


def places(runs: list[tuple[int, int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, the bins of those ranks, and the offset in the bin."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for first, n, content in runs:
        offset = 0
        for length in content:
            found.setdefault(length, []).append((n, first, offset))
            offset += length
    out = {}
    for length, own in found.items():
        n, first, offset = (np.array(x, np.int64) for x in zip(*own, strict=True))
        out[length] = (np.cumsum(n) - n, first, offset)
    return out


# --- the packing


def pack(df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows with a ``length`` of 1 to ``capacity`` and, of each (doc_id, piece), with ``sequence_id`` and ``offset``.

    The rows are read twice and must be the same both times; pass a stored table.
    """
    total = np.zeros(capacity + 1, np.int64)
    for r in df.groupBy("length").agg(F.count("*").alias("n")).collect():
        total[r.length] = r.n
    parts = 1 + total // RANK_ROWS
    first = np.cumsum(parts) - parts
    wanted = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("length").cast("int") + 1)
    keyed = df.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "start"), wanted).cast("int"))
    # One number for each part, about as many as lengths and a RANK_ROWS-th of the pieces.
    before = np.zeros(int(parts.sum()), np.int64)
    for r in keyed.groupBy("length", "_part").agg(F.count("*").alias("n")).collect():
        before[first[r.length] + r._part] = r.n
    run_up = np.cumsum(before) - before
    before = run_up - np.repeat(run_up[first], parts)
    at = places(plan({int(s): int(total[s]) for s in np.flatnonzero(total)}, capacity))
    shared = df.sparkSession.sparkContext.broadcast((first, before, at))
    schema = T.StructType([*df.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_part, before, at = shared.value
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            part = batch.column(batch.schema.get_field_index("_part")).to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            key = first_part[length] + part
            order = np.argsort(key, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1], [True]))) if len(key) else np.zeros(0, int)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                rows = order[a:b]
                own = int(length[rows[0]]), int(part[rows[0]])
                rank = before[first_part[own[0]] + own[1]] + seen.get(own, 0) + np.arange(b - a)
                seen[own] = seen.get(own, 0) + b - a
                ranks, first, where = at[own[0]]
                k = np.searchsorted(ranks, rank, side="right") - 1
                sequence[rows], offset[rows] = first[k] + rank - ranks[k], where[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(sequence), pa.array(offset)], names=schema.names)

    # All rows of a (length, part) are in one task, in whatever order: only their number matters.
    return keyed.repartition("length", "_part").mapInArrow(run, schema)


def packed(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of all texts with their places; the pieces are stored in the shared folder in between."""
    import public_tokenizers

    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        tokenizer = f.read()
    return pack(checkpointed(pieces(docs, tokenizer, capacity)), capacity)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
