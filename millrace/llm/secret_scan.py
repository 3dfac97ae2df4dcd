"""Secret scans: fixed patterns, and formats learned from the credentials that those patterns find.

The patterns label credentials (assigned values, access keys, hex strings). From at most ``PER_KIND`` distinct ones
of each kind, of at most ``LONGEST`` bytes, a probabilistic automaton over byte classes is learned by state merging
(see ``automata``), and from those of all kinds together one over coarse classes, of what formats have in common.
Ordinary words are the other runs of 12 or more token characters that don't mix letters with digits; all of them in
all texts, as often as they occur, are counted into a background automaton. Every run of 12 or more token characters
that mixes them is then a candidate: one that a format explains better than the background by ``MARGIN`` nats, at no less
than ``PER_BYTE`` per byte, is a secret of kind "format"; where patterns' spans overlap it, what they leave of it in
pieces of 12 or more characters. Mixed runs are in neither training set, so keys that no pattern knows don't become
ordinary by being frequent; a run of letters or of digits alone is ordinary by definition.

Offsets count code points, ends are exclusive, and a span is the whole match of its pattern. Null texts are empty and
empty texts have no spans; repeated rows have the same spans, each its own; of credentials that are taken for training
those first by a hash count, and equal hashes are ordered by value. Without labelled credentials there are no formats.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.automata import CLASS_OF, CLASSES, CONTEXTS, Automaton, Background, context_counts, learn
from millrace.llm.bytetext import LOWER, Block, blocks, spans, text_column
from millrace.llm.common import append_columns, checkpointed

#: Distinct labelled credentials of each kind from which automata are learned, at most, and their bytes.
PER_KIND, LONGEST = 400, 4096
#: Parts by which a kind's credentials are ranked first, so that no task holds more than ``PER_KIND`` of each part.
RANK_PARTS = 256
MARGIN, PER_BYTE = 12.0, 0.5
CANDIDATE = 12
KINDS = ("assign", "access", "hex", "format")

#: Fixed patterns of the contract; bytes patterns ignore the case of ASCII letters alone.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[b for b in range(128) if CLASS_OF[b] not in (10, 11)]] = True

Span = tuple[int, int, int]  # start, kind's place in KINDS, end, in bytes of the text


def _rows_with(data: bytes, needles: tuple[bytes, ...], starts: np.ndarray) -> set[int]:
    found: set[int] = set()
    for needle in needles:
        at = data.find(needle)
        while at >= 0:
            row = int(np.searchsorted(starts, at, side="right")) - 1
            found.add(row)
            following = int(starts[row + 1]) if row + 1 < len(starts) else len(data)
            at = data.find(needle, following)
    return found


def base_spans(block: Block) -> dict[int, list[Span]]:
    """The patterns' spans by row of the block, each list sorted; rows without any are left out."""
    out: dict[int, list[Span]] = {}
    for row in _rows_with(LOWER[block.data].tobytes(), _KEYWORDS, block.starts):
        for m in ASSIGN.finditer(block.text(row)):
            if len(m[2]) >= ASSIGN_LEAST:
                out.setdefault(row, []).append((m.start(), 0, m.end()))
    for row in _rows_with(block.data.tobytes(), (b"AKIA",), block.starts):
        for m in ACCESS.finditer(block.text(row)):
            if m.end() - m.start() >= ACCESS_LEAST:
                out.setdefault(row, []).append((m.start(), 1, m.end()))
    starts, ends = spans(block, _HEX[block.data])
    long = ends - starts >= HEX_LEAST
    rows = np.searchsorted(block.starts, starts[long], side="right") - 1
    for row, a, b in zip(rows.tolist(), starts[long].tolist(), ends[long].tolist(), strict=True):
        out.setdefault(row, []).append((a - int(block.starts[row]), 2, b - int(block.starts[row])))
    for found in out.values():
        found.sort()
    return out


def _candidates(block: Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = spans(block, _TOKEN[block.data])
    long = ends - starts >= CANDIDATE
    return starts[long], ends[long]


def _mixed(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which runs hold both letters and digits."""
    classes = CLASS_OF[block.data]
    held = []
    for of in (classes == 0, (classes > 0) & (classes < 5)):
        total = np.concatenate(([0], np.cumsum(of)))
        held.append(total[ends] > total[starts])
    return held[0] & held[1]


class Formats:
    """Automata of credentials and of ordinary words."""

    def __init__(self, formats: list[Automaton], ordinary: Background | Automaton | None):
        self.formats, self.ordinary = formats, ordinary

    def spans(self, block: Block) -> dict[int, list[Span]]:
        """All candidates that a format explains, by row of the block."""
        starts, ends = _candidates(block)
        mixed = _mixed(block, starts, ends)
        starts, ends = starts[mixed], ends[mixed]
        if not self.formats or self.ordinary is None or not len(starts):
            return {}
        best = np.max([f.log_likelihood(block.data, starts, ends) for f in self.formats], axis=0)
        gain = best - self.ordinary.log_likelihood(block.data, starts, ends)
        hit = np.flatnonzero((gain >= MARGIN) & (gain >= PER_BYTE * (ends - starts)))
        out: dict[int, list[Span]] = {}
        for i in hit.tolist():
            row = int(np.searchsorted(block.starts, starts[i], side="right")) - 1
            out.setdefault(row, []).append((int(starts[i] - block.starts[row]), 3, int(ends[i] - block.starts[row])))
        return out


def all_spans(block: Block, formats: Formats) -> dict[int, list[Span]]:
    base, more = base_spans(block), formats.spans(block)
    for row, found in more.items():
        own = base.get(row, [])
        free: list[Span] = []
        for start, kind, end in found:
            # What the patterns' spans leave of a run stays a secret, in pieces of a candidate's length.
            covered = sorted((a, b) for a, _, b in own if a < end and start < b)
            at = start
            for a, b in [*covered, (end, end)]:
                if a - at >= CANDIDATE:
                    free.append((at, kind, a))
                at = max(at, b)
        if free:
            base[row] = sorted(own + free)
    return base


def in_code_points(text: bytes, found: list[Span]) -> list[Span]:
    """The spans with offsets in code points instead of bytes."""
    at = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=at[1:])
    return [(int(at[a]), k, int(at[b])) for a, k, b in found]


def _ordinary(block: Block, base: dict[int, list[Span]]) -> tuple[np.ndarray, np.ndarray]:
    """The candidates that no pattern's span overlaps and that don't mix letters with digits."""
    starts, ends = _candidates(block)
    covered = np.zeros(len(block.data) + 1, np.int64)
    for row, own in base.items():
        for a, _, b in own:
            covered[block.starts[row] + a] += 1
            covered[block.starts[row] + b] -= 1
    total = np.concatenate(([0], np.cumsum(np.cumsum(covered[:-1]) > 0)))
    plain = (total[ends] == total[starts]) & ~_mixed(block, starts, ends)
    return starts[plain], ends[plain]


EXAMPLES = "kind string, value binary, n long"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, value) of the credentials, each once a block, and at the end (context, n) of the ordinary words."""
    names = [x.split()[0] for x in EXAMPLES.split(", ")]
    counts = np.zeros(CONTEXTS * (CLASSES + 1), np.int64)
    for batch in batches:
        found: set[tuple[str, bytes]] = set()
        for block in blocks(text_column(batch)):
            base = base_spans(block)
            for row, own in base.items():
                text = block.text(row)
                for a, k, b in own:
                    value = ASSIGN.fullmatch(text[a:b])[2] if k == 0 else text[a:b]
                    if len(value) <= LONGEST:
                        found.add((KINDS[k], value))
            counts += context_counts(block.data, *_ordinary(block, base))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.binary()), pa.nulls(len(found), pa.int64())], names=names)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(used), pa.string()), pa.array([str(i).encode() for i in used.tolist()], pa.binary()), pa.array(counts[used])], names=names)


def learn_formats(docs: DataFrame, per_kind: int = PER_KIND, without: Sequence[str] = ()) -> Formats:
    """Automata from credentials of all texts: of each kind the ``per_kind`` distinct ones first by a hash.

    Kinds in ``without`` are left out, to measure how well the others' formats find them.
    """
    found = checkpointed(docs.select("text").mapInArrow(_examples, EXAMPLES))
    counts = np.zeros(CONTEXTS * (CLASSES + 1), np.int64)
    for r in found.where("kind is null").groupBy("value").agg(F.sum("n").alias("n")).collect():
        counts[int(bytes(r.value))] = r.n
    order = (F.xxhash64("value"), F.col("value"))
    first = lambda df, *by: df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= per_kind)
    known = found.where(F.col("kind").isNotNull() & ~F.col("kind").isin(list(without))).select("kind", "value").distinct()
    known = first(known.withColumn("part", F.pmod(F.xxhash64("value", F.lit(1)), F.lit(RANK_PARTS))), "kind", "part")
    by: dict[str, list[bytes]] = {}
    for kind, value in first(known, "kind").select("kind", "value").collect():
        by.setdefault(kind, []).append(bytes(value))
    whole = learn(sorted({v for own in by.values() for v in own}), coarse=True)
    return Formats([a for k in sorted(by) if (a := learn(by[k]))] + ([whole] if whole else []), Background(counts))


FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long"


def _named(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def secret_scan(docs: DataFrame, formats: Formats, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts, the digest of the patterns' spans, and all spans as text."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)

    def make():
        f = shared.value

        def run(column: pa.LargeStringArray) -> list[pa.Array]:
            n = len(column)
            number = np.zeros((len(KINDS), n), np.int64)
            named, digest = [""] * n, [hashlib.sha256(b"").hexdigest()] * n
            for block in blocks(column):
                for row, found in all_spans(block, f).items():
                    points = in_code_points(block.text(row), found)
                    i = block.first + row
                    for _, k, _ in points:
                        number[k, i] += 1
                    named[i] = _named(points)
                    digest[i] = hashlib.sha256(_named([s for s in points if s[1] < 3]).encode()).hexdigest()
            return [*[pa.array(number[k]) for k in range(3)], pa.array(digest), pa.array(named), pa.array(number[3])]

        return run

    return append_columns(docs, FIELDS, make, keep=keep)


def redact(docs: DataFrame, formats: Formats, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones together, replaced by ``mark``; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(formats)
    replacement = mark.encode()

    def make():
        f = shared.value

        def run(column: pa.LargeStringArray) -> list[pa.Array]:
            changed: dict[int, str] = {}
            for block in blocks(column):
                for row, found in all_spans(block, f).items():
                    text, out, at = block.text(row), [], 0
                    for a, _, b in found:
                        if a >= at:
                            out += [text[at:a], replacement]
                        at = max(at, b)
                    changed[block.first + row] = (b"".join(out) + text[at:]).decode()
            return [pa.array([changed.get(i) for i in range(len(column))], pa.string())]

        return run

    out = append_columns(docs, "_redacted string", make)
    return out.withColumn("text", F.coalesce("_redacted", "text")).drop("_redacted")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(docs, learn_formats(docs), keep=["doc_id"])
