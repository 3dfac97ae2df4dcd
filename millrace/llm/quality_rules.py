"""Quality rules: counted properties of a text and a calibrated n-gram logistic regression.

The model sees hashed word 1- and 2-grams and hashed 3- and 5-grams of characters (code points), each group as shares
of its own total, so a text's length does not move its score. It is trained on at most ``PER_CLASS`` labelled texts of
each class, Platt-scaled on a third of them that the weights have not seen, and applied in Arrow batches.
Of rows that share a labelled id the largest text trains; equal hashes of ids are ordered by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import ALNUM, Block, Words, blocks, mix64, ngrams, text_column, within, words
from millrace.llm.common import append_columns, labelled_sample
from millrace.llm.linear import Sparse, fit_logistic, platt, sigmoid

#: Labelled texts of each class that train the model, at most.
PER_CLASS = 1200
#: A text is kept only if its probability of good quality is at least this.
KEEP_AT = 0.1
#: Fixed rules: fewest words, and the largest share of words in repeated 3-word windows.
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
BITS = 17
GROUPS = 4
SCALE = 20.0

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def repeated_words(w: Words, n: int = 3) -> np.ndarray:
    """For each text the words that lie in a window of n words found twice or more in it, the first one included."""
    grams = ngrams(w.hashes, n)
    inside = np.flatnonzero(within(w.doc, n))
    doc = w.doc[inside]
    key = mix64(grams[inside] + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] = same
    again[:-1] |= same
    covered = np.zeros(len(w.doc) + n, bool)
    hit = inside[order[again]]
    for j in range(n):
        covered[hit + j] = True
    return np.bincount(w.doc[covered[: len(w.doc)]], minlength=len(w.bounds) - 1)


def duplicate_lines(block: Block) -> np.ndarray:
    """For each text the lines that hold a word and equal an earlier line of it."""
    out = np.zeros(len(block), np.int64)
    for i in range(len(block)):
        lines = [x for x in block.text(i).split(b"\n") if x and not x.isspace()]
        out[i] = len(lines) - len(set(lines))
    return out


def counts(block: Block, w: Words) -> dict[str, np.ndarray]:
    n_words = np.diff(w.bounds)
    member = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(member, w.starts, 1)
    np.add.at(member, w.ends, -1)
    in_word = np.cumsum(member[:-1]).astype(bool)
    repeat = repeated_words(w)
    return {
        "n_words": n_words,
        "word_chars": block.per_text(in_word & ((block.data & 0xC0) != 0x80)),
        "n_symbols": block.per_text(_SYMBOL[block.data]),
        "n_dup_lines": duplicate_lines(block),
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words),
    }


def characters(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The code points of a block's texts, each as its bytes in one number, and the text of each."""
    first = np.flatnonzero((block.data & 0xC0) != 0x80)
    size = np.diff(np.append(first, len(block.data)))
    out = block.data[first].astype(np.uint64)
    for k in (1, 2, 3):
        more = np.flatnonzero(size > k)
        out[more] |= block.data[first[more] + k].astype(np.uint64) << np.uint64(8 * k)
    return out, np.repeat(np.arange(len(block)), block.sizes)[first]


def _features(block: Block) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group (row of each n-gram, its hashed index)."""
    shift = np.uint64(64 - BITS)
    w = words(block, ALNUM)
    out = [(w.doc, (w.hashes >> shift).astype(np.int64))]
    two = within(w.doc, 2)
    out.append((w.doc[:-1][two], (ngrams(w.hashes, 2) >> shift)[two].astype(np.int64)))
    chars, doc = characters(block)
    for n in (3, 5):
        inside = within(doc, n)
        grams = ngrams(chars, n)
        out.append((doc[: len(grams)][inside], (grams >> shift)[inside].astype(np.int64)))
    return [(rows, index + (k << BITS)) for k, (rows, index) in enumerate(out)]


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    a: float
    c: float

    def probability(self, block: Block) -> np.ndarray:
        z = np.full(len(block), self.intercept)
        for rows, index in _features(block):
            total = np.bincount(rows, minlength=len(block))
            z += SCALE * np.bincount(rows, self.weights[index], minlength=len(block)) / np.maximum(total, 1)
        return sigmoid(self.a * z + self.c)


def _sparse(column: pa.LargeStringArray) -> Sparse:
    ptr, index, value = [0], [], []
    for block in blocks(column):
        groups = _features(block)
        ends = [np.searchsorted(rows, np.arange(len(block) + 1)) for rows, _ in groups]
        for i in range(len(block)):
            n = 0
            for (_, feature), end in zip(groups, ends, strict=True):
                own, times = np.unique(feature[end[i] : end[i + 1]], return_counts=True)
                index.append(own)
                value.append(SCALE * times / max(1, times.sum()))
                n += len(own)
            ptr.append(ptr[-1] + n)
    return Sparse(np.array(ptr), np.concatenate(index) if index else np.zeros(0, np.int64), np.concatenate(value) if value else np.zeros(0))


def fit(column: pa.LargeStringArray, y: np.ndarray) -> Model:
    """Weights from two thirds of the rows, the scaling from the rest; without both classes, a constant 0.5."""
    dim = GROUPS << BITS
    if len(np.unique(y)) < 2:
        return Model(np.zeros(dim, np.float32), 0.0, 0.0, 0.0)
    x = _sparse(column)
    part = np.arange(len(y)) % 3
    train, rest = np.flatnonzero(part != 0), np.flatnonzero(part == 0)
    w, b = fit_logistic(x.take(train), y[train], dim)
    own = x.take(rest)
    z = np.bincount(own.rows, own.value * w[own.index], minlength=len(rest)) + b
    return Model(w.astype(np.float32), b, *platt(z, y[rest]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model, fitted in one task on the bounded sample; only its weights come to the driver."""

    def run(batches):
        batches = list(batches)
        if batches:
            rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending")])
            m = fit(text_column(rows), rows["y"].to_numpy().astype(np.int64))
            used = np.flatnonzero(m.weights)
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (used.astype("<i4").tobytes(), m.weights[used].tobytes(), m.intercept, m.a, m.c)], names=["i", "w", "b", "a", "c"])

    sample = labelled_sample(docs, labels, "quality", per_class).repartition(1)
    got = sample.mapInArrow(run, "i binary, w binary, b double, a double, c double").collect()
    weights = np.zeros(GROUPS << BITS, np.float32)
    if not got:
        return Model(weights, 0.0, 0.0, 0.0)
    weights[np.frombuffer(got[0].i, "<i4")] = np.frombuffer(got[0].w, np.float32)
    return Model(weights, got[0].b, got[0].a, got[0].c)


def quality_rules(docs: DataFrame, model: Model, keep_at: float = KEEP_AT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the counts, ``p_quality`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike, each on its own.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = model.value

        def f(column: pa.LargeStringArray) -> list[pa.Array]:
            parts = []
            for block in blocks(column):
                got = counts(block, words(block, lower=False))
                got["p_quality"] = m.probability(block)
                got["kept"] = ~got["base_failed"] & (got["p_quality"] >= keep_at)
                parts.append(got)
            names = [x.split()[0] for x in FIELDS.split(", ")]
            return [pa.array(np.concatenate([p[n] for p in parts]) if parts else []) for n in names]

        return f

    return append_columns(docs, FIELDS, make, keep=keep)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_rules(docs, train(docs, labels), keep=["doc_id"]).select("doc_id", *[F.col(x.split()[0]) for x in FIELDS.split(", ")])
