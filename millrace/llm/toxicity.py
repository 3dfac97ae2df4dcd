"""Toxicity by multiple-instance learning.

A text is a bag of sentences (cut at . ! ? and line ends). A sentence's probability is logistic in its words and
their proper prefixes of 4 to 9 bytes, as insults are inflected; a text's is the noisy-or of its sentences', one minus
the product of one minus each. Only texts carry labels: the gradient of the bag's likelihood finds the sentences that explain them. The model is trained on at most
``PER_CLASS`` labelled texts of each class and knows features of at least ``LEAST_TEXTS`` of them; scoring looks up
64-bit hashes, batch by batch. Null and empty texts have no sentences and score 0. Repeated rows are scored alike, each
on its own; of rows that share a labelled id the largest text trains, and equal hashes of ids are ordered by id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import ALNUM, LOWER, Block, blocks, hash_spans, mix64, text_column, words
from millrace.llm.common import append_columns, fold, labelled_sample, table
from millrace.llm.linear import sigmoid

PER_CLASS = 2500
LEAST_TEXTS = 6
PREFIXES = range(4, 10)
#: A text is toxic, and a sentence offends, from these probabilities on.
TOXIC_AT, OFFENDS_AT = 0.7, 0.5
#: Weights smaller than this share of the largest are left out of the model.
LEAST_WEIGHT = 0.02

_END = np.zeros(256, bool)
_END[list(b".!?\n")] = True

FIELDS = "score double, predicted int, n_sentences long, offending string"


@dataclass
class Sentences:
    """Features of a block's sentences that hold a word: ``row[f]`` is the sentence of feature f."""

    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    feature: np.ndarray


def sentences(block: Block) -> Sentences:
    w = words(block, ALNUM)
    if not len(w.starts):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, np.zeros(0, np.uint64))
    number = np.cumsum(_END[block.data])[w.starts] + w.doc
    first = np.concatenate(([True], number[1:] != number[:-1]))
    row = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.concatenate((at[1:], [len(row)])) - 1
    rows, features = [row], [w.hashes]
    lowered, sizes = LOWER[block.data], w.ends - w.starts
    for k in PREFIXES:
        longer = np.flatnonzero(sizes > k)
        rows.append(row[longer])
        features.append(mix64(hash_spans(lowered, w.starts[longer], w.starts[longer] + k)))
    return Sentences(w.doc[at], w.starts[at], w.ends[last], np.concatenate(rows), np.concatenate(features))


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float

    def sentence_logits(self, s: Sentences) -> np.ndarray:
        z = np.full(len(s.doc), self.intercept)
        if len(self.keys) and len(s.row):
            k = np.minimum(np.searchsorted(self.keys, s.feature), len(self.keys) - 1)
            hit = self.keys[k] == s.feature
            z += np.bincount(s.row[hit], self.weights[k[hit]], minlength=len(z))
        return z

    def score(self, block: Block, s: Sentences, z: np.ndarray) -> np.ndarray:
        clean = np.bincount(s.doc, np.logaddexp(0, z), minlength=len(block))
        return -np.expm1(-clean)


def fit(column: pa.LargeStringArray, y: np.ndarray, rounds: int = 200, rate: float = 0.3, l1: float = 4e-4) -> Model:
    """Full-batch proximal AdaGrad on the bags' likelihood with an L1 penalty, both classes of equal weight.

    Weights aren't negative: a word can make a sentence toxic but not excuse it. Without both classes, the model
    scores 0.
    """
    docs, rows, features, n_rows = [], [], [], 0
    for block in blocks(column):
        s = sentences(block)
        docs.append(s.doc + block.first)
        rows.append(s.row + n_rows)
        features.append(s.feature)
        n_rows += len(s.doc)
    if len(np.unique(y)) < 2 or not n_rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    doc, row, feature = (np.concatenate(x) for x in (docs, rows, features))
    keys, index = np.unique(feature, return_inverse=True)
    seen = np.unique(index * np.int64(len(y)) + doc[row]) // len(y)
    often = np.bincount(seen, minlength=len(keys)) >= LEAST_TEXTS
    number = np.cumsum(often) - 1
    known = often[index]
    row, index, keys = row[known], number[index[known]], keys[often]
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b = np.zeros(len(keys)), -4.0
    gw, gb = np.full(len(keys), 1e-6), 1e-6
    for _ in range(rounds):
        z = np.bincount(row, w[index], minlength=n_rows) + b
        p = sigmoid(z)
        clean = np.bincount(doc, np.logaddexp(0, z), minlength=len(y))
        toxic = np.maximum(-np.expm1(-clean), 1e-12)
        # Of a toxic text, a sentence's part in the bag; of a clean one, its whole probability.
        part = np.where(y == 1, -np.exp(-clean) / toxic, 1.0) * share
        error = p * part[doc]
        grad = np.bincount(index, error[row], minlength=len(keys))
        gw += grad * grad
        step = rate / np.sqrt(gw)
        w = np.maximum(w - step * (grad + l1), 0.0)
        g = error.sum()
        gb += g * g
        b -= rate * g / np.sqrt(gb)
    keep = np.abs(w) >= LEAST_WEIGHT * max(np.abs(w).max(initial=0.0), 1e-9)
    return Model(keys[keep], w[keep], float(b))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, where: Column | None = None) -> Model:
    """The model, fitted in one task on the bounded sample; only its features' weights come to the driver."""

    def run(batches):
        batches = list(batches)
        if batches:
            rows = pa.Table.from_batches(batches).sort_by([("doc_id", "ascending")])
            m = fit(text_column(rows), rows["y"].to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (m.keys.tobytes(), m.weights.tobytes(), m.intercept)], names=["k", "w", "b"])

    got = labelled_sample(docs, labels, "toxic", per_class, where).repartition(1).mapInArrow(run, "k binary, w binary, b double").collect()
    if not got:
        return Model(np.zeros(0, np.uint64), np.zeros(0), -40.0)
    return Model(np.frombuffer(got[0].k, np.uint64), np.frombuffer(got[0].w, np.float64), got[0].b)


def toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score, the verdict and the offending sentences as start:end.

    Offsets are code points, ends exclusive, comma-joined in order.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(column: pa.LargeStringArray) -> list[pa.Array]:
            score, number, named = np.zeros(len(column)), np.zeros(len(column), np.int64), [""] * len(column)
            for block in blocks(column):
                s = sentences(block)
                z = m.sentence_logits(s)
                own = slice(block.first, block.first + len(block))
                score[own] = m.score(block, s, z)
                number[own] = np.bincount(s.doc, minlength=len(block))
                hit = np.flatnonzero(sigmoid(z) >= OFFENDS_AT)
                if len(hit):
                    at = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
                    for i in hit.tolist():
                        d = int(s.doc[i])
                        zero = at[block.starts[d]]
                        span = f"{at[s.starts[i]] - zero}:{at[s.ends[i]] - zero}"
                        k = block.first + d
                        named[k] = f"{named[k]},{span}" if named[k] else span
            return [pa.array(score), pa.array((score >= TOXIC_AT).astype(np.int32)), pa.array(number), pa.array(named, pa.string())]

        return run

    return append_columns(docs, FIELDS, make, keep=keep)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, where=fold("doc_id", 3) != 1)
    scored = toxicity(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), *[F.col(x.split()[0]) for x in FIELDS.split(", ")])
