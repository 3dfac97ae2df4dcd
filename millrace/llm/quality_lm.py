"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model's symbols are bytes: all those of the trusted texts, one symbol for bytes that none of them has and one for
what stands before a text. N-grams of order 1 to 4 are counted in Spark, sharded by n-gram; joins of those shards give
each n-gram its context's totals and discounts, each lower order its continuation counts. Trusted texts are all those
labelled good. N-grams of the ``ALPHABET - 2`` most frequent bytes alone have their probabilities in a table of
``ALPHABET ** 4`` numbers at any number of texts. All others are worked out from their counts: by a search among
the n-grams broadcast, if those with another byte are at most ``REST_ROWS``, or else by joins. A third of the trusted texts are held out; the ``QUANTILE`` of perplexity of
those of a language and a class of length (each twice as long as the one before, as a short text's perplexity varies
more) is the largest that such a text may have. Of fewer than ``ENOUGH``, in whose tail single rows decide, it is
at most ``FENCE`` quartile distances of the logarithms above the upper quartile. A class with
fewer than ``LEAST_TEXTS`` of them has the threshold of its length in all languages, or else of its whole language,
or else of all.

Scoring by shuffled joins of every text's n-grams would move many times the corpus (figures in the README); the bounded
tables are gathered from instead. Null and empty texts have no perplexity and are not kept. Repeated rows are judged
alike, each on its own; a perplexity equal to its threshold is kept, and bytes of equal frequency are ordered by value.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bytetext import Block, blocks, text_column
from millrace.llm.common import append_columns, checkpointed, dropped, table, written

ALPHABET, ORDER = 48, 4
QUANTILE, LEAST_TEXTS, ENOUGH = 0.99, 30, 1000
#: Tukey's outer fence.
FENCE = 3.0
#: Ids that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: N-grams with a byte beyond the table's that are broadcast at most.
REST_ROWS = 2_000_000
FIELDS = "n_symbols_scored long, perplexity double"


def radix(alphabet: bytes) -> int:
    """Symbols that n-grams are numbered by; the table has the first ``ALPHABET`` of them."""
    return max(ALPHABET, len(alphabet) + 2)


def symbols(data: np.ndarray, alphabet: bytes) -> np.ndarray:
    """Each byte's symbol: its place in the alphabet from 2 on, else 1; 0 stands for what precedes a text."""
    code = np.ones(256, np.int64)
    code[list(alphabet)] = np.arange(2, 2 + len(alphabet))
    return code[data]


def _before(block: Block, s: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """The symbols at each byte, one before it, two before it, ..."""
    yield s
    for j in range(1, order):
        out = np.zeros_like(s)
        out[j:] = s[:-j]
        first = (block.starts[:, None] + np.arange(j)).ravel()
        out[first[first < np.repeat(block.ends, j)]] = 0
        yield out


def codes(block: Block, alphabet: bytes, order: int) -> np.ndarray:
    """For each byte the n-gram that ends with it, as one number."""
    out = np.zeros(len(block.data), np.int64)
    for j, own in enumerate(_before(block, symbols(block.data, alphabet), order)):
        out += own * radix(alphabet) ** j
    return out


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, held_out) of all texts labelled good.

    Of rows that share an id, the one of the largest text counts.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    few = good.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    held = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(3)) == 0
    found = docs.select("doc_id", "lang", "text").join(F.broadcast(good) if few else good, "doc_id")
    found = found.groupBy("doc_id").agg(F.max(F.struct("text", "lang")).alias("m")).select("doc_id", "m.lang", "m.text")
    return found.withColumn("held_out", held)


def _byte_counts(batches):
    total = np.zeros(256, np.int64)
    for batch in batches:
        for block in blocks(text_column(batch)):
            total += np.bincount(block.data, minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(total)], names=["b", "n"])


def count_ngrams(texts: DataFrame, alphabet: bytes) -> DataFrame:
    """(gram, n) of the highest order, one row each, sharded by gram."""

    def run(batches):
        for batch in batches:
            for block in blocks(text_column(batch)):
                gram, n = np.unique(codes(block, alphabet, ORDER), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(n)], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def lower_orders(counts: DataFrame, size: int = ALPHABET) -> DataFrame:
    """(order, gram, n) of all orders from the counts of the highest; ``size`` is the alphabet's radix.

    Below the highest order, counts are of distinct symbols that precede.
    """
    levels = [counts.select(F.lit(ORDER).alias("order"), "gram", F.col("n").cast("double").alias("n"))]
    for order in range(ORDER - 1, 0, -1):
        above = levels[-1].select("gram")
        below = above.select((F.col("gram") % F.lit(size**order)).alias("gram")).groupBy("gram").agg(F.count("*").cast("double").alias("n"))
        levels.append(below.select(F.lit(order).alias("order"), "gram", "n"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every


def smoothed(every: DataFrame, size: int = ALPHABET) -> DataFrame:
    """(order, gram, alpha, gamma) of the n-grams of ``lower_orders``, or of counts of the highest order alone.

    ``alpha`` is an n-gram's discounted share of its context, ``gamma`` the context's weight of the lower order.
    """
    every = every if "order" in every.columns else lower_orders(every, size)
    context = F.floor(F.col("gram") / size).cast("long")
    every = every.withColumn("context", context)
    # How often counts of 1, 2, 3 and 4 occur gives each order its three discounts.
    times = every.groupBy("order").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in range(1, 5)])
    y = F.coalesce(F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")), F.lit(0.5))
    cut = lambda k, a, b: F.least(F.lit(float(k)), F.greatest(F.lit(0.05 * k), k - (k + 1) * y * F.coalesce(F.try_divide(F.col(b), F.col(a)), F.lit(0.5))))
    times = times.select("order", cut(1, "t1", "t2").alias("d1"), cut(2, "t2", "t3").alias("d2"), cut(3, "t3", "t4").alias("d3"))
    every = every.join(F.broadcast(times), "order")
    discount = F.when(F.col("n") >= 3, F.col("d3")).when(F.col("n") >= 2, F.col("d2")).otherwise(F.col("d1"))
    every = every.withColumn("d", F.least(discount, F.col("n")))
    totals = every.groupBy("order", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
    joined = every.join(totals, ["order", "context"])
    return joined.select("order", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"), (F.col("taken") / F.col("total")).alias("gamma"))


LEAST_P = 1e-12


@dataclass
class Rest:
    """What n-grams with a byte beyond the table's are worked out from: sorted n-grams and contexts of each order."""

    size: int
    single: np.ndarray  # the probability of each symbol without a context
    alphas: dict[int, tuple[np.ndarray, np.ndarray]]
    gammas: dict[int, tuple[np.ndarray, np.ndarray]]

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        """Of the last symbols of sorted n-grams of the highest order."""
        p = self.single[grams % self.size]
        for n in range(2, ORDER + 1):
            own = grams % self.size**n
            p = _found(*self.alphas[n], own, 0.0) + _found(*self.gammas[n], own // self.size, 1.0) * p
        return p


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


@dataclass
class Model:
    alphabet: bytes
    logs: np.ndarray  # natural logarithm of each full n-gram's last symbol's probability, by the first symbols
    rest: Rest | None = None
    table: DataFrame | None = None  # (order, gram, alpha, gamma), where the rest is too many to be broadcast
    sent: Broadcast | None = None

    def shared(self, spark: SparkSession) -> Broadcast:
        """The model but its table, broadcast once, however many results are computed from it."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(replace(self, table=None))
        return self.sent

    def parts(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each byte's logarithm from the table, 0 where it has none, and those places and their n-grams."""
        before = list(_before(block, symbols(block.data, self.alphabet), ORDER))
        if len(self.alphabet) + 2 <= ALPHABET:
            none = np.zeros(0, np.int64)
            return self.logs[sum(own * ALPHABET**j for j, own in enumerate(before))].astype(np.float64), none, none
        beyond = reduce(np.logical_or, (own >= ALPHABET for own in before))
        at, size = np.flatnonzero(beyond), radix(self.alphabet)
        values = self.logs[sum(np.where(beyond, 0, own) * ALPHABET**j for j, own in enumerate(before))].astype(np.float64)
        values[at] = 0.0
        return values, at, sum(own[at] * size**j for j, own in enumerate(before))

    def perplexity(self, block: Block) -> np.ndarray:
        """For each text the inverse geometric mean of its bytes' probabilities; not a number without bytes."""
        values, at, grams = self.parts(block)
        if len(at):
            own, which = np.unique(grams, return_inverse=True)
            p = self.rest.probabilities(own)
            p[own % self.rest.size == 1] /= max(1, 256 - len(self.alphabet))
            values[at] = np.log(np.maximum(p, LEAST_P))[which]
        total = block.per_text(values)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.exp(-total / block.sizes)


def _beyond(gram: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which n-grams have a symbol that the table lacks."""
    return reduce(np.logical_or, (gram // size**k % size >= ALPHABET for k in range(n)), np.zeros(len(gram), bool))


def _in_table(gram: np.ndarray, n: int, size: int) -> np.ndarray:
    """The places in the table of order n."""
    return gram if size == ALPHABET else sum((gram // size**k % size * ALPHABET**k for k in range(n)), np.zeros(len(gram), np.int64))


def assemble(alphabet: bytes, rows: pa.Table, whole: bool = True) -> Model:
    """The table of interpolated probabilities, order by order; a byte without a symbol of its own has its share.

    Where the alphabet goes beyond the table, rows with other bytes are kept too, if ``whole``; else only contexts of
    the table's bytes matter among them.
    """
    order, gram, alpha_of, gamma_of = (rows[c].to_numpy() for c in ("order", "gram", "alpha", "gamma"))
    size = radix(alphabet)
    p = np.full(ALPHABET, 1.0 / (size - 1))
    rest = Rest(size, np.full(size, 1.0 / (size - 1)), {}, {})
    logs = np.zeros(0, np.float32)
    for n in range(1, ORDER + 1):
        own = np.flatnonzero(order == n)
        grams, contexts = gram[own], gram[own] // size
        known = ~_beyond(contexts, n - 1, size)
        inside = known & (grams % size < ALPHABET)
        gamma = np.ones(ALPHABET ** (n - 1))
        gamma[_in_table(contexts[known], n - 1, size)] = gamma_of[own[known]]
        if size > ALPHABET and whole:
            if n == 1:
                rest.single *= gamma[0]
                rest.single[grams] += alpha_of[own]
            else:
                kept = np.flatnonzero(~inside) if n == ORDER else np.arange(len(own))
                kept = kept[np.argsort(grams[kept])]
                rest.alphas[n] = grams[kept], alpha_of[own[kept]]
                context, first = np.unique(contexts, return_index=True)
                rest.gammas[n] = context, gamma_of[own[first]]
        at = _in_table(grams[inside], n, size)
        by_place = np.argsort(at)
        at, alpha = at[by_place], alpha_of[own[inside]][by_place]
        if n < ORDER:
            p = (gamma.reshape(-1, max(1, len(p) // ALPHABET), 1) * p.reshape(1, -1, ALPHABET)).ravel() if n > 1 else gamma[0] * p
            p[at] += alpha
            continue
        # Made first symbol by first symbol: the table of the highest order is the largest thing on the driver.
        logs, lower, width = np.empty(ALPHABET**n, np.float32), p.reshape(-1, ALPHABET), len(p)
        cuts = np.searchsorted(at, np.arange(ALPHABET + 1) * width)
        for k, weight in enumerate(gamma.reshape(ALPHABET, -1, 1)):
            part = (weight * lower).ravel()
            part[at[cuts[k] : cuts[k + 1]] - k * width] += alpha[cuts[k] : cuts[k + 1]]
            part[1::ALPHABET] /= max(1, 256 - len(alphabet))
            logs[k * width : (k + 1) * width] = np.log(np.maximum(part, LEAST_P))
    return Model(alphabet, logs, rest if size > ALPHABET and whole else None)


def learn(texts: DataFrame, alphabet: bytes) -> Model:
    """The model of the texts; ``alphabet`` has their bytes, the most frequent first."""
    size = radix(alphabet)
    # Stored, as each order and each discount reads them again.
    counts = written(count_ngrams(texts, alphabet), "counts")
    every = written(lower_orders(counts, size), "orders")
    dropped(counts)
    if size == ALPHABET:
        model = assemble(alphabet, smoothed(every).toArrow())
        dropped(every)
        return model
    rows = written(smoothed(every, size), "ngrams")
    dropped(every)
    beyond = lambda gram, n: reduce(Column.__or__, (F.floor(gram / size**k) % size >= ALPHABET for k in range(n)))
    other = beyond(F.col("gram"), ORDER)
    if rows.where(other).limit(REST_ROWS + 1).count() <= REST_ROWS:
        model = assemble(alphabet, rows.toArrow())
        dropped(rows)
        return model
    context = F.floor(F.col("gram") / size)
    bounding = rows.where(other & ~beyond(context, ORDER - 1)).withColumn("c", context).dropDuplicates(["order", "c"]).drop("c")
    model = assemble(alphabet, rows.where(~other).unionByName(bounding).toArrow(), whole=False)
    return replace(model, table=rows)


def perplexities(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the length in bytes and the perplexity, null for empty texts."""
    if model.table is not None:
        return _by_joins(docs, model, keep)
    shared = model.shared(docs.sparkSession)

    def make():
        m = shared.value

        def run(column: pa.LargeStringArray) -> list[pa.Array]:
            parts = [(b.sizes, m.perplexity(b)) for b in blocks(column)]
            size = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            value = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
            return [pa.array(size), pa.array(value, mask=size == 0)]

        return run

    return append_columns(docs, FIELDS, make, keep=keep)


def _by_joins(docs: DataFrame, model: Model, keep: list[str] | None) -> DataFrame:
    """``perplexities`` where n-grams with a byte beyond the table's are joined with their counts."""
    shared = model.shared(docs.sparkSession)

    def make():
        m = shared.value

        def run(column: pa.LargeStringArray) -> list[pa.Array]:
            size, total, number, grams, times = [], [], [], [], []
            for b in blocks(column):
                values, at, gram = m.parts(b)
                size.append(b.sizes)
                total.append(b.per_text(values))
                for i, j in zip(np.searchsorted(at, b.starts).tolist(), np.searchsorted(at, b.ends).tolist(), strict=True):
                    own, n = np.unique(gram[i:j], return_counts=True)
                    number.append(len(own))
                    grams.append(own)
                    times.append(n)
            if not size:
                return [pa.array([], kind) for kind in (pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))]
            bounds = pa.array(np.concatenate(([0], np.cumsum(number))), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x).astype(np.int64))) for x in (grams, times)]
            return [pa.array(np.concatenate(size)), pa.array(np.concatenate(total)), *lists]

        return run

    found = append_columns(docs, "n_symbols_scored long, _total double, _grams array<long>, _times array<long>", make, keep=keep)
    texts = written(found.withColumn("_row", F.monotonically_increasing_id()), "texts")
    each = texts.select("_row", F.explode(F.arrays_zip("_grams", "_times")).alias("x")).select("_row", F.col("x._grams").alias("gram"), F.col("x._times").alias("times"))
    size = radix(model.alphabet)
    logs = each.select("gram").distinct().withColumn("p", F.lit(1.0 / (size - 1)))
    for n in range(1, ORDER + 1):
        own = model.table.where(F.col("order") == n)
        alpha = own.select(F.col("gram").alias("_gram"), "alpha")
        gamma = own.select(F.floor(F.col("gram") / size).cast("long").alias("_context"), "gamma").dropDuplicates(["_context"])
        logs = logs.withColumn("_gram", F.col("gram") % size**n).withColumn("_context", F.floor(F.col("_gram") / size).cast("long"))
        p = F.coalesce("alpha", F.lit(0.0)) + F.coalesce("gamma", F.lit(1.0)) * F.col("p")
        logs = logs.join(alpha, "_gram", "left").join(gamma, "_context", "left").select("gram", p.alias("p"))
    unseen = max(1, 256 - len(model.alphabet))
    p = F.when(F.col("gram") % size == 1, F.col("p") / unseen).otherwise(F.col("p"))
    logs = logs.select("gram", F.log(F.greatest(p, F.lit(LEAST_P))).alias("log"))
    sums = each.join(logs, "gram").groupBy("_row").agg(F.sum(F.col("times") * F.col("log")).alias("_rest"))
    value = F.exp(-(F.col("_total") + F.coalesce("_rest", F.lit(0.0))) / F.col("n_symbols_scored"))
    out = texts.join(sums, "_row", "left").withColumn("perplexity", F.when(F.col("n_symbols_scored") > 0, value))
    return out.drop("_row", "_total", "_rest", "_grams", "_times")


@dataclass
class Classifier:
    model: Model
    thresholds: dict[str | None, float]  # by language; None for the others
    by_length: dict[tuple[str | None, int], float]  # by language and length class; None for all languages


def _length() -> Column:
    """A text's class of length, from its bytes."""
    return F.floor(F.log2(F.greatest(F.col("n_symbols_scored"), F.lit(1)))).cast("int")


def _threshold() -> Column:
    """The quantile of a group's perplexities, of a small group's within the fence."""
    at = F.percentile_approx(F.log("perplexity"), F.array(*[F.lit(q) for q in (0.25, 0.75, QUANTILE)]), F.lit(10000))
    return F.exp(F.when(F.count("*") >= ENOUGH, at[2]).otherwise(F.least(at[2], at[1] + FENCE * (at[1] - at[0])))).alias("at")


def train(docs: DataFrame, labels: DataFrame) -> Classifier:
    """The model of two thirds of the trusted texts and the thresholds of the rest.

    Without trusted texts there is nothing to compare with, and the thresholds keep every text that isn't empty.
    """
    texts = checkpointed(trusted_texts(docs, labels))
    own, rest = texts.where("not held_out"), texts.where("held_out")
    totals = own.select("text").mapInArrow(_byte_counts, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    model = learn(own, bytes(r.b for r in sorted((r for r in totals if r.n), key=lambda r: (-r.n, r.b))))
    at = _threshold()
    scored = checkpointed(perplexities(rest, model, keep=["lang"]).where("perplexity is not null").withColumn("length", _length()))
    groups = scored.cube("lang", "length").agg(F.grouping_id().alias("g"), at, F.count("*").alias("n")).collect()
    found = [r for r in groups if r.n >= LEAST_TEXTS or r.g == 3]
    by = {r.lang: r.at for r in found if r.g == 1 and r.lang is not None}
    by_length = {(r.lang, r.length): r.at for r in found if r.g == 0 and r.lang is not None or r.g == 2}
    whole = next((r.at for r in found if r.g == 3 and r.at is not None), float("inf"))
    return Classifier(model, by | {None: whole}, by_length)


def classify(docs: DataFrame, classifier: Classifier, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``keep``, which needs lang) with the perplexity, its language's and length's threshold and ``kept``."""
    threshold = F.lit(classifier.thresholds[None])
    for lang, at in sorted((k, v) for k, v in classifier.thresholds.items() if k is not None):
        threshold = F.when(F.col("lang") == lang, F.lit(at)).otherwise(threshold)
    # Those of a length in all languages come before those of a language, and those of both before them.
    for (lang, length), at in sorted(classifier.by_length.items(), key=lambda x: (x[0][0] is not None, x[0][0] or "", x[0][1])):
        same = _length() == length if lang is None else (F.col("lang") == lang) & (_length() == length)
        threshold = F.when(same, F.lit(at)).otherwise(threshold)
    out = perplexities(docs, classifier.model, keep).withColumn("threshold", threshold)
    return out.withColumn("kept", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id", "lang"])
