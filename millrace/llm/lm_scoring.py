"""LM scoring: log-probabilities of texts under a backoff model of words, walked as a weighted automaton.

Learning. Every word of every training text is counted, by its 64-bit hash, in shuffled shards: N tokens, V words, a
text's end among them. The unigram level is add-one, (c + 1) / (N + V + 1), the last event being any unknown word.
Above it, pairs and triples of any words are counted over all training texts by 64-bit hash in shuffled shards, and
those that occur ``LEAST_COUNT`` times are kept, with an absolute discount. A kept triple's two pairs and a kept
pair's two words occur as often, so bit sets of what was kept below spare the shuffle most of the others; a false
positive is counted and dropped, so they never affect the result. The arcs are tables in the shared folder.

Automaton. States are the contexts: none, one word, two words (a kept pair). The state table gives each state its
failure arc, to the context without its oldest word, with the weight of backing off. A kept pair is an arc from its
first word's state to its own, a kept triple one from its first pair's state to its last pair's. A text is read from
left to right in one traversal that carries one state: where the state has no arc for the next word, failure arcs are
taken, their weights added, until one has; at the empty context every word has its unigram arc. The state after a word
depends on two words alone, so a long text is cut into segments, each started two words early at the empty context,
and the segments of a block are traversed side by side.

Scoring. Words of a share of at least ``BROADCAST_SHARE`` and n-grams of at least ``GRAM_SHARE``, at most the inverse,
are arcs of a broadcast automaton. A path's weight is a sum over its words, pairs and triples: of each failure
weight, and of each arc what it has over the path below it. So for the others, (n-gram, text) rows are joined by a
shuffle with counts and weights. No table that grows with the vocabulary or the arcs is broadcast or collected.
Tables that only the training reads are removed after it; those of the words and the arcs stay, as the result reads
them.

Null texts are empty: one token, the end. Repeated rows are scored each on its own; every training row counts.
Words and n-grams of equal count, ties of rank, are ordered by their hash, which moves no score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.bytetext import Block, blocks, mix64, text_column, words
from millrace.llm.common import dropped, fold, table, written

BROADCAST_SHARE, GRAM_SHARE = 2.5e-7, 1e-6
#: Bits of the sets of kept hashes, as a power of two.
SIEVE_BITS = 27
LEAST_COUNT = 3
DISCOUNT = 0.75
#: Stands for the end of a text among the words' hashes.
END = np.uint64(0x5BD1E995CAFEF00D)


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block, each text's words and its end, and where each text's begin (one more at the end)."""
    w = words(block)
    n = np.diff(w.bounds)
    bounds = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(bounds[-1], END)
    out[np.arange(len(w.hashes)) + w.doc] = w.hashes
    return out, bounds


class _Counter:
    """Counts of numbers, merged whenever they have grown too many."""

    def __init__(self, limit: int = 3_000_000):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.limit = 0, limit

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > self.limit:
            self.merge()
            self.limit = max(self.limit, 2 * self.size)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = np.concatenate([k for k, _ in self.parts])
        n = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.parts = [(keys[first], np.add.reduceat(n, first) if len(first) else n)]
        self.size = len(first)
        return self.parts[0]

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        keys, n = self.merge()
        for at in range(0, len(keys), 200_000):
            part = slice(at, at + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(keys[part].astype(np.int64, copy=False)), pa.array(n[part].astype(np.int64, copy=False))], names=names)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = _Counter()
    for batch in batches:
        for block in blocks(text_column(batch)):
            total.add(tokens(block)[0].view(np.int64))
    yield from total.batches(["word", "n"])


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens, counted in each task before the shuffle, stored in the shared folder."""
    counts = texts.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return written(counts, "words")


@dataclass
class Frequent:
    """Counts of the frequent words, by sorted hash, and their ranks by count, from 1."""

    keys: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    total: int
    distinct: int

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Each token's place, or -1."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        k = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[k] == hashes, k, -1)

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        k = self.find(hashes)
        return np.where(k >= 0, self.rank[k] if len(self.rank) else 0, 0)


def frequent_words(counts: DataFrame, share: float = BROADCAST_SHARE) -> Frequent:
    """The words of at least the share, at most ``1 / share`` rows on the driver."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("distinct")).first()
    got = counts.where(F.col("n") >= max(1.0, share * whole.total)).toArrow()
    keys, n = got["word"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    rank = np.zeros(len(keys), np.int64)
    top = np.lexsort((keys, -n))
    rank[top] = np.arange(1, len(top) + 1)
    return Frequent(keys, n, rank, int(whole.total), int(whole.distinct))


_P = int(1 / BROADCAST_SHARE) + 2


def _grams(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the hashes of the pair and the triple that end with it; 0 where another text begins.

    A pair's is its first word's, mixed, with the second's; a triple's likewise of its first and second pair, so
    the latter of the two follows from the whole and the former.
    """
    pair, triple = np.zeros(len(hashes), np.uint64), np.zeros(len(hashes), np.uint64)
    two = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pair[two] = mix64(hashes[two - 1]) ^ hashes[two]
    three = np.flatnonzero(doc[2:] == doc[:-2]) + 2
    triple[three] = mix64(pair[three - 1]) ^ pair[three]
    return pair, triple


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64((1 << SIEVE_BITS) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def sieve(table: DataFrame, column: str) -> np.ndarray:
    """The set of a column's hashes modulo the bits, built in shards of 32,768 bits."""
    slot = F.col(column).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    shards = table.select(F.shiftright(slot, 15).alias("shard"), slot.bitwiseAND(F.lit(32767)).alias("bit")).groupBy("shard").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((1 << SIEVE_BITS - 15, 4096), np.uint8)
    got = shards.toArrow()
    for shard, bits in zip(got["shard"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[shard] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def _counted(grams: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, first, n = np.unique(grams, return_index=True, return_counts=True)
    return key, heads[first], n


def count_grams(texts: DataFrame, order: int, bits, name: str) -> DataFrame:
    """(gram, head, tail, n) of the pairs, or triples, that occur ``LEAST_COUNT`` times in all texts, stored.

    Head and tail are the words of a pair and the pairs of a triple; ``bits`` is the broadcast set of those kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = bits.value
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def counted() -> pa.RecordBatch:
            key, head, n = _counted(*map(np.concatenate, zip(*parts, strict=True)))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(head.view(np.int64)), pa.array(n)], names=["gram", "head", "n"])

        for batch in batches:
            for block in blocks(text_column(batch)):
                hashes, bounds = tokens(block)
                doc = np.repeat(np.arange(len(block)), np.diff(bounds))
                pair, triple = _grams(hashes, doc)
                below, gram = (hashes, pair) if order == 2 else (pair, triple)
                well = _passes(kept, below)
                at = np.flatnonzero((doc[order - 1 :] == doc[: 1 - order]) & well[order - 1 :] & well[order - 2 : -1]) + order - 1
                parts.append((gram[at], below[at - 1]))
                if sum(len(g) for g, _ in parts) > 4_000_000:
                    yield counted()
        if parts:
            yield counted()

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, head = (batch.column(c).to_numpy().view(np.uint64) for c in ("gram", "head"))
            yield batch.append_column("tail", pa.array((gram ^ mix64(head)).view(np.int64)))

    # Each task has counted its own, so what helps is one aggregation after the shuffle and none before it.
    found = texts.select("text").mapInArrow(run, "gram long, head long, n long").repartition("gram")
    found = found.groupBy("gram").agg(F.min("head").alias("head"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    return written(found.mapInArrow(tails, "gram long, head long, n long, tail long"), name)


#: Tokens of a segment of a text.
SEGMENT = 256


@dataclass
class Automaton:
    """The state table and the arcs of the frequent n-grams, with base-10 logarithms; weights are the whole model's.

    State 0 is the empty context, 1 to the number of frequent words a word by its rank, and then come the pairs. An
    arc's key is its state times ``_P`` and its word's rank, from 1; ``arc_gain`` is its logarithm over the unigram's.
    """

    total: int
    distinct: int
    unigram: np.ndarray  # by rank; the entry 0 is not used
    fail_to: np.ndarray
    fail_weight: np.ndarray
    arcs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    arc_to: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    arc_gain: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def walk(self, rank: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token of texts at ``bounds`` its log-probability in its state over the unigram's, and the words of
        context of the arc taken, 0 to 2."""
        size = np.diff(bounds)
        pieces = -(-size // SEGMENT)
        own = np.repeat(np.arange(len(size)), pieces)
        place = (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
        first = bounds[own] + place
        begin, end = np.maximum(first - 2, bounds[own]), np.minimum(first + SEGMENT, bounds[own + 1])
        order = np.argsort(begin - end, kind="stable")
        first, begin, length = first[order], begin[order], (end - begin)[order]
        gain, depth = np.zeros(len(rank)), np.zeros(len(rank), np.int8)
        carried = np.zeros(len(begin), np.int64)
        n_words = len(self.unigram) - 1
        for step in range(int(length[0]) if len(length) else 0):
            live = int(np.searchsorted(-length, -step, side="left"))
            word = rank[begin[:live] + step]
            state, weight = carried[:live].copy(), np.zeros(live)
            level = np.zeros(live, np.int8)
            after = word.copy()  # the unigram arcs' states
            todo = np.flatnonzero((state > 0) & (word > 0))
            lost = np.flatnonzero((state > 0) & (word == 0))
            while len(todo):
                at, hit = _lookup(self.arcs, state[todo] * _P + word[todo])
                found = todo[hit]
                weight[found] += self.arc_gain[at]
                after[found] = self.arc_to[at]
                level[found] = 1 + (state[found] > n_words)
                missed = np.ones(len(todo), bool)
                missed[hit] = False
                todo = todo[missed]
                weight[todo] += self.fail_weight[state[todo]]
                state[todo] = self.fail_to[state[todo]]
                todo = todo[state[todo] > 0]
            while len(lost):  # an unknown word has no arc but the empty context's
                weight[lost] += self.fail_weight[state[lost]]
                state[lost] = self.fail_to[state[lost]]
                lost = lost[state[lost] > 0]
            carried[:live] = after
            real = np.flatnonzero(begin[:live] + step >= first[:live])
            gain[begin[real] + step], depth[begin[real] + step] = weight[real], level[real]
        return gain, depth


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in keys, place in wanted) of the wanted codes, other than 0, that are keys."""
    some = np.flatnonzero(wanted)
    if not len(keys) or not len(some):
        none = np.zeros(0, np.int64)
        return none, none
    k = np.minimum(np.searchsorted(keys, wanted[some]), len(keys) - 1)
    same = keys[k] == wanted[some]
    return k[same], some[same]


def _left(taken: str, lower: str) -> Column:
    """The failure weight that makes a state's probabilities sum to one."""
    return F.log10(F.greatest((1 - F.sum(taken)) / F.greatest(1 - F.sum(lower), F.lit(1e-12)), F.lit(1e-12)))


def build(counts: DataFrame, frequent: Frequent, pairs: DataFrame, triples: DataFrame) -> tuple[Automaton, DataFrame]:
    """The automaton of the frequent arcs, and (word, n, weight) of all words, of contexts and of the other arcs.

    A kept pair's words and a kept triple's pairs are kept, so the joins lose nothing.
    """
    norm = float(frequent.total + frequent.distinct + 1)
    least = max(float(LEAST_COUNT), GRAM_SHARE * frequent.total)
    words = counts.where(F.col("n") >= LEAST_COUNT)
    head, tail = (words.select(F.col("word").alias(c), F.col("n").alias(f"n_{c}")) for c in ("head", "tail"))
    two = pairs.join(head, "head").join(tail, "tail")
    own = written(two.select("gram", "head", "tail", "n", "n_head", ((F.col("n") - DISCOUNT) / F.col("n_head")).alias("p"), ((F.col("n_tail") + 1) / norm).alias("lower")), "pairs")
    first = own.select(F.col("gram").alias("head"), F.col("n").alias("n_head"))
    last = own.select(F.col("gram").alias("tail"), F.col("p").alias("lower"), F.col("tail").alias("word"))
    three = triples.join(first, "head").join(last, "tail")
    three = written(three.select("gram", "head", "tail", "word", "n", ((F.col("n") - DISCOUNT) / F.col("n_head")).alias("p"), "lower"), "triples")
    fails = written(own.groupBy("head").agg(_left("p", "lower").alias("fail"), F.max("n_head").alias("n")), "fails")
    deep = written(three.groupBy("head").agg(_left("p", "lower").alias("fail")), "deep")
    two = written(own.join(deep.select(F.col("head").alias("gram"), F.col("fail").alias("fail_two")), "gram", "left"), "states")

    near = fails.where(F.col("n") >= BROADCAST_SHARE * frequent.total).toArrow()
    rank = lambda column: frequent.ranks(column.to_numpy().view(np.uint64))
    n_words = len(frequent.keys)
    count = np.zeros(n_words + 1)
    count[frequent.rank] = frequent.counts
    unigram = np.log10((count + 1) / norm)
    got = two.where(F.col("n") >= least).select("gram", "head", "tail", "p", "fail_two").toArrow()
    gram, first, last = got["gram"].to_numpy(), rank(got["head"]), rank(got["tail"])
    back = got["fail_two"].to_numpy(zero_copy_only=False).astype(float)
    fail_to = np.concatenate((np.zeros(n_words + 1, np.int64), last))
    fail_weight = np.concatenate((np.zeros(n_words + 1), np.nan_to_num(back)))
    fail_weight[rank(near["head"])] = near["fail"].to_numpy()
    fail_weight[0] = 0.0
    key, to, gain = [first * _P + last], [n_words + 1 + np.arange(len(gram))], [np.log10(got["p"].to_numpy()) - unigram[last]]
    # A triple's two pairs occur as often as it does, so they are states here too.
    got = three.where(F.col("n") >= least).select("head", "tail", "word", "p").toArrow()
    by = np.argsort(gram)
    state = lambda c: n_words + 1 + by[np.searchsorted(gram[by], got[c].to_numpy())] if len(got) else np.zeros(0, np.int64)
    word = rank(got["word"])
    key.append(state("head") * _P + word)
    to.append(state("tail"))
    gain.append(np.log10(got["p"].to_numpy()) - unigram[word])
    key, to, gain = (np.concatenate(x) for x in (key, to, gain))
    order = np.argsort(key)
    a = Automaton(frequent.total, frequent.distinct, unigram, fail_to, fail_weight, key[order], to[order], gain[order])

    none = F.lit(None).cast("long").alias("n")
    over = F.log10("p") - F.log10("lower") - F.col("fail")
    rest = two.where(F.col("n") < least).join(fails.select("head", "fail"), "head").select(F.col("gram").alias("word"), none, (over + F.coalesce("fail_two", F.lit(0.0))).alias("weight"))
    rest = rest.unionByName(three.where(F.col("n") < least).join(deep, "head").select(F.col("gram").alias("word"), none, over.alias("weight")))
    rest = rest.unionByName(fails.where(F.col("n") < BROADCAST_SHARE * frequent.total).select(F.col("head").alias("word"), none, F.col("fail").alias("weight")))
    arcs = written(rest, "arcs")
    dropped(own, two, three, fails, deep)
    return a, counts.select("word", "n", F.lit(0.0).alias("weight")).unionByName(arcs)


@dataclass
class Model:
    counts: DataFrame
    frequent: Frequent
    automaton: Automaton
    arcs: DataFrame | None = None  # (word, n, weight)
    sieves: tuple[np.ndarray, np.ndarray] | None = None  # of the kept pairs and triples


def learn(texts: DataFrame) -> Model:
    share = texts.sparkSession.sparkContext.broadcast
    counts = count_words(texts)
    frequent = frequent_words(counts)
    pairs = count_grams(texts, 2, share(sieve(counts.where(F.col("n") >= LEAST_COUNT), "word")), "pairs")
    two = sieve(pairs, "gram")
    triples = count_grams(texts, 3, share(two), "triples")
    model = Model(counts, frequent, *build(counts, frequent, pairs, triples), (two, sieve(triples, "gram")))
    dropped(pairs, triples)
    return model


def _counted_by_text(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each text, how often each occurs in it, and its text."""
    order = np.argsort(doc.astype(np.uint32), kind="stable")
    hashes = hashes[order]
    edges = np.cumsum(np.bincount(doc))
    parts = [np.unique(part, return_counts=True) for part in np.split(hashes, edges[:-1])] if len(hashes) else []
    if not parts:
        return hashes, np.zeros(0, np.int64), doc
    sizes = [len(k) for k, _ in parts]
    return np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]), np.repeat(np.arange(len(parts)), sizes)


SCORED = "word long, row long, times long, sums struct<doc_id: long, n_tokens: long, known: long, log_sum: double, gain: double>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.frequent, model.automaton, model.sieves))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums for each text and a row for each of its words and n-grams that isn't known here."""
        f, automaton, sieves = shared.value
        log_count = np.log10(f.counts + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = batch.column(0)
            for block in blocks(text_column(batch)):
                hashes, bounds = tokens(block)
                size = len(block)
                doc = np.repeat(np.arange(size), np.diff(bounds))
                place = f.find(hashes)
                known = place >= 0
                rank = np.where(known, f.rank[place] if len(f.rank) else 0, 0)
                gain, depth = automaton.walk(rank, bounds)
                logs = np.bincount(doc[known], log_count[place[known]], minlength=size).astype(np.float64)
                numbers = row + np.arange(size)
                row += size
                # A text's row of sums meets no count: its word is a hash of its number, and `times` is null.
                own = [ids.slice(block.first, size), pa.array(np.diff(bounds)), pa.array(np.bincount(doc[known], minlength=size)), pa.array(logs), pa.array(np.bincount(doc, gain, minlength=size))]
                sums = pa.StructArray.from_arrays(own, fields=list(kind))
                yield pa.RecordBatch.from_arrays([pa.array(mix64(numbers.astype(np.uint64)).view(np.int64)), pa.array(numbers), pa.nulls(size, pa.int64()), sums], names=names)
                grams, inside = [hashes[~known]], [doc[~known]]
                if sieves:
                    for gram, bits, n in zip(_grams(hashes, doc), sieves, (1, 2), strict=True):
                        missing = depth < n
                        missing[:n] = False
                        missing[n:] &= doc[n:] == doc[:-n]
                        missing &= _passes(bits, gram)
                        grams.append(gram[missing])
                        inside.append(doc[missing])
                h, times, d = _counted_by_text(np.concatenate(grams), np.concatenate(inside))
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(numbers[d]), pa.array(times), pa.nulls(len(h), kind)], names=names)

    names = ["word", "row", "times", "sums"]
    kind = pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_sum", pa.float64()), ("gain", pa.float64())])
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORED)
    arcs = model.counts.withColumn("weight", F.lit(0.0)) if model.arcs is None else model.arcs
    # The counts and arcs are the smaller side: hashed, so the texts' rows need no sort.
    joined = parts.join(arcs.hint("shuffle_hash"), "word", "left")
    here = F.col("times").isNotNull() & F.col("n").isNotNull()
    added = [F.sum(F.when(here, F.col("times"))), F.sum(F.when(here, F.col("times") * F.log10(F.col("n") + 1))), F.sum(F.col("times") * F.col("weight"))]
    sums = joined.groupBy("row").agg(F.max("sums").alias("s"), *[F.coalesce(a, F.lit(0)).alias(n) for a, n in zip(added, ("more_known", "more_logs", "more_gain"), strict=True)])
    sums = sums.select("s.doc_id", "s.n_tokens", (F.col("s.known") + F.col("more_known")).alias("n_known"), (F.col("s.log_sum") + F.col("more_logs")).alias("logs"), (F.col("s.gain") + F.col("more_gain")).alias("gain"))
    norm = float(np.log10(model.frequent.total + model.frequent.distinct + 1.0))
    base = F.col("logs") - F.col("n_tokens") * norm
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.frequent.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))


def held_out(doc_id: str = "doc_id", modulus: int = 7, remainder: int = 2) -> Column:
    return fold(doc_id, modulus) == remainder


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, learn(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
