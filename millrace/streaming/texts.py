"""Fixed-size samples of a stream of texts, and their most frequent hashtags."""

from __future__ import annotations

import json
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions import hashtags


def tracked(texts: DataFrame, word: str = "#", text: str = "text") -> DataFrame:
    """The rows whose text contains the word, of a table or a stream."""
    return texts.where(F.contains(F.col(text), F.lit(word)))


def top_tags(texts: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    """(tag, n) of the k most frequent hashtags, ties by tag."""
    tags = texts.select(F.explode(hashtags(F.col(text))).alias("tag"))
    return tags.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def mean_length(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row (n, mean_length) in characters."""
    return texts.agg(F.count(text).alias("n"), F.avg(F.length(text)).alias("mean_length"))


def sample(texts: DataFrame, size: int = 100, seed: int = 42, key: str = "id") -> DataFrame:
    """A uniform sample of at most ``size`` rows: those first by a seeded hash of their key.

    Each task keeps its own first rows, so the sample is drawn in parallel; ties are ordered by key.
    """
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return texts.orderBy(drawn, key).limit(size)


@dataclass
class Reservoir:
    """A sample of the texts so far. The draw for the n-th text depends on the seed and n alone.

    With ``parity``, a draw of 1 to n replaces the element at that place if it is below the size, so the first
    element always stays; without it, each text is kept with equal chance.
    """

    size: int = 100
    seed: int = 42
    parity: bool = False
    n: int = 0
    texts: list[str] = field(default_factory=list)
    tags: Counter = field(default_factory=Counter)

    def count(self, text: str, by: int) -> None:
        """One more or one less for each of the text's tags; a tag that no text has any more stays, at zero."""
        for w in text.split():
            if len(w) > 1 and w[0] == "#":
                self.tags[w[1:]] += by

    def add(self, text: str) -> bool:
        """Whether the text replaced one."""
        self.n += 1
        if len(self.texts) < self.size:
            self.texts.append(text)
            self.count(text, 1)
            return False
        draw = random.Random(self.seed * 1_000_003 + self.n)
        at = draw.randint(1, self.n) if self.parity else draw.randrange(self.n)
        if at >= self.size:
            return False
        self.count(self.texts.pop(at), -1)
        self.texts.append(text)
        self.count(text, 1)
        return True

    def report(self, k: int = 5) -> tuple[str, float]:
        """The k most frequent tags of the sample, as tag:n, and the mean length of its texts."""
        top = sorted(((t, n) for t, n in self.tags.items() if n), key=lambda e: (-e[1], e[0]))[:k]
        return ",".join(f"{t}:{n}" for t, n in top), sum(map(len, self.texts)) / max(1, len(self.texts))


class _ReservoirProcessor(StatefulProcessor):
    def __init__(self, size: int, seed: int, parity: bool):
        self.new = lambda: Reservoir(size, seed, parity)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sample", "sample string")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        reservoir = self.new()
        if self.state.exists():
            reservoir.n, reservoir.texts, tags = json.loads(self.state.get()[0])
            reservoir.tags.update(tags)
        changed = [reservoir.add(t) for t in frame["text"].tolist()]
        self.state.update((json.dumps([reservoir.n, reservoir.texts, reservoir.tags]),))
        if any(changed):
            tags, length = reservoir.report()
            yield pd.DataFrame({"k": [key[0]], "n": [reservoir.n], "size": [len(reservoir.texts)], "top": [tags], "mean_length": [length]})

    def close(self) -> None:
        pass


def reservoir_stream(texts: DataFrame, size: int = 100, seed: int = 42, parity: bool = False) -> DataFrame:
    """A stream of (k, n, size, top, mean_length), a row for each key and micro-batch that changed the sample."""
    grouped = texts.select("k", "seq", "text").groupBy("k")
    return grouped.transformWithStateInPandas(_ReservoirProcessor(size, seed, parity), "k long, n long, size long, top string, mean_length double", "append", "none")


def reservoir_batch(texts: DataFrame, size: int = 100, seed: int = 42, parity: bool = False) -> DataFrame:
    """(place, text) of the sample after all rows of (seq, text), in order; one task holds the sample alone."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reservoir = Reservoir(size, seed, parity)
        for f in frames:
            for t in f["text"].tolist():
                reservoir.add(t)
        yield pd.DataFrame({"place": range(len(reservoir.texts)), "text": reservoir.texts})

    return texts.select("seq", "text").repartition(1).sortWithinPartitions("seq").mapInPandas(run, "place long, text string")
