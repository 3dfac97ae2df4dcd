"""Ones among the last bits of a stream: exactly, and by buckets of exponentially growing size (DGIM)."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Rows of one block of the exact count; each block also reads the rows of the window before it.
BLOCK = 1_000_000


def sliding_ones(bits: DataFrame, n: int = 1000, block: int = BLOCK) -> DataFrame:
    """(seq, ones): ones among the last n bits up to each; ``seq`` counts the rows from 0 without gaps.

    The rows are dealt to blocks of the sequence with the end of the block before, so no task sees the whole stream.
    """
    if n > block:
        raise ValueError("a block holds at least a window")
    own = (F.col("seq") / block).cast("long")
    blocks = F.when(F.pmod("seq", F.lit(block)) > block - n, F.array(own, own + 1)).otherwise(F.array(own))
    rows = bits.select("seq", "bit", own.alias("own"), F.explode(blocks).alias("block"))
    window = Window.partitionBy("block").orderBy("seq").rowsBetween(-(n - 1), 0)
    return rows.withColumn("ones", F.sum("bit").over(window)).where("own = block").select("seq", F.col("ones").cast("long").alias("ones"))


@dataclass
class Dgim:
    """Buckets (exponent, timestamp), newest first, of the ones in the last ``window`` bits; bits are numbered from 1."""

    window: int = 1000
    t: int = 0
    buckets: list[tuple[int, int]] = field(default_factory=list)
    tail: list[int] = field(default_factory=list)

    def add(self, bit: int) -> None:
        """One more bit, 0 or 1. At most one bucket expires; one that ends exactly a window ago is still kept."""
        if bit not in (0, 1):
            raise ValueError("a bit is 0 or 1")
        self.t += 1
        self.tail.append(bit)
        if len(self.tail) > 2 * self.window:
            del self.tail[: -self.window]
        if len(self.buckets) > 1 and self.buckets[-1][1] < self.t - self.window:
            self.buckets.pop()
        if not bit:
            return
        self.buckets.insert(0, (0, self.t))
        i = 0
        while i + 2 < len(self.buckets) and self.buckets[i][0] == self.buckets[i + 2][0]:
            exponent, newer = self.buckets[i + 1]
            self.buckets[i + 1 : i + 3] = [(exponent + 1, newer)]
            i += 1

    def estimate(self) -> int | None:
        """All buckets but the oldest and half of that, rounded down; None before a whole window, 0 without ones."""
        if self.t < self.window:
            return None
        if not self.buckets:
            return 0
        return int(sum(2**e for e, _ in self.buckets[:-1]) + 2 ** self.buckets[-1][0] / 2)

    def exact(self) -> int:
        return sum(self.tail[-self.window :])

    def dump(self) -> str:
        return json.dumps([self.window, self.t, self.buckets, self.tail[-self.window :]])

    @classmethod
    def load(cls, text: str) -> Dgim:
        window, t, buckets, tail = json.loads(text)
        return cls(window, t, [tuple(b) for b in buckets], tail)


def dgim_batch(bits: DataFrame, window: int = 1000, every: int = 1000) -> DataFrame:
    """(seq, estimate, exact) after every so many bits of (seq, bit), in order.

    The sketch is sequential by nature: one task reads the bits, a batch at a time, and holds a window of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = Dgim(window)
        for f in frames:
            out = []
            for seq, bit in zip(f["seq"].tolist(), f["bit"].tolist(), strict=True):
                sketch.add(int(bit))
                if sketch.t % every == 0 and sketch.estimate() is not None:
                    out.append((seq, sketch.estimate(), sketch.exact()))
            yield pd.DataFrame(out, columns=["seq", "estimate", "exact"], dtype="int64")

    return bits.select("seq", "bit").repartition(1).sortWithinPartitions("seq").mapInPandas(run, "seq long, estimate long, exact long")


class _DgimProcessor(StatefulProcessor):
    def __init__(self, window: int):
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sketch", "sketch string")

    def handleInputRows(self, key, rows, timer) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        sketch = Dgim.load(self.state.get()[0]) if self.state.exists() else Dgim(self.window)
        for bit in frame["bit"].tolist():
            sketch.add(int(bit))
        self.state.update((sketch.dump(),))
        if sketch.estimate() is not None:
            yield pd.DataFrame({"k": [key[0]], "t": [sketch.t], "estimate": [sketch.estimate()], "exact": [sketch.exact()]})

    def close(self) -> None:
        pass


def dgim_stream(bits: DataFrame, window: int = 1000) -> DataFrame:
    """A stream of (k, t, estimate, exact), a row for each key and micro-batch, from a stream of (k, seq, bit).

    Each key is a bit stream of its own. Rows are put in order within a micro-batch; the session's state store
    must be RocksDB's.
    """
    grouped = bits.select("k", "seq", "bit").groupBy("k")
    return grouped.transformWithStateInPandas(_DgimProcessor(window), "k long, t long, estimate long, exact long", "append", "none")
