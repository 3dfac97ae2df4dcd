"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Each byte starts a triplet with the bytes 3 and 7 places on (nothing, beyond the text's end). Triplets are hashed to
256 buckets; a bucket is coded 0 to 3 by the quartiles of the text's own 256 counts. The digest is two hex digits of
the length's logarithm and 128 of the codes. The difference of two digests is the sum of the codes' differences and
four times that of the length codes; their likeness falls from 1, at none, to 0 at ``BOUND``, about what unrelated
texts have, and beyond. Null texts are empty; empty texts have the digest of zeros. Counts that tie with a quartile
have the code below it. A text is digested whole, in memory of its own size times about thirty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.bytetext import Block, blocks, text_column
from millrace.llm.common import append_columns

BUCKETS = 256
OFFSETS = (3, 7)
BOUND = 1.25 * BUCKETS
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def codes(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Bucket codes (a row for each text) and length codes."""
    data = block.data.astype(np.uint64)
    end = np.repeat(block.ends, block.sizes)
    key = data << np.uint64(18)
    for k, offset in enumerate(OFFSETS):
        there = np.flatnonzero(np.arange(len(data)) + offset < end)
        key[there] += (data[there + offset] + np.uint64(1)) << np.uint64(9 * (1 - k))
    bucket = ((key + np.uint64(1)) * _SPREAD >> np.uint64(56)).astype(np.int64)
    bucket += BUCKETS * np.repeat(np.arange(len(block)), block.sizes)
    count = np.bincount(bucket, minlength=BUCKETS * len(block)).reshape(-1, BUCKETS)
    quartiles = np.sort(count, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = sum((count > quartiles[:, k : k + 1]).astype(np.uint8) for k in range(3))
    return code, np.minimum(255, 8 * np.log1p(block.sizes)).astype(np.uint8)


def _hex(code: np.ndarray, length: np.ndarray) -> list[str]:
    four = code.reshape(len(code), -1, 4)
    packed = (four << np.array([6, 4, 2, 0], np.uint8)).sum(axis=2).astype(np.uint8)
    return [row.tobytes().hex() for row in np.concatenate([length[:, None], packed], axis=1)]


def _likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    apart = np.abs(a[0].astype(np.int16) - b[0]).sum(axis=1) + 4 * np.abs(a[1].astype(np.int16) - b[1])
    return np.maximum(0.0, 1.0 - apart / BOUND)


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [codes(b) for b in blocks(texts)]
    if not parts:
        return np.zeros((0, BUCKETS), np.uint8), np.zeros(0, np.uint8)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _parsed(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), 1 + BUCKETS // 4)
    return ((raw[:, 1:, None] >> np.array([6, 4, 2, 0], np.uint8)) & 3).reshape(len(raw), BUCKETS), raw[:, 0]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Likeness of digests, pair by pair."""
    return _likeness(_parsed(a), _parsed(b))


def fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``fingerprint``, each whole text's digest."""
    return append_columns(docs, "fingerprint string", lambda: lambda column: [pa.array(_hex(*_codes(column)), pa.string())], text, keep)


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows in runs of descending ids, each run ended by a guest, the row that follows its last one.

    The ids' quantiles cut them into about ``parts`` ranges. The first row of a range is also dealt to the range
    before it, that of the first range to the last one, so each row meets the next one without a global order. The
    ranges' first ids, one row a range, are a table that is joined, so a plan is as long with many ranges as with few.
    Null ids come last; equal ids are ordered by text.
    """
    low = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    cuts = docs.select(low.alias("k")).agg(F.percentile_approx("k", [i / parts for i in range(1, parts)] or [0.5], 10 * parts)).first()[0] or []
    inner = sorted({float(c) for c in cuts if abs(c) < 2**62})
    bucket = Bucketizer(splits=[-float("inf"), *(inner or [0.0]), float("inf")], inputCol="_d", outputCol="_b")
    rows = docs.select("doc_id", "text", low.alias("_k"), low.cast("double").alias("_d"))
    rows = bucket.transform(rows).select("doc_id", "text", "_k", F.col("_b").cast("int").alias("_run"))
    found = sorted(((r._run, r.k) for r in rows.groupBy("_run").agg(F.max("_k").alias("k")).collect()), reverse=True)
    before = [(run, first, found[i - 1][0]) for i, (run, first) in enumerate(found)]
    ranges = docs.sparkSession.createDataFrame(before, "_run int, _first long, _before int")
    own = F.struct(F.col("_run").alias("run"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_before").alias("run"), F.lit(1).alias("guest"))
    placed = rows.join(F.broadcast(ranges), "_run")  # one row a range
    dealt = placed.withColumn("_to", F.explode(F.when(F.col("_k") == F.col("_first"), F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select("doc_id", "text", "_k", "_to.run", "_to.guest")
    ordered = dealt.repartition(parts, "run").sortWithinPartitions("run", "guest", F.desc("_k"), F.desc_nulls_last("doc_id"), "text")
    return ordered.select("run", "guest", "doc_id", "text")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row but the guests, from its text and the following row's; a run's second guest is not used."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", text_column(rows))
        if held is not None:
            rows = pa.concat_tables([held, rows])
        held = rows.slice(rows.num_rows - 1)
        if rows.num_rows > 1:
            yield _pairs(rows)


def _pairs(rows: pa.Table) -> pa.RecordBatch:
    column = text_column(rows)
    own = np.flatnonzero(np.asarray(rows["guest"])[:-1] == 0)
    n_chars, edited, sha = [], [], []
    texts = column.to_pylist()
    for i in own.tolist():
        t, following = texts[i], texts[i + 1]
        k = len(t) // 3
        n_chars.append(len(t))
        edited.append(t[: len(t) - k] + following[:k])
        sha.append(hashlib.sha256(edited[-1].encode()).hexdigest())
    code, length = _codes(column)
    changed = _codes(pa.array(edited, pa.large_string()))
    at = lambda i: (code[i], length[i])
    ids = rows["doc_id"].combine_chunks().take(pa.array(own))
    arrays = [ids, pa.array(n_chars, pa.int64()), pa.array(sha, pa.string()), pa.array(_hex(*at(own)), pa.string()), pa.array(_hex(*changed), pa.string()), pa.array(_likeness(at(own), changed)), pa.array(_likeness(at(own), at(own + 1)))]
    return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in OUT.split(", ")])


def edited_likeness(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Each text's digest, that of the text edited with the next one, and likenesses to both; one shuffle of the texts.

    A single row is its own next one. Equal rows are each compared with the row that follows them. There are four
    ranges for each shuffle partition of the session, at any size.
    """
    parts = parts or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), parts)
    return ordered.mapInArrow(_compare, T.StructType.fromDDL(OUT))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
