"""What the operators share: tables, folds, shared storage, and columns computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.bytetext import text_column
from millrace.storage import checkpointed, dropped, shared_folder
from millrace.storage import stored as written

__all__ = ["append_columns", "checkpointed", "dropped", "fold", "labelled_sample", "others", "shared_folder", "small_batches", "table", "written"]

#: Rows of a batch of texts at most: a task holds its batches several times, in the JVM outside the heap and in Python.
BATCH_ROWS = 2000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: make() runs once in a task and returns a function from a text column to the new columns.
Maker = Callable[[], Callable[[pa.LargeStringArray], Sequence[pa.Array]]]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a null id has the fold of the empty text, 0."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def others(columns: Sequence[str], names: Sequence[str]) -> list[str]:
    """The columns whose names aren't among ``names``, in any case of letters."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def small_batches(spark: SparkSession) -> None:
    """From now on, as results are lazy, the session's Arrow batches have at most ``BATCH_ROWS`` rows."""
    if not 0 < int(spark.conf.get(_BATCH_ROWS)) <= BATCH_ROWS:  # 0 or less: any number
        spark.conf.set(_BATCH_ROWS, BATCH_ROWS)


def append_columns(df: DataFrame, fields: str, make: Maker, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``df``'s columns (or ``keep``) with columns computed from each whole text, batch by batch, without a shuffle.

    A computed column takes the place of one of the same name.
    """
    small_batches(df.sparkSession)
    new = T.StructType.fromDDL(fields)
    keep = others(df.columns if keep is None else keep, new.names)
    schema = T.StructType([df.schema[c] for c in keep] + new.fields)
    arrow = to_arrow_schema(new)
    needed = list(dict.fromkeys([*keep, text]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            made = f(text_column(batch, text))
            old = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            cast = [a if a.type == field.type else a.cast(field.type) for a, field in zip(made, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*old, *cast], names=[*keep, *arrow.names])

    return df.select(*[F.col(f"`{c}`") for c in needed]).mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None) -> DataFrame:
    """(doc_id, text, y): at most ``per_class`` labelled texts of each class, those first by a hash of their id.

    The ids are limited before the texts are joined, so the join broadcasts at most ``2 * per_class`` ids.
    An id labelled more than once has the larger label; null labels and ids are ignored; of rows of ``docs`` that
    share an id the one of the largest text counts.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.where(where) if where is not None else known
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    first = [known.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    found = docs.select("doc_id", "text").join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    return found.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y"))
