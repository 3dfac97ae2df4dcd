"""Storage that all executors share, for results that later steps read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, as in a local test, a new folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared folder, with the lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark drops a query's shuffle files when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, the shuffle files of each query that ends go at once; only for queries whose results are stored."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_noted: list[list[DataFrame]] = []


@contextmanager
def temporary(*kept: str) -> Iterator[None]:
    """Tables stored within it are removed at its end, but those of the names in ``kept``."""
    _noted.append([])
    try:
        yield
    finally:
        dropped(*[df for df in _noted.pop() if df.stored_as not in kept])


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder; ``dropped`` removes it, and the end of ``temporary``."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at, out.stored_as = path, name
    for tables in _noted[-1:]:
        tables.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "stored_at", None)
        if path:
            spark = df.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
