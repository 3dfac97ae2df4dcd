"""Grouped averages, splits, indexes and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import ratio
from millrace.storage import checkpointed


def movie_totals(ratings: DataFrame) -> DataFrame:
    """(movieId, total, n): the sum of ratings and the number of rows with a timestamp."""
    return ratings.groupBy("movieId").agg(F.sum("rating").alias("total"), F.count("timestamp").alias("n"))


def movie_avg(ratings: DataFrame) -> DataFrame:
    """(movieId, rating_avg)."""
    return movie_totals(ratings).select("movieId", ratio(F.col("total"), F.col("n")).alias("rating_avg"))


def tag_avg(ratings: DataFrame, tags: DataFrame) -> DataFrame:
    """(tag, rating_avg): over a tag's rows, the sum of its movies' totals by that of their counts.

    A movie weighs in once for each row that gives it the tag. Movies are aggregated before the join.
    """
    joined = tags.select("movieId", "tag").join(movie_totals(ratings), "movieId")
    summed = joined.groupBy("tag").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return summed.select("tag", ratio(F.col("total"), F.col("n")).alias("rating_avg"))


def split(ratings: DataFrame, test: DataFrame) -> DataFrame:
    """The ratings whose (userId, movieId) is not a test key."""
    return ratings.join(test.select("userId", "movieId"), ["userId", "movieId"], "left_anti")


def mean_by(ratings: DataFrame, key: str) -> DataFrame:
    """(key, mean, n)."""
    return ratings.groupBy(key).agg(F.avg("rating").alias("mean"), F.count("rating").alias("n"))


def numbered(df: DataFrame, *order: Column | str, name: str = "seq") -> DataFrame:
    """``df`` with its rows numbered from 0 in the order of the columns, without a global sort in one task.

    Rows are dealt to ranges; a range's numbers start at the number of rows in the ranges before it. One row a
    range reaches the single task that adds up those starts.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = checkpointed(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_first", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    at = (F.col("_at") - F.col("_first") + F.col("_start")).alias(name)
    return placed.join(F.broadcast(starts), "_part").select(*[F.col(f"`{c}`") for c in df.columns], at)


def dense_index(ids: DataFrame, column: str) -> DataFrame:
    """(column, idx): distinct values other than null in ascending order, numbered from 0."""
    return numbered(ids.select(column).where(F.col(column).isNotNull()).distinct(), column, name="idx")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; each task keeps k of its own before they meet."""
    return df.orderBy(*order).limit(k)


def top_per_group(df: DataFrame, group: str, k: int, *order) -> DataFrame:
    """The first k rows of each group; Spark limits each task's groups before the shuffle."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def union(*parts: DataFrame) -> DataFrame:
    """All rows of all parts, matched by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
