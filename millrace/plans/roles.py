"""The given tables in the roles that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rating():
    return F.max(F.ceil(F.col("l_quantity") / 5) / 2).alias("rating")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers rate parts, from half to five stars by quantity."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("userId"), F.col("l_partkey").alias("movieId"))
    return rows.agg(_rating(), F.max(F.unix_timestamp("l_shipdate")).alias("timestamp"))


def brand_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers rate brands; brands are numbered in order of their names."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).cast("int").alias("movieId"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("userId"), "movieId").agg(_rating())


def test_keys(rows: DataFrame) -> DataFrame:
    """A tenth of the keys, by arithmetic on them."""
    return rows.where((F.col("userId") * 31 + F.col("movieId") * 17) % 10 == 0).select("userId", "movieId")


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's type and brand as its tags, and its type once more for large parts."""
    parts = table(spark, sf_dir, "part")
    one = lambda rows, tag: rows.select(F.col("p_partkey").alias("movieId"), F.col(tag).alias("tag"))
    return one(parts, "p_type").unionByName(one(parts, "p_brand")).unionByName(one(parts.where("p_size > 25"), "p_type"))


def word_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, element): documents and their distinct lower-cased words."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("element")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item"), words).where("element <> ''")


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, bit): events in order of time, purchases being ones."""
    from millrace.operators.aggregates import numbered

    events = table(spark, sf_dir, "events").select("ts", "event_id", (F.col("event_type") == "purchase").cast("int").alias("bit"))
    return numbered(events, "ts", "event_id").select("seq", "bit")


def tagged_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text): events as short texts with a hashtag."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" #"), "event_type").alias("text"))
