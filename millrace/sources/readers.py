"""Typed readers: no inference pass, and every path a parameter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATINGS = "userId int, movieId int, rating double, timestamp long"
TAGS = "userId int, movieId int, tag string, timestamp long"
MOVIES = "movieId int, title string, genres string"
LINKS = "movieId int, imdbId string, tmdbId string"
GENOME_TAGS = "tagId int, tag string"
GENOME_SCORES = "movieId int, tagId int, relevance double"
TEST_KEYS = "userId int, movieId int"
TRUTH_PAIRS = "m1 int, m2 int"


def read_csv(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Rows of a CSV file with LF, CRLF or bare CR line ends; doubled quotes in quoted fields are one quote.

    Lines with fields missing or of the wrong type are dropped.
    """
    return spark.read.schema(schema).csv(path, header=header, escape='"', mode="DROPMALFORMED", enforceSchema=True)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, RATINGS)


def read_tags(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, TAGS)


def read_test_keys(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns of a headed file."""
    return spark.read.csv(path, header=True, escape='"').toDF(*_names(spark, path)).selectExpr("cast(c0 as int) userId", "cast(c1 as int) movieId")


def _names(spark: SparkSession, path: str) -> list[str]:
    return [f"c{i}" for i in range(len(spark.read.csv(path, header=True).columns))]


def read_truth_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a file without a header."""
    return read_csv(spark, path, TRUTH_PAIRS, header=False)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file with their comma-separated fields; a header is dropped with every line equal to it."""
    lines = spark.read.text(path)
    first = lines.limit(1).select(F.col("value").alias("header"))
    rest = lines.join(F.broadcast(first), F.col("value") == F.col("header"), "left_anti")
    return rest.select("value", F.split("value", ",").alias("fields")).where(F.size("fields") > 1)


def socket_lines(spark: SparkSession, host: str = "localhost", port: int = 9999) -> DataFrame:
    """A stream of (value) lines from a TCP server."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (value) lines of the files that appear in a folder."""
    return spark.readStream.schema("value string").text(path)


def rate_bits(spark: SparkSession, rows_per_second: int = 100, seed: int = 42) -> DataFrame:
    """A stream of (seq, bit): a bit for each row of the rate source, the same for the same seed."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(F.col("value").alias("seq"), F.pmod(F.xxhash64("value", F.lit(seed)), F.lit(2)).cast("int").alias("bit"))
