"""The operators as programs over files: ``python -m millrace.programs NAME ARGUMENTS``, or through spark-submit.

Each reads headed CSV files, writes one file or folder, and prints its metrics and its time.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, evaluate, graph, itemsets, lsh, recommend
from millrace.sources import readers, writers
from millrace.storage import checkpointed, temporary
from millrace.streaming import bits, texts


def session(name: str, master: str | None = None) -> SparkSession:
    """The session that spark-submit has set up, or one on ``master``; state of streams is kept by RocksDB."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return builder.config("spark.sql.streaming.stateStore.providerClass", provider).getOrCreate()


def movie_averages(spark: SparkSession, a: argparse.Namespace) -> None:
    writers.write_csv(aggregates.movie_avg(readers.read_ratings(spark, a.ratings)), a.output, [F.asc("movieId")])


def tag_averages(spark: SparkSession, a: argparse.Namespace) -> None:
    found = aggregates.tag_avg(readers.read_ratings(spark, a.ratings), readers.read_tags(spark, a.tags))
    writers.write_csv(found, a.output, [F.desc("tag")], success_file=False)


def frequent_itemsets(spark: SparkSession, a: argparse.Namespace) -> None:
    pairs = checkpointed(itemsets.baskets(readers.read_ratings(spark, a.ratings), a.case))
    found = itemsets.frequent_itemsets(pairs, a.support)
    writers.write_lines(writers.itemset_lines(found), a.output, ["size"], blank_between=True)


def similar_movies(spark: SparkSession, a: argparse.Namespace) -> None:
    rated = readers.read_ratings(spark, a.ratings).select(F.col("movieId").alias("item"), F.col("userId").alias("element"))
    with temporary():
        sets = checkpointed(lsh.indexed(rated))
    found = checkpointed(lsh.jaccard_pairs(sets, lsh.lsh_candidates(checkpointed(lsh.minhash(sets)))))
    writers.write_lines(writers.triple_lines(found, "m1", "m2", "jaccard").withColumn("key", F.split("value", ", ").cast("array<double>")), a.output, ["key"])
    truth = readers.read_truth_pairs(spark, a.truth) if a.truth else lsh.jaccard_exact(sets)
    print(lsh.precision_recall(found, truth).first().asDict())


def _predicted(spark: SparkSession, a: argparse.Namespace, predict: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    rows, test = checkpointed(readers.read_ratings(spark, a.ratings)), checkpointed(readers.read_test_keys(spark, a.test))
    found = checkpointed(predict(aggregates.split(rows, test), test, rows))
    writers.write_csv(found, a.output, [F.asc("userId"), F.asc("movieId")])
    for metric in (evaluate.error_histogram(rows, found), evaluate.rmse(rows, found)):
        print(metric.first().asDict())


def user_cf(spark: SparkSession, a: argparse.Namespace) -> None:
    _predicted(spark, a, lambda train, test, _: recommend.user_cf(train, test))


def item_cf(spark: SparkSession, a: argparse.Namespace) -> None:
    def predict(train: DataFrame, test: DataFrame, rows: DataFrame) -> DataFrame:
        rated = rows.select(F.col("movieId").alias("item"), F.col("userId").alias("e")).distinct()
        return recommend.item_cf(train, test, lsh.jaccard_exact(rated))

    _predicted(spark, a, predict)


def als(spark: SparkSession, a: argparse.Namespace) -> None:
    _predicted(spark, a, lambda train, test, _: recommend.als_cf(train, test))


def _edges(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return checkpointed(graph.cooccurrence_edges(readers.read_ratings(spark, a.ratings), a.shared))


def betweenness(spark: SparkSession, a: argparse.Namespace) -> None:
    found = graph.edge_betweenness(_edges(spark, a), a.weighting)
    lines = writers.triple_lines(found, "src", "dst", "betweenness").withColumn("key", F.split("value", ", ").cast("array<double>"))
    writers.write_lines(lines, a.output, ["key"])


def _communities(found: DataFrame, a: argparse.Namespace) -> None:
    writers.write_lines(writers.community_lines(found, "node", "component"), a.output, ["first"])


def communities(spark: SparkSession, a: argparse.Namespace) -> None:
    found = checkpointed(graph.best_communities(_edges(spark, a)))
    _communities(found, a)
    print(found.agg(F.max("modularity").alias("modularity"), F.countDistinct("component").alias("communities")).first().asDict())


def girvan_newman(spark: SparkSession, a: argparse.Namespace) -> None:
    _communities(graph.girvan_newman(_edges(spark, a), a.splits), a)


def count_ones(spark: SparkSession, a: argparse.Namespace) -> None:
    """Estimates for a socket's bits, batch by batch, until it closes; a token other than 0 is a one."""
    lines = readers.socket_lines(spark, a.host, a.port).select(F.explode(F.split("value", r"\s+")).alias("b")).where("b <> ''")
    rows = lines.select(F.lit(1).cast("long").alias("k"), F.monotonically_increasing_id().alias("seq"), (F.col("b") != "0").cast("int").alias("bit"))
    writers.run_until_failure(lambda: writers.print_stream(bits.dgim_stream(rows, a.window), a.checkpoint, a.seconds), 0)


def sample_texts(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tags and mean length of a sample of the tagged lines of a folder's files, whenever the sample changes."""
    lines = texts.tracked(readers.text_stream(spark, a.input).withColumnRenamed("value", "text"))
    rows = lines.select(F.lit(1).cast("long").alias("k"), F.monotonically_increasing_id().alias("seq"), "text")
    report = lambda number, error: print(f"failed {number} times: {error}")
    writers.run_until_failure(lambda: writers.print_stream(texts.reservoir_stream(rows, a.size), a.checkpoint, a.seconds), a.retries, report)


#: Of each program its function and its arguments: positional ones by name, others with their defaults.
PROGRAMS: dict[str, tuple[Callable[[SparkSession, argparse.Namespace], None], dict[str, object]]] = {
    "movie-averages": (movie_averages, {"ratings": str, "output": str}),
    "tag-averages": (tag_averages, {"ratings": str, "tags": str, "output": str}),
    "frequent-itemsets": (frequent_itemsets, {"case": int, "ratings": str, "support": int, "output": str}),
    "similar-movies": (similar_movies, {"ratings": str, "output": str, "--truth": ""}),
    "user-cf": (user_cf, {"ratings": str, "test": str, "output": str}),
    "item-cf": (item_cf, {"ratings": str, "test": str, "output": str}),
    "als": (als, {"ratings": str, "test": str, "output": str}),
    "betweenness": (betweenness, {"ratings": str, "output": str, "--shared": 9, "--weighting": "equal"}),
    "communities": (communities, {"ratings": str, "output": str, "--shared": 9}),
    "girvan-newman": (girvan_newman, {"ratings": str, "output": str, "--shared": 9, "--splits": 3}),
    "count-ones": (count_ones, {"checkpoint": str, "--host": "localhost", "--port": 9999, "--window": 1000, "--seconds": 10}),
    "sample-texts": (sample_texts, {"input": str, "checkpoint": str, "--size": 100, "--seconds": 10, "--retries": 3}),
}


def parsed(arguments: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="millrace.programs", description=__doc__)
    parser.add_argument("--master", default=None)
    programs = parser.add_subparsers(dest="program", required=True)
    for name, (_, wanted) in PROGRAMS.items():
        own = programs.add_parser(name)
        for argument, kind in wanted.items():
            if argument.startswith("--"):
                own.add_argument(argument, type=type(kind), default=kind)
            else:
                own.add_argument(argument, type=kind)
    return parser.parse_args(arguments)


def main(arguments: list[str] | None = None) -> None:
    a = parsed(arguments)
    start = time.perf_counter()
    PROGRAMS[a.program][0](session(a.program, a.master), a)
    print(f"{a.program}: {time.perf_counter() - start:.1f} s")


if __name__ == "__main__":
    main()
