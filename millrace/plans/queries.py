"""Operators applied to the given tables. Each query takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import clamp
from millrace.operators import aggregates, evaluate, graph, itemsets, lsh, recommend
from millrace.plans import roles
from millrace.sources import writers
from millrace.storage import checkpointed, dropped, shuffles_dropped, stored, temporary
from millrace.streaming import bits as bit_streams
from millrace.streaming import texts as text_streams

#: Share of baskets that a frequent itemset is in, and quantile of co-occurrences from which two nodes are joined.
SUPPORT_SHARE, EDGE_QUANTILE = 0.46, 0.97
PLACES = 6

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, Query] = {}


def query(f: Query) -> Query:
    _found[f.__name__] = f
    return f


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) for c in columns})


def _train_test(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    test = roles.test_keys(rows)
    return aggregates.split(rows, test), test


# --- averages, splits, indexes


@query
def movie_avg(spark, sf_dir):
    return aggregates.movie_avg(roles.ratings(spark, sf_dir))


@query
def tag_avg(spark, sf_dir):
    return aggregates.tag_avg(roles.ratings(spark, sf_dir), roles.tags(spark, sf_dir))


@query
def train_split(spark, sf_dir):
    return _train_test(roles.ratings(spark, sf_dir))[0].select("userId", "movieId", "rating")


@query
def user_mean(spark, sf_dir):
    return aggregates.mean_by(_train_test(roles.ratings(spark, sf_dir))[0], "userId")


@query
def item_mean_baseline(spark, sf_dir):
    return recommend.item_mean(*_train_test(roles.ratings(spark, sf_dir)))


@query
def dense_index(spark, sf_dir):
    return aggregates.dense_index(roles.ratings(spark, sf_dir), "movieId")


@query
def corated_counts(spark, sf_dir):
    return graph.cooccurrences(roles.ratings(spark, sf_dir))


@query
def item_popularity_topk(spark, sf_dir):
    counted = roles.ratings(spark, sf_dir).groupBy("movieId").agg(F.count("*").alias("n"))
    return aggregates.top_k(counted, 20, F.desc("n"), "movieId")


@query
def ratings_clamped(spark, sf_dir):
    return roles.ratings(spark, sf_dir).select("userId", "movieId", clamp(F.col("rating"), 1, 4).alias("rating"))


@query
def tags_union(spark, sf_dir):
    tags = roles.tags(spark, sf_dir)
    labels = roles.ratings(spark, sf_dir).where("rating = 5").select("movieId", F.lit("best").alias("tag"))
    return aggregates.union(tags, labels).groupBy("tag").agg(F.count("*").alias("n"))


# --- itemsets


def _customers_brands(spark, sf_dir) -> DataFrame:
    """Customers' baskets of brands, stored for the levels, whose results don't read them again."""
    return stored(itemsets.baskets(roles.brand_ratings(spark, sf_dir), 1), "pairs")


def _support(pairs: DataFrame) -> int:
    return int(pairs.agg(F.ceil(F.countDistinct("basket") * F.lit(SUPPORT_SHARE)).alias("s")).first().s)


@query
def baskets_by_user(spark, sf_dir):
    return itemsets.basket_lists(itemsets.baskets(roles.brand_ratings(spark, sf_dir), 1))


@query
def baskets_by_item(spark, sf_dir):
    return itemsets.basket_lists(itemsets.baskets(roles.brand_ratings(spark, sf_dir), 2))


def _level(spark, sf_dir, k: int) -> DataFrame:
    pairs = _customers_brands(spark, sf_dir)
    found = itemsets.levels(pairs, _support(pairs), k)
    dropped(pairs)
    columns = [f"i{j}" for j in range(1, k + 1)]
    return found[k - 1] if len(found) >= k else spark.createDataFrame([], ", ".join(f"{c} int" for c in columns) + ", n long")


@query
def frequent_1(spark, sf_dir):
    return _level(spark, sf_dir, 1)


@query
def frequent_2(spark, sf_dir):
    return _level(spark, sf_dir, 2)


@query
def frequent_3(spark, sf_dir):
    return _level(spark, sf_dir, 3)


@query
def frequent_itemsets_fpgrowth(spark, sf_dir):
    pairs = checkpointed(itemsets.baskets(roles.brand_ratings(spark, sf_dir), 1))
    found = itemsets.frequent_itemsets_fpgrowth(pairs, _support(pairs))
    return found.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n")


@query
def frequent_itemsets(spark, sf_dir):
    """The level-wise join's itemsets of all sizes; the same rows as FP-growth's."""
    pairs = _customers_brands(spark, sf_dir)
    found = itemsets.frequent_itemsets(pairs, _support(pairs))
    dropped(pairs)
    return found.select(F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "n")


# --- rows in order, each with its place


def _placed(df: DataFrame, *order) -> DataFrame:
    return aggregates.numbered(df, *order, name="place")


@query
def movie_avg_sorted(spark, sf_dir):
    return _placed(aggregates.movie_avg(roles.ratings(spark, sf_dir)), "movieId")


@query
def tag_avg_sorted(spark, sf_dir):
    return _placed(aggregates.tag_avg(roles.ratings(spark, sf_dir), roles.tags(spark, sf_dir)), F.desc("tag"))


@query
def predictions_sorted(spark, sf_dir):
    return _placed(_rounded(_user_cf(spark, sf_dir)[1], "rating"), "userId", "movieId")


def _betweenness(spark, sf_dir, weighting: str) -> DataFrame:
    """Rounded to nine places before ``PLACES``: what a sum of fractions loses doesn't decide how a half is rounded."""
    found = graph.edge_betweenness(_edges(spark, sf_dir), weighting)
    return _rounded(found.withColumn("betweenness", F.round("betweenness", 9)), "betweenness")


@query
def betweenness_sorted(spark, sf_dir):
    """Edges by falling betweenness, ties by their ends."""
    return _placed(_betweenness(spark, sf_dir, "equal"), F.desc("betweenness"), "src", "dst")


@query
def edges_sorted(spark, sf_dir):
    return _placed(_betweenness(spark, sf_dir, "equal"), "src", "dst")


@query
def itemset_lines(spark, sf_dir):
    """A line for each size of itemsets, ascending inside and across."""
    pairs = _customers_brands(spark, sf_dir)
    found = itemsets.frequent_itemsets(pairs, _support(pairs))
    dropped(pairs)
    return writers.itemset_lines(found)


@query
def community_lines(spark, sf_dir):
    """A line for each component, by its first member."""
    lines = writers.community_lines(graph.components(_edges(spark, sf_dir)), "node", "component")
    return _placed(lines, "first")


# --- sets and similarity


def _sets(spark, sf_dir) -> DataFrame:
    with shuffles_dropped(spark), temporary("words"):
        return stored(lsh.indexed(roles.word_sets(spark, sf_dir)), "words")


@query
def minhash_signatures(spark, sf_dir):
    return lsh.minhash(_sets(spark, sf_dir))


@query
def lsh_bands(spark, sf_dir):
    return lsh.band_keys(lsh.minhash(_sets(spark, sf_dir)))


@query
def lsh_candidates(spark, sf_dir):
    return lsh.lsh_candidates(checkpointed(lsh.minhash(_sets(spark, sf_dir))))


@query
def jaccard_similar_lsh(spark, sf_dir):
    pairs = _sets(spark, sf_dir)
    found = lsh.jaccard_lsh(pairs)
    dropped(pairs)
    return found


@query
def jaccard_similar_exact(spark, sf_dir):
    pairs = _sets(spark, sf_dir)
    sets = lsh.ranked_sets(pairs)
    dropped(pairs)
    return lsh.jaccard_exact(pairs, sets=sets)


def _found_and_true(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    sets = lsh.ranked_sets(pairs)
    found = lsh.jaccard_lsh(pairs, sets=sets)
    dropped(pairs)
    return found, lsh.jaccard_exact(pairs, sets=sets)


@query
def lsh_precision_recall(spark, sf_dir):
    return lsh.precision_recall(*_found_and_true(_sets(spark, sf_dir)))


@query
def similar_in_both(spark, sf_dir):
    found, true = _found_and_true(_sets(spark, sf_dir))
    return found.select("m1", "m2").intersect(true.select("m1", "m2"))


# --- recommendation


@query
def user_pearson(spark, sf_dir):
    return _rounded(recommend.pearson(_train_test(roles.ratings(spark, sf_dir))[0], "userId", "movieId"), "sim")


@query
def user_topn_neighbours(spark, sf_dir):
    pairs = _rounded(recommend.pearson(_train_test(roles.ratings(spark, sf_dir))[0], "userId", "movieId"), "sim")
    return recommend.neighbours(pairs, 5)


def _user_cf(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = checkpointed(roles.ratings(spark, sf_dir))
    return rows, recommend.user_cf(*_train_test(rows))


@query
def user_cf_predict(spark, sf_dir):
    return _rounded(_user_cf(spark, sf_dir)[1], "rating")


@query
def user_cf_histogram(spark, sf_dir):
    rows, predicted = _user_cf(spark, sf_dir)
    return evaluate.error_histogram(rows, _rounded(predicted, "rating"))


@query
def user_cf_rmse(spark, sf_dir):
    return _rounded(evaluate.rmse(*_user_cf(spark, sf_dir)), "rmse")


def _similar(rows: DataFrame) -> DataFrame:
    return lsh.jaccard_exact(rows.select(F.col("movieId").alias("item"), F.col("userId").alias("e")).distinct())


@query
def item_pearson_gated(spark, sf_dir):
    rows = checkpointed(roles.brand_ratings(spark, sf_dir))
    return _rounded(recommend.gated(recommend.pearson(_train_test(rows)[0], "movieId", "userId"), _similar(rows)), "sim")


def _item_cf(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = checkpointed(roles.brand_ratings(spark, sf_dir))
    return rows, recommend.item_cf(*_train_test(rows), _similar(rows))


@query
def item_cf_predict(spark, sf_dir):
    return _rounded(_item_cf(spark, sf_dir)[1], "rating")


@query
def item_cf_rmse(spark, sf_dir):
    return _rounded(evaluate.rmse(*_item_cf(spark, sf_dir)), "rmse")


def _als(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = checkpointed(roles.ratings(spark, sf_dir))
    return rows, recommend.als_cf(*_train_test(rows))


@query
def als_predict(spark, sf_dir):
    return _als(spark, sf_dir)[1]


@query
def als_histogram(spark, sf_dir):
    return evaluate.error_histogram(*_als(spark, sf_dir))


# --- graphs


def _edges(spark, sf_dir) -> DataFrame:
    with temporary("cooccurrences"):
        counted = stored(graph.cooccurrences(roles.ratings(spark, sf_dir)), "cooccurrences")
    least = counted.agg(F.expr(f"percentile_disc({EDGE_QUANTILE}) within group (order by n)").alias("least"))
    edges = counted.crossJoin(F.broadcast(least)).where("n >= least")  # one row on the right
    edges = checkpointed(edges.select("src", "dst"))
    dropped(counted)
    return edges


@query
def graph_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def graph_degree(spark, sf_dir):
    return graph.degrees(_edges(spark, sf_dir))


@query
def bfs_levels(spark, sf_dir):
    return graph.bfs_levels(_edges(spark, sf_dir)).select("root", "node", "level", F.col("paths").cast("long").alias("paths"))


@query
def edge_betweenness_equal(spark, sf_dir):
    return _betweenness(spark, sf_dir, "equal")


@query
def edge_betweenness_sigma(spark, sf_dir):
    return _betweenness(spark, sf_dir, "paths")


@query
def components(spark, sf_dir):
    return graph.components(_edges(spark, sf_dir))


@query
def modularity_of_components(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return _rounded(graph.modularity(edges, graph.components(edges)), "modularity")


@query
def best_modularity_communities(spark, sf_dir):
    return _rounded(graph.best_communities(_edges(spark, sf_dir)), "modularity")


@query
def girvan_newman_3(spark, sf_dir):
    return graph.girvan_newman(_edges(spark, sf_dir), 3)


# --- streams


@query
def sliding_ones_1000(spark, sf_dir):
    return bit_streams.sliding_ones(roles.bits(spark, sf_dir), 1000)


@query
def dgim_estimate(spark, sf_dir):
    return bit_streams.dgim_batch(roles.bits(spark, sf_dir), 1000, 1000)


@query
def hashtag_topk(spark, sf_dir):
    return text_streams.top_tags(roles.tagged_texts(spark, sf_dir), 5)


@query
def mean_text_length(spark, sf_dir):
    return _rounded(text_streams.mean_length(roles.table(spark, sf_dir, "documents")), "mean_length")


@query
def reservoir_sample(spark, sf_dir):
    """A hundred rows drawn by a seeded hash, in parallel; the one-pass reservoir is for streams."""
    return text_streams.sample(roles.tagged_texts(spark, sf_dir), 100).select("id", "text")


def queries() -> dict[str, Query]:
    return dict(_found)
