import pytest
from pyspark.sql import functions as F

from millrace.functions import clamp, hashtags, token_bits
from millrace.operators import aggregates, evaluate, itemsets


def test_tag_average_weighs_every_application(spark):
    ratings = spark.createDataFrame([(1, "m1", 4.0, 1), (2, "m1", 5.0, 1), (1, "m2", 1.0, 1), (2, "m2", 1.0, 1), (3, "m2", 1.0, 1)], "userId long, movieId string, rating double, timestamp long")
    tags = spark.createDataFrame([("t", "m1"), ("t", "m1"), ("t", "m2")], "tag string, movieId string")
    assert [tuple(r) for r in aggregates.tag_avg(ratings, tags).collect()] == [("t", 3.0)]


def test_average_counts_timestamps(spark):
    ratings = spark.createDataFrame([(1, 1, 4.0, None), (2, 1, 2.0, 5), (1, 2, 3.0, None)], "userId long, movieId long, rating double, timestamp long")
    assert {r.movieId: r.rating_avg for r in aggregates.movie_avg(ratings).collect()} == {1: 6.0, 2: None}


def test_numbers_are_dense_and_in_order(spark):
    ids = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v")).union(spark.range(5).select(F.col("id").alias("v")))
    got = {r.v: r.idx for r in aggregates.dense_index(ids, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(got))}
    assert aggregates.dense_index(ids.limit(0), "v").count() == 0


def test_split_and_top(spark):
    ratings = spark.createDataFrame([(u, m, 1.0) for u in range(3) for m in range(3)], "userId long, movieId long, rating double")
    test = spark.createDataFrame([(0, 0), (2, 1)], "userId long, movieId long")
    assert aggregates.split(ratings, test).count() == 7
    top = aggregates.top_per_group(ratings, "userId", 2, F.desc("rating"), "movieId").collect()
    assert sorted((r.userId, r.movieId) for r in top) == [(u, m) for u in range(3) for m in range(2)]


def test_error_histogram(spark):
    said = [0, 0.99, 1, 2.5, 3, 4, 4.5]
    actual = spark.createDataFrame([(i, 0, 0.0) for i in range(7)], "userId long, movieId long, rating double")
    predicted = spark.createDataFrame([(i, 0, float(x)) for i, x in enumerate(said)], "userId long, movieId long, rating double")
    assert tuple(evaluate.error_histogram(actual, predicted).first()) == (2, 1, 1, 1, 2)
    r = evaluate.rmse(actual, predicted).first()
    assert r.n == 7 and abs(r.rmse - (sum(x * x for x in said) / 7) ** 0.5) < 1e-12
    assert evaluate.rmse(actual.limit(0), predicted).first().rmse is None


def test_scalar_functions(spark):
    row = spark.createDataFrame([("#a b ##c # #d, e#f", " 1 0 x 1 ")], "t string, b string").select(hashtags(F.col("t")).alias("h"), token_bits(F.col("b")).alias("b")).first()
    assert row.h == ["a", "#c", "d,"] and row.b == [1, 0, 1]
    got = spark.createDataFrame([(-1.0,), (2.0,), (9.0,), (None,)], "x double").select(clamp(F.col("x"), 0, 5).alias("y")).collect()
    assert [r.y for r in got] == [0.0, 2.0, 5.0, None]


def _brute(baskets, support):
    from itertools import combinations

    items, out, k = sorted({i for b in baskets for i in b}), {}, 1
    while True:
        found = {c: n for c in combinations(items, k) if (n := sum(set(c) <= b for b in baskets)) >= support}
        if not found:
            return out
        out |= found
        k += 1


@pytest.mark.parametrize("support", [3, 5])
def test_itemsets_are_exact(spark, support):
    rows = [(u, m) for u in range(14) for m in range(7) if (u * 31 + m * 17 + u * m) % 5 < 3]
    ratings = spark.createDataFrame(rows + rows[:9], "userId long, movieId long")
    pairs = itemsets.baskets(ratings, 1)
    baskets = [{m for v, m in rows if v == u} for u in range(14)]
    want = _brute(baskets, support)
    assert {tuple(r["items"]): r.n for r in itemsets.frequent_itemsets(pairs, support).collect()} == want
    assert {tuple(r["items"]): r.n for r in itemsets.frequent_itemsets_fpgrowth(pairs, support).collect()} == want
    assert len({len(i) for i in want}) > 1


def test_itemsets_of_nothing(spark):
    pairs = spark.createDataFrame([], "basket long, item long")
    assert itemsets.frequent_itemsets(pairs, 1).count() == 0
    with pytest.raises(ValueError):
        itemsets.baskets(pairs, 3)
