"""Every registered query of the core against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from millrace.operators import itemsets
from millrace.plans import sql
from millrace.registry import oracle_sql, queries


def _norm(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, sf_dir, db, name):
    df = queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    got = sorted((tuple(_norm(r[n]) for n in names) for r in df.collect()), key=repr)
    sql = oracle_sql().get(name)
    if sql is None:
        assert got
        return
    rows = db.sql(sql)
    assert sorted(rows.columns) == names
    at = [rows.columns.index(n) for n in names]
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in rows.fetchall()), key=repr)


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_dgim_by_definition(spark, sf_dir, db):
    """The query's rows against buckets kept as a plain list of (size, time of the newest one)."""
    bits = [b for (b,) in db.sql("select cast(event_type = 'purchase' as integer) from events order by ts, event_id").fetchall()]
    want, buckets = [], []  # oldest first
    for t, bit in enumerate(bits, 1):
        if len(buckets) > 1 and buckets[0][1] < t - 1000:
            buckets.pop(0)
        if bit:
            buckets.append((1, t))
            size = 1
            while sum(s == size for s, _ in buckets) > 2:
                first, second = [i for i, (s, _) in enumerate(buckets) if s == size][:2]
                buckets[first : second + 1] = [(2 * size, buckets[second][1])]
                size *= 2
        if t % 1000 == 0:
            want.append((t - 1, int(sum(s for s, _ in buckets[1:]) + buckets[0][0] / 2) if buckets else 0, sum(bits[max(0, t - 1000) : t])))
    got = sorted((r.seq, r.estimate, r.exact) for r in queries()["dgim_estimate"](spark, sf_dir).collect())
    assert got == want and want


def test_girvan_newman_query(spark, sf_dir, db):
    """The removals one after another in plain Python, betweenness by dependencies from every node."""
    edges = sorted(db.sql(oracle_sql()["graph_edges"]).fetchall())
    got = sorted((r.node, r.component) for r in queries()["girvan_newman_3"](spark, sf_dir).collect())
    assert got == sorted(_removed_until(edges, 3).items())


def _removed_until(edges, splits):
    nodes, left = sorted({v for e in edges for v in e}), set(edges)

    def parts():
        name = {v: v for v in nodes}
        moved = True
        while moved:
            moved = False
            for a, b in left:
                if name[a] != name[b]:
                    name[a] = name[b] = min(name[a], name[b])
                    moved = True
        return name

    goal = len(set(parts().values())) + splits
    while left and len(set(parts().values())) < goal:
        credit = dict.fromkeys(left, 0.0)
        ways = {v: [w for w in nodes if (min(v, w), max(v, w)) in left] for v in nodes}
        for s in nodes:
            far, count, order = {s: 0}, {s: 1}, [s]
            for v in order:
                for w in ways[v]:
                    if w not in far:
                        far[w], count[w] = far[v] + 1, 0
                        order.append(w)
                    if far[w] == far[v] + 1:
                        count[w] += count[v]
            owed = dict.fromkeys(order, 1.0)
            for w in reversed(order):
                for v in ways[w]:
                    if far[v] == far[w] - 1:
                        owed[v] += owed[w] * count[v] / count[w]
                        credit[min(v, w), max(v, w)] += owed[w] * count[v] / count[w] / 2
        left.remove(min(credit, key=lambda e: (-round(credit[e], 9), e)))
    return parts()


def test_als_queries(spark, sf_dir, db):
    """A row for each test key, within the limits; the histogram counts the keys by their errors."""
    keys = {(u, m) for u, m in db.sql(f"with {sql._RATINGS}, {sql._SPLIT} select userId, movieId from test").fetchall()}
    predicted = {(r.userId, r.movieId): r.rating for r in queries()["als_predict"](spark, sf_dir).collect()}
    assert predicted.keys() == keys and all(1 <= x <= 5 for x in predicted.values())
    assert sum(queries()["als_histogram"](spark, sf_dir).first()) == len(keys)


def test_no_itemset_is_larger_than_the_sql_unrolls(db):
    assert db.sql(oracle_sql()["itemset_lines"]).fetchall()
    assert max(r[0] for r in db.sql(oracle_sql()["itemset_lines"]).fetchall()) < sql.MOST_ITEMS


#: The movies that each of 19 users rated, users in order from 1.
BASKETS = """
100 98 101 102; 101 99 97 100; 98 103 105 102 97 99; 102 103 101 99 97; 98 97; 101 102; 99 97 101; 102 104 103 98 97 99;
97 98 99; 98 97; 97 98 99; 100 101 108 98 106 105 107 102; 108 100 105 102 107 98 99 103 106 101; 97; 97 99 101;
98 101 100 99; 97 99; 98 99 97; 102 97 98
"""


@pytest.mark.parametrize("case, support, counts", [(1, 3, [8, 20, 16, 3]), (1, 4, [7, 14, 4]), (2, 5, [5, 3])])
def test_itemsets_of_a_small_file(spark, case, support, counts):
    rows = [(u, int(m)) for u, own in enumerate(BASKETS.split(";"), 1) for m in own.split()]
    assert len(rows) == 74
    pairs = itemsets.baskets(spark.createDataFrame(rows, "userId long, movieId long"), case)
    for found in (itemsets.frequent_itemsets(pairs, support), itemsets.frequent_itemsets_fpgrowth(pairs, support)):
        by = {}
        for r in found.collect():
            by[len(r["items"])] = by.get(len(r["items"]), 0) + 1
        assert [by[k] for k in sorted(by)] == counts
