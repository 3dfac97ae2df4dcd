"""Graphs as undirected edges (src, dst) with src < dst: betweenness, components, communities."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.paths import Graph
from millrace.storage import checkpointed, shuffles_dropped, stored

#: A graph of at most so many edges is broadcast, and its roots are shared out; a larger one is joined.
BROADCAST_EDGES = 2_000_000
#: Edges that Girvan-Newman holds on the driver as Python objects, at most.
HELD_EDGES = 1_000_000
#: Distinct links whose components are found on the driver, at most; more of them are joined.
HELD_LINKS = 50_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def cooccurrences(ratings: DataFrame, node: str = "userId", shared: str = "movieId") -> DataFrame:
    """(src, dst, n), src < dst: how many distinct shared values two nodes have in common.

    The nodes of a value go, sorted, to each block of nodes that has one of them, where the pairs whose smaller node
    is of that block are made and counted. So lists are shuffled, and no pairs. Whole numbers are in blocks of
    neighbouring ones, of about as many rows each, as nodes that meet are often near each other: so a list goes to few
    blocks. Nodes of other types are in blocks by hash. The distinct rows are stored; the end of ``temporary`` removes them.
    """
    rows, block = _rows_and_block(ratings, node, shared)
    blocks = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt_lists(rows, block).repartition(blocks, "block")
    each = dealt.select("block", "vs", F.posexplode("vs").alias("i", "src")).where(block(F.col("src")) == F.col("block"))
    met = each.select("block", "src", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("dst"))
    return met.groupBy("block", "src", "dst").agg(F.count("*").alias("n")).select("src", "dst", "n")


def _rows_and_block(ratings: DataFrame, node: str, shared: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Distinct (k, v) of shared values and nodes, stored, and the block of a node."""
    with shuffles_dropped(ratings.sparkSession):
        rows = stored(ratings.select(F.col(shared).alias("k"), F.col(node).alias("v")).where("k is not null and v is not null").distinct(), "rows")
    blocks = int(ratings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if isinstance(rows.schema["v"].dataType, _WHOLE):
        bounds = _cuts(rows, blocks)
        return rows, lambda v: _interval(v, bounds)
    return rows, lambda v: F.pmod(F.xxhash64(v), F.lit(blocks)).cast("int")


def _dealt_lists(rows: DataFrame, block: Callable[[Column], Column]) -> DataFrame:
    """(block, vs): each value's nodes, ascending, once for each block that has one of them, from the block's first on."""
    lists = rows.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("vs")).select("vs", F.transform("vs", block).alias("of"))
    dealt = lists.select("vs", "of", F.explode(F.array_distinct("of")).alias("block"))
    rest = F.slice("vs", F.array_position("of", F.col("block")).cast("int"), F.size("vs"))
    return dealt.select("block", rest.alias("vs")).where(F.size("vs") > 1)


def _cuts(rows: DataFrame, blocks: int) -> list[int]:
    """Distinct numbers, ascending, that cut the rows' ``v`` into at most ``blocks`` intervals of about as many rows."""
    shares = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    return sorted(set(rows.agg(F.percentile_approx("v", shares, F.lit(10000)).alias("at")).first().at or [])) if blocks > 1 else []


def _interval(v: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are at most ``v``, by halving."""

    def among(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(v < F.lit(bounds[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return among(0, len(bounds))


def cooccurrence_edges(ratings: DataFrame, min_shared: int = 9, node: str = "userId", shared: str = "movieId") -> DataFrame:
    """(src, dst) of nodes with at least ``min_shared`` values in common."""
    return cooccurrences(ratings, node, shared).where(F.col("n") >= min_shared).select("src", "dst")


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    pair = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    return edges.select(pair.alias("e")).select("e.src", "e.dst")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree)."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def _shared(edges: DataFrame) -> Graph | None:
    """The graph, if its nodes are whole numbers and it has at most ``BROADCAST_EDGES`` edges."""
    if not all(isinstance(edges.schema[c].dataType, _WHOLE) for c in ("src", "dst")):
        return None
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src is not null and dst is not null")
    got = rows.limit(BROADCAST_EDGES + 1).toArrow()
    if got.num_rows > BROADCAST_EDGES:
        return None
    return Graph.of(got["src"].to_numpy(), got["dst"].to_numpy())


def _by_roots(spark: SparkSession, graph: Graph, roots: np.ndarray, run, schema: str) -> DataFrame:
    """``run(graph, batches)`` in as many tasks as the session has cores or more; each takes batches of neighbouring roots."""
    batches = graph.batches(roots)
    shared = spark.sparkContext.broadcast((graph, batches))

    def task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, dealt = shared.value
        at = [i for p in parts for i in p.column(0).to_pylist()]
        if at:
            yield from run(own, (dealt[i] for i in at))

    tasks = max(1, min(len(batches), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, len(batches), 1, tasks).mapInArrow(task, schema)


def _levels_of(graph: Graph, batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        root, node, level, paths = graph.levels(batch)
        yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node), pa.array(level), pa.array(paths)], names=["root", "node", "level", "paths"])


def _credit_of(weighting: str):
    def run(graph: Graph, batches: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        credit = graph.credit(batches, weighting)
        used = np.flatnonzero(credit)
        yield pa.RecordBatch.from_arrays([pa.array(graph.names[graph.a[used]]), pa.array(graph.names[graph.b[used]]), pa.array(credit[used])], names=["src", "dst", "b"])

    return run


def bfs_levels(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, node, level, paths) of all nodes reachable from each root (all nodes, if none are given).

    ``paths`` counts the shortest paths. The roots of a graph of at most ``BROADCAST_EDGES`` edges are shared out and
    nothing but the graph is stored; a larger graph is walked by joins.
    """
    graph = _shared(edges)
    if graph is None:
        return _bfs_levels_by_joins(edges, roots)
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    wanted, lone = _roots_of(graph, roots)
    found = _by_roots(spark, graph, wanted, _levels_of, "root long, node long, level int, paths double")
    if len(lone):
        found = found.unionByName(spark.createDataFrame([(v, v, 0, 1.0) for v in lone.tolist()], found.schema))
    return found.select(F.col("root").cast(kind).alias("root"), F.col("node").cast(kind).alias("node"), "level", "paths")


def _roots_of(graph: Graph, roots: DataFrame | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of the roots in the graph, all by default, and the names of given ones that have no edge."""
    if roots is None:
        return np.arange(len(graph.names)), np.zeros(0, np.int64)
    named = np.unique(roots.toDF("root").where("root is not null").select(F.col("root").cast("long")).distinct().toArrow()["root"].to_numpy())
    return graph.places(named)


def _bfs_levels_by_joins(edges: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Each step joins the frontier of all roots with the edges and drops what was reached before; the steps are as
    many as the longest distance."""
    ways = checkpointed(both_ways(edges))
    roots = ways.select(F.col("src").alias("root")).distinct() if roots is None else roots.toDF("root").distinct()
    frontier = checkpointed(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")))
    seen, level = frontier, 0
    while True:
        level += 1
        step = frontier.join(ways.toDF("node", "next"), "node").groupBy("root", F.col("next").alias("node")).agg(F.sum("paths").alias("paths"))
        frontier = checkpointed(step.join(seen.select("root", "node"), ["root", "node"], "left_anti").select("root", "node", F.lit(level).alias("level"), "paths"))
        if not frontier.limit(1).count():
            return seen
        seen = checkpointed(seen.unionByName(frontier))


def edge_betweenness(edges: DataFrame, weighting: str = "equal", roots: DataFrame | None = None) -> DataFrame:
    """(src, dst, betweenness) of all edges that lie on a shortest path from a root; all nodes are roots by default.

    From each root, a node passes one unit and all it has received to its parents, the neighbours one level up: in
    equal parts, or with weighting "paths" in proportion to their numbers of shortest paths. Half the sum over all
    roots is an edge's betweenness. The roots of a graph of at most ``BROADCAST_EDGES`` edges are shared out, and each
    task adds up its own. A larger graph is joined, which takes a row for each pair of connected nodes: there, pass
    a sample of roots, over which the sum is scaled up to all nodes.
    """
    if weighting not in ("equal", "paths"):
        raise ValueError("weighting is equal or paths")
    graph = _shared(edges)
    if graph is None:
        return _edge_betweenness_by_joins(edges, weighting, roots)
    wanted, lone = _roots_of(graph, roots)
    scale = 1.0 if roots is None else len(graph.names) / max(1, len(wanted) + len(lone))
    credit = _by_roots(edges.sparkSession, graph, wanted, _credit_of(weighting), "src long, dst long, b double")
    summed = credit.groupBy("src", "dst").agg((F.sum("b") / 2 * scale).alias("betweenness"))
    return summed.select(*[F.col(c).cast(edges.schema[c].dataType).alias(c) for c in ("src", "dst")], "betweenness")


def _edge_betweenness_by_joins(edges: DataFrame, weighting: str, roots: DataFrame | None) -> DataFrame:
    levels = _bfs_levels_by_joins(edges, roots)
    ways = both_ways(edges)
    scale = 1.0 if roots is None else ways.select("src").distinct().count() / max(1, levels.select("root").distinct().count())
    child = levels.toDF("root", "child", "level", "child_paths")
    parent = levels.select("root", F.col("node").alias("parent"), (F.col("level") + 1).alias("level"), F.col("paths").alias("parent_paths"))
    up = child.join(ways.toDF("child", "parent"), "child").join(parent, ["root", "parent", "level"])
    if weighting == "equal":
        number = up.groupBy("root", "child").agg(F.count("*").alias("k"))
        up = up.join(number, ["root", "child"]).withColumn("share", 1 / F.col("k"))
    else:
        up = up.withColumn("share", F.col("parent_paths") / F.col("child_paths"))
    up = checkpointed(up.select("root", "child", "parent", "level", "share"))
    deepest = up.agg(F.max("level")).first()[0] or 0
    flows, received = None, None
    for level in range(deepest, 0, -1):
        own = up.where(F.col("level") == level)
        if received is None:
            flow = own.select("root", "child", "parent", F.col("share").alias("flow"))
        else:
            flow = own.join(received.withColumnRenamed("node", "child"), ["root", "child"], "left").select("root", "child", "parent", (F.col("share") * (1 + F.coalesce("got", F.lit(0.0)))).alias("flow"))
        flow = checkpointed(flow)
        received = flow.groupBy("root", F.col("parent").alias("node")).agg(F.sum("flow").alias("got"))
        flows = flow if flows is None else flows.unionByName(flow)
    if flows is None:
        return edges.select("src", "dst", F.lit(0.0).alias("betweenness")).limit(0)
    summed = flows.groupBy(F.least("child", "parent").alias("src"), F.greatest("child", "parent").alias("dst")).agg((F.sum("flow") / 2 * scale).alias("betweenness"))
    return summed.select("src", "dst", "betweenness")


def _smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the smallest node that each can reach."""
    names, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends.reshape(2, -1)
    root = np.arange(len(names))
    while len(x):
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, np.maximum(root[x], root[y]), low)
        while (root[root] != root).any():
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    return names, names[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each can reach.

    In each round every node points to the smallest of itself and its neighbours; pointers are doubled until they
    reach the roots, and the edges are renamed by root and made distinct, until none joins two names. At least half
    of the names that are left vanish in a round, however long the paths are. Of at most ``HELD_LINKS`` edges between
    whole numbers the driver does so itself, as each round is several queries, whatever its size.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    left = checkpointed(pairs.distinct())
    kind = left.schema["a"].dataType
    if isinstance(kind, _WHOLE) and left.count() <= HELD_LINKS:
        got = left.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).toArrow()
        found = pa.table(dict(zip(("node", "component"), _smallest_reached(got["a"].to_numpy(), got["b"].to_numpy()), strict=True)))
        return left.sparkSession.createDataFrame(found, "node long, component long").select(*[F.col(c).cast(kind).alias(c) for c in found.column_names])
    named = both_ways(left.toDF("src", "dst")).select(F.col("src").alias("node")).distinct().withColumn("component", F.col("node"))
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        root = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("m")))
        while True:
            further = root.join(root.toDF("m", "n"), "m").select("node", F.col("n").alias("m"), (F.col("n") != F.col("m")).alias("moved"))
            further = checkpointed(further)
            root = further.select("node", "m")
            if not further.where("moved").limit(1).count():
                break
        renamed = left.join(root.toDF("a", "x"), "a").join(root.toDF("b", "y"), "b").where("x <> y")
        left = checkpointed(renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        named = checkpointed(named.join(root.toDF("component", "m"), "component", "left").select("node", F.coalesce("m", "component").alias("component")))
    return named


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row (m, modularity) of a partition (node, component): sum of L / m - (D / 2m)^2 over communities."""
    inside = edges.join(communities.toDF("src", "c1"), "src").join(communities.toDF("dst", "c2"), "dst").where("c1 = c2")
    own = inside.groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("l"))
    total = degrees(edges).join(communities, "node").groupBy("component").agg(F.sum("degree").alias("d"))
    m = edges.agg(F.count("*").alias("m"))
    terms = total.join(own, "component", "left").crossJoin(F.broadcast(m))  # one row on the right
    q = F.try_divide(F.coalesce("l", F.lit(0)), F.col("m")) - F.pow(F.try_divide(F.col("d"), 2 * F.col("m")), 2)
    return terms.groupBy("m").agg(F.sum(q).alias("modularity"))


def _best(edges: list[tuple[int, int, float]]) -> tuple[dict[int, int], float]:
    """The partition of highest modularity among those that removing edges by falling betweenness passes through.

    Run backwards as a union-find: edges are added by rising betweenness, and each merge of two communities changes
    the modularity by their share of edges between less the product of their degrees.
    """
    m = len(edges)
    degree: dict[int, int] = defaultdict(int)
    between: dict[int, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for a, b, _ in edges:
        degree[a] += 1
        degree[b] += 1
        between[a][b] += 1
        between[b][a] += 1
    parent = {v: v for v in degree}
    members = {v: [v] for v in degree}

    def find(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    q = -sum((d / (2 * m)) ** 2 for d in degree.values())
    total = dict(degree)
    best, merges, at = q, [], 0
    for a, b, _ in sorted(edges, key=lambda e: (e[2], -e[0], -e[1])):
        x, y = find(a), find(b)
        if x == y:
            continue
        if len(between[x]) < len(between[y]):
            x, y = y, x
        q += between[x][y] / m - total[x] * total[y] / (2 * m * m)
        parent[y] = x
        total[x] += total[y]
        for z, n in between.pop(y).items():
            if z != x:
                between[x][z] += n
                between[z][x] += n
                between[z].pop(y, None)
        between[x].pop(y, None)
        merges.append((x, y))
        if q >= best - 1e-12:
            best, at = max(q, best), len(merges)
    for x, y in merges[:at]:
        members[x] += members.pop(y)
    return {v: min(vs) for vs in members.values() for v in vs}, best


def best_communities(edges: DataFrame, betweenness: DataFrame | None = None) -> DataFrame:
    """(node, component, modularity) of the best partition met when edges go by falling betweenness.

    The order is computed once, on the whole graph; the sweep itself is sequential and runs in one task over the
    edges alone.
    """
    ranked = edge_betweenness(edges) if betweenness is None else betweenness

    def sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for f in frames for r in f.itertuples(index=False, name=None)]
        if rows:
            found, q = _best(rows)
            yield pd.DataFrame({"node": list(found), "component": list(found.values()), "modularity": q})

    values = ranked.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.round("betweenness", 9).alias("b"))
    return values.repartition(1).mapInPandas(sweep, "node long, component long, modularity double")


Ways = dict[int, set[int]]


def _reached(start: int, ways: Ways) -> set[int]:
    seen, todo = {start}, [start]
    while todo:
        for w in ways[todo.pop()]:
            if w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def _betweenness_of(edges: set[tuple[int, int]], spark: SparkSession) -> dict[tuple[int, int], float]:
    """Path-count betweenness of a broadcast graph; each task takes a share of the roots."""
    ends = np.array(sorted(edges), np.int64)
    graph = Graph.of(ends[:, 0], ends[:, 1])
    credit = _by_roots(spark, graph, np.arange(len(graph.names)), _credit_of("paths"), "src long, dst long, b double")
    got = credit.groupBy("src", "dst").agg((F.sum("b") / 2).alias("b")).toArrow()
    return dict(zip(zip(got["src"].to_pylist(), got["dst"].to_pylist(), strict=True), got["b"].to_pylist(), strict=True))


def girvan_newman(edges: DataFrame, splits: int = 3) -> DataFrame:
    """(node, component) after the given number of splits, path-count betweenness being taken anew after each removal.

    The removals follow one another; the betweenness before each is computed in parallel, by roots over a broadcast
    graph of at most ``HELD_EDGES`` edges, of which only the component that lost an edge is taken anew, or by
    joins for a larger graph. Of edges that tie, the first by its ends goes.
    """
    spark = edges.sparkSession
    rows = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).where("src < dst").distinct()
    rows = checkpointed(rows)
    most = min(HELD_EDGES, BROADCAST_EDGES)
    if rows.limit(most + 1).count() > most:
        return _girvan_newman_by_joins(rows, splits)
    left = {(r.src, r.dst) for r in rows.collect()}
    ways: Ways = defaultdict(set)
    for a, b in left:
        ways[a].add(b)
        ways[b].add(a)
    flow = _betweenness_of(left, spark) if left else {}
    while splits and flow:
        a, b = min(flow, key=lambda e: (-round(flow[e], 9), e))
        del flow[a, b]
        ways[a].discard(b)
        ways[b].discard(a)
        one = _reached(a, ways)
        parts = [one] if b in one else [one, _reached(b, ways)]
        splits -= len(parts) - 1
        if splits:
            touched = {e for e in flow if any(e[0] in p for p in parts)}
            flow.update(_betweenness_of(touched, spark) if touched else {})
    found: dict[int, int] = {}
    for v in sorted(ways):
        if v not in found:
            found.update(dict.fromkeys(_reached(v, ways), v))
    return spark.createDataFrame(sorted(found.items()), "node long, component long")


def _girvan_newman_by_joins(edges: DataFrame, splits: int) -> DataFrame:
    nodes = both_ways(edges).select(F.col("src").alias("node")).distinct()

    def named(left: DataFrame) -> DataFrame:
        return checkpointed(nodes.join(components(left), "node", "left").select("node", F.coalesce("component", "node").alias("component")))

    left, communities = edges, named(edges)
    number = communities.select("component").distinct().count()
    goal = number + splits
    while number < goal:
        top = edge_betweenness(left, "paths").orderBy(F.desc(F.round("betweenness", 9)), "src", "dst").first()
        if top is None:
            break
        left = checkpointed(left.where((F.col("src") != top.src) | (F.col("dst") != top.dst)))
        communities = named(left)
        number = communities.select("component").distinct().count()
    return communities
