"""The registered queries in DuckDB's SQL, over views of the same tables."""

from __future__ import annotations

from millrace.operators.lsh import BANDS, HASHES, ROWS
from millrace.plans.queries import EDGE_QUANTILE, SUPPORT_SHARE

_RATINGS = """s as (select l_suppkey as userId, l_partkey as movieId, max(ceil(l_quantity / 5) / 2) as rating
  from lineitem group by 1, 2)"""
_BRANDS = r"""s as (select o_custkey as userId, cast(regexp_extract(p_brand, '(\d+)', 1) as integer) as movieId,
  max(ceil(l_quantity / 5) / 2) as rating from lineitem join orders on l_orderkey = o_orderkey
  join part on l_partkey = p_partkey group by 1, 2)"""
_SPLIT = """test as (select userId, movieId from s where (userId * 31 + movieId * 17) % 10 = 0),
train as (select s.* from s anti join test using (userId, movieId))"""
_TAGS = """tags as (select p_partkey as movieId, p_type as tag from part union all select p_partkey, p_brand from part
  union all select p_partkey, p_type from part where p_size > 25)"""
_PAIRS = f"""support as (select ceil(count(distinct userId) * {SUPPORT_SHARE}) as least from s)"""
_SETS = r"""w as (select distinct doc_id as item, unnest(string_split_regex(lower(text), '\s+')) as element from documents),
x as (select item, dense_rank() over (order by element) - 1 as e from w where element <> ''),
m as (select count(distinct e) as m from x)"""
_SIGNATURES = f"""{_SETS}, sig as (select item, {", ".join(f"min((({a}::bigint * e + {b}) % {p}) % m) as h{k}" for k, (a, b, p) in enumerate(HASHES))}
  from x, m group by item)"""
_KEYS = f"""{_SIGNATURES}, keys as ({" union all ".join(f"select {b} as band, {', '.join(f'h{b * ROWS + r} as k{r}' for r in range(ROWS))}, item from sig" for b in range(BANDS))})"""
_CANDIDATES = f"""{_KEYS}, cand as (select distinct p.item as m1, q.item as m2 from keys p join keys q
  on p.band = q.band and {" and ".join(f"p.k{r} = q.k{r}" for r in range(ROWS))} and p.item < q.item)"""
_SIMILAR = """n as (select item, count(*) as n from x group by item),
both_ as (select p.item as m1, q.item as m2, count(*) as c from x p join x q on p.e = q.e and p.item < q.item group by 1, 2),
near as (select m1, m2, c / (a.n + b.n - c) as jaccard from both_ join n a on a.item = m1 join n b on b.item = m2
  where c / (a.n + b.n - c) >= 0.5)"""


def _pearson(entity: str, shared: str) -> str:
    return f"""mom as (select p.{entity} as a, q.{entity} as b, count(*) as n, sum(p.rating) as sa, sum(q.rating) as sb,
  sum(p.rating * q.rating) as ab, sum(p.rating * p.rating) as aa, sum(q.rating * q.rating) as bb
  from train p join train q on p.{shared} = q.{shared} and p.{entity} < q.{entity} group by 1, 2),
pear as (select a, b, n, case when n * ab - sa * sb = 0 then 0.0
  else (n * ab - sa * sb) / (sqrt(n * aa - sa * sa) * sqrt(n * bb - sb * sb)) end as sim from mom)"""


def _near(n: int, sim: str = "sim", pairs: str = "pear") -> str:
    return f"""sym as (select a as id, b as nbr, {sim} as sim from {pairs} union all select b, a, {sim} from {pairs}),
top as (select id, nbr, sim from (select *, row_number() over (partition by id order by sim desc, nbr) as r from sym) where r <= {n})"""


_USER_CF = f"""{_RATINGS}, {_SPLIT}, {_pearson("userId", "movieId")}, {_near(5)},
means as (select userId, avg(rating) as mean from train group by 1),
votes as (select t.userId, t.movieId, sum(top.sim * (r.rating - mn.mean)) as up, sum(abs(top.sim)) as down
  from test t join top on top.id = t.userId join train r on r.userId = top.nbr and r.movieId = t.movieId
  join means mn on mn.userId = top.nbr group by 1, 2),
pred as (select t.userId, t.movieId, greatest(0.0, least(5.0, coalesce(mean + coalesce(case when down > 0 then up / down end, 0.0), 2.5))) as rating
  from test t left join means using (userId) left join votes v on v.userId = t.userId and v.movieId = t.movieId)"""
_BRAND_SIMILAR = f"""x as (select distinct movieId as item, userId as e from s), {_SIMILAR}"""
_ITEM_GATED = f"""{_BRANDS}, {_SPLIT}, {_BRAND_SIMILAR}, {_pearson("movieId", "userId")},
gate as (select pear.* from pear semi join near on near.m1 = pear.a and near.m2 = pear.b)"""
_ITEM_CF = f"""{_ITEM_GATED}, {_near(2, pairs="gate")},
means as (select movieId, avg(rating) as mean from train group by 1),
votes as (select t.userId, t.movieId, sum(top.sim * r.rating) as up, sum(abs(top.sim)) as down
  from test t join top on top.id = t.movieId join train r on r.movieId = top.nbr and r.userId = t.userId group by 1, 2),
pred as (select t.userId, t.movieId, greatest(0.0, least(5.0, coalesce(case when down > 0 then up / down end, mean, 2.5))) as rating
  from test t left join means using (movieId) left join votes v on v.userId = t.userId and v.movieId = t.movieId)"""
_RMSE = "select count(*) as n, round(sqrt(avg((s.rating - pred.rating) * (s.rating - pred.rating))), 6) as rmse from s join pred using (userId, movieId)"

_EDGES = f"""{_RATINGS}, co as (select p.userId as src, q.userId as dst, count(*) as n from s p join s q
  on p.movieId = q.movieId and p.userId < q.userId group by 1, 2),
edges as (select src, dst from co where n >= (select quantile_disc(n, {EDGE_QUANTILE}) from co)),
ways as (select src, dst from edges union all select dst, src from edges)"""
_LEVELS = f"""{_EDGES}, walk as (select distinct src as root, src as node, 0 as level from ways
  union select root, dst, level + 1 from walk join ways on node = src where level < 16),
lv as (select root, node, min(level) as level from walk group by 1, 2),
par as (select c.root, c.node as child, p.node as parent, c.level from lv c join ways on ways.src = c.node
  join lv p on p.root = c.root and p.node = ways.dst and p.level = c.level - 1)"""
_PATHS = """routes as (select root, node from lv where level = 0
  union all select par.root, par.child from routes join par on par.root = routes.root and par.parent = routes.node),
np as (select root, node, count(*) as paths from routes group by 1, 2)"""


def _flow(share: str) -> str:
    return f"""share as ({share}),
flow as (select root, node as at, 1.0::double as unit, null::bigint as child, null::bigint as parent from lv
  union all select f.root, sh.parent, f.unit * sh.part, sh.child, sh.parent from flow f join share sh on sh.root = f.root and sh.child = f.at)
select least(child, parent) as src, greatest(child, parent) as dst, round(sum(unit) / 2, 6) as betweenness
from flow where child is not null group by 1, 2"""


_COMPONENTS = """reach as (select distinct src as node, src as other from ways union select node, dst from reach join ways on other = src),
comp as (select node, min(other) as component from reach group by 1)"""
_BITS = "b as (select row_number() over (order by ts, event_id) - 1 as seq, cast(event_type = 'purchase' as integer) as bit from events)"


#: Sizes of itemsets that the SQL unrolls; the tests check that no larger one is frequent in the given tables.
MOST_ITEMS = 8


def _itemsets() -> str:
    """Tables f1 to f8 of the frequent itemsets, level by level, and their union as (items, size, n)."""
    made = ["f1 as (select movieId as i1, count(*) as n from s group by 1 having count(*) >= (select least from support))"]
    for k in range(2, MOST_ITEMS + 1):
        items = [f"i{j}" for j in range(1, k + 1)]
        same = " and ".join(["true", *[f"p.{i} = q.{i}" for i in items[:-2]]])
        made.append(f"c{k} as (select {', '.join(f'p.{i}' for i in items[:-1])}, q.{items[-2]} as {items[-1]} from f{k - 1} p join f{k - 1} q on {same} and p.{items[-2]} < q.{items[-2]})")
        held = " ".join(f"join s s{j} on s{j}.movieId = c.i{j}" + (" and s1.userId = s%d.userId" % j if j > 1 else "") for j in range(1, k + 1))
        made.append(f"f{k} as (select {', '.join(f'c.{i}' for i in items)}, count(*) as n from c{k} c {held} group by all having count(*) >= (select least from support))")
    union = " union all ".join(f"select concat_ws(',', {', '.join(f'i{j}' for j in range(1, k + 1))}) as items, [{', '.join(f'i{j}' for j in range(1, k + 1))}] as list, {k} as size, n from f{k}" for k in range(1, MOST_ITEMS + 1))
    return f"{', '.join(made)}, every as ({union})"


_ITEMSETS = f"{_BRANDS}, {_PAIRS}, {_itemsets()}"
_EQUAL_SHARES = """k as (select root, child, count(*) as k from par group by 1, 2),
    """
_BETWEEN = f"""{_LEVELS}, {_EQUAL_SHARES}bt as (with recursive {_flow("select par.root, par.child, par.parent, 1.0 / k as part from par join k using (root, child)")})"""
#: Removing edges by falling betweenness: (gone, node, c), the component of each node when ``gone`` edges are removed.
_SWEEP = f"""{_BETWEEN}, ord as (select src, dst, row_number() over (order by betweenness desc, src, dst) as r from bt),
steps as (select 0 as gone union all select r from ord),
open as (select src, dst, r from ord union all select dst, src, r from ord),
grown as (select distinct gone, src as node, src as other from steps, ways
  union select grown.gone, node, dst from grown join open on open.src = other and open.r > grown.gone),
parts as (select gone, node, min(other) as c from grown group by 1, 2),
total as (select count(*) as m from edges),
deg as (select gone, c, count(*) as d from parts join ways on ways.src = node group by 1, 2),
inside as (select p.gone, p.c, count(*) as l from edges join parts p on p.node = edges.src join parts q on q.gone = p.gone and q.node = edges.dst and q.c = p.c group by 1, 2),
mod as (select gone, sum(coalesce(l, 0) / m - (d / (2 * m)) * (d / (2 * m))) as q from deg left join inside using (gone, c), total group by 1),
best as (select min(gone) as gone, any_value(top) as q from mod, (select max(q) as top from mod) where q >= top - 1e-9)"""


def oracle_sql() -> dict[str, str]:
    return {
        "movie_avg": f"with {_RATINGS} select movieId, sum(rating) / count(*) as rating_avg from s group by 1",
        "tag_avg": f"""with {_RATINGS}, {_TAGS}, t as (select movieId, sum(rating) as total, count(*) as n from s group by 1)
            select tag, sum(total) / sum(n) as rating_avg from tags join t using (movieId) group by 1""",
        "train_split": f"with {_RATINGS}, {_SPLIT} select userId, movieId, rating from train",
        "user_mean": f"with {_RATINGS}, {_SPLIT} select userId, avg(rating) as mean, count(*) as n from train group by 1",
        "item_mean_baseline": f"""with {_RATINGS}, {_SPLIT}, m as (select movieId, avg(rating) as mean from train group by 1)
            select userId, movieId, coalesce(mean, 2.5) as rating from test left join m using (movieId)""",
        "dense_index": f"with {_RATINGS} select movieId, cast(dense_rank() over (order by movieId) - 1 as bigint) as idx from (select distinct movieId from s)",
        "corated_counts": f"with {_RATINGS} select p.userId as src, q.userId as dst, count(*) as n from s p join s q on p.movieId = q.movieId and p.userId < q.userId group by 1, 2",
        "item_popularity_topk": f"with {_RATINGS} select movieId, count(*) as n from s group by 1 order by n desc, movieId limit 20",
        "ratings_clamped": f"with {_RATINGS} select userId, movieId, greatest(1.0, least(4.0, rating)) as rating from s",
        "tags_union": f"""with {_RATINGS}, {_TAGS} select tag, count(*) as n from (select tag from tags union all select 'best' from s where rating = 5) group by 1""",
        "baskets_by_user": f"with {_BRANDS} select userId as basket, count(*) as n, string_agg(movieId::varchar, ',' order by movieId) as items from s group by 1",
        "baskets_by_item": f"with {_BRANDS} select movieId as basket, count(*) as n, string_agg(userId::varchar, ',' order by userId) as items from s group by 1",
        "frequent_1": f"with {_BRANDS}, {_PAIRS} select movieId as i1, count(*) as n from s group by 1 having count(*) >= (select least from support)",
        "frequent_2": f"""with {_BRANDS}, {_PAIRS} select a.movieId as i1, b.movieId as i2, count(*) as n from s a
            join s b on a.userId = b.userId and a.movieId < b.movieId group by 1, 2 having count(*) >= (select least from support)""",
        "frequent_3": f"""with {_BRANDS}, {_PAIRS} select a.movieId as i1, b.movieId as i2, c.movieId as i3, count(*) as n from s a
            join s b on a.userId = b.userId and a.movieId < b.movieId join s c on c.userId = b.userId and b.movieId < c.movieId
            group by 1, 2, 3 having count(*) >= (select least from support)""",
        "frequent_itemsets_fpgrowth": f"with {_ITEMSETS} select items, n from every",
        "frequent_itemsets": f"with {_ITEMSETS} select items, n from every",
        "itemset_lines": f"""with {_ITEMSETS} select size, string_agg('(' || replace(items, ',', ', ') || ')', ', ' order by list) as value from every group by size""",
        "movie_avg_sorted": f"with {_RATINGS}, a as (select movieId, sum(rating) / count(*) as rating_avg from s group by 1) select *, row_number() over (order by movieId) - 1 as place from a",
        "tag_avg_sorted": f"""with {_RATINGS}, {_TAGS}, t as (select movieId, sum(rating) as total, count(*) as n from s group by 1),
            a as (select tag, sum(total) / sum(n) as rating_avg from tags join t using (movieId) group by 1) select *, row_number() over (order by tag desc) - 1 as place from a""",
        "predictions_sorted": f"with {_USER_CF} select userId, movieId, round(rating, 6) as rating, row_number() over (order by userId, movieId) - 1 as place from pred",
        "betweenness_sorted": f"with recursive {_BETWEEN} select src, dst, betweenness, row_number() over (order by betweenness desc, src, dst) - 1 as place from bt",
        "edges_sorted": f"with recursive {_BETWEEN} select src, dst, betweenness, row_number() over (order by src, dst) - 1 as place from bt",
        "community_lines": f"""with recursive {_EDGES}, {_COMPONENTS} select component as first, '[' || string_agg(node::varchar, ', ' order by node) || ']' as value,
            row_number() over (order by component) - 1 as place from comp group by component""",
        "best_modularity_communities": f"with recursive {_SWEEP} select node, c as component, round(q, 6) as modularity from parts join best using (gone)",
        "reservoir_sample": """select event_id as id, 'user ' || user_id || ' #' || event_type as text from events order by md5('42:' || event_id), event_id limit 100""",
        "minhash_signatures": f"with {_SIGNATURES} select * from sig",
        "lsh_bands": f"with {_KEYS} select * from keys",
        "lsh_candidates": f"with {_CANDIDATES} select * from cand",
        "jaccard_similar_lsh": f"with {_CANDIDATES}, {_SIMILAR} select near.* from near semi join cand using (m1, m2)",
        "jaccard_similar_exact": f"with {_SETS}, {_SIMILAR} select * from near",
        "lsh_precision_recall": f"""with {_CANDIDATES}, {_SIMILAR}, f as (select near.* from near semi join cand using (m1, m2)),
            c as (select (select count(*) from f) as found, (select count(*) from near) as truth)
            select found, truth, found as hits, case when found > 0 then 1.0::double end as precision, case when truth > 0 then found / truth end as recall from c""",
        "similar_in_both": f"with {_CANDIDATES}, {_SIMILAR} select m1, m2 from near semi join cand using (m1, m2) intersect select m1, m2 from near",
        "user_pearson": f"with {_RATINGS}, {_SPLIT}, {_pearson('userId', 'movieId')} select a, b, n, round(sim, 6) as sim from pear",
        "user_topn_neighbours": f"with {_RATINGS}, {_SPLIT}, {_pearson('userId', 'movieId')}, {_near(5, 'round(sim, 6)')} select * from top",
        "user_cf_predict": f"with {_USER_CF} select userId, movieId, round(rating, 6) as rating from pred",
        "user_cf_histogram": f"""with {_USER_CF}, e as (select abs(s.rating - round(pred.rating, 6)) as e from s join pred using (userId, movieId))
            select {", ".join(f"count(*) filter (e >= {k} and e < {k + 1}) as b{k}" for k in range(4))}, count(*) filter (e >= 4) as b4 from e""",
        "user_cf_rmse": f"with {_USER_CF} {_RMSE}",
        "item_pearson_gated": f"with {_ITEM_GATED} select a, b, n, round(sim, 6) as sim from gate",
        "item_cf_predict": f"with {_ITEM_CF} select userId, movieId, round(rating, 6) as rating from pred",
        "item_cf_rmse": f"with {_ITEM_CF} {_RMSE}",
        "graph_edges": f"with {_EDGES} select src, dst from edges",
        "graph_degree": f"with {_EDGES} select src as node, count(*) as degree from ways group by 1",
        "bfs_levels": f"with recursive {_LEVELS}, {_PATHS} select root, node, level, paths from lv join np using (root, node)",
        "edge_betweenness_equal": f"""with recursive {_LEVELS},
            k as (select root, child, count(*) as k from par group by 1, 2),
            {_flow("select par.root, par.child, par.parent, 1.0 / k as part from par join k using (root, child)")}""",
        "edge_betweenness_sigma": f"""with recursive {_LEVELS}, {_PATHS},
            {_flow("select par.root, par.child, par.parent, p.paths / c.paths as part from par join np p on p.root = par.root and p.node = par.parent join np c on c.root = par.root and c.node = par.child")}""",
        "components": f"with recursive {_EDGES}, {_COMPONENTS} select * from comp",
        "modularity_of_components": f"""with recursive {_EDGES}, {_COMPONENTS}, m as (select count(*) as m from edges),
            d as (select component, count(*) as d from ways join comp on node = src group by 1),
            l as (select component, count(*) as l from edges join comp on node = src group by 1)
            select m, round(sum(l / m - (d / (2 * m)) * (d / (2 * m))), 6) as modularity from d join l using (component), m group by 1""",
        "sliding_ones_1000": f"with {_BITS} select seq, cast(sum(bit) over (order by seq rows 999 preceding) as bigint) as ones from b",
        "hashtag_topk": "select event_type as tag, count(*) as n from events group by 1 order by n desc, tag limit 5",
        "mean_text_length": "select count(text) as n, round(avg(length(text)), 6) as mean_length from documents",
    }
