", ", "What queries store on their way does not outgrow their input.", ", "

import pytest

from millrace.operators import graph, lsh
from millrace.plans import queries as plans

SIMILAR = ["jaccard_similar_lsh", "similar_in_both", "lsh_precision_recall"]
GRAPHS = ["edge_betweenness_sigma", "bfs_levels", "betweenness_sorted", "edges_sorted", "best_modularity_communities"]


@pytest.mark.parametrize("name", GRAPHS)
def test_graph_queries_store_no_row_of_a_root_and_a_node(spark, sf_dir, monkeypatch, name):
    edges = plans._edges(spark, sf_dir)
    stored = []

    def counted(df):
        stored.append(df.count())
        return df

    monkeypatch.setattr(plans, "_edges", lambda *_: edges)
    monkeypatch.setattr(graph, "checkpointed", counted)
    plans.queries()[name](spark, sf_dir).count()
    assert max(stored, default=0) <= edges.count()


@pytest.mark.parametrize("name", SIMILAR)
def test_similarity_queries_store_few_pairs(spark, sf_dir, monkeypatch, name):
    ", ", "Candidates that aren't similar don't leave the task where they meet.", ""
    met = []
    monkeypatch.setattr(lsh, "stored", lambda df, name, keep=lsh.stored: met.append((name, (out := keep(df, name)).count())) or out)
    plans.queries()[name](spark, sf_dir).count()
    pairs = [n for what, n in met if what == "met"]
    similar = sum(n for what, n in met if what == "similar")
    assert pairs and sum(pairs) <= 1.5 * similar + 50
