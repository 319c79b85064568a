"""Vector cells, fixed encodings and graph kernels against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.catalog import Graph
from lattica.operators import ann, kernels
from lattica.operators.graphs import project
from lattica.session import Session


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (10, 16))
    x = centres[rng.integers(0, 10, 2000)] + rng.normal(0, 1, (2000, 16))
    g = Graph(spark).add_nodes("V", spark.createDataFrame([(i, i, [float(v) for v in r]) for i, r in enumerate(x)], "_vid long, k long, e array<double>"))
    return x, Session(g)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_cells_find_most_neighbours_and_all_with_all_probes(vectors, metric):
    x, s = vectors
    s.query(f"CREATE VECTOR INDEX v_{metric} FOR (n:V) ON (n.e) OPTIONS {{type: 'ivf_flat', partitions: 16, metric: '{metric}'}}")
    ask = lambda q, more: [r.k for r in s.query(f"CALL uni.vector.query('V', 'e', $q, 10, null, null, {{metric: '{metric}'{more}}}) YIELD node RETURN node.k AS k", q=[float(v) for v in q]).collect()]
    hits = 0
    for i in range(0, 2000, 500):
        exact = ask(x[i], "")
        assert sorted(ask(x[i], ", nprobes: 16")) == sorted(exact)
        hits += len(set(ask(x[i], ", nprobes: 4")) & set(exact))
    assert hits >= 36
    s.query("CREATE (:V {k: -1, e: $e})", e=[0.0] * 16)  # the index is of another table now, so all rows are compared
    assert len(ask(x[0], ", nprobes: 1")) == 10


def test_fixed_encodings_rank_like_maxsim(spark):
    rng = np.random.default_rng(4)
    docs = [rng.normal(size=(rng.integers(2, 6), 8)) for _ in range(60)]
    query = docs[17][:2] + rng.normal(0, 0.05, (2, 8))
    g = Graph(spark).add_nodes("D", spark.createDataFrame([(i, i, [[float(v) for v in r] for r in d]) for i, d in enumerate(docs)], "_vid long, k long, m array<array<double>>"))
    s = Session(g)
    q = [[float(v) for v in r] for r in query]
    best = [r.k for r in s.query("CALL uni.vector.query('D', 'm', $q, 3, null, null, {reranker: 'maxsim'}) YIELD node RETURN node.k AS k", q=q).collect()]
    fast = [r.k for r in s.query("CALL uni.vector.query('D', 'm', $q, 3, null, null, {reranker: 'maxsim', muvera: true}) YIELD node RETURN node.k AS k", q=q).collect()]
    assert best[0] == fast[0] == 17
    empty = spark.createDataFrame([([],)], "m array<array<double>>").select(ann.fixed_encoding(F.col("m"), 8).alias("e")).first().e
    assert set(empty) == {0.0}


@pytest.fixture(scope="module")
def graph(spark):
    g = Graph(spark)
    g.add_nodes("N", spark.range(5).selectExpr("id AS _vid"))
    g.add_edges("E", spark.createDataFrame([(1, 0, 1, 2.0), (2, 0, 2, 3.0), (3, 1, 2, 4.0), (4, 2, 3, None)], "_eid long, _src long, _dst long, w double"), "N", "N")
    return project(g, ["N"], ["E"], "w")


def test_full_text_search_without_k_finds_all(spark):
    texts = spark.range(1500).selectExpr("id AS _vid", "id AS k", "if(id < 1200, 'the apache license', if(id < 1400, concat('license ', repeat('word ', 30)), 'nothing')) AS text")
    s = Session(Graph(spark).add_nodes("D", texts))
    count = lambda more: s.query(f"CALL uni.fts.query('D', 'text', 'apache license', {more}) YIELD node, score RETURN count(node.k) AS n").first().n
    assert count("null, 0.8") == 1200 and count("null") == 1400 and count("1000, 0.8") == 1000


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_kernels(spark, graph):
    v = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, -3.0)], "id long, v double")
    u = spark.createDataFrame([(1, 10.0), (4, 5.0)], "id long, v double")
    assert rows(kernels.frontier(graph, F.col("id") > 2)) == [(3,), (4,)]
    assert rows(kernels.union(v, u)) == [(0,), (1,), (2,), (4,)] and rows(kernels.intersection(v, u)) == [(1,)] and rows(kernels.difference(v, u)) == [(0,), (2,)]
    assert rows(kernels.ewise(v, u, "mul")) == [(1, 20.0)] and rows(kernels.ewise(v, u, "add", 0.0)) == [(0, 1.0), (1, 12.0), (2, -3.0), (4, 5.0)]
    assert rows(kernels.compare(v, "gt", 1.0)) == [(0, False), (1, True), (2, False)] and rows(kernels.compare(v, "lt", u)) == [(1, True)]
    assert rows(kernels.mask(v, u)) == [(1, 2.0)] and rows(kernels.mask(v, u, False)) == [(0, 1.0), (2, -3.0)]
    assert rows(kernels.scatter(v, u)) == [(0, 1.0), (1, 10.0), (2, -3.0), (4, 5.0)]
    assert [round(r[1], 6) for r in rows(kernels.normalise(v))] == [0.166667, 0.333333, -0.5]
    assert rows(kernels.reduce_values(v)) == [(0.0,)] and rows(kernels.arg_reduce(v)) == [(1, 2.0)] and rows(kernels.top(v, 2)) == [(0, 1.0), (1, 2.0)]
    assert rows(kernels.expand(graph, v)) == [(1,), (2,), (3,)] and rows(kernels.expand(graph, u, True)) == [(0,)]
    assert rows(kernels.spmv(graph, v)) == [(1, 2.0), (2, 11.0), (3, -3.0)] and rows(kernels.spmv(graph, v, "min", "add")) == [(1, 3.0), (2, 4.0), (3, -2.0)]
    segments = spark.createDataFrame([(0, 7), (1, 7), (2, 8)], "id long, segment long")
    assert rows(kernels.segmented_reduce(v, segments)) == [(7, 3.0), (8, -3.0)]
    assert kernels.sample_edges(graph, 1).count() == 3 and rows(kernels.sample_edges(graph, 9)) == rows(graph.edges)
    assert rows(kernels.neighbourhood_overlap(graph))[0][:2] == (0, 1)
