"""Algorithms on a fixed graph, against plain Python."""

import random

import pytest

from lattica.catalog import Graph
from lattica.operators import graphs as G
from lattica.operators import sequential as Q
from lattica.operators.crdt import causal_register_merge, gset_merge, lww_merge, orset_merge, sequence_merge
from lattica.session import Session

EDGES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (7, 8)]


@pytest.fixture(scope="module")
def p(spark):
    g = Graph(spark)
    g.add_nodes("N", spark.createDataFrame([(i,) for i in range(1, 10)], "_vid long"))
    g.add_edges("E", spark.createDataFrame([(i, a, b, float(i)) for i, (a, b) in enumerate(EDGES)], "_eid long, _src long, _dst long, w double"), "N", "N")
    return G.project(g, ["N"], ["E"], "w")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_components(p):
    assert pairs(G.wcc(p)) == {(i, 1) for i in range(1, 7)} | {(7, 7), (8, 7), (9, 9)}
    assert pairs(G.strong_components(p)) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, 7), (8, 8), (9, 9)}


def test_counts(p):
    assert dict(pairs(G.triangles(p))) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 0, 8: 0, 9: 0}
    assert dict(pairs(G.core_numbers(p))) == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2, 6: 2, 7: 1, 8: 1, 9: 0}
    ranks = dict(pairs(G.pagerank(p, rounds=50, tolerance=1e-12)))
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[4] > ranks[1] > ranks[9]


def test_sequential(p):
    ids, edges = p.local("test")
    points, bridges = Q.low_links(ids, edges)
    assert points == {3, 4} and bridges == {(3, 4), (7, 8)}
    assert Q.cliques(ids, edges, 3) == [[1, 2, 3], [4, 5, 6]]
    colours = Q.colouring(ids, edges)
    assert all(colours[a] != colours[b] for a, b in EDGES) and max(colours.values()) == 2
    assert len(set(Q.louvain(ids, edges).values())) == 4
    assert Q.max_flow(ids, [(1, 2, 3.0, 0), (1, 3, 2.0, 1), (2, 4, 2.0, 2), (3, 4, 3.0, 3), (2, 3, 5.0, 4)], 1, 4)[0] == 5.0
    assert [c for _, c in Q.k_shortest([(1, 2, 1, 0), (2, 4, 1, 1), (1, 3, 1, 2), (3, 4, 2, 3), (1, 4, 9, 4)], 1, 4, 3)] == [2, 3, 9]
    with pytest.raises(ValueError, match="bipartite"):
        Q.matching(ids, edges)
    assert len(Q.circuits(ids, edges)) == 2 and Q.find_cycle(ids, edges)[0] == Q.find_cycle(ids, edges)[-1]
    assert Q.walks(Q.adjacency(edges), [1], 3, 2, 1, 1, 5) == Q.walks(Q.adjacency(edges), [1], 3, 2, 1, 1, 5)


@pytest.mark.parametrize("least", [1, 2, 3])
def test_cliques_by_joins(p, spark, monkeypatch, least):
    rng = random.Random(5)
    edges = [(i, a, b) for i, (a, b) in enumerate((rng.randrange(30), rng.randrange(30)) for _ in range(260))] + [(900 + i, 40, 50 + i) for i in range(12)] + [(950, 50, 51), (951, 60, 60)]
    g = Graph(spark)
    g.add_nodes("N", spark.range(64).selectExpr("id AS _vid"))
    g.add_edges("E", spark.createDataFrame(edges, "_eid long, _src long, _dst long"), "N", "N")
    monkeypatch.setattr(G, "LOCAL_EDGES", 3)  # they don't go to one process
    found = Session(g).query("CALL uni.algo.maximalCliques(['N'], ['E'], $least) YIELD clique RETURN clique", least=least).collect()
    assert sorted(list(r.clique) for r in found) == Q.cliques(range(64), [(a, b) for _, a, b in edges], least)
    assert max(len(r.clique) for r in found) > 3


def test_similar_vertices_move_each_pair_once(spark):
    rng = random.Random(7)
    edges = [(i, rng.randrange(25), rng.randrange(25)) for i in range(120)] + [(500 + i, i, 30) for i in range(25)]  # 30 is a hub
    g = Graph(spark)
    g.add_nodes("N", spark.range(31).selectExpr("id AS _vid"))
    g.add_edges("E", spark.createDataFrame(edges, "_eid long, _src long, _dst long"), "N", "N")
    out = {}
    for _, a, b in edges:
        out.setdefault(a, set()).add(b)
    for metric, of in (("JACCARD", lambda c, x, y: c / (x + y - c)), ("OVERLAP", lambda c, x, y: c / min(x, y)), ("COSINE", lambda c, x, y: c / (x * y) ** 0.5)):
        df = G.similar_vertices(G.project(g, ["N"], ["E"]), metric, 0.2, 3)
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1  # degrees go with the edges, not to the pairs
        want = set()
        for a in out:
            scored = [(-round(of(len(out[a] & out[b]), len(out[a]), len(out[b])), 9), b) for b in out if a != b and out[a] & out[b]]
            want |= {(a, b, -s) for s, b in sorted(x for x in scored if -x[0] >= 0.2)[:3]}
        assert {(a, b, round(s, 9)) for a, b, s in pairs(df)} == want


def test_spanning_forest(p):
    found = pairs(G.spanning_forest(p))
    assert sum(w for *_, w in found) == sum(range(8)) - 2 - 6 and all(a < b for a, b, _ in found) and len(found) == 6


def test_walks_by_joins(p, spark):
    starts = spark.createDataFrame([(1,), (9,)], "id long")
    walks = lambda seed: sorted(r.path for r in G.random_walks(p, 4, 12, starts, seed).collect())
    found = walks(1)
    assert len(found) == 24 and found == walks(1) and found != walks(2)
    assert found[-12:] == [[9]] * 12 and all((a, b) in EDGES for w in found for a, b in zip(w, w[1:], strict=False))
    heavy = G.Projection(p.ids, spark.createDataFrame([(1, 2, 0.0, 1), (1, 3, 5.0, 2)], "src long, dst long, w double, eid long"))
    assert {tuple(r.path) for r in G.random_walks(heavy, 2, 20, starts.limit(1), 0).collect()} == {(1, 3)}


def test_relax_negative_cycle(p, spark):
    from lattica.errors import CompileError

    edges = spark.createDataFrame([(1, 2, -1.0), (2, 1, -1.0)], "src long, dst long, w double")
    with pytest.raises(CompileError):
        G.relax(spark.createDataFrame([(1, 1, 0.0)], "s long, node long, d double"), edges, 3)


def test_replicated_values(spark):
    assert pairs(lww_merge(spark.createDataFrame([(1, "a", 5, "x"), (1, "b", 5, "y"), (1, "c", 4, "z")], "key long, value string, ts long, actor string")).select("value")) == {("b",)}
    assert gset_merge(spark.createDataFrame([(1, ["b", "a"]), (1, ["c", "a"])], "key long, elements array<string>")).first().elements == ["a", "b", "c"]
    dots = "key long, element string, actor string, seq long"
    clock = "key long, actor string, seq long"
    left, right = spark.createDataFrame([(1, "x", "A", 1), (1, "z", "A", 3)], dots), spark.createDataFrame([(1, "y", "B", 1)], dots)
    merged = orset_merge(left, right, spark.createDataFrame([(1, "A", 3)], clock), spark.createDataFrame([(1, "A", 2), (1, "B", 1)], clock))
    assert pairs(merged.select("element")) == {("z",), ("y",)}  # x was removed on the right, z is new, y unseen
    states = spark.createDataFrame([(1, "a", {"A": 1}), (1, "b", {"A": 2}), (1, "c", {"B": 1})], "key long, value string, clock map<string,int>")
    assert pairs(causal_register_merge(states).select("value")) == {("b",), ("c",)}
    ops = spark.createDataFrame([(1, 1, None, "a", False), (1, 2, 1, "c", False), (1, 3, 1, "b", False), (1, 4, 3, "x", True)], "key long, id long, after long, value string, deleted boolean")
    assert sequence_merge(ops).first()["items"] == ["a", "b", "c"]
