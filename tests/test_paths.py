"""Unbounded paths end where nothing new is found, however long they are."""

import pytest

from lattica.catalog import Graph
from lattica.errors import IterationLimit
from lattica.session import Session

LONG = 104


@pytest.fixture(scope="module")
def chain(spark):
    g = Graph(spark)
    g.add_nodes("N", spark.range(LONG).selectExpr("id AS _vid", "id AS k"))
    g.add_edges("E", spark.range(LONG - 1).selectExpr("id AS _eid", "id AS _src", "id + 1 AS _dst"), "N", "N")
    return Session(g)


def test_reach_along_a_chain(chain):
    assert chain.query("MATCH (a:N {k: 0})-[:E*]->(b:N) RETURN DISTINCT b.k AS k").count() == LONG - 1


def test_a_limit_is_an_error(spark, chain):
    limited = Session(chain.graph)
    limited.settings.max_hops = 5
    with pytest.raises(IterationLimit):
        limited.query("MATCH (a:N {k: 0})-[:E*]->(b:N) RETURN DISTINCT b.k AS k").count()


@pytest.fixture(scope="module")
def ring(spark):
    g = Graph(spark)
    g.add_nodes("N", spark.range(4).selectExpr("id AS _vid", "id AS k"))
    g.add_edges("E", spark.range(3).selectExpr("id AS _eid", "id AS _src", "(id + 1) % 3 AS _dst"), "N", "N")
    return Session(g)


def test_starts_on_a_cycle_are_ends(ring):
    rows = lambda q: sorted(tuple(r) for r in ring.query(q).collect())
    assert rows("MATCH (a:N)-[:E*]->(b:N) RETURN DISTINCT a.k AS a, b.k AS b") == [(a, b) for a in range(3) for b in range(3)]
    assert rows("MATCH (a:N)-[:E*1..2]->(b:N) RETURN DISTINCT a.k AS a, b.k AS b") == [(a, b) for a in range(3) for b in range(3) if a != b]
    assert rows("MATCH (a:N)-[:E*0..]->(b:N) RETURN DISTINCT a.k AS a, b.k AS b") == [(a, b) for a in range(3) for b in range(3)] + [(3, 3)]
    assert rows("MATCH (a:N {k: 0}), (b:N) WHERE a <> b MATCH p = shortestPath((a)-[:E*]->(b)) RETURN b.k AS b, length(p) AS n") == [(1, 1), (2, 2)]
    assert rows("MATCH (a:N {k: 0})-[r:E*]->(b:N) RETURN b.k AS b, size(r) AS n") == [(0, 3), (1, 1), (2, 2)]
