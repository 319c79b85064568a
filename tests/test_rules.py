import itertools
import random

import pytest

from lattica.catalog import Graph
from lattica.errors import ClauseMismatch, CyclicNegation, RuleError, UndefinedRule
from lattica.session import Session


def session(spark, edges):
    g = Graph(spark)
    g.add_nodes("N", spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)], "_vid long, name string"))
    g.add_edges("E", spark.createDataFrame([(i + 1, a, b, float(w), float(p)) for i, (a, b, w, p) in enumerate(edges)], "_eid long, _src long, _dst long, w double, p double"), "N", "N")
    return Session(g)


EDGES = [(1, 2, 1, 0.7), (2, 3, 2, 0.5), (1, 3, 5, 0.3), (3, 4, 1, 0.9)]


def out(s, text):
    return sorted(tuple(r) for r in s.rules_program(text).rows().collect())


REACH = "CREATE RULE reach AS MATCH (a:N)-[:E]->(b:N) YIELD KEY a, KEY b\nCREATE RULE reach AS MATCH (a:N)-[:E]->(m:N) WHERE m IS reach TO b YIELD KEY a, KEY b\n"


def test_against_naive_closure(spark):
    rng = random.Random(3)
    edges = [(a, b, 1, 0.5) for a, b in itertools.product(range(1, 6), repeat=2) if rng.random() < 0.3]
    closure = {(a, b) for a, b, *_ in edges}
    while True:
        more = closure | {(a, d) for (a, b), (c, d) in itertools.product(closure, closure) if b == c}
        if more == closure:
            break
        closure = more
    assert out(session(spark, edges), REACH + "QUERY reach") == sorted(closure)


def test_folds(spark):
    s = session(spark, EDGES)
    assert out(s, "CREATE RULE t AS MATCH (a:N)-[e:E]->(b:N) FOLD t = SUM(e.w), n = COUNT(*) WHERE n >= 2 YIELD KEY a, t, n\nQUERY t RETURN a.name AS a, t, n") == [("n1", 6.0, 2)]
    p = out(s, "CREATE RULE r AS MATCH (a:N)-[e:E]->(b:N) FOLD q = MNOR(e.p) YIELD KEY b, q AS PROB\nQUERY r")
    assert [(b, round(q, 6)) for b, q in p] == [(2, 0.7), (3, 0.65), (4, 0.9)]


def test_recursive_fold_counts_every_derivation(spark):
    text = "CREATE RULE inner_ AS MATCH (p:N)-[:E]->(c:N) YIELD KEY p\nCREATE RULE b AS MATCH (p:N) WHERE p IS NOT inner_ YIELD KEY p, 0.5 AS v\nCREATE RULE b AS MATCH (p:N)-[:E]->(c:N) WHERE c IS b FOLD v = MPROD(v) YIELD KEY p, v\nQUERY b"
    assert out(session(spark, [(1, 2, 1, 1), (2, 3, 1, 1), (2, 4, 1, 1)]), text) == [(1, 0.25), (2, 0.25), (3, 0.5), (4, 0.5), (5, 0.5)]
    assert dict(out(session(spark, [(1, 3, 1, 1), (1, 3, 1, 1)]), text))[1] == 0.25


def test_best_by_and_negation(spark):
    s = session(spark, EDGES)
    text = "CREATE RULE d AS MATCH (a:N)-[e:E]->(b:N) ALONG x = prev.x + e.w BEST BY x ASC YIELD KEY a, KEY b, x\nCREATE RULE d AS MATCH (a:N)-[e:E]->(m:N) WHERE m IS d TO b ALONG x = prev.x + e.w BEST BY x ASC YIELD KEY a, KEY b, x\nQUERY d WHERE a.name = 'n1' RETURN b.name AS b, x"
    assert out(s, text) == [("n2", 1.0), ("n3", 3.0), ("n4", 4.0)]
    assert out(s, REACH + "CREATE RULE cut AS MATCH (a:N), (b:N) WHERE (a, b) IS NOT reach AND a <> b YIELD KEY a, KEY b\nQUERY cut WHERE a.name = 'n4' RETURN b.name AS b") == [("n1",), ("n2",), ("n3",), ("n5",)]


def test_commands(spark):
    s = session(spark, EDGES)
    r = s.rules_program(REACH + "ASSUME { MATCH (a:N {name: 'n2'})-[e:E]->() DELETE e } THEN { QUERY reach WHERE a.name = 'n2' RETURN count(*) AS n }\nQUERY reach WHERE a.name = 'n2' RETURN count(*) AS n\nABDUCE NOT reach WHERE a.name = 'n3'\nABDUCE reach WHERE a.name = 'n5'")
    assert r.results[0].rows().first()[0] == 0 and r.results[1].first()[0] == 2
    assert [x.eid for x in r.results[2].collect() if x.validated] == [4]
    added = [x for x in r.results[3].collect() if x.kind == "add_edge"]
    assert added and all(x.cost == 1.5 for x in added)


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("CREATE RULE a AS MATCH (x:N) WHERE x IS NOT b YIELD KEY x\nCREATE RULE b AS MATCH (x:N) WHERE x IS a YIELD KEY x", CyclicNegation),
        ("CREATE RULE a AS MATCH (x:N) WHERE x IS nothing YIELD KEY x", UndefinedRule),
        ("CREATE RULE a AS MATCH (x:N) YIELD KEY x\nCREATE RULE a AS MATCH (x:N) YIELD KEY x, 1 AS v", ClauseMismatch),
        ("CREATE RULE a AS MATCH (x:N) YIELD KEY x, 1 AS v\nCREATE RULE a AS MATCH (x:N)-[:E]->(y:N) WHERE y IS a FOLD v = SUM(v) YIELD KEY x, v", RuleError),
    ],
)
def test_compile_errors(spark, text, error):
    with pytest.raises(error):
        session(spark, EDGES).rules_program(text)


def test_models(spark):
    from lattica.rules.models import register_model

    s = session(spark, EDGES)
    register_model(s, "m", lambda batch: [min(1.0, r["f0"] / 10) for r in batch])
    r = s.rules_program("CREATE MODEL risk AS INPUT (e) FEATURES e.w OUTPUT PROB p USING xervo('m')\nCREATE RULE r AS MATCH (a:N)-[e:E]->(b:N) YIELD KEY a, KEY b, risk(e.w) AS PROB\nCALIBRATE risk ON MATCH (a:N)-[e:E]->(b:N) TARGET CASE WHEN e.w > 1 THEN 1 ELSE 0 END METHOD platt_scaling\nVALIDATE risk ON MATCH (a:N)-[e:E]->(b:N) TARGET CASE WHEN e.w > 1 THEN 1 ELSE 0 END METRICS brier_score, auc, ece")
    row = r.rows().first()
    assert row.auc == 1.0 and 0 <= row.brier_score < 0.5
