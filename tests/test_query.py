"""Semantics that Spark alone doesn't give: nulls, NaN, trails, optional patterns, writes."""

import math

import pytest

from lattica.catalog import Graph
from lattica.cypher.compiler import property_needs
from lattica.cypher.parser import parse
from lattica.errors import CompileError, ConstraintError, MissingParameter
from lattica.operators import paths
from lattica.session import Session
from lattica.storage import keep


@pytest.fixture
def people(spark):
    g = Graph(spark)
    g.add_nodes("Person", spark.createDataFrame([(1, "Ann", 30, 1.5), (2, "Bob", None, float("nan")), (3, "Cid", 30, None), (4, "Dee", 41, -0.0), (5, "Eve", 20, 2.0)], "_vid long, name string, age int, score double"))
    g.add_nodes("City", spark.createDataFrame([(10, "Ulm")], "_vid long, name string"))
    g.add_edges("KNOWS", spark.createDataFrame([(1, 1, 2, 5), (2, 2, 3, 7), (3, 3, 1, 1), (4, 1, 2, 9), (5, 4, 4, 2)], "_eid long, _src long, _dst long, w int"), "Person", "Person")
    g.add_edges("LIVES", spark.createDataFrame([(20, 1, 10)], "_eid long, _src long, _dst long"), "Person", "City")
    return Session(g)


def rows(s, text, **params):
    return [tuple(r) for r in s.query(text, **params).collect()]


def one(s, text, **params):
    return rows(s, text, **params)[0]


def test_three_valued_logic(people):
    assert one(people, "RETURN null = 1 AS a, null IN [] AS b, 1 IN [2, null] AS c, 1 IN [1, null] AS d, [1, null] = [1, 2] AS e, null OR true AS f, null AND false AS g, null XOR true AS h") == (None, False, None, True, None, True, False, None)


def test_nan_and_mixed_types(people):
    assert rows(people, "MATCH (p:Person {name: 'Bob'}) RETURN p.score = p.score AS e, p.score < 1 AS l, p.score <> 1 AS n") == [(False, False, True)]
    assert one(people, "RETURN 1 = 'a' AS a, 1 < 'a' AS b, 5 STARTS WITH 'a' AS c, 'a' + 1.0 AS d, 7 / 2 AS e, 7 / 2.0 AS f, 2 ^ 2 AS g, 1.0 / 0 AS h") == (False, None, None, "a1.0", 3, 3.5, 4.0, math.inf)


def test_order_has_null_last(people):
    assert [r[0] for r in rows(people, "MATCH (p:Person) RETURN p.age AS a ORDER BY a")] == [20, 30, 30, 41, None]
    assert rows(people, "MATCH (p:Person) RETURN p.age AS a ORDER BY a DESC")[0] == (None,)


def test_lists(people):
    assert one(people, "WITH [1, 2, 3, 4] AS l RETURN l[0] AS a, l[-1] AS b, l[9] AS c, l[1..-1] AS d, l[..2] AS e, size(l + 5) AS f, head([]) AS g, range(3, 1) AS h, range(3, 1, -1) AS i, reduce(x = '', i IN l | x + i) AS j") == (1, 4, None, [2, 3], [1, 2], 5, None, [], [3, 2, 1], "1234")
    assert one(people, "RETURN all(x IN [] WHERE x > 0) AS a, any(x IN [] WHERE x > 0) AS b, single(x IN [1, null] WHERE x > 0) AS c, none(x IN [null] WHERE x > 0) AS d") == (True, False, None, None)


def test_regex_matches_whole(people):
    assert one(people, "RETURN 'xabcx' =~ 'abc' AS a, 'abc' =~ 'a(?=b).*' AS b, substring('hello', 1, 3) AS c, split('a.b.c', '.') AS d") == (False, True, "ell", ["a", "b", "c"])


def test_aggregates(people):
    assert one(people, "MATCH (p:Person) RETURN count(*) AS n, count(p.age) AS k, count(DISTINCT p.age) AS d, sum(p.age) AS s, collect(DISTINCT p.age) AS c, percentileDisc(p.age, 0.5) AS m")[:4] == (5, 4, 3, 121)
    assert one(people, "MATCH (p:Person) WHERE p.age > 99 RETURN sum(p.age) AS s, avg(p.age) AS a, max(p.age) AS m, collect(p.age) AS c") == (0, None, None, [])
    assert one(people, "UNWIND [1, 2, 3, 4] AS x RETURN percentileDisc(x, 0.5) AS d, percentileCont(x, 0.5) AS c, sum(x) + count(*) AS t") == (3, 2.5, 14)
    assert one(people, "UNWIND [9223372036854775807, 1] AS x RETURN sum(x) > 0 AS s") in [(True,), (None,)]


def test_group_keys_of_entities(people):
    assert rows(people, "MATCH (p:Person)-[r:KNOWS]->(q) WITH p, count(r) AS n, max(r.w) AS w RETURN p.name AS a, n, w ORDER BY a") == [("Ann", 2, 9), ("Bob", 1, 7), ("Cid", 1, 1), ("Dee", 1, 2)]


def test_trails_and_loops(people):
    # parallel edges are different, an edge isn't used twice
    assert one(people, "MATCH (a:Person {name: 'Ann'})-[:KNOWS*]->(b) RETURN count(*) AS n, count(DISTINCT b) AS d") == (8, 3)
    assert one(people, "MATCH (a:Person {name: 'Dee'})-[:KNOWS]-(b) RETURN count(*) AS n") == (1,)
    assert one(people, "MATCH (a:Person {name: 'Ann'})-[:KNOWS*0..1]->(b) RETURN count(*) AS n") == (3,)
    assert rows(people, "MATCH (a:Person {name: 'Ann'})-[:KNOWS*3..2]->(b) RETURN b.name AS b") == []
    assert rows(people, "MATCH (a:Person)-[:KNOWS*]->(b) RETURN DISTINCT a.name AS a, b.name AS b ORDER BY a, b")[:3] == [("Ann", "Ann"), ("Ann", "Bob"), ("Ann", "Cid")]


def test_variable_length_lists(people):
    assert rows(people, "MATCH p = (a:Person {name: 'Ann'})-[r:KNOWS*2]->(b) RETURN length(p) AS l, [x IN r | x._eid] AS e, [n IN nodes(p) | n._vid] AS v ORDER BY e") == [(2, [1, 2], [1, 2, 3]), (2, [4, 2], [1, 2, 3])]


def test_shortest(people):
    assert rows(people, "MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Cid'}) MATCH p = shortestPath((a)-[:KNOWS*]->(b)) RETURN length(p) AS l, [r IN relationships(p) | r._eid] AS e") == [(2, [1, 2])]
    assert one(people, "MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Cid'}) MATCH p = allShortestPaths((a)-[:KNOWS*]->(b)) RETURN count(p) AS n") == (2,)


def test_shortest_counted_without_their_contents(spark, monkeypatch):
    g = Graph(spark)
    g.add_nodes("N", spark.range(20).selectExpr("id AS _vid", "id AS k"))
    steps = [(a, b) for a in range(15) for b in range(15) if b // 3 == a // 3 + 1] + [(0, 3), (0, 0), (4, 1)]  # layers of three, a parallel edge, a loop, a way back
    g.add_edges("E", spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(steps)], "_eid long, _src long, _dst long"), "N", "N")
    s = Session(g)
    ask = lambda how, more, back: rows(s, f"MATCH (a:N), (b:N) WHERE a.k IN [0, 4] AND b.k IN [0, 1, 9, 12, 18] MATCH p = {how}((a)-[:E*{more}]->(b)) RETURN a.k AS a, b.k AS b, {back} ORDER BY a, b")
    monkeypatch.setattr(paths, "REPEATED", 2)
    assert ask("allShortestPaths", "", "count(p) AS n, max(length(p)) AS l") == [(0, 1, 1, 2), (0, 9, 12, 3), (0, 12, 36, 4), (4, 1, 1, 1), (4, 9, 3, 2), (4, 12, 9, 3)]
    for how, more in (("shortestPath", "0.."), ("allShortestPaths", "0..3")):
        assert ask(how, more, "count(p) AS n, max(length(p)) AS l") == ask(how, more, "size(collect(relationships(p))) AS n, max(size(relationships(p))) AS l")
    kept = []
    monkeypatch.setattr(paths, "keep", lambda df, name="table": kept.append(df.columns) or keep(df, name))
    ask("allShortestPaths", "", "count(p) AS n")
    assert kept and not any({"_rels", "_nodes", "_rel"} & set(c) for c in kept)  # levels hold vertices, not paths


def test_shortest_in_an_expression_keeps_its_contents(people):
    assert one(people, "MATCH (a:Person {name: 'Ann'}), (b:Person {name: 'Cid'}) RETURN [n IN nodes(shortestPath((a)-[:KNOWS*]->(b))) | n._vid] AS v") == ([1, 2, 3],)


def test_a_path_that_is_a_key_keeps_its_contents():
    same = lambda text: {k[1] for k in property_needs(parse("MATCH p = allShortestPaths((a)-[:E*]->(b)) " + text)) if isinstance(k, tuple)}
    assert same("RETURN count(DISTINCT p) AS n") == {"p"} and same("WITH p, count(*) AS k RETURN k") == {"p"} and same("WITH DISTINCT * RETURN count(p) AS n") == {"*"}
    assert same("RETURN count(p) AS n, max(length(p)) AS l") == set()


def test_optional_and_existence(people):
    assert rows(people, "MATCH (p:Person) OPTIONAL MATCH (p)-[:LIVES]->(c:City) RETURN p.name AS p, c.name AS c ORDER BY p")[:2] == [("Ann", "Ulm"), ("Bob", None)]
    assert rows(people, "MATCH (p:Person) WHERE NOT (p)-[:KNOWS]->() RETURN p.name AS p") == [("Eve",)]
    assert rows(people, "MATCH (p:Person) WHERE EXISTS { MATCH (p)-[k:KNOWS]->(q) WHERE k.w > p.age - 25 } RETURN p.name AS p ORDER BY p") == [("Ann",)]
    assert rows(people, "MATCH (p:Person) RETURN p.name AS p, COUNT { (p)-[:KNOWS]->() } AS n, [(p)-[k:KNOWS]->(q) WHERE k.w > 5 | q.name] AS l ORDER BY p")[:2] == [("Ann", 2, ["Bob"]), ("Bob", 1, ["Cid"])]
    assert one(people, "OPTIONAL MATCH (x:Person {name: 'nobody'}) RETURN x.name AS n, count(*) AS k") == (None, 1)


def test_plans(people):
    plan = people.query("EXPLAIN MATCH (p:Person) WHERE NOT (p)-[:KNOWS]->() RETURN p.name AS n ORDER BY n LIMIT 2").first()[0]
    assert "LeftAnti" in plan and "TakeOrderedAndProject" in plan and "PythonUDF" not in plan and "ArrowEval" not in plan
    plan = people.query("EXPLAIN MATCH ()-[r:KNOWS]->() RETURN count(*) AS n").first()[0]
    assert "Join" not in plan


def test_errors(people):
    with pytest.raises(MissingParameter, match="x, y"):
        people.query("RETURN $x + $y AS z")
    with pytest.raises(CompileError):
        people.query("MATCH (p:Person) RETURN q.name AS n")
    with pytest.raises(CompileError):
        people.query("RETURN abs('a') AS x")
    with pytest.raises(CompileError):
        people.query("RETURN 1 AS a UNION RETURN 2 AS b")


def test_writes(people):
    people.query("CREATE (a:Person {name: 'Fay', age: 7})-[:KNOWS {w: 1}]->(b:Person {name: 'Gus'})")
    assert rows(people, "MATCH (a)-[k:KNOWS {w: 1}]->(b:Person {name: 'Gus'}) RETURN a.name AS a, b.age AS g") == [("Fay", None)]
    people.query("UNWIND ['x', 'x', 'y'] AS n MERGE (:Tag {name: n})")
    assert rows(people, "MATCH (t:Tag) RETURN t.name AS n ORDER BY n") == [("x",), ("y",)]
    people.query("MATCH (p:Person) WHERE p.age < 25 SET p.age = p.age + 1, p.young = true")
    assert rows(people, "MATCH (p:Person) WHERE p.young RETURN p.name AS n, p.age AS a ORDER BY n") == [("Eve", 21), ("Fay", 8)]
    with pytest.raises(ConstraintError):
        people.query("MATCH (p:Person {name: 'Ann'}) DELETE p")
    people.query("MATCH (p:Person {name: 'Ann'}) DETACH DELETE p")
    assert one(people, "MATCH ()-[k:KNOWS]->() RETURN count(*) AS n") == (3,)


def test_constraints_and_ddl(people):
    people.query("CREATE CONSTRAINT pn ON (p:Person) ASSERT p.name IS UNIQUE")
    with pytest.raises(ConstraintError):
        people.query("CREATE (:Person {name: 'Bob'})")
    with pytest.raises(ConstraintError):
        people.query("CREATE CONSTRAINT pa ON (p:Person) ASSERT exists(p.age)")
    people.query("CREATE LABEL Dog (name STRING NOT NULL, size INT32)")
    assert one(people, "MATCH (d:Dog) RETURN count(*) AS n") == (0,)
    people.query("DROP LABEL Dog")
    people.query("CREATE INDEX ix FOR (p:Person) ON (p.name)")
    assert one(people, "CALL uni.schema.indexes() YIELD name, label RETURN name, label") == ("ix", "Person")


def test_snapshot_fork_trigger(people):
    people.snapshot("v1")
    branch = people.fork()
    branch.query("MATCH (p:Person {name: 'Bob'}) SET p.age = 99")
    assert one(people, "MATCH (p:Person {name: 'Bob'}) RETURN p.age AS a") == (None,)
    people.query("MATCH (c:City) DETACH DELETE c")
    assert one(people, "MATCH (c:City) RETURN count(*) AS n VERSION AS OF 'v1'") == (1,)
    from lattica.streaming.changes import Trigger

    people.triggers.append(Trigger("no", lambda events: False, "before_commit", labels={"Person"}))
    with pytest.raises(ConstraintError):
        people.query("CREATE (:Person {name: 'Zed'})")
    assert one(people, "MATCH (p:Person) RETURN count(*) AS n") == (5,)


def test_partition_identity(people):
    """Rows split by a predicate, its negation and its null part are all rows."""
    whole = rows(people, "MATCH (p:Person) RETURN p.name AS n ORDER BY n")
    parts = [rows(people, f"MATCH (p:Person) WHERE {c} RETURN p.name AS n") for c in ("p.age > 25", "NOT p.age > 25", "(p.age > 25) IS NULL")]
    assert sorted(sum(parts, [])) == whole and all(len(p) for p in parts)


def test_recursion_limit_and_types(people):
    people.settings.recursion_rounds = 3
    from lattica.errors import IterationLimit

    with pytest.raises(IterationLimit):
        people.query("WITH RECURSIVE r(n) AS (RETURN 1 AS n UNION MATCH (x:r) RETURN x.n + 1 AS n) MATCH (x:r) RETURN count(*) AS n")


def test_temporal(people):
    r = one(people, "RETURN toString(date('2024-01-31') + duration('P1M')) AS a, duration.between(date('2024-01-01'), date('2024-03-05')).days AS b, toString(duration('P1Y2M3DT4H5M6.5S')) AS c, date({year: 2024, month: 2, day: 29}).dayOfYear AS d, toString(duration('PT36H') * 2) AS e")
    assert r == ("2024-02-29", 4, "P1Y2M3DT4H5M6.5S", 60, "PT72H")
