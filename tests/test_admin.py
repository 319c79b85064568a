"""Statements and procedures that change the session."""

import time
from datetime import UTC, datetime

import pytest

from lattica.catalog import Graph
from lattica.errors import CompileError, ConstraintError
from lattica.session import Session


@pytest.fixture
def s(spark):
    g = Graph(spark)
    g.add_nodes("P", spark.createDataFrame([(1, "Ann", 30), (2, "Bob", 20)], "_vid long, name string, age int"))
    g.add_edges("K", spark.createDataFrame([(1, 1, 2, 5.0)], "_eid long, _src long, _dst long, w double"), "P", "P")
    return Session(g)


def rows(s, text, **params):
    return [tuple(r) for r in s.query(text, **params).collect()]


def test_schema_procedures(s):
    rows(s, "CALL uni.schema.createLabel('U', {properties: {org: {type: 'STRING'}, n: {type: 'INT', nullable: false}}, constraints: [{type: 'UNIQUE', properties: ['org']}]})")
    rows(s, "CREATE (:U {org: 'a', n: 1})")
    with pytest.raises(ConstraintError):
        rows(s, "CREATE (:U {org: 'a', n: 2})")
    rows(s, "CALL uni.schema.createEdgeType('R', ['U'], ['P'], {properties: {w: {type: 'FLOAT'}}})")
    rows(s, "CALL uni.schema.createIndex('U', 'org', {type: 'inverted', name: 'i'})")
    assert rows(s, "CALL uni.schema.indexes() YIELD name, kind RETURN name, kind") == [("i", "inverted")]
    rows(s, "CALL uni.schema.dropIndex('i')")
    rows(s, "CALL uni.schema.dropLabel('U')")
    assert "U" not in s.graph.nodes and "R" in s.graph.edges
    with pytest.raises(CompileError):
        s.read_only("CALL uni.schema.dropLabel('P')")


def test_ddl_forms(s):
    for text in (
        "CREATE LABEL IF NOT EXISTS E (email STRING UNIQUE, n INT NOT NULL)",
        "DROP LABEL IF EXISTS Nothing",
        "DROP LABEL Nothing IF EXISTS",
        "CREATE VECTOR INDEX v FOR (p:P) ON (p.emb) OPTIONS { metric: 'cosine' }",
        "CREATE FULLTEXT INDEX f FOR (p:P) ON EACH [p.name]",
        "CREATE JSON FULLTEXT INDEX j FOR (p:P) ON meta",
        "DROP INDEX v",
        "CREATE CONSTRAINT has_w ON ()-[k:K]->() ASSERT EXISTS(k.w)",
        "CREATE CONSTRAINT adult ON (p:P) ASSERT p.age >= 18",
        "SHOW DATABASE",
        "SHOW CONFIG",
        "SHOW STATISTICS",
        "SHOW EDGE TYPES",
        "SHOW SNAPSHOTS",
    ):
        s.query(text).collect()
    assert rows(s, "SHOW STATISTICS") == [("label", "E", 0), ("label", "P", 2), ("edge type", "K", 1)]
    with pytest.raises(ConstraintError):
        rows(s, "CREATE (:P {name: 'Kid', age: 3})")
    rows(s, "CREATE (:E {email: 'x', n: 1})")
    with pytest.raises(ConstraintError):
        rows(s, "CREATE (:E {email: 'x', n: 2})")


def test_snapshots_and_time_travel(s):
    before = datetime.now(UTC).isoformat()
    time.sleep(0.01)
    assert rows(s, "CALL uni.admin.snapshot.create('v1') YIELD snapshot_id") == [("v1",)]
    now = datetime.now(UTC).isoformat()
    rows(s, "MATCH (p:P {name: 'Bob'}) DETACH DELETE p")
    assert rows(s, "MATCH (p:P) RETURN count(*) AS n") == [(1,)]
    assert rows(s, "MATCH (p:P) VERSION AS OF 'v1' WHERE p.age < 25 RETURN p.name AS n") == [("Bob",)]
    assert rows(s, f"MATCH (p:P) TIMESTAMP AS OF '{now}' RETURN count(*) AS n") == [(2,)]
    with pytest.raises(CompileError):
        rows(s, f"MATCH (p:P) TIMESTAMP AS OF '{before}' RETURN count(*) AS n")
    rows(s, "CALL uni.admin.snapshot.restore('v1') YIELD status")
    assert rows(s, "MATCH (p:P) RETURN count(*) AS n") == [(2,)]
    assert [r[0] for r in rows(s, "CALL uni.admin.snapshot.list() YIELD snapshot_id")] == ["v1"]


def test_declarations(s):
    rows(s, "CALL uni.plugin.declareFunction('my.full', '$first + \" \" + $last', 'string', '[\"first\",\"last\"]')")
    assert rows(s, "RETURN my.full('Ada', 'L') AS n") == [("Ada L",)]
    rows(s, "CALL uni.plugin.declareAggregate('my.squares', '0', '$state + ($x * $x)', '$state', 'int', '[\"x\"]')")
    assert rows(s, "UNWIND [1, 2, 3] AS v RETURN my.squares(v) AS n") == [(14,)]
    rows(s, "CALL uni.plugin.declareProcedure('my.older', 'MATCH (p:P) WHERE p.age > $a RETURN p.name AS name', 'READ', '[\"name\"]', '[\"a\"]')")
    assert rows(s, "CALL my.older(25) YIELD name RETURN name") == [("Ann",)]
    with pytest.raises(CompileError):
        rows(s, "CALL uni.plugin.declareProcedure('my.bad', 'CREATE (:M)', 'READ', '[]', '[]')")
    rows(s, "CALL uni.plugin.declareTrigger('my.mark', 'CREATE ON :P', 'CREATE (:Seen {v: $vid})')")
    rows(s, "CREATE (:P {name: 'Cid', age: 1})")
    assert rows(s, "MATCH (m:Seen) RETURN count(*) AS n") == [(1,)]
    assert [r[:2] for r in rows(s, "CALL uni.plugin.listDeclared() YIELD qname, kind RETURN qname, kind")] == [("my.full", "function"), ("my.mark", "trigger"), ("my.older", "procedure"), ("my.squares", "aggregate")]
    assert rows(s, "CALL uni.plugin.dropDeclared('my.mark')") == [(True,)]
    rows(s, "CREATE (:P {name: 'Dee', age: 1})")
    assert rows(s, "MATCH (m:Seen) RETURN count(*) AS n") == [(1,)]


def test_jobs(s):
    rows(s, "CALL uni.periodic.schedule('uni.system.statistics_refresh', 'periodic', '60')")
    rows(s, "CALL uni.plugin.runJob('uni.system.statistics_refresh')")
    assert rows(s, "CALL uni.periodic.list()") == [("uni.system.statistics_refresh", "succeeded", 0)]
    assert rows(s, "CALL uni.periodic.cancel('uni.system.statistics_refresh')") == [(True,)]
    rows(s, "CALL uni.periodic.submit('CREATE (:T {v: 1})')")
    assert rows(s, "CALL uni.periodic.iterate('UNWIND range(1, 5) AS x RETURN x', 'CREATE (:T {v: x})', '{\"batchSize\": 2}')") == [(3, 5)]
    assert rows(s, "MATCH (t:T) RETURN count(*) AS n") == [(6,)]
    with pytest.raises(CompileError):
        rows(s, "CALL uni.periodic.schedule('x', 'cron', 'nonsense')")
    assert rows(s, "CALL uni.system.echo('hi') YIELD message RETURN message") == [("hi",)]
