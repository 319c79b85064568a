"""Forks, transactions, watchers, trigger modes, window and collation plugins."""

import pytest
from pyspark.sql import functions as F

from lattica.catalog import Graph
from lattica.operators.forks import invert
from lattica.session import Session
from lattica.streaming.changes import Trigger
from lattica.transactions import Conflict, Transaction, retry


@pytest.fixture
def people(spark):
    g = Graph(spark)
    g.add_nodes("Person", spark.createDataFrame([(1, "Ann", 30), (2, "bob", None), (3, "Cid", 41)], "_vid long, name string, age int"))
    g.add_nodes("City", spark.createDataFrame([(10, "Ulm")], "_vid long, name string"))
    g.add_edges("KNOWS", spark.createDataFrame([(1, 1, 2)], "_eid long, _src long, _dst long"), "Person", "Person")
    return Session(g)


def names(s):
    return sorted(r.n for r in s.query("MATCH (p:Person) RETURN p.name AS n").collect())


def test_diff_and_its_inverse(people):
    fork = people.fork()
    fork.query("CREATE (:Person {name: 'Dee', age: 9})")
    fork.query("MATCH (p:Person {name: 'Cid'}) DETACH DELETE p")
    fork.query("MATCH (p:Person {name: 'Ann'}) SET p.age = 31")
    found = people.diff(fork)
    key = lambda df: sorted((r.entity, r.label, r.change, r.before or "", r.after or "") for r in df.collect())
    vertices = [r for r in key(found) if r[0] == "vertex"]
    assert [(r[1], r[2]) for r in vertices] == [("Person", "added"), ("Person", "changed"), ("Person", "deleted")]
    assert '"age":31' in vertices[1][4] and '"age":30' in vertices[1][3]
    assert [r[2] for r in key(found) if r[0] == "edge"] == ["changed"]  # its source is another content now
    assert key(invert(found)) == key(fork.diff(people))
    assert people.diff(people.fork()).count() == 0


def test_promotion_skips_what_is_there_and_edges_without_an_end(people):
    fork = people.fork()
    fork.query("CREATE (:Person {name: 'Dee', age: 9})-[:KNOWS]->(:Person {name: 'Eve', age: 8})")
    fork.query("MATCH (a:Person {name: 'Dee'}), (b:Person {name: 'Ann'}) CREATE (a)-[:KNOWS]->(b)")
    report = people.promote(fork, [{"label": "Person", "where": "n.name <> 'Eve'"}, {"edge_type": "KNOWS"}])
    assert (report.vertices_inserted, report.vertices_skipped_uid_conflict) == (1, 3)
    assert (report.edges_inserted, report.edges_skipped_duplicate, report.edges_skipped_no_endpoint) == (1, 1, 1)
    assert names(people) == ["Ann", "Cid", "Dee", "bob"]
    pairs = people.query("MATCH (a:Person)-[:KNOWS]->(b:Person) RETURN a.name AS a, b.name AS b").collect()
    assert sorted(map(tuple, pairs)) == [("Ann", "bob"), ("Dee", "Ann")]
    again = people.promote(fork, [{"label": "Person", "where": "n.name <> 'Eve'"}, {"edge_type": "KNOWS"}])
    assert again.vertices_inserted == again.edges_inserted == 0


def test_first_committer_wins(people):
    a, b = people.transaction(), people.transaction()
    a.query("CREATE (:Person {name: 'Dee'})")
    b.query("CREATE (:Person {name: 'Eve'})")
    assert names(people) == ["Ann", "Cid", "bob"]
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert names(people) == ["Ann", "Cid", "Dee", "bob"]


def test_reads_count_where_it_is_serializable(people):
    for serializable in (True, False):
        a, b = people.transaction(serializable), people.transaction()
        assert a.query("MATCH (p:Person) RETURN count(*) AS n").first().n > 0
        a.query("CREATE (:City {name: 'Bonn'})")
        b.query("MATCH (p:Person {name: 'Ann'}) SET p.age = 5")
        b.commit()
        if serializable:
            with pytest.raises(Conflict):
                a.commit()
        else:
            a.commit()
    held, other = people.transaction(False), people.transaction()
    held.for_update("Person")
    held.query("CREATE (:City {name: 'Kiel'})")
    other.query("CREATE (:Person {name: 'Fay'})")
    other.commit()
    with pytest.raises(Conflict):
        held.commit()


def test_rollback_and_retry(people):
    with pytest.raises(ZeroDivisionError), Transaction(people) as tx:
        tx.query("CREATE (:Person {name: 'Dee'})")
        raise ZeroDivisionError
    assert "Dee" not in names(people)
    tries = []

    def work(tx):
        tries.append(1)
        tx.query("CREATE (:Person {name: 'Gus'})")
        if len(tries) == 1:  # somebody else is faster
            people.query("CREATE (:Person {name: 'Hal'})")

    retry(people, work)
    assert len(tries) == 2 and {"Gus", "Hal"} <= set(names(people))


def test_watchers_and_trigger_modes(people):
    seen, fired = [], []
    stop = people.watch(seen.append, labels={"City"})
    people.watch(lambda event: 1 / 0)
    for mode in ("sync", "async", "eventual"):
        people.triggers.append(Trigger(mode, lambda events, mode=mode: fired.append((mode, events.count())), labels={"City"}, mode=mode))
    people.query("CREATE (:City {name: 'Bonn'})")
    assert [sorted(e.labels) for e in seen] == [["City"]] and any("watcher failed" in w for w in people.warnings)
    assert ("eventual", 1) not in fired and ("sync", 1) in fired
    people.drain()
    assert sorted(fired) == [("async", 1), ("eventual", 1), ("sync", 1)]
    stop()
    people.triggers.clear()
    people.query("CREATE (:City {name: 'Kiel'})")
    assert len(seen) == 1


def test_window_plugin(people):
    people.register_window("share", lambda columns, ordered, whole: columns[0] / F.sum(columns[0]).over(whole))
    found = people.query("UNWIND [1, 1, 2] AS x RETURN x, share(x) OVER (ORDER BY x) AS s").collect()
    assert sorted(map(tuple, found)) == [(1, 0.25), (1, 0.25), (2, 0.5)]


def test_collations(people):
    people.register_collation("german", "de_CI")
    order = people.query("MATCH (p:Person) RETURN p.name AS n ORDER BY collate(p.name, 'nocase')").collect()
    assert [r.n for r in order] == ["Ann", "bob", "Cid"]
    assert people.query("MATCH (p:Person) WHERE collate(p.name, 'unicode_ci') = 'BOB' RETURN p.name AS n").count() == 1
    assert people.query("MATCH (p:Person) WHERE collate(p.name, 'german') = 'ANN' RETURN p.name AS n").count() == 1
