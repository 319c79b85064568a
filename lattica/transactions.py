"""Transactions: a snapshot to read, private tables to write, and a check when they are committed.

Tables are immutable, so a snapshot is a copy of the catalog. The first of two transactions that write one table wins; the
other gets a :class:`Conflict`. Under ``serializable`` a table that was only read counts as well. The unit of conflict is a label's or
edge type's table, coarser than a row, so a conflict may be reported for writes that don't meet, and none is missed.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .catalog import Graph
from .errors import LatticaError


class Conflict(LatticaError):
    """Another transaction committed a table that this one wrote, or read, first."""


@dataclass
class Recording(Graph):
    """A graph that notes which tables are read."""

    reads: set = field(default_factory=set)

    def resolve_label(self, label: str) -> DataFrame | None:
        self.reads.add(("label", label))
        return super().resolve_label(label)

    def scan_nodes(self, groups: list[list[str]]) -> DataFrame:
        self.reads |= {("label", x) for x in (groups[0] if groups else self.nodes)}
        return super().scan_nodes(groups)

    def edge_tables(self, types: list[str]):
        self.reads |= {("type", x) for x in (types or self.edges)}
        return super().edge_tables(types)


_lock = threading.Lock()


class Transaction:
    """Use as a context: it commits at the end, or rolls back where an error leaves the block."""

    def __init__(self, session, serializable: bool = True):
        self.session, self.serializable, self.locked, self.open = session, serializable, set(), True
        self.nodes, self.edges = session.graph.nodes.copy(), session.graph.edges.copy()
        g = session.graph.copy()
        self.work = session.fork()
        self.work.graph = Recording(**{n: getattr(g, n) for n in Graph.__dataclass_fields__})
        self.reads = self.work.graph.reads

    def query(self, text: str, **params) -> DataFrame:
        return self.work.query(text, **params)

    def for_update(self, *names: str) -> None:
        """Labels and edge types that must not change until the commit, though they are only read."""
        self.locked |= {("label", n) for n in names} | {("type", n) for n in names}

    def rollback(self) -> None:
        self.open = False

    def commit(self) -> None:
        if not self.open:
            raise LatticaError("the transaction has ended")
        self.open = False
        now, mine = self.session.graph, self.work.graph
        with _lock:
            written = {("label", n) for n in {*mine.nodes, *self.nodes} if mine.nodes.get(n) is not self.nodes.get(n)}
            written |= {("type", n) for n in {*mine.edges, *self.edges} if mine.edges.get(n) is not self.edges.get(n)}
            if not written:
                return
            checked = written | self.locked | (self.reads if self.serializable else set())
            for kind, name in sorted(checked):
                ours, theirs = (self.nodes, now.nodes) if kind == "label" else (self.edges, now.edges)
                if ours.get(name) is not theirs.get(name):
                    raise Conflict(f"{kind} {name} was committed by another transaction")
            out, before = now.copy(), (dict(now.nodes), dict(now.edges))
            for kind, name in written:
                target, source = (out.nodes, mine.nodes) if kind == "label" else (out.edges, mine.edges)
                if name in source:
                    target[name] = source[name]
                else:
                    target.pop(name, None)
            self.session.commit(out, before)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.rollback()
        elif self.open:
            self.commit()


def retry(session, work: Callable[[Transaction], object], attempts: int = 3, serializable: bool = True):
    """Run ``work`` in a transaction, again where it meets a conflict, at most ``attempts`` times."""
    for attempt in range(1, attempts + 1):
        try:
            with Transaction(session, serializable) as tx:
                return work(tx)
        except Conflict:
            if attempt == attempts:
                raise
    return None
