"""Sessions: run query texts over a graph."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from .catalog import Graph
from .cypher import ast as A
from .cypher.compiler import Context, Settings
from .cypher.parser import parse
from .cypher.plan import Planner
from .errors import CompileError


def spark_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the engine expects."""
    builder = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    return builder.getOrCreate()


@dataclass(frozen=True)
class CommitEvent:
    """A commit: its number, the labels and edge types whose tables it replaced, and when."""

    version: int
    labels: frozenset[str]
    edge_types: frozenset[str]
    time: float


class Session:
    """One graph, its registered functions, and the statements run on it."""

    def __init__(self, graph: Graph, settings: Settings | None = None):
        self.graph, self.settings = graph, settings or Settings()
        self.parsed: dict[str, object] = {}
        self.functions: dict = {}
        self.macros: dict = {}
        self.aggregates: dict = {}
        self.procedures: dict = {}
        self.hooks: list[Callable] = []
        self.triggers: list = []
        self.warnings: list[str] = []
        self.snapshots: dict[str, Graph] = {}
        self.snapshot_times: dict[str, float] = {}
        self.declarations: dict[str, str] = {}
        self.variables: dict = {}
        self.rules: dict = {}
        self.jobs: list = []
        self.windows: dict = {}
        self.collations: dict[str, str] = {}
        self.watchers: list = []
        self.version = 0

    def context(self, params: dict | None = None) -> Context:
        from .operators import admin  # noqa: F401 - registers its procedures
        from .operators.procedures import PROCEDURES

        known = {**{f"session.{k}": v for k, v in self.variables.items()}, **(params or {})}
        self.warnings = []
        ctx = Context(self.graph, known, self.functions, self.macros, self.aggregates, {**PROCEDURES, **self.procedures}, settings=self.settings, warnings=self.warnings)
        ctx.windows, ctx.collations = self.windows, self.collations
        ctx.session = self
        return ctx

    def parse(self, text: str):
        """Syntax tree of a text, remembered by the text."""
        if text not in self.parsed:
            self.parsed[text] = parse(text)
        return self.parsed[text]

    def query(self, text: str, **params) -> DataFrame:
        """The rows of a statement, as a lazy DataFrame where it only reads."""
        from .sources.commands import run_command, split_version

        text, version = split_version(text)
        tree = self.parse(text)
        for hook in self.hooks:
            hook("before", text, params)
        began = time.time()
        saved = self.graph
        if version is not None:
            kind, name = version
            self.graph = self.at_version(name) if kind == "version" or name in self.snapshots else self.at_time(name)
        try:
            if isinstance(tree, A.Command):
                return run_command(self, tree, params)
            writes = is_write(tree)
            before = (self.graph.nodes.copy(), self.graph.edges.copy()) if writes else None
            work = self.graph.copy() if writes else self.graph
            ctx = self.context(params)
            ctx.graph = work
            df = Planner(ctx).run(tree)
            if writes:
                self.commit(work, before)
            return df
        finally:
            if version is not None:
                self.graph = saved
            for hook in self.hooks:
                hook("after", text, {"seconds": time.time() - began})

    cypher = query

    def commit(self, work: Graph, before) -> None:
        """Triggers may veto; then the new tables replace the old at once."""
        from .streaming.changes import changes_between

        if self.triggers:
            events = changes_between(before, work)
            for trigger in self.triggers:
                trigger.fire(events, "before_commit", self)
        self.graph = work
        self.version += 1
        if self.triggers:
            for trigger in self.triggers:
                trigger.fire(events, "after_commit", self)
        self.notify(work, before)

    def watch(self, callback: Callable, labels: set[str] | None = None, edge_types: set[str] | None = None) -> Callable[[], None]:
        """Tell ``callback`` of commits (a :class:`CommitEvent`) that touch the labels or edge types; gives a function that ends it.

        It is told after the commit and as well as may be: its errors are warnings of the session and undo nothing.
        """
        entry = (callback, labels, edge_types)
        self.watchers.append(entry)
        return lambda: self.watchers.remove(entry) if entry in self.watchers else None

    def notify(self, work: Graph, before) -> None:
        labels = {n for n in {*before[0], *work.nodes} if before[0].get(n) is not work.nodes.get(n)}
        types = {n for n in {*before[1], *work.edges} if before[1].get(n) is not work.edges.get(n)}
        for callback, wanted_labels, wanted_types in list(self.watchers):
            everything = wanted_labels is None and wanted_types is None
            if everything or labels & (wanted_labels or set()) or types & (wanted_types or set()):
                try:
                    callback(CommitEvent(self.version, frozenset(labels), frozenset(types), time.time()))
                except Exception as error:  # noqa: BLE001 - a watcher must not undo a commit
                    self.warnings.append(f"a watcher failed: {error}")

    def drain(self) -> None:
        """Run what eventual triggers have waiting, and wait for asynchronous ones."""
        for trigger in self.triggers:
            trigger.drain()

    def read_only(self, text: str, **params) -> DataFrame:
        """A query that must not write."""
        self.check_read_only(text)
        return self.query(text, **params)

    def check_read_only(self, text: str) -> None:
        tree = self.parse(text)
        if is_write(tree) or isinstance(tree, A.Command) and tree.kind not in ("explain", "profile", "show") or calls_writer(tree):
            raise CompileError("the statement writes")

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """A statement parsed once, to be run with different parameters."""
        self.parse(text)
        return lambda **params: self.query(text, **params)

    def rules_program(self, text: str, **params):
        """Run a rule program; see :mod:`lattica.rules`."""
        from .rules.engine import run_program

        return run_program(self, text, params)

    def snapshot(self, name: str) -> None:
        self.snapshots[name], self.snapshot_times[name] = self.graph.copy(), time.time()

    def at_version(self, name: str) -> Graph:
        if name not in self.snapshots:
            raise CompileError(f"no snapshot {name}")
        return self.snapshots[name]

    def at_time(self, text: str) -> Graph:
        """The last snapshot taken at that time or before."""
        when = datetime.fromisoformat(text)
        moment = (when if when.tzinfo else when.replace(tzinfo=UTC)).timestamp()
        before = [n for n, t in self.snapshot_times.items() if t <= moment]
        if not before:
            raise CompileError(f"no snapshot at {text}")
        return self.snapshots[max(before, key=self.snapshot_times.__getitem__)]

    def fork(self) -> Session:
        """A branch: it shares tables until either side writes."""
        out = Session(self.graph.copy(), self.settings)
        out.functions, out.macros, out.aggregates, out.procedures = self.functions, self.macros, self.aggregates, self.procedures
        out.windows, out.collations = self.windows, self.collations
        return out

    def diff(self, other: Session) -> DataFrame:
        """What must happen to this session's graph to become the other's; see :mod:`lattica.operators.forks`."""
        from .operators.forks import diff

        return diff(self.graph, other.graph)

    def promote(self, fork: Session, patterns: list[dict]):
        """Copy a fork's vertices and edges that are new here; gives the report."""
        from .operators.forks import promote

        return promote(self, fork, patterns)

    def transaction(self, serializable: bool = True):
        """A transaction over this session's graph; see :mod:`lattica.transactions`."""
        from .transactions import Transaction

        return Transaction(self, serializable)

    # --- extensions ---------------------------------------------------------------------------------------------
    def register_function(self, name: str, builder: Callable) -> None:
        """A scalar function: ``builder(columns, types)`` gives a column (native expression or pandas UDF call)."""
        self.functions[name.lower()] = builder

    def register_udf(self, name: str, function: Callable, returns: str) -> None:
        """A Python function of scalars, run in Arrow batches."""
        udf = _vectorised(function, returns)
        self.functions[name.lower()] = lambda cols, types: udf(*cols)

    def register_aggregate(self, name: str, builder: Callable) -> None:
        """An aggregate: ``builder(columns)`` gives an aggregate column."""
        self.aggregates[name.lower()] = builder

    def register_window(self, name: str, builder: Callable) -> None:
        """A window function: ``builder(columns, ordered, whole)`` gives a column over the ordered or the whole partition."""
        self.windows[name.lower()] = builder

    def register_collation(self, name: str, collation: str) -> None:
        """A name for one of Spark's collations, for ``collate(text, name)``."""
        self.collations[name.lower()] = collation

    def register_procedure(self, name: str, function: Callable) -> None:
        """A table function: ``function(context, args)`` gives a DataFrame."""
        self.procedures[name.lower()] = function

    def declare_function(self, name: str, parameters: list[str], text: str) -> None:
        """A function defined by an expression; calls are replaced by it, so it stays native."""
        from .cypher.parser import Parser

        self.macros[name.lower()] = (parameters, Parser(text).expr())

    def declare_aggregate(self, name: str, init: str, update: str, finalize: str = "$acc") -> None:
        """An aggregate by expressions over $acc and $value, folded over the collected values."""
        from pyspark.sql import functions as F

        from .cypher.compiler import Expressions
        from .cypher.parser import Parser
        from .cypher.scope import State

        init_e, update_e, final_e = (Parser(t.replace("$acc", "acc").replace("$value", "value")).expr() for t in (init, update, finalize))

        def build(columns):
            ex = Expressions(self.context(), State(self.graph.spark.range(1), {}))
            start, t = ex.typed(init_e)
            import pyspark.sql.types as T

            return F.aggregate(F.collect_list(columns[0]), start.cast("double") if not isinstance(t, T.StringType) else start, lambda a, x: ex.child(acc=(a, T.DoubleType() if not isinstance(t, T.StringType) else t), value=(x, T.DoubleType() if not isinstance(t, T.StringType) else t)).column(update_e), lambda a: ex.child(acc=(a, T.DoubleType() if not isinstance(t, T.StringType) else t)).column(final_e))

        self.aggregates[name.lower()] = build

    def declared(self) -> list[str]:
        return sorted([*self.macros, *self.aggregates])

    def drop_declared(self, name: str) -> None:
        self.macros.pop(name.lower(), None)
        self.aggregates.pop(name.lower(), None)


def _vectorised(function: Callable, returns: str):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def over(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*row) for row in zip(*series, strict=True)])

    n = function.__code__.co_argcount
    names = [f"a{i}" for i in range(n)]
    source = f"def run({', '.join(f'{x}: pd.Series' for x in names)}) -> pd.Series:\n    return over({', '.join(names)})"
    space = {"pd": pd, "over": over}
    exec(source, space)  # noqa: S102 - fixed arity for the type hints that pandas_udf reads
    return pandas_udf(space["run"], returns)


WRITES = (A.Create, A.Merge, A.SetItems, A.Remove, A.Delete, A.Foreach)


#: Procedures that change the session; a read-only statement must not call them.
WRITERS = re.compile(r"uni\.(admin\.(snapshot\.(create|restore|delete)|compact$|verifyEdgeEndpoints)|schema\.(create|drop)|plugin\.(declare|dropDeclared|runJob)|periodic\.(?!list)|system\.ttl_sweep|graph\.(project|drop))", re.IGNORECASE)


def calls_writer(tree) -> bool:
    if isinstance(tree, A.Union):
        return any(map(calls_writer, tree.parts))
    return isinstance(tree, A.Query) and any(isinstance(c, A.Call) and bool(WRITERS.match(c.name)) or isinstance(c, A.SubCall) and calls_writer(c.query) for c in tree.clauses)


def is_write(tree) -> bool:
    if isinstance(tree, A.Union):
        return any(map(is_write, tree.parts))
    if isinstance(tree, A.Recursive):
        return False
    return isinstance(tree, A.Query) and any(isinstance(c, WRITES) or isinstance(c, A.SubCall) and is_write(c.query) for c in tree.clauses)
