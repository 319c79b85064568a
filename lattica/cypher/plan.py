"""Clauses to DataFrames: pattern expansion, projections, subqueries, recursion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import DST, EID, LABELS, SRC, TYPE, VID
from ..errors import CompileError, IterationLimit, MissingParameter
from ..functions import values
from ..storage import keep
from . import ast as A
from .compiler import Context, Expressions, conjuncts, has_aggregate, literal, names_in, parameters_of, property_needs
from .scope import Entry, State, fresh

INSENSITIVE = {"exists"}


class Planner:
    """Compiles one statement."""

    def __init__(self, ctx: Context):
        self.ctx = ctx
        self.carry: list[str] = []  # key columns of an outer query that every row keeps

    # --- statements ---------------------------------------------------------------------------------------------
    def run(self, tree) -> DataFrame:
        missing = sorted(p for p in parameters_of(tree) if p not in self.ctx.params)
        if missing:
            raise MissingParameter(", ".join(missing))
        return self.table(tree, State(None, {}))

    def table(self, tree, start: State) -> DataFrame:
        """The final rows of a query, with the carried columns first."""
        if isinstance(tree, A.Union):
            frames = [self.table(p, start) for p in tree.parts]
            names = frames[0].columns
            if any(sorted(f.columns) != sorted(names) for f in frames):
                raise CompileError("parts of a UNION need the same columns")
            out = reduce(lambda a, b: a.unionByName(b), frames)
            return out if tree.all else out.distinct()
        if isinstance(tree, A.Recursive):
            return self._recursive(tree, start)
        state, final = self.clauses(tree, start)
        if not final and len(tree.clauses) == 1 and isinstance(tree.clauses[0], A.Call):
            return self.output(state)  # a CALL alone returns what it yields
        if not final:
            return state.df.select(*self.carry) if state.df is not None else self.unit()
        return self.output(state)

    def output(self, state: State) -> DataFrame:
        ex = Expressions(self.ctx, state)
        return state.df.select(*[F.col(c) for c in self.carry], *[ex.column(("var", n)).alias(n) for n in state.scope])

    def unit(self) -> DataFrame:
        return self.ctx.spark.range(1).select(F.lit(True).alias("_unit"))

    def clauses(self, tree: A.Query, state: State) -> tuple[State, bool]:
        saved, self.ctx.needs = self.ctx.needs, _merged(self.ctx.needs, property_needs(tree))
        final = False
        for i, clause in enumerate(tree.clauses):
            following = tree.clauses[i + 1] if i + 1 < len(tree.clauses) else None
            state = self.clause(clause, state, _multiplicity_free(following, self.ctx))
            final = isinstance(clause, A.Projection) and clause.final or final
        self.ctx.needs = saved
        return state, final

    def clause(self, clause, state: State, insensitive: bool = False) -> State:
        if isinstance(clause, A.Match):
            return self.optional(clause, state) if clause.optional else self.match(clause, state, insensitive)
        if isinstance(clause, A.Unwind):
            return self.unwind(clause, state)
        if isinstance(clause, A.Projection):
            return self.project(clause, state)
        if isinstance(clause, A.Call):
            return self.call(clause, state)
        if isinstance(clause, A.SubCall):
            return self.subcall(clause, state)
        from ..operators.writes import apply_write

        return apply_write(self, clause, state)

    def expressions(self, state: State) -> Expressions:
        return Expressions(self.ctx, state if state.df is not None else State(self.unit(), state.scope))

    # --- filters and subqueries ---------------------------------------------------------------------------------
    def filter(self, state: State, where) -> State:
        for e in conjuncts(where):
            negated = e[0] == "not" and e[1][0] == "subquery" and e[1][1] == "exists"
            sub = e[1] if negated else e
            if sub[0] == "subquery" and sub[1] == "exists":
                state = self.semi(state, sub[2], negated)
                continue
            e, state = self.lift(e, state)
            if e[0] == "fn" and e[1] in self.ctx.procedures:
                raise CompileError(f"{e[1]} isn't a predicate")
            state = State(state.df.where(self.expressions(state).boolean(e)), state.scope)
        return state

    def correlated(self, tree, state: State) -> list[str]:
        return sorted(n for n in names_in(tree) if n in state.scope)

    def pattern_only(self, tree) -> A.Match | None:
        """The match of a subquery that is one pattern with predicates, without a projection of its own."""
        if isinstance(tree, A.Query) and isinstance(tree.clauses[0], A.Match) and not tree.clauses[0].optional:
            rest = tree.clauses[1:]
            if not rest or len(rest) == 1 and isinstance(rest[0], A.Projection) and rest[0].final and not rest[0].distinct and rest[0].limit is None and rest[0].skip is None and not any(has_aggregate(e, self.ctx) for e, _ in rest[0].items):
                return tree.clauses[0]
        return None

    def free(self, match: A.Match, state: State) -> tuple[Planner, State, list[str]] | None:
        """The pattern compiled over its own scans, if it meets the outer rows at nodes and relationships only."""
        outer = self.correlated(match, state)
        in_pattern = names_in(match.patterns)
        if not outer or any(state.scope[n].kind not in ("node",) or n not in in_pattern for n in outer) or any(isinstance(p.var, str) and p.var in state.scope for p in match.patterns):
            return None
        inner = Planner(self.ctx)
        hints = {n: state.scope[n].label_names for n in outer}
        return inner, inner.match(match, State(None, {}), True, hints), outer

    def semi(self, state: State, tree, negated: bool) -> State:
        how = "left_anti" if negated else "left_semi"
        match = self.pattern_only(tree)
        saved, self.ctx.needs = self.ctx.needs, _merged(property_needs(tree), {})
        try:
            if match and (found := self.free(match, state)):
                _, inner, outer = found
                keys = [fresh("k") for _ in outer]
                right = inner.df.select(*[F.col(inner.scope[n].ident).alias(k) for n, k in zip(outer, keys, strict=True)])
                return State(state.df.join(right, [F.col(state.scope[n].ident) == F.col(k) for n, k in zip(outer, keys, strict=True)], how), state.scope)
        finally:
            self.ctx.needs = saved
        name, state = self.aggregate_subquery("exists", tree, state)
        return State(state.df.where(~F.col(name) if negated else F.col(name)), state.scope)

    def lift(self, e, state: State):
        """Subqueries in an expression become columns of the rows; the expression then names them."""
        if not isinstance(e, tuple) or not e:
            if isinstance(e, list):
                out = []
                for x in e:
                    x, state = self.lift(x, state)
                    out.append(x)
                return out, state
            return e, state
        if e[0] == "subquery":
            name, state = self.aggregate_subquery(e[1], e[2], state)
            return ("col", name), state
        if e[0] == "patcomp":
            _, path, where, out = e
            tree = A.Query([A.Match([path], where), A.Projection([(out, "_item")], final=True)])
            name, state = self.aggregate_subquery("collect", tree, state)
            return ("col", name), state
        if e[0] == "pathexpr":
            path = A.PathPat(fresh("p"), e[1].elements, e[1].selector)
            state = self.optional(A.Match([path], None, True), state)
            return ("var", path.var), state
        parts = []
        for x in e:
            if isinstance(x, (tuple, list)):
                x, state = self.lift(x, state)
            parts.append(x)
        return tuple(parts), state

    def aggregate_subquery(self, kind: str, tree, state: State) -> tuple[str, State]:
        """Add a column with EXISTS, COUNT or COLLECT of a correlated subquery."""
        if state.df is None:
            state = State(self.unit(), state.scope)
        name = fresh("s")
        default = {"exists": F.lit(False), "count": F.lit(0).cast("long")}.get(kind)
        match = self.pattern_only(tree)
        saved, self.ctx.needs = self.ctx.needs, _merged(property_needs(tree), {})
        rows = keys = None
        try:
            if match and (found := self.free(match, state)):
                inner_planner, inner, outer = found
                keys = [state.scope[n].ident for n in outer]
                own = [inner.scope[n].ident for n in outer]
                item = None
                if kind == "collect":
                    e = tree.clauses[-1].items[0][0]
                    e, inner = inner_planner.lift(e, inner)
                    item = Expressions(self.ctx, inner).column(e)
                rows = inner.df.select(*[F.col(o).alias(f"{name}_{i}") for i, o in enumerate(own)], *([item.alias(f"{name}_v")] if item is not None else []))
        finally:
            self.ctx.needs = saved
        if rows is None:
            outer = self.correlated(tree, state)
            keys = [state.scope[n].ident for n in outer] + self.carry
            inner_planner = Planner(self.ctx)
            inner_planner.carry = keys
            if keys:
                entry_columns = list(dict.fromkeys([c for n in outer for c in state.scope[n].columns()] + self.carry))
                start = State(state.df.select(*entry_columns).dropDuplicates(keys), {n: state.scope[n] for n in outer})
            else:
                start = State(None, {})
            if isinstance(tree, A.Query) and not (isinstance(tree.clauses[-1], A.Projection) and tree.clauses[-1].final):
                tree = A.Query([*tree.clauses, A.Projection([(("lit", 1), "_one")], final=True)])
            out = inner_planner.table(tree, start)
            value = [c for c in out.columns if c not in keys]
            rows = out.select(*[F.col(k).alias(f"{name}_{i}") for i, k in enumerate(keys)], *([F.col(f"`{value[0]}`").alias(f"{name}_v")] if kind == "collect" else []))
        joined = [f"{name}_{i}" for i in range(len(keys))]
        agg = {"exists": F.lit(True), "count": F.count(F.lit(1))}.get(kind)
        if kind == "collect":
            agg = F.collect_list(f"{name}_v")
            default = F.array().cast(T.ArrayType(rows.schema[f"{name}_v"].dataType))
        if not keys:
            grouped = rows.agg((F.count(F.lit(1)) > 0).alias(name) if kind == "exists" else agg.alias(name))
            return name, State(state.df.crossJoin(F.broadcast(grouped)), state.scope)  # one row
        grouped = rows.groupBy(*joined).agg(F.first(agg).alias(name) if kind == "exists" else agg.alias(name))
        on = [F.col(k).eqNullSafe(F.col(j)) for k, j in zip(keys, joined, strict=True)]
        df = state.df.join(grouped, on, "left").withColumn(name, F.coalesce(F.col(name), default)).drop(*joined)
        return name, State(df, state.scope)

    # --- MATCH --------------------------------------------------------------------------------------------------
    def match(self, clause: A.Match, state: State, insensitive: bool = False, hints: dict | None = None) -> State:
        used: list[tuple] = []
        known = set(state.scope)
        pending = list(clause.patterns)
        while pending:
            bound = [p for p in pending if any(isinstance(x, A.NodePat) and x.var in state.scope for x in p.elements)]
            path = (bound or pending)[0]
            pending.remove(path)
            state = self.path(path, state, used, insensitive and len(clause.patterns) == 1, hints or {})
        del known
        return self.filter(state, clause.where)

    def path(self, path: A.PathPat, state: State, used: list, insensitive: bool, hints: dict) -> State:
        elements = [_named(x) for x in path.elements]
        if any(isinstance(x, A.GroupPat) for x in elements):
            from ..operators.paths import quantified

            return quantified(self, path, elements, state, used, hints)
        if path.selector:
            from ..operators.paths import shortest

            return shortest(self, path, elements, state, hints)
        if path.var and self.needs(path.var):
            for x in elements:
                if isinstance(x, A.NodePat):
                    self.ctx.needs.setdefault(x.var, set()).add("*")
        nodes = elements[0::2]
        at = next((i for i, n in enumerate(nodes) if n.var in state.scope), 0)
        if nodes[at].var in state.scope:
            state = self.narrow(nodes[at], state)
        elif len(nodes) > 1 and state.df is None and not self.must_read(nodes[at]) and not elements[2 * at + 1].variable:
            state, at = self.from_edges(elements, at, state, used), at  # starts from the edges
            pieces = [(elements[2 * at + 1], True)]
            return self.finish_path(path, elements, at, state, used, insensitive, hints, pieces)
        else:
            state = self.scan(nodes[at], state, hints)
        return self.finish_path(path, elements, at, state, used, insensitive, hints, [])

    def finish_path(self, path, elements, at, state, used, insensitive, hints, done) -> State:
        nodes, rels = elements[0::2], elements[1::2]
        collected: dict[int, object] = {}
        start = at + len(done)
        for i in range(start, len(rels)):
            state, collected[i] = self.expand(state, nodes[i], rels[i], nodes[i + 1], True, used, path, insensitive, hints)
        for i in range(at - 1, -1, -1):
            state, collected[i] = self.expand(state, nodes[i + 1], rels[i], nodes[i], False, used, path, insensitive, hints)
        if path.var:
            state = self.bind_path(path, nodes, rels, collected, state)
        return state

    def needs(self, var: str | None) -> set[str]:
        return self.ctx.needs.get(var, set()) if var else set()

    def must_read(self, node: A.NodePat) -> bool:
        return bool(self.needs(node.var) or node.props or node.where or node.labels)

    def scan(self, node: A.NodePat, state: State, hints: dict) -> State:
        labels = node.labels or ([list(hints[node.var])] if hints.get(node.var) else [])
        frame, entry = self.node_frame(labels)
        df = frame if state.df is None else state.df.crossJoin(frame)
        return self.narrow(A.NodePat(node.var, [], node.props, node.where), State(df, {**state.scope, node.var: entry}))

    def node_frame(self, labels: list[list[str]]) -> tuple[DataFrame, Entry]:
        df = self.ctx.graph.scan_nodes(labels)
        entry = Entry("node", fresh("n"), {}, fresh("l"), tuple(labels[0]) if len(labels) == 1 else ())
        entry.props = {c: fresh("p") for c in df.columns if c not in (VID, LABELS)}
        return df.select(F.col(VID).alias(entry.ident), F.col(LABELS).alias(entry.labels), *[F.col(f"`{p}`").alias(c) for p, c in entry.props.items()]), entry

    def narrow(self, node: A.NodePat, state: State) -> State:
        """Apply labels, inline properties and WHERE of a pattern to a bound node."""
        ex = None
        df, entry = state.df, state.scope[node.var]
        if entry.kind == "value":
            state = self.as_entity(node.var, state)
            df, entry = state.df, state.scope[node.var]
        for group in node.labels:
            if entry.label_names and set(entry.label_names) <= set(group):
                continue
            df = df.where(F.arrays_overlap(entry.labels, F.array(*[F.lit(x) for x in group])) if entry.labels else F.lit(False))
        state = State(df, state.scope)
        for key, e in _inline(node.props, self.ctx):
            ex = ex or Expressions(self.ctx, state)
            state = State(state.df.where(ex._cmp("=", ("prop", ("var", node.var), key), e)), state.scope)
        return self.filter(state, node.where) if node.where else state

    def as_entity(self, var: str, state: State) -> State:
        """A value that holds a node becomes a node with its columns."""
        entry = state.scope[var]
        t = state.df.schema[entry.ident].dataType
        if not isinstance(t, T.StructType) or "_vid" not in t.fieldNames():
            raise CompileError(f"{var} isn't a node")
        new = Entry("node", fresh("n"), {f: fresh("p") for f in t.fieldNames() if not f.startswith("_")}, fresh("l"))
        base = F.col(entry.ident)
        df = state.df.withColumns({new.ident: base["_vid"], new.labels: base["_labels"] if "_labels" in t.fieldNames() else F.lit(None).cast("array<string>"), **{c: base[p] for p, c in new.props.items()}})
        return State(df, {**state.scope, var: new})

    def edge_frame(self, rel: A.RelPat, forward: bool, from_labels: tuple, to_labels: list) -> tuple[DataFrame, Entry, str, str, list]:
        """Edges as (from, to, id, ...) in the direction of travel, of the tables that the endpoints' labels allow."""
        graph = self.ctx.graph
        direction = rel.direction if forward or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]
        frames, ends = [], []
        wanted = {x for g in to_labels for x in g}
        multi = graph.multi_labelled()
        for name, table in graph.edge_tables(rel.types):
            df = table.df.withColumn(TYPE, F.lit(name))
            for way in ("out", "in"):
                if direction not in (way, "both"):
                    continue
                a, b = (table.sources, table.targets) if way == "out" else (table.targets, table.sources)
                if not multi and (from_labels and a and not set(from_labels) & set(a) or wanted and b and not wanted & set(b)):
                    continue
                x, y = (SRC, DST) if way == "out" else (DST, SRC)
                part = df.withColumns({"_from": F.col(x), "_to": F.col(y)})
                if direction == "both" and way == "in":
                    part = part.where(F.col(SRC) != F.col(DST))  # a loop is met once
                frames.append(part)
                ends.append(tuple(b))
        if not frames:
            df = graph.scan_edges([]).limit(0).withColumns({"_from": F.col(SRC), "_to": F.col(DST)}) if graph.edges else graph.scan_edges([]).withColumns({"_from": F.col(SRC), "_to": F.col(DST)})
        else:
            from ..catalog import union_all

            df = union_all(frames)
        entry = Entry("rel", fresh("e"), {}, fresh("t"), (), fresh("s"), fresh("d"))
        entry.props = {c: fresh("p") for c in df.columns if c not in (EID, SRC, DST, TYPE, "_from", "_to")}
        a, b = fresh("f"), fresh("n")
        out = df.select(F.col("_from").alias(a), F.col("_to").alias(b), F.col(EID).alias(entry.ident), F.col(SRC).alias(entry.src), F.col(DST).alias(entry.dst), F.col(TYPE).alias(entry.labels), *[F.col(f"`{p}`").alias(c) for p, c in entry.props.items()])
        return out, entry, a, b, ends

    def rel_filters(self, rel: A.RelPat, entry: Entry, df: DataFrame, scope: dict) -> DataFrame:
        if not rel.props and not rel.where:
            return df
        state = State(df, {**scope, rel.var: entry})
        ex = Expressions(self.ctx, state)
        for key, e in _inline(rel.props, self.ctx):
            df = df.where(ex._cmp("=", ("prop", ("var", rel.var), key), e))
        return df.where(ex.boolean(rel.where)) if rel.where else df

    def from_edges(self, elements, at, state, used) -> State:
        node, rel, other = elements[2 * at], elements[2 * at + 1], elements[2 * at + 2]
        edges, entry, a, b, ends = self.edge_frame(rel, True, (), other.labels)
        edges = self.rel_filters(rel, entry, edges, state.scope)
        state = State(edges, {**state.scope, rel.var: entry, node.var: Entry("node", a)})
        used.append(("one", entry.ident, set(rel.types)))
        return self.arrive(state, other, b, ends)

    def arrive(self, state: State, node: A.NodePat, ident: str, ends: list) -> State:
        """Bind the far node of an expansion: to the node of that name, or by a join with its label's table where something of it is read."""
        if node.var in state.scope:
            known = state.scope[node.var]
            if known.kind == "value":
                state = self.as_entity(node.var, state)
                known = state.scope[node.var]
            state = State(state.df.where(F.col(known.ident) == F.col(ident)), state.scope)
            return self.narrow(node, state)
        implied = bool(ends) and all(e for e in ends) and all(all(set(e) <= set(g) for e in ends) for g in node.labels) and not self.ctx.graph.multi_labelled()
        names = tuple(sorted({x for e in ends for x in e})) if ends and all(ends) else ()
        if not (self.needs(node.var) or node.props or node.where) and (not node.labels or implied):
            return State(state.df, {**state.scope, node.var: Entry("node", ident, {}, None, tuple(node.labels[0]) if len(node.labels) == 1 else names)})
        labels = node.labels or ([list(names)] if names else [])
        frame, entry = self.node_frame(labels)
        own = entry.ident
        df = state.df.join(frame, F.col(ident) == F.col(own))
        return self.narrow(A.NodePat(node.var, [], node.props, node.where), State(df, {**state.scope, node.var: entry}))

    def hydrate(self, var: str, state: State) -> State:
        """Read the properties of a node that so far is an id."""
        entry = state.scope[var]
        frame, new = self.node_frame([list(entry.label_names)] if entry.label_names else [])
        return State(state.df.join(frame, F.col(entry.ident) == F.col(new.ident), "left"), {**state.scope, var: new})

    def expand(self, state, node, rel, other, forward, used, path, insensitive, hints) -> tuple[State, object]:
        start = state.scope[node.var]
        if rel.variable:
            from ..operators.paths import variable_length

            return variable_length(self, state, node, rel, other, forward, used, path, insensitive, hints)
        edges, entry, a, b, ends = self.edge_frame(rel, forward, start.label_names, other.labels)
        edges = self.rel_filters(rel, entry, edges, {}) if not (names_in(rel.props) | names_in(rel.where)) - {rel.var} else edges
        df = state.df.join(edges, F.col(start.ident) == F.col(a)).drop(a)
        if (names_in(rel.props) | names_in(rel.where)) - {rel.var}:
            df = self.rel_filters(rel, entry, df, state.scope)
        if rel.var in state.scope:
            df = df.where(F.col(state.scope[rel.var].ident) == F.col(entry.ident))
        for kind, column, types in used:
            if types and rel.types and not types & set(rel.types):
                continue
            if kind == "one":
                df = df.where(F.col(column) != F.col(entry.ident))
            else:
                df = df.where(~F.array_contains(column, F.col(entry.ident)))
        used.append(("one", entry.ident, set(rel.types)))
        return self.arrive(State(df, {**state.scope, rel.var: entry}), other, b, ends), entry

    def node_struct(self, entry: Entry):
        props = [x for n, c in sorted(entry.props.items()) for x in (F.lit(n), F.col(c).cast("string"))]
        return F.struct(F.col(entry.ident).alias("_vid"), (F.col(entry.labels) if entry.labels else F.lit(None).cast("array<string>")).alias("_labels"), (F.create_map(*props) if props else F.create_map().cast("map<string,string>")).alias("_props"))

    def rel_struct(self, entry: Entry):
        return F.struct(F.col(entry.ident).alias("_eid"), F.col(entry.src).alias("_src"), F.col(entry.dst).alias("_dst"), F.col(entry.labels).alias("_type"))

    def bind_path(self, path, nodes, rels, collected, state: State) -> State:
        """A path value: its nodes and relationships in order."""
        node_parts, rel_parts, run_nodes, run_rels = [], [], [], []

        def flush():
            if run_nodes:
                node_parts.append(F.array(*run_nodes))
                run_nodes.clear()
            if run_rels:
                rel_parts.append(F.array(*run_rels))
                run_rels.clear()

        run_nodes.append(self.node_struct(state.scope[nodes[0].var]))
        for i, rel in enumerate(rels):
            if rel.variable:
                inner_nodes, inner_rels = collected[i]
                flush()
                node_parts.append(F.col(inner_nodes))
                rel_parts.append(F.col(inner_rels))
            else:
                run_rels.append(self.rel_struct(state.scope[rel.var]))
            if not rel.variable:
                run_nodes.append(self.node_struct(state.scope[nodes[i + 1].var]))
        flush()
        empty = F.array().cast("array<struct<_eid:bigint,_src:bigint,_dst:bigint,_type:string>>")
        c = fresh("path")
        df = state.df.withColumn(c, F.struct((F.concat(*node_parts) if len(node_parts) > 1 else node_parts[0]).alias("nodes"), (F.concat(*rel_parts) if len(rel_parts) > 1 else rel_parts[0] if rel_parts else empty).alias("relationships")))
        return State(df, {**state.scope, path.var: Entry("value", c)})

    def optional(self, clause: A.Match, state: State) -> State:
        """Left join with the pattern and its WHERE, on what they share with the rows so far."""
        new = [n for n in _pattern_names(clause) if n not in state.scope]
        if state.df is None:
            inner = self.match(A.Match(clause.patterns, clause.where), State(None, {}))
            df = self.unit().join(inner.df, F.lit(True), "left")
            return State(df, {**{n: e for n, e in inner.scope.items() if n in new}})
        outer = self.correlated([clause.patterns, clause.where], state)
        free = self.free(A.Match(clause.patterns, clause.where), state)
        if free:
            planner, _, outer = free
            inner = planner.match(A.Match(clause.patterns, clause.where), State(None, {}), False, {n: state.scope[n].label_names for n in outer})
            keys = [(state.scope[n].ident, inner.scope[n].ident) for n in outer]
        else:
            idents = [state.scope[n].ident for n in outer]
            columns = list(dict.fromkeys(c for n in outer for c in state.scope[n].columns()))
            start = State(state.df.select(*columns).dropDuplicates(idents), {n: state.scope[n] for n in outer}) if outer else State(None, {})
            inner = Planner(self.ctx).match(A.Match(clause.patterns, clause.where), start)
            keys = [(i, i) for i in idents]
        wanted = list(dict.fromkeys(c for n in new if n in inner.scope for c in inner.scope[n].columns()))
        names = {k: fresh("k") for _, k in keys}
        right = inner.df.select(*[F.col(k).alias(n) for k, n in names.items()], *[F.col(c) for c in wanted if c not in names])
        scope_fix = {k: n for k, n in names.items()}
        on = [F.col(a).eqNullSafe(F.col(names[k])) for a, k in keys]
        df = state.df.join(right, reduce(lambda x, y: x & y, on) if on else F.lit(True), "left")
        scope = dict(state.scope)
        for n in new:
            if n in inner.scope:
                e = inner.scope[n]
                scope[n] = Entry(e.kind, scope_fix.get(e.ident, e.ident), {p: scope_fix.get(c, c) for p, c in e.props.items()}, scope_fix.get(e.labels, e.labels) if e.labels else None, e.label_names, scope_fix.get(e.src, e.src) if e.src else None, scope_fix.get(e.dst, e.dst) if e.dst else None)
        return State(df, scope)

    # --- UNWIND, CALL -------------------------------------------------------------------------------------------
    def unwind(self, clause: A.Unwind, state: State) -> State:
        e, state = self.lift(clause.expr, state)
        if state.df is None:
            state = State(self.unit(), state.scope)
        ex = self.expressions(state)
        c, t = ex.typed(e)
        if isinstance(t, T.NullType):
            c = F.lit(None).cast("array<string>")
        elif not isinstance(t, T.ArrayType):
            c = F.array(c)
        name = fresh("u")
        df = state.df.select("*", F.explode(c).alias(name))
        return self.entity_or_value(clause.var, name, State(df, state.scope))

    def entity_or_value(self, var: str, column: str, state: State) -> State:
        state = State(state.df, {**state.scope, var: Entry("value", column)})
        t = state.df.schema[column].dataType
        if isinstance(t, T.StructType) and "_vid" in t.fieldNames() and "_props" not in t.fieldNames():
            return self.as_entity(var, state)
        return state

    def call(self, clause: A.Call, state: State) -> State:
        procedure = self.ctx.procedures.get(clause.name.lower()) or self.ctx.procedures.get(clause.name)
        if procedure is None:
            raise CompileError(f"unknown procedure {clause.name}")
        df = procedure(self.ctx, [self.constant(a) for a in clause.args])
        yields = clause.yields if clause.yields is not None else [(c, c) for c in df.columns]
        if unknown := [s for s, _ in yields if s not in df.columns]:
            raise CompileError(f"{clause.name} doesn't yield {', '.join(unknown)}")
        names = {alias: fresh("y") for _, alias in yields}
        df = df.select(*[F.col(f"`{s}`").alias(names[alias]) for s, alias in yields])
        state = State(df if state.df is None else state.df.crossJoin(df), state.scope)
        for alias, column in names.items():
            state = self.entity_or_value(alias, column, state)
        return self.filter(state, clause.where) if clause.where else state

    def constant(self, e):
        """Value of an expression without names."""
        if e[0] == "lit":
            return e[1]
        if e[0] == "param":
            return self.ctx.params[e[1]]
        if e[0] == "list":
            return [self.constant(x) for x in e[1]]
        if e[0] == "map":
            return {k: self.constant(x) for k, x in e[1]}
        if names_in(e):
            raise CompileError("arguments of a procedure must be constants or parameters")
        return self.unit().select(Expressions(self.ctx, State(self.unit(), {})).column(e).alias("x")).first()[0]

    def subcall(self, clause: A.SubCall, state: State) -> State:
        """A subquery for each row: compiled once over the distinct values of what it imports."""
        tree = clause.query
        first = tree.clauses[0] if isinstance(tree, A.Query) else tree.parts[0].clauses[0]
        if clause.imports is not None:
            imports = list(state.scope) if "*" in clause.imports else clause.imports
        elif isinstance(first, A.Projection) and not first.final and all(e[0] == "var" for e, _ in first.items):
            imports = [e[1] for e, _ in first.items]
        else:
            imports = []
        inner = Planner(self.ctx)
        keys = [state.scope[n].ident for n in imports]
        if imports:
            columns = list(dict.fromkeys(c for n in imports for c in state.scope[n].columns()))
            start = State(state.df.select(*columns).dropDuplicates(keys), {n: state.scope[n] for n in imports})
        else:
            start = State(None, {})
        inner.carry = keys
        out = inner.table(tree, start)
        fresh_keys = {k: fresh("k") for k in keys}
        names = {c: fresh("y") for c in out.columns if c not in keys}
        right = out.select(*[F.col(k).alias(n) for k, n in fresh_keys.items()], *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        if state.df is None:
            df = right
        elif not keys:
            df = state.df.crossJoin(right)
        else:
            df = state.df.join(right, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(n)) for k, n in fresh_keys.items()]), "left" if clause.optional else "inner").drop(*fresh_keys.values())
        state = State(df, state.scope)
        for name, column in names.items():
            state = self.entity_or_value(name, column, state)
        return state

    # --- WITH and RETURN ----------------------------------------------------------------------------------------
    def project(self, clause: A.Projection, state: State) -> State:
        if state.df is None:
            state = State(self.unit(), state.scope)
        items = list(clause.items)
        if clause.star:
            items = [(("var", n), n) for n in state.scope if not n.startswith("_")] + items
        aliases = [a for _, a in items]
        if len(set(aliases)) < len(aliases):
            raise CompileError("columns of a projection need different names")
        lifted = []
        for e, alias in items:
            e, state = self.lift(e, state)
            lifted.append((e, alias))
        for e, _ in lifted:  # entities that are passed on whole need their columns
            if e[0] == "var" and e[1] in state.scope and state.scope[e[1]].kind == "node" and not state.scope[e[1]].labels and clause.final:
                state = self.hydrate(e[1], state)
        ex = Expressions(self.ctx, state)
        aggregated = any(has_aggregate(e, self.ctx) for e, _ in lifted)
        scope: dict[str, Entry] = {}
        select, keys, key_columns, aggs, carried = [], [], [], [], []
        for e, alias in lifted:
            entry = state.scope.get(e[1]) if e[0] == "var" else None
            if entry is not None and entry.kind != "value":
                scope[alias] = entry
                keys.append(F.col(entry.ident))
                key_columns.append(entry.ident)
                carried += [c for c in entry.columns() if c != entry.ident]
                continue
            column = fresh("c")
            scope[alias] = Entry("value", column)
            if has_aggregate(e, self.ctx):
                aggs.append(self.mixed(ex, e).alias(column))
            else:
                c = ex.column(e)
                select.append(c.alias(column))
                keys.append(c.alias(column))
                key_columns.append(column)
        carried = list(dict.fromkeys(c for c in carried if c not in key_columns))
        hidden: list[str] = []
        late: list[tuple[str, tuple]] = []
        if aggregated:  # window calls see the groups: what they read becomes columns of the groups
            select, keys, key_columns, late = self.split_windows(lifted, scope, ex, select, keys, key_columns, aggs, hidden)
        orders = []
        by_expr = {repr(e): a for e, a in items}
        for e, down in clause.order:
            if repr(e) in by_expr:
                orders.append((("var", by_expr[repr(e)]), down))
            elif not aggregated and not names_in(e) <= set(scope):
                e, state = self.lift(e, state)
                ex = Expressions(self.ctx, state)
                h = fresh("o")
                hidden.append(h)
                select.append(ex.column(e).alias(h))
                orders.append((("col", h), down))
            else:
                orders.append((_replace(e, {repr(x): ("var", a) for x, a in items}), down))
        if aggregated:
            base = state.df
            grouped = [*[F.col(c) for c in self.carry if c not in key_columns], *keys]
            firsts = [F.first(c).alias(c) for c in carried if c not in self.carry]
            df = base.groupBy(*grouped).agg(*firsts, *aggs) if grouped else base.agg(*aggs)
            for column, e in late:
                df = df.withColumn(column, Expressions(self.ctx, State(df, scope)).column(e))
        else:
            entity_columns = list(dict.fromkeys([c for e in scope.values() if e.kind != "value" for c in e.columns()] + self.carry))
            df = state.df.select(*[F.col(c) for c in entity_columns], *select)
        new = State(df, scope)
        if clause.distinct:
            new = self.distinct(new, hidden)
        if clause.where is not None:
            new = self.filter(new, clause.where)
        if orders or clause.limit is not None or clause.skip is not None:
            new = self.order(new, orders, clause)
        return State(new.df.drop(*hidden) if hidden else new.df, new.scope)

    def mixed(self, ex: Expressions, e):
        return ex.column(e)

    def split_windows(self, items, scope, ex, select, keys, key_columns, aggs, hidden):
        """Take items with OVER out of the keys of a grouped projection; they are computed on the groups."""
        late = []
        plain = {repr(e): scope[a].ident for e, a in items if not _has_over(e)}

        def group_column(e):
            if not isinstance(e, tuple) or not e or e[0] in ("lit", "param", "star"):
                return e
            if repr(e) in plain:
                return ("col", plain[repr(e)])
            column = fresh("w")
            hidden.append(column)
            plain[repr(e)] = column
            if has_aggregate(e, self.ctx):
                aggs.append(ex.column(e).alias(column))
            else:
                keys.append(ex.column(e).alias(column))
                key_columns.append(column)
            return ("col", column)

        def rewrite(e):
            if isinstance(e, tuple) and e and e[0] == "over":
                _, call, partition, order = e
                return ("over", ("fn", call[1], [group_column(a) for a in call[2]], call[3]), [group_column(p) for p in partition], [(group_column(o), d) for o, d in order])
            if isinstance(e, tuple):
                return tuple(rewrite(x) for x in e)
            return [rewrite(x) for x in e] if isinstance(e, list) else e

        for e, alias in items:
            if _has_over(e):
                column = scope[alias].ident
                at = key_columns.index(column)
                del keys[at], key_columns[at]
                late.append((column, rewrite(e)))
        return select, keys, key_columns, late

    def distinct(self, state: State, hidden: list[str]) -> State:
        subset = list(dict.fromkeys([e.ident for e in state.scope.values()] + self.carry))
        maps = [f.name for f in state.df.schema if f.name in subset and isinstance(f.dataType, T.MapType)]
        if maps:
            raise CompileError("DISTINCT over maps of open keys isn't supported")
        floats = [f.name for f in state.df.schema if f.name in subset and isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = state.df.withColumns({c: F.when(F.col(c) == 0, F.lit(0.0).cast(state.df.schema[c].dataType)).otherwise(F.col(c)) for c in floats}) if floats else state.df
        extra = set(df.columns) - set(subset)
        return State(df.dropDuplicates(subset) if extra else df.distinct(), state.scope)

    def order(self, state: State, orders, clause: A.Projection) -> State:
        ex = Expressions(self.ctx, state)
        columns = []
        for e, down in orders:
            if e[0] == "var" and e[1] in state.scope and state.scope[e[1]].kind != "value":
                columns.append(values.order(F.col(state.scope[e[1]].ident), T.LongType(), down))
            else:
                c = ex.column(e)
                columns.append(values.order(c, ex.type_of(c), down))
        skip = self.count(clause.skip, "SKIP")
        limit = self.count(clause.limit, "LIMIT")
        df = state.df
        if self.carry and (skip is not None or limit is not None):  # a window for each outer row
            n = fresh("r")
            w = Window.partitionBy(*self.carry).orderBy(*(columns or [F.lit(1)]))
            df = df.withColumn(n, F.row_number().over(w))
            df = df.where((F.col(n) > (skip or 0)) & (F.col(n) <= (skip or 0) + limit if limit is not None else F.lit(True))).drop(n)
            return State(df, state.scope)
        if columns:
            df = df.orderBy(*columns)
        if skip is not None:
            df = df.offset(skip)
        if limit is not None:
            df = df.limit(limit)
        return State(df, state.scope)

    def count(self, e, what: str) -> int | None:
        if e is None:
            return None
        n = self.constant(e)
        if not isinstance(n, int) or isinstance(n, bool) or n < 0:
            raise CompileError(f"{what} needs a number of rows")
        return n

    # --- recursion ----------------------------------------------------------------------------------------------
    def _recursive(self, tree: A.Recursive, start: State) -> DataFrame:
        """Set semantics: each round sees the rows that were new in the round before."""
        rows = self.table(tree.anchor, State(None, {})).distinct()
        rows = rows.toDF(*tree.columns) if tree.columns else rows
        known = delta = keep(rows, tree.name)
        for _ in range(self.ctx.settings.recursion_rounds):
            step = self.over_table(tree.name, delta, tree.step)
            step = step.toDF(*known.columns).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in known.schema])
            on = [step[c].eqNullSafe(known[c]) for c in known.columns]
            delta = keep(step.distinct().join(known, on, "left_anti"), tree.name)
            if delta.isEmpty():
                return self.over_table(tree.name, known, tree.rest)
            known = known.unionAll(delta)
        raise IterationLimit(f"{tree.name}: no end after {self.ctx.settings.recursion_rounds} rounds")

    def over_table(self, name: str, df: DataFrame, tree) -> DataFrame:
        """A query in which ``MATCH (r:name)`` reads the given table's rows."""
        saved = self.ctx.graph
        self.ctx.graph = saved.copy()
        self.ctx.graph.nodes = {**saved.nodes, name: df.withColumn(VID, F.xxhash64(*df.columns))}
        try:
            return Planner(self.ctx).table(tree, State(None, {}))
        finally:
            self.ctx.graph = saved


def _merged(a: dict, b: dict) -> dict:
    out = {k: set(v) for k, v in a.items()}
    for k, v in b.items():
        out.setdefault(k, set()).update(v)
    return out


def _inline(props: dict, ctx: Context):
    for key, e in props.items():
        if key == "*":
            for k, v in ctx.params[e[1]].items():
                yield k, ("lit", v)
        else:
            yield key, e


def _named(x):
    """The pattern element with a name; anonymous ones get a hidden one."""
    if isinstance(x, A.NodePat):
        return x if x.var else A.NodePat(fresh("_n"), x.labels, x.props, x.where)
    if isinstance(x, A.RelPat):
        return x if x.var else A.RelPat(fresh("_r"), x.types, x.direction, x.low, x.high, x.variable, x.props, x.where)
    return x


def _pattern_names(clause: A.Match) -> list[str]:
    out: list[str] = []
    for p in clause.patterns:
        out += [p.var] if p.var else []
        for x in p.elements:
            if isinstance(x, A.GroupPat):
                out += [y.var for y in x.elements if y.var]
            elif x.var:
                out.append(x.var)
    return list(dict.fromkeys(out))


def _replace(e, names: dict[str, tuple]):
    if isinstance(e, tuple):
        if repr(e) in names:
            return names[repr(e)]
        return tuple(_replace(x, names) for x in e)
    if isinstance(e, list):
        return [_replace(x, names) for x in e]
    return e


def _has_over(e) -> bool:
    if isinstance(e, tuple) and e and e[0] == "over":
        return True
    return isinstance(e, (tuple, list)) and any(_has_over(x) for x in e)


def _multiplicity_free(clause, ctx: Context) -> bool:
    """Whether a projection reads only which rows there are, not how many."""
    if not isinstance(clause, A.Projection):
        return False
    if any(has_aggregate(e, ctx) for e, _ in clause.items):
        found = []

        def visit(e):
            if isinstance(e, tuple) and e and e[0] == "fn" and (has_aggregate(e, ctx)):
                found.append(e[1] in ("min", "max") or e[1] in ("count", "collect", "sum") and e[3])
            for x in e if isinstance(e, (tuple, list)) else ():
                if isinstance(x, (tuple, list)):
                    visit(x)

        for e, _ in clause.items:
            visit(e)
        return all(found)
    return clause.distinct


__all__ = ["Planner", "literal"]
