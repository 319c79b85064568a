"""Writes: copy-on-write over immutable label and edge tables, one new version for each statement.

New entities get ids above all others by the order of their rows; the rows that a write reads are written to the shared folder
first, so a task that runs again writes the same entities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DST, EID, LABELS, SRC, VID, EdgeTable
from ..cypher import ast as A
from ..cypher.compiler import Expressions, conjuncts
from ..cypher.scope import Entry, State, fresh
from ..errors import CompileError, ConstraintError
from ..storage import keep


def numbered(df: DataFrame, first: int, name: str) -> DataFrame:
    """Rows with consecutive numbers from ``first``: counts of partitions, then numbers within them; no row changes its task."""
    part, at = fresh("q"), fresh("q")
    rows = keep(df.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    counts = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect()}  # one number a partition
    base, total = {}, first
    for p in sorted(counts):
        base[p] = total
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(list(base.items()) or [(0, first)], f"{part} int, _base long")
    return rows.join(F.broadcast(offsets), part).withColumn(name, F.col("_base") + F.col(at)).drop(part, at, "_base")


def apply_write(planner, clause, state: State) -> State:
    if state.df is None:
        state = State(planner.unit(), state.scope)
    if isinstance(clause, A.Create):
        for p in clause.patterns:
            state = create(planner, p, state)
        return state
    if isinstance(clause, A.Merge):
        return merge(planner, clause, state)
    if isinstance(clause, A.SetItems):
        return set_items(planner, clause.items, state)
    if isinstance(clause, A.Remove):
        items = [("prop", i[1], i[2], ("lit", None)) if i[0] == "prop" else ("unlabel", i[1], i[2]) for i in clause.items]
        return set_items(planner, items, state)
    if isinstance(clause, A.Delete):
        return delete(planner, clause, state)
    if isinstance(clause, A.Foreach):
        inner = planner.unwind(A.Unwind(clause.expr, clause.var), state)
        for c in clause.body:
            inner = apply_write(planner, c, inner)
        return state
    raise CompileError(f"{type(clause).__name__} isn't supported here")


def _values(planner, props: dict, state: State):
    ex = Expressions(planner.ctx, state)
    out = {}
    for key, e in props.items():
        if key == "*":
            out |= {k: ex.column(("lit", v)) for k, v in planner.ctx.params[e[1]].items()}
        else:
            out[key] = ex.column(e)
    return out


def create(planner, path: A.PathPat, state: State) -> State:
    graph = planner.ctx.graph
    elements = [x if x.var else type(x)(**{**x.__dict__, "var": fresh("_w")}) for x in path.elements]
    for x in elements[0::2]:
        if x.var in state.scope:
            continue
        if not x.labels:
            raise CompileError("a new vertex needs a label")
        vid = fresh("n")
        props = _values(planner, x.props, state)
        names = {k: fresh("p") for k in props}
        df = numbered(state.df.withColumns({names[k]: c for k, c in props.items()}), graph.next_id(), vid)
        labels = [g[0] for g in x.labels]
        lab = fresh("l")
        df = df.withColumn(lab, F.array(*[F.lit(z) for z in labels]))
        df = keep(df, "created")
        new = df.select(F.col(vid).alias(VID), *([F.col(lab).alias(LABELS)] if len(labels) > 1 else []), *[F.col(c).alias(k) for k, c in names.items()])
        append_nodes(graph, labels[0], new)
        state = State(df, {**state.scope, x.var: Entry("node", vid, names, lab, (labels[0],))})
    for i in range(1, len(elements), 2):
        rel, a, b = elements[i], elements[i - 1], elements[i + 1]
        if len(rel.types) != 1 or rel.direction == "both":
            raise CompileError("a new relationship needs one type and a direction")
        if rel.direction == "in":
            a, b = b, a
        eid = fresh("e")
        props = _values(planner, rel.props, state)
        names = {k: fresh("p") for k in props}
        df = numbered(state.df.withColumns({names[k]: c for k, c in props.items()}), graph.next_id(), eid)
        df = keep(df, "created")
        sa, sb = state.scope[a.var], state.scope[b.var]
        check_endpoints(graph, rel.types[0], sa.label_names, sb.label_names)
        append_edges(graph, rel.types[0], df.select(F.col(eid).alias(EID), F.col(sa.ident).alias(SRC), F.col(sb.ident).alias(DST), *[F.col(c).alias(k) for k, c in names.items()]), sa.label_names, sb.label_names)
        t = fresh("t")
        df = df.withColumn(t, F.lit(rel.types[0]))
        state = State(df, {**state.scope, rel.var: Entry("rel", eid, names, t, (), sa.ident, sb.ident)})
    return state


def check_endpoints(graph, type_: str, sources, targets) -> None:
    table = graph.edges.get(type_)
    for own, allowed in ((sources, table.sources if table else ()), (targets, table.targets if table else ())):
        if own and allowed and not set(own) <= set(allowed):
            raise ConstraintError(f"{type_} doesn't join {sorted(own)}")


def append_nodes(graph, label: str, new: DataFrame) -> None:
    old = graph.nodes.get(label)
    joined = new if old is None else _aligned(old, new)
    check_constraints(graph, label, joined)
    graph.nodes[label] = joined


def append_edges(graph, type_: str, new: DataFrame, sources=(), targets=()) -> None:
    old = graph.edges.get(type_)
    graph.edges[type_] = EdgeTable(new, tuple(sources), tuple(targets)) if old is None else EdgeTable(_aligned(old.df, new), old.sources, old.targets)


def _aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    types = dict(old.dtypes)
    new = new.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in new.columns])
    if LABELS in new.columns and LABELS not in old.columns:
        old = old.withColumn(LABELS, F.lit(None).cast("array<string>"))
    return old.unionByName(new, allowMissingColumns=True)


def check_constraints(graph, label: str, df: DataFrame) -> None:
    """Validate a label's new version."""
    for c in graph.constraints:
        if c["label"] != label:
            continue
        cols = c.get("props", [])
        if c["kind"] in ("exists", "key") and df.where(" or ".join(f"`{p}` is null" for p in cols) if set(cols) <= set(df.columns) else "true").limit(1).count():
            raise ConstraintError(f"{label}: {', '.join(cols)} must exist")
        if c["kind"] in ("unique", "key") and set(cols) <= set(df.columns) and df.dropna(subset=cols).groupBy(*cols).count().where("count > 1").limit(1).count():
            raise ConstraintError(f"{label}: {', '.join(cols)} must be unique")
        if c["kind"] == "check":
            from ..cypher.compiler import Context

            scope = {p: Entry("value", p) for p in df.columns}
            ok = Expressions(Context(graph), State(df, scope)).boolean(c["expr"])
            if df.where(~ok).limit(1).count():
                raise ConstraintError(f"{label}: a row breaks the check")


def merge(planner, clause: A.Merge, state: State) -> State:
    """Match the pattern for each row; where there is none create it once for equal values."""
    path = clause.pattern
    named = A.PathPat(path.var, [x if x.var else type(x)(**{**x.__dict__, "var": fresh("_w")}) for x in path.elements])
    for x in named.elements:
        planner.ctx.needs.setdefault(x.var, set()).add("*")
    new = [x.var for x in named.elements if x.var not in state.scope]
    rows = State(keep(state.df, "merge"), state.scope)
    probe = planner.optional(A.Match([named], None, True), rows)
    marker = next(v for v in new)
    df = keep(probe.df, "merge")
    probe = State(df, probe.scope)
    hit = State(df.where(F.col(probe.scope[marker].ident).isNotNull()), probe.scope)
    miss = State(df.where(F.col(probe.scope[marker].ident).isNull()).select(*rows.df.columns), rows.scope)
    graph = planner.ctx.graph
    if clause.on_match and not hit.df.isEmpty():
        set_items(planner, clause.on_match, hit)
    if not miss.df.isEmpty():
        values = [c.alias(fresh("m")) for x in named.elements for c in _values(planner, x.props, miss).values()]
        bound = [F.col(miss.scope[x.var].ident) for x in named.elements if x.var in miss.scope]
        keyed = miss.df.withColumn("_key", F.struct(*values, *bound) if values or bound else F.lit(1))
        once = State(keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.lit(1)))).where("_n = 1").drop("_n", "_key"), miss.scope)
        made = create(planner, named, once)
        if clause.on_create:
            set_items(planner, clause.on_create, made)
    del graph
    return planner.match(A.Match([named]), rows)


def set_items(planner, items: list[tuple], state: State) -> State:
    """Update properties and labels of the entities bound in the rows; of several rows for one entity one wins."""
    graph = planner.ctx.graph
    by_var: dict[str, list[tuple]] = {}
    for i in items:
        by_var.setdefault(i[1], []).append(i)
    frozen = State(keep(state.df, "set"), state.scope)
    changed: dict[str, dict[str, str]] = {}
    for var, own in by_var.items():
        entry = frozen.scope[var]
        ex = Expressions(planner.ctx, frozen)
        new: dict[str, object] = {}
        replace_all = False
        labels, unlabel = [], []
        for i in own:
            if i[0] == "prop":
                new[i[2]] = ex.column(i[3])
            elif i[0] in ("plus", "all"):
                replace_all = replace_all or i[0] == "all"
                e = i[2]
                pairs = e[1] if e[0] == "map" else [(k, ("lit", v)) for k, v in planner.ctx.params[e[1]].items()] if e[0] == "param" else [(p, ("prop", e, p)) for p in frozen.scope[e[1]].props]
                new |= {k: ex.column(v) for k, v in pairs}
            elif i[0] == "label":
                labels += i[2]
            else:
                unlabel += i[2]
        ident = VID if entry.kind == "node" else EID
        updates = frozen.df.where(F.col(entry.ident).isNotNull()).select(F.col(entry.ident).alias("_id"), *[c.alias(f"_new_{k}") for k, c in new.items()]).dropDuplicates(["_id"])
        updates = keep(updates, "updates")
        tables = graph.nodes if entry.kind == "node" else {t: e.df for t, e in graph.edges.items()}
        touched = entry.label_names if entry.kind == "node" and entry.label_names else tables
        for name in list(touched):
            old = tables[name]
            joined = old.join(updates, old[ident] == updates["_id"], "left")
            types = dict(old.dtypes)
            columns = []
            fixed = {VID, EID, SRC, DST, LABELS}
            for c in [*old.columns, *[k for k in new if k not in old.columns]]:
                if c in new:
                    value = F.col(f"_new_{c}")
                    value = value.cast(types[c]) if c in types else value
                    columns.append((F.when(F.col("_id").isNotNull(), value).otherwise(F.col(f"`{c}`")) if c in types else F.when(F.col("_id").isNotNull(), value)).alias(c))
                elif replace_all and c not in fixed:
                    columns.append(F.when(F.col("_id").isNull(), F.col(f"`{c}`")).alias(c))
                elif c == LABELS and (labels or unlabel):
                    continue
                else:
                    columns.append(F.col(f"`{c}`"))
            if labels or unlabel:
                current = F.coalesce(F.col(LABELS), F.array(F.lit(name))) if LABELS in old.columns else F.array(F.lit(name))
                moved = F.array_except(F.array_union(current, F.array(*[F.lit(x) for x in labels]).cast("array<string>")), F.array(*[F.lit(x) for x in unlabel]).cast("array<string>"))
                columns.append(F.when(F.col("_id").isNotNull(), moved).otherwise(current).alias(LABELS))
            df = joined.select(*columns)
            if entry.kind == "node":
                check_constraints(graph, name, df)
                graph.nodes[name] = df
            else:
                graph.edges[name] = EdgeTable(df, graph.edges[name].sources, graph.edges[name].targets)
        changed[var] = {k: fresh("p") for k in new}
        frozen = State(frozen.df.withColumns({changed[var][k]: c for k, c in new.items()}), {**frozen.scope, var: Entry(entry.kind, entry.ident, {**({} if replace_all else entry.props), **changed[var]}, entry.labels, entry.label_names, entry.src, entry.dst)})
    return frozen


def delete(planner, clause: A.Delete, state: State) -> State:
    """Remove entities; a vertex with relationships only by DETACH DELETE."""
    graph = planner.ctx.graph
    rows = State(keep(state.df, "delete"), state.scope)
    for e in clause.exprs:
        if e[0] != "var" or rows.scope[e[1]].kind == "value":
            raise CompileError("DELETE takes nodes and relationships")
        entry = rows.scope[e[1]]
        ids = keep(rows.df.where(F.col(entry.ident).isNotNull()).select(F.col(entry.ident).alias("_id")).distinct(), "delete")
        if entry.kind == "rel":
            for t, table in list(graph.edges.items()):
                graph.edges[t] = EdgeTable(table.df.join(ids, table.df[EID] == ids["_id"], "left_anti"), table.sources, table.targets)
            continue
        for t, table in list(graph.edges.items()):
            touching = (table.df[SRC] == ids["_id"]) | (table.df[DST] == ids["_id"])
            if clause.detach:
                left = table.df.join(ids, table.df[SRC] == ids["_id"], "left_anti")
                graph.edges[t] = EdgeTable(left.join(ids, left[DST] == ids["_id"], "left_anti"), table.sources, table.targets)
            else:
                ends = table.df.select(F.explode(F.array(SRC, DST)).alias("_end"))
                if ends.join(ids, F.col("_end") == ids["_id"], "left_semi").limit(1).count():
                    raise ConstraintError("the vertex still has relationships; use DETACH DELETE")
            del touching
        for label, df in list(graph.nodes.items()):
            if not entry.label_names or label in entry.label_names:
                graph.nodes[label] = df.join(ids, df[VID] == ids["_id"], "left_anti")
    return rows


__all__ = ["apply_write", "conjuncts"]
