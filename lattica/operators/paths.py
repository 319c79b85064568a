"""Variable-length patterns, quantified groups and shortest paths as iterated joins.

Levels of a small bound stay one lazy plan; beyond that each level is written to the shared folder, so plans stay short. Where only
the endpoints count, visited pairs are dropped level by level, and no path is enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..cypher import ast as A
from ..cypher.scope import Entry, State, fresh
from ..errors import CompileError, IterationLimit
from ..storage import keep

LAZY_LEVELS = 3
#: Written levels that are read one by one before they are written as one table.
LEVELS_APART = 16
#: Rows that one generator repeats at a time.
REPEATED = 4096
NODE_T = "struct<_vid:bigint,_labels:array<string>,_props:map<string,string>>"
REL_T = "struct<_eid:bigint,_src:bigint,_dst:bigint,_type:string>"


def _node(vid: Column, labels: Column | None = None, props: Column | None = None) -> Column:
    return F.struct(vid.alias("_vid"), (labels if labels is not None else F.lit(None).cast("array<string>")).alias("_labels"), (props if props is not None else F.lit(None).cast("map<string,string>")).alias("_props"))


def hops(high: int | None, settings) -> Iterator[int]:
    """Levels from 1 to ``high``; without it they end with the caller, or are an error beyond a limit that is set."""
    if high is not None:
        yield from range(1, high + 1)
        return
    for level in count(1):
        if settings.max_hops is not None and level > settings.max_hops:
            raise IterationLimit(f"paths go on beyond {settings.max_hops} hops")
        yield level


def gather(parts: list[DataFrame], name: str) -> DataFrame:
    """The union of written levels; many of them become one table."""
    if len(parts) >= LEVELS_APART:
        parts[:] = [keep(reduce(DataFrame.unionAll, parts), name)]
    return reduce(DataFrame.unionAll, parts)


def variable_length(planner, state: State, node, rel, other, forward: bool, used: list, path, insensitive: bool, hints: dict):
    """Bind the far node (and lists of relationships and nodes) of ``-[*low..high]-``."""
    ctx = planner.ctx
    low, high = rel.low or 0, rel.high
    if high is not None and high < low:
        return planner.arrive(State(state.df.where(F.lit(False)).withColumn(c := fresh("n"), F.lit(None).cast("long")), state.scope), other, c, []), (None, None)
    start = state.scope[node.var]
    edges, entry, a, b, _ = planner.edge_frame(rel, forward, (), [])
    edges = planner.rel_filters(rel, entry, edges, {})
    wants_list = bool(planner.needs(rel.var)) or bool(path.var and planner.needs(path.var))
    full_nodes = bool(path.var and "*" in planner.needs(path.var))
    if insensitive and not wants_list and low <= 1 and not used:
        return reach(planner, state, start.ident, edges, a, b, other, low, high), (None, None)
    written = high is None or high > LAZY_LEVELS
    cur, eids, rels, inner = fresh("n"), fresh("eids"), fresh("rels"), fresh("nodes")
    frame = state.df.withColumns({cur: F.col(start.ident), eids: F.array().cast("array<bigint>"), rels: F.array().cast(f"array<{REL_T}>"), inner: F.array().cast(f"array<{NODE_T}>")})
    base_columns = state.df.columns
    step_edges = edges.select(a, F.col(b).alias("_next"), F.col(entry.ident).alias("_id"), planner.rel_struct(entry).alias("_rel"))
    if full_nodes and (path.var or wants_list):
        nodes, e = planner.node_frame([])
        step_edges = step_edges.join(nodes.select(F.col(e.ident).alias("_nid"), planner.node_struct(e).alias("_node")), F.col("_next") == F.col("_nid")).drop("_nid")
    else:
        step_edges = step_edges.withColumn("_node", _node(F.col("_next")))
    step_edges = keep(step_edges, "edges") if written else step_edges
    levels = [frame] if low == 0 else []
    earlier = [(kind, c) for kind, c, types in used if not (types and rel.types and not types & set(rel.types))]
    sources = None
    for level in hops(high, ctx.settings):
        if path.mode == "walk" and high is None and level > 2 * LEVELS_APART:
            sources = sources or step_edges.select(a).distinct().count()
            if level - 1 > sources:  # it left some vertex twice
                raise IterationLimit("walks without an upper bound don't end on a cycle")
        nxt = frame.join(step_edges, F.col(cur) == F.col(a))
        if path.mode != "walk":
            nxt = nxt.where(~F.array_contains(eids, F.col("_id")))
        if path.mode in ("acyclic", "simple"):
            nxt = nxt.where(~F.exists(inner, lambda x: x["_vid"] == F.col("_next")) & (F.col("_next") != F.col(start.ident)))
        for kind, c in earlier:
            nxt = nxt.where(F.col(c) != F.col("_id") if kind == "one" else ~F.array_contains(c, F.col("_id")))
        frame = nxt.select(*base_columns, F.col("_next").alias(cur), F.array_append(eids, F.col("_id")).alias(eids), F.array_append(rels, F.col("_rel")).alias(rels), F.array_append(inner, F.col("_node")).alias(inner))
        if written:
            frame = keep(frame, "hops")
            if level > 1 and frame.isEmpty():
                break
        if level >= low:
            levels.append(frame)
    df = reduce(DataFrame.unionByName, levels) if levels else frame.limit(0)
    if not forward:  # the pattern was walked from its right end
        df = df.withColumns({rels: F.reverse(rels), inner: F.when(F.size(inner) > 0, F.concat(F.reverse(F.slice(inner, F.lit(1), F.greatest(F.size(inner) - 1, F.lit(0)))), F.array(_node(F.col(start.ident))))).otherwise(F.col(inner))})
    used.append(("many", eids, set(rel.types)))
    scope = {**state.scope}
    if rel.var and not rel.var.startswith("__r"):
        scope[rel.var] = Entry("value", rels)
    return planner.arrive(State(df, scope), other, cur, []), (inner, rels)


def reach(planner, state: State, start: str, edges: DataFrame, a: str, b: str, other, low: int, high: int | None) -> State:
    """Endpoints by breadth-first search; each (start, end) pair once."""
    pairs = keep(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct(), "edges")
    starts = state.df.select(F.col(start).alias("_s")).distinct()
    frontier = keep(starts.select("_s", F.col("_s").alias("_c"), F.lit(0).alias("_k")), "reach")
    parts = [frontier]
    for level in hops(high, planner.ctx.settings):
        nxt = frontier.join(pairs, F.col("_c") == F.col("_a")).select("_s", F.col("_b").alias("_c"), F.lit(level).alias("_k")).distinct()
        frontier = keep(nxt.join(gather(parts, "reach"), ["_s", "_c"], "left_anti"), "reach")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    seen = gather(parts, "reach")
    if low == 1:  # a start is an end only where an edge leads back to it
        back = seen if high is None else seen.where(F.col("_k") < high)
        loops = back.join(pairs, (F.col("_c") == F.col("_a")) & (F.col("_s") == F.col("_b"))).select("_s", F.col("_s").alias("_c")).distinct()
        ends = seen.where("_k > 0").select("_s", "_c").unionAll(loops)
    else:
        ends = seen.select("_s", "_c")
    c, k = fresh("n"), fresh("k")
    df = state.df.join(ends.select(F.col("_s").alias(k), F.col("_c").alias(c)), F.col(start) == F.col(k)).drop(k)
    return planner.arrive(State(df, state.scope), other, c, [])


def quantified(planner, path, elements, state: State, used: list, hints: dict) -> State:
    """A path with quantified groups; group variables become lists."""
    position = 0
    nodes_before = None
    lists: dict[str, str] = {}
    while position < len(elements):
        x = elements[position]
        if isinstance(x, A.NodePat):
            if nodes_before is None:
                state = planner.narrow(x, state) if x.var in state.scope else planner.scan(x, state, hints)
            nodes_before = x
            position += 1
            continue
        if isinstance(x, A.RelPat):
            other = elements[position + 1]
            state, _ = planner.expand(state, nodes_before, x, other, True, used, path, False, hints)
            nodes_before = other
            position += 2
            continue
        inner = [_hidden(y) for y in x.elements]
        if nodes_before is None:
            head = A.NodePat(fresh("_n"), inner[0].labels if x.low > 0 else [])
            state = planner.scan(head, state, hints)
            nodes_before = head
        after = elements[position + 1] if position + 1 < len(elements) and isinstance(elements[position + 1], A.NodePat) else A.NodePat(fresh("_n"))
        state = _group(planner, state, nodes_before, x, inner, after, used, lists)
        nodes_before = after
        position += 2 if position + 1 < len(elements) and elements[position + 1] is after else 1
    if path.var:
        raise CompileError("a path with quantified groups can't be bound to a name; use its group variables")
    return state


def _hidden(y):
    if isinstance(y, A.GroupPat):
        raise CompileError("quantified groups can't be nested")
    return y


def _group(planner, state: State, before, group, inner, after, used, lists) -> State:
    ctx = planner.ctx
    written = group.high is None or group.high > LAZY_LEVELS
    cur, eids = fresh("n"), fresh("eids")
    named = {y.var: fresh("g") for y in inner if y.var}
    start = state.scope[before.var]
    base = state.df.columns
    types = {y.var: (NODE_T if isinstance(y, A.NodePat) else REL_T) for y in inner if y.var}
    frame = state.df.withColumns({cur: F.col(start.ident), eids: F.array().cast("array<bigint>"), **{c: F.array().cast(f"array<{types[v]}>") for v, c in named.items()}})
    levels = [frame] if group.low == 0 else []
    for v in [y.var for y in inner if y.var]:
        planner.ctx.needs.setdefault(v, set()).add("*")
    for level in hops(group.high, ctx.settings):
        scope = {"_at": Entry("node", cur)}
        sub = [A.NodePat("_at" if i == 0 else (y.var or fresh("_n")), y.labels, y.props, y.where) if isinstance(y, A.NodePat) else A.RelPat(y.var or fresh("_r"), y.types, y.direction, y.low, y.high, y.variable, y.props, y.where) for i, y in enumerate(inner)]
        st = State(frame, scope)
        if inner[0].labels or inner[0].props or inner[0].where or inner[0].var:
            st = planner.hydrate("_at", st)
            st = planner.narrow(sub[0], st)
        mine = [*used, ("many", eids, set())]
        for i in range(1, len(sub), 2):
            st, _ = planner.expand(st, sub[i - 1], sub[i], sub[i + 1], True, mine, A.PathPat(None, []), False, {})
        if group.where is not None:
            names = {inner[0].var: st.scope["_at"]} if inner[0].var else {}
            st = planner.filter(State(st.df, {**st.scope, **names}), group.where)
        grown = {}
        for i, y in enumerate(inner):
            if y.var:
                e = st.scope[sub[i].var]
                grown[named[y.var]] = F.array_append(named[y.var], planner.node_struct(e) if isinstance(y, A.NodePat) else planner.rel_struct(e))
        new_ids = [F.col(st.scope[sub[i].var].ident) for i in range(1, len(sub), 2)]
        frame = st.df.select(*base, F.col(st.scope[sub[-1].var].ident).alias(cur), F.concat(F.col(eids), F.array(*new_ids)).alias(eids), *[grown[c].alias(c) for c in named.values()])
        if written:
            frame = keep(frame, "groups")
            if frame.isEmpty():
                break
        if level >= group.low:
            levels.append(frame)
    df = reduce(DataFrame.unionByName, levels) if levels else frame.limit(0)
    used.append(("many", eids, set()))
    scope = {**state.scope, **{v: Entry("value", c) for v, c in named.items()}}
    return planner.arrive(State(df, scope), after, cur, [])


def shortest(planner, path, elements, state: State, hints: dict) -> State:
    """shortestPath, allShortestPaths and SHORTEST k between every pair of bound endpoints."""
    if len(elements) != 3:
        raise CompileError("a shortest path has two endpoints and one relationship pattern")
    left, rel, right = elements
    for n in (left, right):
        state = planner.narrow(n, state) if n.var in state.scope else planner.scan(n, state, hints)
    if path.selector == "k":
        return _k_shortest(planner, path, left, rel, right, state)
    low = rel.low if rel.variable else 1
    high = rel.high if rel.variable else 1
    s, t = state.scope[left.var].ident, state.scope[right.var].ident
    edges, entry, a, b, _ = planner.edge_frame(rel, True, (), [])
    edges = planner.rel_filters(rel, entry, edges, {})
    pairs = keep(state.df.select(F.col(s).alias("_s"), F.col(t).alias("_t")).distinct().where("_s is not null and _t is not null"), "pairs")
    if not _contents(planner, path, rel):
        return _counted(planner, path, state, s, t, pairs, edges.select(F.col(a).alias("_a"), F.col(b).alias("_b")), low, high)
    steps = keep(edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"), F.col(entry.ident).alias("_id"), planner.rel_struct(entry).alias("_rel")), "edges")
    rel_list, node_list = F.array().cast(f"array<{REL_T}>"), F.array().cast(f"array<{NODE_T}>")
    frontier = pairs.select("_s").distinct().select("_s", F.col("_s").alias("_c"), rel_list.alias("_rels"), node_list.alias("_nodes"))
    parts = [frontier.select("_s", "_c")]
    found = [frontier.where("_s = _c").join(pairs.where("_s = _t").select("_s"), "_s", "left_semi").select("_s", "_c", "_rels", "_nodes")] if low == 0 else []
    open_pairs = pairs.where("_s <> _t")
    for _ in hops(high, planner.ctx.settings):
        nxt = frontier.join(steps, F.col("_c") == F.col("_a")).select("_s", F.col("_b").alias("_c"), F.array_append("_rels", F.col("_rel")).alias("_rels"), F.array_append("_nodes", _node(F.col("_b"))).alias("_nodes"))
        nxt = nxt.join(gather(parts, "seen"), ["_s", "_c"], "left_anti")
        if path.selector == "shortest":  # of paths of equal length the least by relationship ids
            nxt = nxt.groupBy("_s", "_c").agg(F.min_by(F.struct("_rels", "_nodes"), F.transform("_rels", lambda r: r["_eid"])).alias("p")).select("_s", "_c", "p._rels", "p._nodes")
        frontier = keep(nxt, "bfs")
        if frontier.isEmpty():
            break
        parts.append(frontier.select("_s", "_c").distinct())
        found.append(frontier.join(open_pairs.select("_s", F.col("_t").alias("_c")), ["_s", "_c"], "left_semi").select("_s", "_c", "_rels", "_nodes"))
        open_pairs = keep(open_pairs.join(frontier.select("_s", F.col("_c").alias("_t")), ["_s", "_t"], "left_anti"), "open")
        if open_pairs.isEmpty():
            break
    ends = reduce(DataFrame.unionByName, found) if found else frontier.limit(0).select("_s", "_c", "_rels", "_nodes")
    c = fresh("path")
    ks, kt = fresh("k"), fresh("k")
    paths = ends.select(F.col("_s").alias(ks), F.col("_c").alias(kt), F.struct(F.concat(F.array(_node(F.col("_s"))), F.col("_nodes")).alias("nodes"), F.col("_rels").alias("relationships")).alias(c))
    df = state.df.join(paths, (F.col(s) == F.col(ks)) & (F.col(t) == F.col(kt))).drop(ks, kt)
    scope = {**state.scope}
    if path.var:
        scope[path.var] = Entry("value", c)
    if rel.var and not rel.var.startswith("__r"):
        scope[rel.var] = Entry("value", r := fresh("rels"))
        df = df.withColumn(r, F.col(c)["relationships"])
    return State(df, scope)


def _contents(planner, path, rel) -> bool:
    """Whether a query reads more of a shortest path than its length and how many there are; a path of an expression, of which no use is known, counts as read."""
    needs = planner.ctx.needs
    named = rel.var and not rel.var.startswith("__r")
    return bool(named or path.var and (path.var not in needs or any(needs.get(k) for k in (path.var, ("same", path.var), "*", ("same", "*")))))


def _counted(planner, path, state: State, s: str, t: str, pairs: DataFrame, edges: DataFrame, low: int, high: int | None) -> State:
    """Shortest paths of which only the lengths and numbers are read: a level holds each vertex once, with the number of its paths.

    A row is repeated for each of its paths after the last join, so what is moved and written doesn't grow with the number of paths.
    """
    one = path.selector == "shortest"
    steps = keep(edges.distinct().withColumn("_m", F.lit(1).cast("long")) if one else edges.groupBy("_a", "_b").agg(F.count("*").alias("_m")), "edges")
    frontier = keep(pairs.select("_s").distinct().select("_s", F.col("_s").alias("_c"), F.lit(1).cast("long").alias("_n"), F.lit(0).alias("_k")), "bfs")
    parts = [frontier]
    left = pairs.where("_s <> _t").count()
    for level in hops(high, planner.ctx.settings):
        if not left:
            break
        nxt = frontier.join(steps, F.col("_c") == F.col("_a")).groupBy("_s", F.col("_b").alias("_c")).agg((F.max("_m") if one else F.sum(F.col("_n") * F.col("_m"))).alias("_n"))
        frontier = keep(nxt.join(gather(parts, "bfs").select("_s", "_c"), ["_s", "_c"], "left_anti").select("_s", "_c", "_n", F.lit(level).alias("_k")), "bfs")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        left -= frontier.join(pairs.select("_s", F.col("_t").alias("_c")), ["_s", "_c"], "left_semi").count()
    ends = gather(parts, "bfs").where("_k > 0" if low else "true")
    c, n, k = fresh("path"), fresh("n"), fresh("k")
    ks, kt = fresh("k"), fresh("k")
    df = state.df.join(ends.select(F.col("_s").alias(ks), F.col("_c").alias(kt), F.col("_n").alias(n), F.col("_k").alias(k)), (F.col(s) == F.col(ks)) & (F.col(t) == F.col(kt))).drop(ks, kt)
    if not one:
        block, each = fresh("b"), fresh("i")
        df = df.withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {REPEATED}"))))
        df = df.withColumn(each, F.explode(F.array_repeat(F.lit(0), F.least(F.lit(REPEATED), F.col(n) - F.col(block) * REPEATED).cast("int")))).drop(block, each)
    if path.var:
        df = df.withColumn(c, F.struct(F.array().cast(f"array<{NODE_T}>").alias("nodes"), F.array_repeat(F.lit(None).cast(REL_T), F.col(k)).alias("relationships")))
    return State(df.drop(n, k), {**state.scope, **({path.var: Entry("value", c)} if path.var else {})})


def _k_shortest(planner, path, left, rel, right, state: State) -> State:
    """The k shortest trails of each pair, by length and then relationship ids."""
    hop = A.RelPat(rel.var, rel.types, rel.direction, rel.low if rel.variable else 1, (rel.high if rel.variable else 1) or 8, True, rel.props, rel.where)
    inner = A.PathPat(path.var or fresh("p"), [left, hop, right], None)
    planner.ctx.needs.setdefault(inner.var, set()).add("length")
    out, (_, rels) = variable_length(planner, state, left, hop, right, True, [], inner, False, {})
    s, t = out.scope[left.var].ident, out.scope[right.var].ident
    n = fresh("r")
    w = Window.partitionBy(s, t).orderBy(F.size(rels), F.transform(rels, lambda r: r["_eid"]))
    df = out.df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= path.k).drop(n)
    c = fresh("path")
    df = df.withColumn(c, F.struct(F.concat(F.array(_node(F.col(s))), F.transform(rels, lambda r: _node(r["_dst"]))).alias("nodes"), F.col(rels).alias("relationships")))
    return State(df, {**out.scope, **({path.var: Entry("value", c)} if path.var else {})})
