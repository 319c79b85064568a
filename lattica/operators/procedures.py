"""Procedures of ``CALL``: name -> function(context, arguments) that gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DST, EID, SRC, VID
from ..errors import CompileError
from . import graphs as G
from . import search as S
from . import sequential as Q

PROCEDURES: dict[str, Callable] = {}


def procedure(*names: str):
    def wrap(f):
        for name in names:
            PROCEDURES[name.lower()] = f
        return f

    return wrap


def arg(args: list, i: int, default=None):
    return args[i] if len(args) > i and args[i] is not None else default


def _project(ctx, args, weight: str | None = None) -> G.Projection:
    return G.project(ctx.graph, arg(args, 0), arg(args, 1), weight)


def _rows(ctx, rows: list[tuple], schema: str) -> DataFrame:
    return ctx.spark.createDataFrame(rows, schema)


# --- distributed ------------------------------------------------------------------------------------------------
@procedure("uni.algo.degreeCentrality")
def degree_centrality(ctx, args):
    return G.degrees(_project(ctx, args), arg(args, 2, "OUTGOING")).select(F.col("id").alias("nodeId"), F.col("degree").cast("double").alias("score"))


@procedure("uni.algo.pageRank", "uni.algo.pagerank", "uni.algo.gcpagerank")
def page_rank(ctx, args):
    return G.pagerank(_project(ctx, args), arg(args, 2, 0.85), arg(args, 3, 20), arg(args, 4, 1e-6)).select(F.col("id").alias("nodeId"), "score")


@procedure("uni.algo.wcc")
def wcc(ctx, args):
    found = G.wcc(_project(ctx, args))
    least = arg(args, 2, 1)
    if least > 1:
        big = found.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
        found = found.join(big, "component", "left_semi")
    return found.select(F.col("id").alias("nodeId"), F.col("component").alias("componentId"))


@procedure("uni.algo.scc")
def scc(ctx, args):
    found = G.strong_components(_project(ctx, args))
    return found.select(F.col("id").alias("nodeId"), F.col("component").alias("componentId"))


@procedure("uni.algo.triangleCount")
def triangle_count(ctx, args):
    return G.triangles(_project(ctx, args)).select(F.col("id").alias("nodeId"), F.col("triangles").alias("triangleCount"))


@procedure("uni.algo.maximalCliques")
def maximal_cliques(ctx, args):
    return G.cliques(_project(ctx, args), arg(args, 2, 2))


@procedure("uni.algo.kCore")
def k_core(ctx, args):
    out = G.core_numbers(_project(ctx, args)).select(F.col("id").alias("nodeId"), F.col("core").alias("coreNumber"))
    k = arg(args, 2)
    return out if k is None else out.where(F.col("coreNumber") >= k)


@procedure("uni.algo.labelPropagation")
def label_propagation(ctx, args):
    return G.label_propagation(_project(ctx, args), arg(args, 2, 10)).select(F.col("id").alias("nodeId"), F.col("community").alias("communityId"))


@procedure("uni.algo.closeness")
def closeness(ctx, args):
    p = _project(ctx, args)
    n = p.ids.count()
    sums = G.all_distances(p, False).groupBy("s").agg(F.sum("d").alias("total"), F.count("*").alias("r"))
    score = F.col("r") * F.col("r") / ((n - 1) * F.col("total")) if arg(args, 2, False) else (n - 1) / F.col("total")
    return p.ids.join(sums, F.col("id") == F.col("s"), "left").select(F.col("id").alias("nodeId"), F.coalesce(score.cast("double"), F.lit(0.0)).alias("score"))


@procedure("uni.algo.harmonicCentrality")
def harmonic(ctx, args):
    p = _project(ctx, args)
    sums = G.all_distances(p, False).groupBy("s").agg(F.sum(1 / F.col("d")).alias("total"))
    return p.ids.join(sums, F.col("id") == F.col("s"), "left").select(F.col("id").alias("nodeId"), F.coalesce("total", F.lit(0.0)).alias("centrality"))


@procedure("uni.algo.eigenvectorCentrality")
def eigenvector(ctx, args):
    p = _project(ctx, args, arg(args, 4))
    n = p.ids.count()
    return G.power(p, 1 / max(n, 1) ** 0.5, arg(args, 2, 100), arg(args, 3, 1e-6), lambda got: got, True).select(F.col("id").alias("nodeId"), "score")


@procedure("uni.algo.katzCentrality")
def katz(ctx, args):
    alpha, beta = arg(args, 2, 0.1), arg(args, 3, 1.0)
    p = _project(ctx, args, arg(args, 6))
    return G.power(p, beta, arg(args, 4, 100), arg(args, 5, 1e-6), lambda got: F.lit(beta) + alpha * got, False).select(F.col("id").alias("nodeId"), "score")


@procedure("uni.algo.nodeSimilarity", "uni.algo.gcoverlap")
def node_similarity(ctx, args):
    return G.similar_vertices(_project(ctx, args), arg(args, 2, "JACCARD"), arg(args, 3, 0.1), arg(args, 4, 10))


@procedure("uni.algo.bellmanFord")
def bellman_ford(ctx, args):
    p = _project(ctx, args, arg(args, 3))
    start = ctx.spark.createDataFrame([(args[2], args[2], 0.0)], "s long, node long, d double")
    n = p.ids.count()
    return G.relax(start, G.keep(G.weighted(p.edges), "edges"), n + 1).select(F.col("node").alias("nodeId"), F.col("d").alias("distance"))


@procedure("uni.algo.sssp")
def sssp(ctx, args):
    p = _project(ctx, args, arg(args, 3))
    start = args[2]
    initial = F.when(F.col("id") == start, F.lit(0.0))
    out = G.pregel(p, initial, F.col("v") + F.col("w"), F.min, lambda v, m: F.least(v, m), arg(args, 4, 1000))
    return out.where("v is not null").select(F.col("id").alias("nodeId"), F.col("v").alias("distance"))


@procedure("uni.algo.dijkstra")
def dijkstra(ctx, args):
    p = _project(ctx, args, arg(args, 4))
    end, most = arg(args, 3), arg(args, 5)
    if end is not None:
        _, edges = p.local("a path")
        hit = Q.dijkstra(edges, args[2], end).get(end)
        ok = hit is not None and (most is None or hit[0] <= most)
        return _rows(ctx, [(end, hit[0], hit[1])] if ok else [], "nodeId long, distance double, path array<long>")
    start = ctx.spark.createDataFrame([(args[2], args[2], 0.0)], "s long, node long, d double")
    out = G.relax(start, G.keep(G.weighted(p.edges), "edges"), limit=most)
    return out.select(F.col("node").alias("nodeId"), F.col("d").alias("distance"), F.array().cast("array<long>").alias("path"))


@procedure("uni.algo.bidirectionalDijkstra")
def bidirectional(ctx, args):
    p = _project(ctx, args, arg(args, 4))
    start = ctx.spark.createDataFrame([(args[2], args[2], 0.0)], "s long, node long, d double")
    return G.relax(start, G.keep(G.weighted(p.edges), "edges")).where(F.col("node") == args[3]).select(F.col("d").alias("distance"))


@procedure("uni.algo.allPairsShortestPath")
def all_pairs(ctx, args):
    p = _project(ctx, args, arg(args, 2))
    return G.all_distances(p, arg(args, 2) is not None).select(F.col("s").alias("sourceNodeId"), F.col("node").alias("targetNodeId"), F.col("d").alias("distance"))


def eccentricities(ctx, args) -> DataFrame:
    p = _project(ctx, args, arg(args, 2))
    far = G.all_distances(p, arg(args, 2) is not None).groupBy("s").agg(F.max("d").alias("e"))
    return G.keep(p.ids.join(far, F.col("id") == F.col("s"), "left").select("id", F.coalesce("e", F.lit(0.0)).alias("e")), "eccentricity")


@procedure("uni.algo.metrics")
def metrics(ctx, args):
    e = eccentricities(ctx, args)
    ends = e.agg(F.max("e").alias("diameter"), F.min("e").alias("radius"))
    members = lambda column, name: e.join(F.broadcast(ends), F.col("e") == F.col(column)).agg(F.array_sort(F.collect_list("id")).alias(name))
    return ends.crossJoin(members("radius", "center")).crossJoin(members("diameter", "periphery"))


@procedure("uni.algo.diameter")
def diameter(ctx, args):
    p = _project(ctx, args, arg(args, 2))
    far = G.all_distances(p, arg(args, 2) is not None).orderBy(F.col("d").desc(), "s", "node").limit(1).collect()
    if not far:
        return _rows(ctx, [(0.0, [])], "diameter double, path array<long>")
    _, edges = p.local("a path")
    return _rows(ctx, [(far[0].d, Q.dijkstra(edges, far[0].s, far[0].node)[far[0].node][1])], "diameter double, path array<long>")


@procedure("uni.algo.topoSort")
def topo_sort(ctx, args):
    from pyspark.sql import Window

    layers, left = G.peel(_project(ctx, args))
    if not left.isEmpty():
        raise CompileError("the graph has a cycle")
    # layers are small against all rows, so numbers go by counts of layers and places inside them
    sizes = layers.groupBy("level").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("level", "before")
    w = Window.partitionBy("level").orderBy("id")
    return layers.withColumn("r", F.row_number().over(w) - 1).join(before, "level").select(F.col("id").alias("nodeId"), (F.col("before") + F.col("r")).cast("long").alias("order"))


@procedure("uni.algo.hasCycle")
def has_cycle(ctx, args):
    p = _project(ctx, args)
    _, left = G.peel(p)
    if left.isEmpty():
        return _rows(ctx, [(False, [])], "hasCycle boolean, cycleNodes array<long>")
    core = G.Projection(left, p.edges.join(left.select(F.col("id").alias("a")), F.col("src") == F.col("a"), "left_semi").join(left.select(F.col("id").alias("b")), F.col("dst") == F.col("b"), "left_semi"))
    return _rows(ctx, [(True, Q.find_cycle(*core.local("a cycle")))], "hasCycle boolean, cycleNodes array<long>")


@procedure("uni.algo.isBipartite")
def is_bipartite(ctx, args):
    """Components get their least vertex as root; parities by breadth-first levels from the roots."""
    p = _project(ctx, args)
    both = G.Projection(p.ids, p.edges.select("src", "dst", "w", "eid").unionAll(p.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", "eid")))
    roots = G.wcc(p).select(F.col("component").alias("s")).distinct()
    parity = G.keep(G.hops(both, roots).select("node", (F.col("d") % 2).alias("side")), "parity")
    bad = p.edges.join(parity.select(F.col("node").alias("a"), F.col("side").alias("sa")), F.col("src") == F.col("a")).join(parity.select(F.col("node").alias("b"), F.col("side").alias("sb")), F.col("dst") == F.col("b")).where("sa = sb").limit(1).count()
    if bad:
        return _rows(ctx, [(False, None)], "isBipartite boolean, partition map<long,long>")
    return parity.agg(F.lit(True).alias("isBipartite"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("node", "side")))).alias("partition"))


@procedure("uni.algo.reachability")
def reachability(ctx, args):
    spec = arg(args, 1, {}) or {}
    p = G.project(ctx.graph, spec.get("nodeLabels"), spec.get("edgeTypes"))
    start = ctx.spark.createDataFrame([(args[0],)], "s long")
    return G.hops(p, start, bool(spec.get("reverse"))).select(F.col("node").alias("nodeId"), F.col("d").alias("distance"))


@procedure("uni.path.expand")
def path_expand(ctx, args):
    spec = arg(args, 1, {}) or {}
    p = G.project(ctx.graph, spec.get("nodeLabels"), spec.get("edgeTypes"))
    way = str(spec.get("direction", "OUTGOING")).upper()
    start = ctx.spark.createDataFrame([(args[0],)], "s long")
    if way == "BOTH":
        p = G.Projection(p.ids, p.edges.select("src", "dst").unionAll(p.edges.select("dst", "src")))
    out = G.hops(p, start, way == "INCOMING", spec.get("maxLevel"))
    return out.where(F.col("d") >= spec.get("minLevel", 1)).select(F.col("node").alias("nodeId"), F.col("d").alias("level"))


@procedure("uni.algo.shortestPath")
def shortest_path(ctx, args):
    """Breadth-first levels from the source, then back from the target along the least predecessors."""
    source, target, types = args[0], args[1], arg(args, 2)
    edges = G.keep(ctx.graph.scan_edges([types] if isinstance(types, str) else types or []).select(F.col(SRC).alias("src"), F.col(DST).alias("dst"), F.col(EID).alias("eid")), "edges")
    p = G.Projection(ctx.spark.createDataFrame([], "id long"), edges)
    levels = G.hops(p, ctx.spark.createDataFrame([(source,)], "s long"))
    hit = levels.where(F.col("node") == target).first()
    if hit is None:
        return _rows(ctx, [], "nodeIds array<long>, edgeIds array<long>, length long")
    nodes, ids, at = [target], [], target
    for d in range(hit.d - 1, -1, -1):
        step = edges.where(F.col("dst") == at).join(levels.where(F.col("d") == d), F.col("src") == F.col("node"), "left_semi").orderBy("src", "eid").first()
        at = step.src
        nodes.insert(0, at)
        ids.insert(0, step.eid)
    return _rows(ctx, [(nodes, ids, len(ids))], "nodeIds array<long>, edgeIds array<long>, length long")


# --- sequential, over a projection of checked size --------------------------------------------------------------
@procedure("uni.algo.articulationPoints")
def articulation_points(ctx, args):
    points, _ = Q.low_links(*_project(ctx, args).local("articulationPoints"))
    return _rows(ctx, [(v,) for v in sorted(points)], "node long")


@procedure("uni.algo.bridges")
def bridges(ctx, args):
    _, found = Q.low_links(*_project(ctx, args).local("bridges"))
    return _rows(ctx, sorted(found), "source long, target long")


@procedure("uni.algo.betweenness")
def betweenness(ctx, args):
    """Sources are dealt over tasks; every task has the edges, which are of checked size."""
    p = _project(ctx, args)
    ids, edges = p.local("betweenness")
    normalise, sample = arg(args, 2, True), arg(args, 3)
    sources = ids if sample is None or sample >= len(ids) else ids[:: max(1, len(ids) // sample)][:sample]
    shared = ctx.spark.sparkContext.broadcast((ids, edges))

    def run(batches):
        import pandas as pd

        own = [int(v) for b in batches for v in b["s"]]
        ids, edges = shared.value
        if own:
            found = {v: x for v, x in Q.betweenness(ids, edges, False, own).items() if x}
            scale = len(own) / len(ids) if len(own) < len(ids) else 1.0  # undo the scaling of one task's part
            yield pd.DataFrame({"id": list(found), "score": [x * scale for x in found.values()]})

    starts = ctx.spark.createDataFrame([(v,) for v in sources], "s long").repartition(max(1, min(len(sources), 4 * ctx.spark.sparkContext.defaultParallelism)))
    sums = starts.mapInPandas(run, "id long, score double").groupBy("id").agg(F.sum("score").alias("total"))
    n = len(ids)
    scale = (n / len(sources) if sources else 1.0) / ((n - 1) * (n - 2) if normalise and n > 2 else 1.0)
    return p.ids.join(sums, "id", "left").select(F.col("id").alias("nodeId"), (F.coalesce("total", F.lit(0.0)) * scale).alias("score"))


@procedure("uni.algo.graphColoring")
def graph_coloring(ctx, args):
    return _rows(ctx, sorted(Q.colouring(*_project(ctx, args).local("graphColoring")).items()), "nodeId long, color long")


@procedure("uni.algo.louvain")
def louvain(ctx, args):
    found = Q.louvain(*_project(ctx, args).local("louvain"), arg(args, 2, 1.0), arg(args, 3, 10), arg(args, 4, 1e-4))
    return _rows(ctx, sorted(found.items()), "nodeId long, communityId long")


@procedure("uni.algo.maxFlow")
def max_flow(ctx, args):
    total, flows = Q.max_flow(*_project(ctx, args, arg(args, 4)).local("maxFlow"), args[2], args[3])
    edges = [{"source": a, "target": b, "flow": float(f)} for a, b, f in flows]
    return _rows(ctx, [(float(total), edges)], "maxFlow double, flowEdges array<struct<source:long,target:long,flow:double>>")


@procedure("uni.algo.fordFulkerson")
def ford_fulkerson(ctx, args):
    return max_flow(ctx, args).select("maxFlow")


@procedure("uni.algo.maxMatching")
def max_matching(ctx, args):
    try:
        pairs = Q.matching(*_project(ctx, args).local("maxMatching"))
    except ValueError as e:
        raise CompileError(str(e)) from e
    return _rows(ctx, [(a, b, 0) for a, b in pairs], "node1 long, node2 long, matchId long")


@procedure("uni.algo.mst")
def mst(ctx, args):
    return G.spanning_forest(_project(ctx, args, arg(args, 2)))


@procedure("uni.algo.kShortestPaths")
def k_shortest_paths(ctx, args):
    _, edges = _project(ctx, args, arg(args, 5)).local("kShortestPaths")
    found = Q.k_shortest(edges, args[2], args[3], arg(args, 4, 3))
    return _rows(ctx, [(p, float(c), i + 1) for i, (p, c) in enumerate(found)], "path array<long>, cost double, rank long")


@procedure("uni.algo.astar")
def astar(ctx, args):
    """Shortest path guided by a property of the vertices that estimates what is left."""
    types = arg(args, 2)
    weight = "weight" if "weight" in ctx.graph.scan_edges([types] if isinstance(types, str) else types or []).columns else None
    p = G.project(ctx.graph, None, types, weight)
    _, edges = p.local("astar")
    prop = arg(args, 3)
    nodes = ctx.graph.scan_nodes([])
    guess = {}
    if prop and prop in nodes.columns:  # of the vertices that have an edge, which are of checked size
        ends = p.edges.select(F.explode(F.array("src", "dst")).alias("_e")).distinct()
        guess = {r[0]: float(r[1] or 0) for r in nodes.select(VID, prop).join(ends, F.col(VID) == F.col("_e"), "left_semi").collect()}
    hit = Q.dijkstra(edges, args[0], args[1], guess=lambda v: guess.get(v, 0.0)).get(args[1])
    return _rows(ctx, [(hit[1], hit[0])] if hit else [], "path array<long>, cost double")


@procedure("uni.algo.allSimplePaths")
def all_simple_paths(ctx, args):
    _, edges = G.project(ctx.graph, arg(args, 4), arg(args, 2)).local("allSimplePaths")
    return _rows(ctx, [(p,) for p in Q.simple_paths(edges, args[0], args[1], arg(args, 3, 5))], "path array<long>")


@procedure("uni.algo.elementaryCircuits")
def elementary_circuits(ctx, args):
    return _rows(ctx, [(c,) for c in Q.circuits(*_project(ctx, args).local("elementaryCircuits"), arg(args, 2, 1000))], "cycle array<long>")


@procedure("uni.algo.randomWalk", "uni.algo.gcwalks")
def random_walk(ctx, args):
    """Walks by joins; those biased by a return or in-out factor are dealt over tasks that have the edges, which are of checked size."""
    p = _project(ctx, args)
    if arg(args, 5, 1.0) == 1 and arg(args, 6, 1.0) == 1:
        chosen = arg(args, 4)
        starts = p.ids if chosen is None else ctx.spark.createDataFrame([(v,) for v in chosen], "id long")
        return G.random_walks(p, arg(args, 2, 5), arg(args, 3, 1), starts, arg(args, 7, 0))
    ids, edges = p.local("randomWalk")
    length, per, starts, back, out, seed = arg(args, 2, 5), arg(args, 3, 1), arg(args, 4, ids), arg(args, 5, 1.0), arg(args, 6, 1.0), arg(args, 7, 0)
    shared = ctx.spark.sparkContext.broadcast(edges)

    def run(batches):
        import pandas as pd

        adj = Q.adjacency(shared.value)
        for b in batches:
            yield pd.DataFrame({"path": Q.walks(adj, [int(v) for v in b["s"]], length, per, back, out, seed)})

    return ctx.spark.createDataFrame([(v,) for v in starts], "s long").mapInPandas(run, "path array<long>")


# --- kernels ----------------------------------------------------------------------------------------------------
@procedure("uni.kernel.topk")
def kernel_topk(ctx, args):
    """Vertices of a label with the greatest values of a property."""
    df = ctx.graph.scan_nodes([[args[0]]])
    return df.orderBy(F.col(args[1]).desc_nulls_last(), VID).limit(args[2]).select(F.col(VID).alias("nodeId"), F.col(args[1]).cast("double").alias("value"))


@procedure("uni.kernel.spmv")
def kernel_spmv(ctx, args):
    """Sum over in-edges of weight times the source's property."""
    p = _project(ctx, args, arg(args, 2))
    x = ctx.graph.scan_nodes([]).select(F.col(VID).alias("id"), F.col(args[3]).cast("double").alias("x"))
    return x.join(p.edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("x") * F.coalesce("w", F.lit(1.0))).alias("value")).select(F.col("dst").alias("nodeId"), "value")


@procedure("uni.kernel.degrees")
def kernel_degrees(ctx, args):
    return G.degrees(_project(ctx, args), arg(args, 2, "OUTGOING")).select(F.col("id").alias("nodeId"), "degree")


# --- named projections, virtual entities, schema ----------------------------------------------------------------
@procedure("uni.graph.project")
def graph_project(ctx, args):
    spec = arg(args, 1, {}) or {}
    ctx.graph.projections[args[0]] = (spec.get("nodeLabels"), spec.get("edgeTypes"), spec.get("weightProperty"))
    return _rows(ctx, [(args[0],)], "name string")


@procedure("uni.graph.drop")
def graph_drop(ctx, args):
    return _rows(ctx, [(args[0], ctx.graph.projections.pop(args[0], None) is not None)], "name string, dropped boolean")


@procedure("uni.graph.list")
def graph_list(ctx, args):
    return _rows(ctx, [(n, spec[0] or [], spec[1] or []) for n, spec in sorted(ctx.graph.projections.items())], "name string, nodeLabels array<string>, edgeTypes array<string>")


@procedure("uni.graph.exists")
def graph_exists(ctx, args):
    return _rows(ctx, [(args[0] in ctx.graph.projections,)], "exists boolean")


@procedure("uni.create.vNode", "apoc.create.vNode")
def virtual_node(ctx, args):
    from pyspark.sql import Row

    labels = [args[0]] if isinstance(args[0], str) else args[0]
    props = arg(args, 1, {}) or {}
    return ctx.spark.createDataFrame([(Row(_vid=-1, _labels=labels, **props),)], ["node"])


@procedure("uni.create.vEdge", "apoc.create.vRelationship")
def virtual_edge(ctx, args):
    return _rows(ctx, [(-1, args[0], args[-1], args[1])], "id long, source long, target long, type string")


@procedure("uni.schema.labels", "db.labels")
def schema_labels(ctx, args):
    g = ctx.graph
    return _rows(ctx, [(n, len([c for c in d.columns if not c.startswith("_")]), len([i for i in g.indexes if i["label"] == n]), len([c for c in g.constraints if c["label"] == n])) for n, d in sorted(g.nodes.items())], "label string, propertyCount long, indexCount long, constraintCount long").withColumn("name", F.col("label"))


@procedure("uni.schema.edgeTypes", "uni.schema.relationshipTypes", "db.relationshipTypes")
def schema_edge_types(ctx, args):
    return _rows(ctx, [(n, n, list(e.sources), list(e.targets), len([c for c in e.df.columns if not c.startswith("_")])) for n, e in sorted(ctx.graph.edges.items())], "type string, relationshipType string, sourceLabels array<string>, targetLabels array<string>, propertyCount long")


@procedure("uni.schema.indexes")
def schema_indexes(ctx, args):
    return _rows(ctx, [(i["name"], i["label"], i["props"], i["index_kind"]) for i in ctx.graph.indexes], "name string, label string, properties array<string>, kind string")


@procedure("uni.schema.constraints")
def schema_constraints(ctx, args):
    return _rows(ctx, [(c["name"], c["label"], c.get("props", []), c["kind"]) for c in ctx.graph.constraints], "name string, label string, properties array<string>, kind string")


@procedure("uni.schema.labelInfo")
def schema_label_info(ctx, args):
    df = ctx.graph.resolve_label(args[0])
    if df is None:
        raise CompileError(f"no label {args[0]}")
    unique = {p for c in ctx.graph.constraints if c["label"] == args[0] and c["kind"] in ("unique", "key") for p in c.get("props", [])}
    indexed = {p for i in ctx.graph.indexes if i["label"] == args[0] for p in i["props"]}
    return _rows(ctx, [(f.name, f.dataType.simpleString(), f.nullable, f.name in indexed, f.name in unique) for f in df.schema if not f.name.startswith("_")], "property string, dataType string, nullable boolean, indexed boolean, unique boolean")


@procedure("uni.admin.verifyEdgeEndpoints")
def verify_endpoints(ctx, args):
    """Edges whose endpoints don't exist, or have other labels than their type declares."""
    g = ctx.graph
    parts = []
    for name, e in sorted(g.edges.items()):
        for column, labels in ((SRC, e.sources), (DST, e.targets)):
            ids = g.scan_nodes([list(labels)] if labels else []).select(F.col(VID).alias("_k"))
            parts.append(e.df.join(ids, F.col(column) == F.col("_k"), "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("edgeType"), F.lit("source" if column == SRC else "target").alias("endpoint"), "violations"))
    from functools import reduce

    return reduce(DataFrame.unionAll, parts) if parts else _rows(ctx, [], "edgeType string, endpoint string, violations long")


@procedure("uni.admin.compact", "uni.admin.compactionStatus")
def compact(ctx, args):
    return _rows(ctx, [("idle", 0)], "status string, pending long")


for _name, _f in S.PROCEDURES.items():
    PROCEDURES[_name.lower()] = _f
