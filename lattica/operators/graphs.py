"""Projections of a graph and the loops that distributed algorithms share.

A projection is two tables, ids and edges (src, dst, w). Loops write each round's table to the shared folder; a round is a
join on the edges and an aggregation with partial sums. Algorithms that are sequential by nature take a projection of a checked
size to one process (``local``), as embedded engines do.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import DST, EID, LABELS, SRC, VID, Graph
from ..errors import CompileError
from ..storage import keep
from . import sequential as Q

LOCAL_EDGES = 1_000_000


@dataclass
class Projection:
    ids: DataFrame  # id
    edges: DataFrame  # src, dst, w, eid

    def undirected(self) -> DataFrame:
        """Both directions of every edge that isn't a loop, each pair once."""
        e = self.edges.where("src <> dst").select("src", "dst")
        return e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()

    def local(self, what: str) -> tuple[list[int], list[tuple[int, int, float, int]]]:
        """Ids and edges in one process, if they are few."""
        n = self.edges.limit(LOCAL_EDGES + 1).count()
        if n > LOCAL_EDGES or self.ids.limit(LOCAL_EDGES + 1).count() > LOCAL_EDGES:
            raise CompileError(f"{what} is sequential and takes at most {LOCAL_EDGES} edges and vertices")
        ids = sorted(r.id for r in self.ids.collect())
        return ids, sorted((r.src, r.dst, 1.0 if r.w is None else float(r.w), r.eid) for r in self.edges.collect())


def project(graph: Graph, labels=None, types=None, weight: str | None = None) -> Projection:
    """Vertices of the labels and edges of the types between them; no labels or types mean all."""
    labels = [labels] if isinstance(labels, str) else list(labels or [])
    types = [types] if isinstance(types, str) else list(types or [])
    if len(labels) == 1 and labels[0] in graph.projections:
        labels, types, weight = graph.projections[labels[0]]
    ids = graph.scan_nodes([labels] if labels else []).select(F.col(VID).alias("id"))
    if len(labels) != 1:
        ids = ids.distinct()
    edges = graph.scan_edges(types)
    if weight and weight not in edges.columns:
        raise CompileError(f"edges have no property {weight}")
    edges = edges.select(F.col(SRC).alias("src"), F.col(DST).alias("dst"), (F.col(weight).cast("double") if weight else F.lit(None).cast("double")).alias("w"), F.col(EID).alias("eid"))
    multi = graph.multi_labelled()
    for end, column in ((SRC, "src"), (DST, "dst")):
        known = graph.endpoint_labels(types, end)
        if labels and (multi or known is None or not known <= set(labels)):
            edges = edges.join(ids.select(F.col("id").alias("_k")), F.col(column) == F.col("_k"), "left_semi")
    return Projection(ids, edges)


def relax(sources: DataFrame, edges: DataFrame, rounds: int = 10_000, limit: float | None = None) -> DataFrame:
    """Least distances (s, node, d) from the start rows (s, node, d), over edges (src, dst, w); only improved rows go on."""
    best = frontier = keep(sources.select("s", "node", "d"), "relax")
    for _ in range(rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("n2")).agg(F.min(F.col("d") + F.col("w")).alias("nd"))
        if limit is not None:
            step = step.where(F.col("nd") <= limit)
        joined = step.join(best.select(F.col("s").alias("bs"), "node", F.col("d").alias("bd")), (F.col("s") == F.col("bs")) & (F.col("n2") == F.col("node")), "left")
        frontier = keep(joined.where("bd is null or nd < bd").select("s", F.col("n2").alias("node"), F.col("nd").alias("d")), "frontier")
        if frontier.isEmpty():
            return best
        best = keep(best.unionAll(frontier).groupBy("s", "node").agg(F.min("d").alias("d")), "relax")
    raise CompileError("negative cycle")


def weighted(edges: DataFrame) -> DataFrame:
    """Edges with a weight, 1 where there is none; parallel edges keep the least."""
    return edges.groupBy("src", "dst").agg(F.min(F.coalesce("w", F.lit(1.0))).alias("w"))


def spread(values: DataFrame, edges: DataFrame, combine: Callable, message) -> DataFrame:
    """Messages along edges: (dst as id, combine(message)), message a column over the source's value ``v``, ``w`` and edge columns."""
    return values.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(combine(message).alias("m")).withColumnRenamed("dst", "id")


def degrees(p: Projection, direction: str = "OUTGOING") -> DataFrame:
    """(id, degree); 0 for vertices without edges."""
    way = direction.upper()
    if way not in ("OUTGOING", "INCOMING", "BOTH", "OUT", "IN"):
        raise CompileError(f"unknown direction {direction}")
    ends = p.edges.select(F.col("src").alias("e")) if way in ("OUTGOING", "OUT") else p.edges.select(F.col("dst").alias("e")) if way in ("INCOMING", "IN") else p.edges.select(F.explode(F.array("src", "dst")).alias("e"))
    return p.ids.join(ends.groupBy("e").agg(F.count("*").alias("n")), F.col("id") == F.col("e"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b): the least node of each component, by alternating stars."""
    edges = keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["n"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n")
        small = large.join(least, large["u"] == least["n"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        edges = keep(small, "links")
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def wcc(p: Projection) -> DataFrame:
    """(id, component): the least id of the weakly connected component."""
    found = components(p.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return p.ids.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("component"))


def pagerank(p: Projection, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(id, score): power iteration; the mass of vertices without out-edges is dealt to all; stops by the L1 change."""
    ids = keep(p.ids.join(p.edges.groupBy("src").agg(F.count("*").alias("out")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("out", F.lit(0)).alias("out")), "ranks")
    n = ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("score"))
    edges = keep(p.edges.groupBy("src", "dst").agg(F.count("*").alias("k")), "edges")
    ranks = ids.select("id", "out", F.lit(1.0 / n).alias("score"))
    dangling = ids.where("out = 0").count() / n
    for _ in range(rounds):
        base = (1 - damping) / n + damping * dangling / n
        moved = ranks.where("out > 0").join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("k") / F.col("out")).alias("got"))
        nxt = keep(ranks.join(moved, F.col("id") == F.col("dst"), "left").select("id", "out", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("score"), F.col("score").alias("old")), "ranks")
        change, dangling = nxt.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("score"))), F.lit(0.0))).first()
        ranks = nxt.drop("old")
        if change < tolerance:
            break
    return ranks.select("id", "score")


def power(p: Projection, start: float, rounds: int, tolerance: float, step: Callable, normalise: bool) -> DataFrame:
    """Iterate (id, score) <- step(sum over in-edges of w * score); optionally to unit length."""
    edges = keep(p.edges.groupBy("src", "dst").agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("w")), "edges")
    ids = keep(p.ids, "ids")
    scores = ids.select("id", F.lit(start).alias("score"))
    for _ in range(rounds):
        got = scores.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("score") * F.col("w")).alias("got"))
        nxt = scores.join(got, F.col("id") == F.col("dst"), "left").select("id", step(F.coalesce("got", F.lit(0.0))).alias("new"), F.col("score").alias("old"))
        nxt = keep(nxt, "scores")
        if normalise:
            norm = nxt.agg(F.sqrt(F.sum(F.col("new") * F.col("new")))).first()[0] or 0.0
            nxt = nxt.withColumn("new", F.col("new") / (norm if norm > 0 else 1.0))
        change = nxt.agg(F.sum(F.abs(F.col("new") - F.col("old")))).first()[0] or 0.0
        scores = nxt.select("id", F.col("new").alias("score"))
        if change < tolerance:
            break
    return scores


def triangles(p: Projection) -> DataFrame:
    """(id, triangles) by oriented wedges: edges point from lower to higher (degree, id), so hubs open few wedges."""
    und = keep(p.undirected(), "undirected")
    deg = und.groupBy("src").agg(F.count("*").alias("deg"))
    a = und.join(deg.select(F.col("src").alias("x"), F.col("deg").alias("dx")), F.col("src") == F.col("x")).join(deg.select(F.col("src").alias("y"), F.col("deg").alias("dy")), F.col("dst") == F.col("y"))
    oriented = keep(a.where("dx < dy or (dx = dy and src < dst)").select("src", "dst"), "oriented")
    b = oriented.select(F.col("src").alias("s"), F.col("dst").alias("d"))
    wedges = oriented.join(b, (F.col("src") == F.col("s")) & (F.col("dst") < F.col("d"))).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("d").alias("w"))
    found = wedges.join(und.select(F.col("src").alias("p"), F.col("dst").alias("q")), (F.col("v") == F.col("p")) & (F.col("w") == F.col("q")), "left_semi")
    counts = found.select(F.explode(F.array("u", "v", "w")).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return p.ids.join(counts, F.col("id") == F.col("t"), "left").select("id", F.coalesce("n", F.lit(0)).alias("triangles"))


def oriented(p: Projection) -> DataFrame:
    """(src, dst): each pair that an edge joins once, from the lower to the higher (degree, id), so hubs have few out-edges."""
    und = keep(p.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct(), "undirected")
    deg = und.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    both = und.join(deg.select(F.col("x").alias("u"), F.col("n").alias("nu")), "u").join(deg.select(F.col("x").alias("v"), F.col("n").alias("nv")), "v")
    up = F.col("nu") <= F.col("nv")
    return keep(both.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst")), "oriented")


def cliques(p: Projection, least: int = 2) -> DataFrame:
    """(clique): maximal cliques of at least ``least`` vertices, each found at its vertex that is lowest by (degree, id).

    A vertex's task holds the triangles in which it is lowest (its candidates and their edges) or in the middle (a lower vertex that
    would extend a clique, so that clique belongs to another task). Edges in no triangle and vertices without edges are cliques by themselves.
    """
    edges = oriented(p)
    wedges = edges.select(F.col("src").alias("a"), F.col("dst").alias("x")).join(edges.select(F.col("src").alias("a"), F.col("dst").alias("y")), "a").where("x < y")
    closing = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y"), F.col("src").alias("b"), F.col("dst").alias("c"))
    triads = keep(wedges.join(closing, ["x", "y"]).select("a", "b", "c"), "triads")
    links = triads.select(F.col("a").alias("k"), F.col("b").alias("x"), F.col("c").alias("y"), F.lit(True).alias("later")).unionAll(triads.select(F.col("b").alias("k"), F.col("a").alias("x"), F.col("c").alias("y"), F.lit(False).alias("later")))

    def run(key, rows):
        import pandas as pd

        adj, cand, seen = defaultdict(set), set(), set()
        for x, y, later in zip(rows["x"].tolist(), rows["y"].tolist(), rows["later"].tolist(), strict=True):
            adj[x].add(y)
            adj[y].add(x)
            (cand if later else seen).add(x)
            cand.add(y)
        return pd.DataFrame({"clique": list(Q.grown_cliques([int(key[0])], cand, seen, adj, least))}, dtype=object)

    parts = [links.groupBy("k").applyInPandas(run, "clique array<long>")]
    if least <= 2:
        closed = triads.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")), F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))).alias("e")).select("e.*")
        parts.append(edges.join(closed, ["src", "dst"], "left_anti").select(F.array_sort(F.array("src", "dst")).alias("clique")))
    if least <= 1:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("e"))
        parts.append(p.ids.distinct().join(ends, F.col("id") == F.col("e"), "left_anti").select(F.array("id").alias("clique")))
    return reduce(DataFrame.unionAll, parts)


def core_numbers(p: Projection) -> DataFrame:
    """(id, core) by peeling: vertices of degree at most k go until none is left, then k grows."""
    edges = keep(p.undirected(), "undirected")
    left = keep(p.ids, "ids")
    done, k = None, 0
    while True:
        deg = left.join(edges.groupBy("src").agg(F.count("*").alias("n")), F.col("id") == F.col("src"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
        deg = keep(deg, "degrees")
        least = deg.agg(F.min("n")).first()[0]
        if least is None:
            return done if done is not None else p.ids.select("id", F.lit(0).alias("core"))
        k = max(k, least)
        gone = deg.where(F.col("n") <= k).select("id")
        layer = keep(gone.select("id", F.lit(k).cast("long").alias("core")), "core")
        done = layer if done is None else done.unionAll(layer)
        left = keep(left.join(layer.select("id"), "id", "left_anti"), "ids")
        out = layer.select(F.col("id").alias("g"))
        edges = keep(edges.join(out, F.col("src") == F.col("g"), "left_anti").join(out, F.col("dst") == F.col("g"), "left_anti"), "undirected")


def label_propagation(p: Projection, rounds: int = 10) -> DataFrame:
    """(id, community), synchronous: the label most neighbours have, ties to the least; parallel edges count."""
    e = p.edges.where("src <> dst").select("src", "dst")
    both = keep(e.unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src", "dst").agg(F.count("*").alias("k")), "edges")
    labels = keep(p.ids.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        votes = labels.join(both, F.col("id") == F.col("src")).groupBy("dst", "label").agg(F.sum("k").alias("n"))
        best = votes.groupBy("dst").agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("new"))
        nxt = keep(labels.join(best, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("new", "label").alias("label"), F.col("label").alias("old")), "labels")
        changed = nxt.where("label <> old").limit(1).count()
        labels = nxt.drop("old")
        if not changed:
            break
    return labels.select("id", F.col("label").alias("community"))


def hops(p: Projection, sources: DataFrame, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(s, node, d): breadth-first levels from the sources (s); each pair once."""
    pairs = keep((p.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else p.edges.select("src", "dst")).distinct(), "edges")
    seen = frontier = keep(sources.select("s", F.col("s").alias("node"), F.lit(0).cast("long").alias("d")), "bfs")
    level = 0
    while most is None or level < most:
        level += 1
        nxt = frontier.join(pairs, F.col("node") == F.col("src")).select("s", F.col("dst").alias("node")).distinct()
        frontier = keep(nxt.join(seen, ["s", "node"], "left_anti").select("s", "node", F.lit(level).cast("long").alias("d")), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def all_distances(p: Projection, by_weight: bool) -> DataFrame:
    """(s, node, d) for all reachable pairs but a vertex with itself."""
    starts = p.ids.select(F.col("id").alias("s"))
    if by_weight:
        out = relax(starts.select("s", F.col("s").alias("node"), F.lit(0.0).alias("d")), keep(weighted(p.edges), "edges"))
    else:
        out = hops(p, starts)
    return out.where("s <> node").select("s", "node", F.col("d").cast("double").alias("d"))


def strong_components(p: Projection) -> DataFrame:
    """(id, component): repeatedly the greatest ancestor colours vertices, and those that reach their colour's root backwards form its component."""
    left, edges = keep(p.ids, "ids"), keep(p.edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    done = None
    while True:
        # vertices without in- or out-edges are components of their own
        while True:
            ends = edges.select(F.col("src").alias("e")).distinct().intersect(edges.select(F.col("dst").alias("e")).distinct())
            single = keep(left.join(ends, F.col("id") == F.col("e"), "left_anti"), "single")
            if single.isEmpty():
                break
            layer = single.select("id", F.col("id").alias("component"))
            done = layer if done is None else done.unionAll(layer)
            left = keep(left.join(single, "id", "left_anti"), "ids")
            g = single.select(F.col("id").alias("g"))
            edges = keep(edges.join(g, F.col("src") == F.col("g"), "left_anti").join(g, F.col("dst") == F.col("g"), "left_anti"), "edges")
        if left.isEmpty():
            break
        colour = keep(left.select("id", F.col("id").alias("c")), "colour")
        while True:
            got = colour.join(edges, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("c").alias("m"))
            nxt = keep(colour.join(got, F.col("id") == F.col("dst"), "left").select("id", F.least("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")), "colour")
            moved = nxt.where("c <> old").limit(1).count()
            colour = nxt.drop("old")
            if not moved:
                break
        inside = edges.join(colour.select(F.col("id").alias("i1"), F.col("c").alias("c1")), F.col("src") == F.col("i1")).join(colour.select(F.col("id").alias("i2"), F.col("c").alias("c2")), F.col("dst") == F.col("i2")).where("c1 = c2").select("src", "dst")
        inside = keep(inside, "inside")
        reached = frontier = keep(colour.where("id = c").select("id", "c"), "reached")
        while True:
            nxt = frontier.join(inside, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "c").distinct()
            frontier = keep(nxt.join(reached, ["id", "c"], "left_anti"), "reached")
            if frontier.isEmpty():
                break
            reached = reached.unionAll(frontier)
        layer = keep(reached.select("id", F.col("c").alias("component")), "component")
        done = layer if done is None else done.unionAll(layer)
        left = keep(left.join(layer.select("id"), "id", "left_anti"), "ids")
        g = layer.select(F.col("id").alias("g"))
        edges = keep(edges.join(g, F.col("src") == F.col("g"), "left_anti").join(g, F.col("dst") == F.col("g"), "left_anti"), "edges")
    return done if done is not None else p.ids.select("id", F.col("id").alias("component"))


def peel(p: Projection) -> tuple[DataFrame, DataFrame]:
    """(id, level) of the vertices in topological layers, and the vertices on or behind cycles."""
    left, edges = keep(p.ids, "ids"), keep(p.edges.select("src", "dst").distinct(), "edges")
    done, level = None, 0
    while True:
        free = keep(left.join(edges.select(F.col("dst").alias("e")).distinct(), F.col("id") == F.col("e"), "left_anti"), "layer")
        if free.isEmpty():
            break
        layer = free.select("id", F.lit(level).cast("long").alias("level"))
        done = layer if done is None else done.unionAll(layer)
        level += 1
        left = keep(left.join(free, "id", "left_anti"), "ids")
        edges = keep(edges.join(free.select(F.col("id").alias("g")), F.col("src") == F.col("g"), "left_anti"), "edges")
    return (done if done is not None else p.ids.limit(0).select("id", F.lit(0).cast("long").alias("level"))), left


def similar_vertices(p: Projection, metric: str = "JACCARD", cutoff: float = 0.1, top: int = 10) -> DataFrame:
    """(node1, node2, similarity): overlap of out-neighbour sets, the ``top`` best of each vertex.

    An edge carries its vertex's degree, so pairs with a common neighbour move once, each in one direction; both directions are
    made of those that reach the cutoff.
    """
    common, na, nb = F.col("common"), F.col("na"), F.col("nb")
    score = {"JACCARD": common / (na + nb - common), "OVERLAP": common / F.least(na, nb), "COSINE": common / F.sqrt(na * nb)}.get(metric.upper())
    if score is None:
        raise CompileError(f"unknown metric {metric}")
    linked = p.edges.select("src", "dst").distinct()
    deg = linked.groupBy("src").agg(F.count("*").alias("n"))
    out = keep(linked.join(deg, "src"), "edges")
    a, b = (out.select("dst", F.col("src").alias(x), F.col("n").alias(f"n{x}")) for x in "ab")
    pairs = a.join(b, "dst").where("a < b").select("a", "na", "b", "nb").repartition("a", "b")  # few repeat, so counts of parts before the exchange don't pay
    scored = pairs.groupBy("a", "b").agg(F.count("*").alias("common"), F.first("na").alias("na"), F.first("nb").alias("nb")).select("a", "b", score.cast("double").alias("similarity")).where(F.col("similarity") >= cutoff)
    ways = F.explode(F.array(F.struct(F.col("a").alias("node1"), F.col("b").alias("node2")), F.struct(F.col("b").alias("node1"), F.col("a").alias("node2"))))
    w = Window.partitionBy("node1").orderBy(F.col("similarity").desc(), "node2")
    return scored.select(ways.alias("way"), "similarity").select("way.node1", "way.node2", "similarity").withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def pregel(p: Projection, initial, message, combine: Callable, update: Callable, rounds: int = 20) -> DataFrame:
    """A vertex program: (id, v). Messages are columns over v, w; ``update(v, m)`` is the new value; it halts when none changes."""
    edges = keep(p.edges.select("src", "dst", F.coalesce("w", F.lit(1.0)).alias("w")), "edges")
    values = keep(p.ids.select("id", initial.alias("v")), "values")
    for _ in range(rounds):
        got = values.join(edges, F.col("id") == F.col("src")).where(message.isNotNull()).groupBy("dst").agg(combine(message).alias("m"))
        nxt = keep(values.join(got, F.col("id") == F.col("dst"), "left").select("id", update(F.col("v"), F.col("m")).alias("v"), F.col("v").alias("old")), "values")
        changed = nxt.where(~F.col("v").eqNullSafe(F.col("old"))).limit(1).count()
        values = nxt.drop("old")
        if not changed:
            break
    return values


def spanning_forest(p: Projection) -> DataFrame:
    """(source, target, weight) of a least spanning forest: each round every component takes its least edge, by weight and then ends.

    That order is total, so no round closes a cycle, and the number of components halves at least.
    """
    ends = p.edges.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.coalesce("w", F.lit(1.0)).alias("w"))
    edges = keep(ends.groupBy("u", "v").agg(F.min("w").alias("w")), "forest-edges")
    part = keep(p.ids.select("id", F.col("id").alias("c")).distinct(), "forest-parts")
    chosen = []
    while True:
        cu, cv = part.select(F.col("id").alias("u"), F.col("c").alias("cu")), part.select(F.col("id").alias("v"), F.col("c").alias("cv"))
        edges = keep(edges.select("u", "v", "w").join(cu, "u").join(cv, "v").where("cu <> cv"), "forest-edges")
        if edges.isEmpty():
            break
        edge = F.struct("w", "u", "v", "cu", "cv").alias("e")
        sides = edges.select(F.col("cu").alias("c"), edge).unionAll(edges.select(F.col("cv").alias("c"), edge))
        picked = keep(sides.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), "forest")
        chosen.append(picked.select(F.col("u").alias("source"), F.col("v").alias("target"), F.col("w").alias("weight")))
        roots = components(picked.select(F.col("cu").alias("a"), F.col("cv").alias("b")))
        part = keep(part.join(roots, F.col("c") == F.col("node"), "left").select("id", F.coalesce("root", "c").alias("c")), "forest-parts")
    return reduce(DataFrame.unionAll, chosen) if chosen else p.ids.limit(0).select(F.col("id").alias("source"), F.col("id").alias("target"), F.lit(0.0).alias("weight"))


def random_walks(p: Projection, length: int, per: int, starts: DataFrame, seed: int) -> DataFrame:
    """(path): ``per`` walks of ``length`` steps from each start (id); an edge is taken in proportion to its weight.

    A step is a join of the walks' ends with the edges, whose weights are laid end to end for each vertex; the draw is a hash of the
    seed, start, walk and step, so it doesn't depend on partitions. A walk ends where no edge leaves.
    """
    w = Window.partitionBy("src")
    along = w.orderBy("dst", "eid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weights = p.edges.select("src", "dst", "eid", F.greatest(F.coalesce("w", F.lit(1.0)), F.lit(0.0)).alias("w")).withColumn("any", F.sum("w").over(w) > 0)
    laid = weights.withColumn("w", F.when(F.col("any"), F.col("w")).otherwise(F.lit(1.0))).withColumns({"hi": F.sum("w").over(along), "total": F.sum("w").over(w)})
    edges = keep(laid.select("src", "dst", (F.col("hi") - F.col("w")).alias("lo"), "hi", "total"), "walk-edges")
    live = starts.select(F.col("id").alias("at"), F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("walk"), F.array("id").alias("path"))
    done = []
    for step in range(length):
        draw = F.pmod(F.xxhash64(F.lit(seed), "start", "walk", F.lit(step)), F.lit(1 << 53)) / float(1 << 53)
        drawn = live.withColumn("draw", draw)
        taken = (F.col("at") == F.col("src")) & (F.col("draw") * F.col("total") >= F.col("lo")) & (F.col("draw") * F.col("total") < F.col("hi"))
        moved = keep(drawn.join(edges, taken, "left"), "walks")
        done.append(moved.where("dst is null").select("path"))
        live = moved.where("dst is not null").select(F.col("dst").alias("at"), "start", "walk", F.array_append("path", F.col("dst")).alias("path"))
    return reduce(DataFrame.unionAll, [*done, live.select("path")])
