"""Diff and promotion between branches of a graph.

A vertex is named by its content, a hash of its label and properties; an edge by its type and the contents of its endpoints.
Branches that dealt the same ids to different vertices, or other ids to equal ones, compare correctly.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DST, EID, SRC, VID, EdgeTable, Graph, union_all
from ..errors import CompileError
from ..storage import keep
from .writes import numbered

DIFF = "entity string, label string, change string, uid string, before string, after string"


def content(df: DataFrame, label: str) -> DataFrame:
    """(_vid, uid, json) of vertices; the label and all properties that aren't null make the uid."""
    names = sorted(c for c in df.columns if not c.startswith("_"))
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")
    return df.select(VID, json.alias("json")).select(VID, F.sha2(F.concat_ws("\x1f", F.lit(label), "json"), 256).alias("uid"), "json")


def vertex_uids(graph: Graph) -> DataFrame:
    """(_vid, uid) of all vertices."""
    frames = [content(df, label).select(VID, "uid") for label, df in sorted(graph.nodes.items())]
    return reduce(DataFrame.unionAll, frames) if frames else graph.spark.createDataFrame([], f"{VID} bigint, uid string")


def edge_content(table: EdgeTable, uids: DataFrame) -> DataFrame:
    """(_eid, source, target, json) of edges whose endpoints exist; source and target are contents."""
    names = sorted(c for c in table.df.columns if not c.startswith("_"))
    json = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])) if names else F.lit("{}")
    a, b = (uids.select(F.col(VID).alias(f"_{x}"), F.col("uid").alias(x)) for x in ("source", "target"))
    return table.df.select(EID, SRC, DST, json.alias("json")).join(a, F.col(SRC) == F.col("_source")).join(b, F.col(DST) == F.col("_target")).select(EID, "source", "target", "json")


def _paired(old: DataFrame, new: DataFrame, key: str, entity: str, label: str) -> DataFrame:
    """Rows (key, uid, json) that one side lacks; those of one key on both sides are one change."""
    gone = old.join(new.select("uid").distinct(), "uid", "left_anti").select(F.col(key).alias("k"), F.col("uid").alias("u1"), F.col("json").alias("before"))
    come = new.join(old.select("uid").distinct(), "uid", "left_anti").select(F.col(key).alias("k"), F.col("uid").alias("u2"), F.col("json").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("changed")
    return gone.join(come, "k", "full").select(F.lit(entity).alias("entity"), F.lit(label).alias("label"), change.alias("change"), F.coalesce("u2", "u1").alias("uid"), "before", "after")


def diff(a: Graph, b: Graph) -> DataFrame:
    """What must happen to ``a`` to become ``b``: (entity, label, change, uid, before, after), change added, deleted or changed."""
    parts = []
    none = a.spark.createDataFrame([], f"{VID} bigint, uid string, json string")
    for label in sorted({*a.nodes, *b.nodes}):
        if a.nodes.get(label) is not b.nodes.get(label):
            old, new = (content(g.nodes[label], label) if label in g.nodes else none for g in (a, b))
            parts.append(_paired(old, new, VID, "vertex", label))
    same_vertices = not parts
    uids = None
    for t in sorted({*a.edges, *b.edges}):
        if same_vertices and a.edges.get(t) is b.edges.get(t):
            continue
        uids = uids or (keep(vertex_uids(a), "uids"), keep(vertex_uids(b), "uids"))
        frames = []
        for g, u in zip((a, b), uids, strict=True):
            df = edge_content(g.edges[t], u) if t in g.edges else a.spark.createDataFrame([], f"{EID} bigint, source string, target string, json string")
            frames.append(df.select(EID, F.sha2(F.concat_ws("\x1f", F.lit(t), "source", "target", "json"), 256).alias("uid"), "json"))
        parts.append(_paired(*frames, EID, "edge", t))
    return reduce(DataFrame.unionAll, parts) if parts else a.spark.createDataFrame([], DIFF)


def invert(found: DataFrame) -> DataFrame:
    """The way back: diff(a, b) inverted is diff(b, a), but for the uid of what changed, which stays that of b."""
    change = F.when(F.col("change") == "added", "deleted").when(F.col("change") == "deleted", "added").otherwise(F.col("change"))
    return found.select("entity", "label", change.alias("change"), "uid", F.col("after").alias("before"), F.col("before").alias("after"))


@dataclass
class Report:
    vertices_inserted: int = 0
    edges_inserted: int = 0
    vertices_skipped_uid_conflict: int = 0
    edges_skipped_duplicate: int = 0
    edges_skipped_no_endpoint: int = 0


def promote(session, fork, patterns: list[dict]) -> Report:
    """Copy what a fork has and the session's graph lacks; all patterns are committed at once, or none.

    Patterns: {"label": name[, "where": text over n]} or {"edge_type": name}. Vertices of a content that is there are skipped, as are
    edges that are there or lack an endpoint.
    """
    work, source, report = session.graph.copy(), fork.graph, Report()
    for p in patterns:
        if "label" in p:
            _promote_vertices(work, source, fork, p, report)
        elif "edge_type" in p:
            _promote_edges(work, source, p["edge_type"], report)
        else:
            raise CompileError("a pattern names a label or an edge_type")
    before = {**session.graph.nodes}, {**session.graph.edges}
    session.commit(work, before)
    return report


def _promote_vertices(work: Graph, source: Graph, fork, pattern: dict, report: Report) -> None:
    label = pattern["label"]
    df = source.resolve_label(label)
    if df is None:
        raise CompileError(f"no label {label}")
    if pattern.get("where"):
        chosen = fork.query(f"MATCH (n:{label}) WHERE {pattern['where']} RETURN id(n) AS chosen")
        df = df.join(chosen, F.col(VID) == F.col("chosen"), "left_semi")
    named = df.join(content(df, label).select(F.col(VID).alias("_v"), F.col("uid").alias("_uid")), F.col(VID) == F.col("_v")).drop("_v").dropDuplicates(["_uid"])
    here = work.nodes.get(label)
    if here is not None:
        known = content(here, label).select(F.col("uid").alias("_uid")).distinct()
        report.vertices_skipped_uid_conflict += named.join(known, "_uid", "left_semi").count()
        named = named.join(known, "_uid", "left_anti")
    new = numbered(named.drop("_uid", VID), work.next_id(), VID)
    report.vertices_inserted += new.count()
    work.nodes[label] = new if here is None else union_all([here, new])


def _promote_edges(work: Graph, source: Graph, type_: str, report: Report) -> None:
    table = source.edges.get(type_)
    if table is None:
        raise CompileError(f"no edge type {type_}")
    there = edge_content(table, vertex_uids(source)).dropDuplicates(["source", "target"])
    uids = keep(vertex_uids(work).groupBy("uid").agg(F.min(VID).alias(VID)), "uids")
    a, b = (uids.select(F.col("uid").alias(x), F.col(VID).alias(f"_{x}")) for x in ("source", "target"))
    mapped = keep(there.join(a, "source", "left").join(b, "target", "left"), "promoted")
    found = mapped.where("_source is not null and _target is not null")
    report.edges_skipped_no_endpoint += mapped.count() - found.count()
    here = work.edges.get(type_)
    if here is not None:
        known = edge_content(here, vertex_uids(work)).select("source", "target").distinct()
        report.edges_skipped_duplicate += found.join(known, ["source", "target"], "left_semi").count()
        found = found.join(known, ["source", "target"], "left_anti")
    moved = table.df.drop(SRC, DST).join(found.select(EID, F.col("_source").alias(SRC), F.col("_target").alias(DST)), EID)
    new = numbered(moved.drop(EID), work.next_id(), EID)
    report.edges_inserted += new.count()
    work.edges[type_] = EdgeTable(new if here is None else union_all([here.df, new]), (here or table).sources, (here or table).targets)
