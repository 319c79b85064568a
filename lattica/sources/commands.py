"""Statements that aren't queries: DDL, COPY, SHOW, EXPLAIN, BACKUP."""

from __future__ import annotations

import re
import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DST, EID, LABELS, SRC, VID, EdgeTable
from ..errors import CompileError, ConstraintError
from ..operators.writes import append_edges, append_nodes, check_constraints

TYPES = {"string": "string", "int32": "int", "int64": "bigint", "int": "bigint", "integer": "bigint", "float32": "float", "float64": "double", "float": "double", "double": "double", "bool": "boolean", "boolean": "boolean", "timestamp": "timestamp", "datetime": "timestamp", "date": "date", "json": "string", "cyphervalue": "string", "bytes": "binary"}


def spark_type(name: str) -> str:
    """Spark's name of a declared type."""
    low = name.lower()
    if m := re.match(r"list<(.*)>$", low):
        return f"array<{spark_type(m[1])}>"
    if low.startswith("vector"):
        return "array<float>"
    if low.startswith("sparse"):
        return "struct<indices:array<int>,values:array<float>>"
    if low.startswith("map"):
        return "map<string,string>"
    if low in ("duration", "btic"):
        return "struct<months:bigint,days:bigint,nanos:bigint>" if low == "duration" else "struct<lo:bigint,hi:bigint,meta:bigint>"
    if low not in TYPES:
        raise CompileError(f"unknown type {name}")
    return TYPES[low]


def split_version(text: str) -> tuple[str, tuple[str, str] | None]:
    """The statement without its VERSION (or TIMESTAMP) AS OF 'name', and what that says."""
    m = re.search(r"\s(VERSION|TIMESTAMP)\s+AS\s+OF\s+'([^']*)'", text, re.IGNORECASE)
    return (text[: m.start()] + " " + text[m.end() :], (m[1].lower(), m[2])) if m else (text, None)


def done(session, what: str) -> DataFrame:
    return session.graph.spark.createDataFrame([(what,)], "status string")


def run_command(session, tree, params: dict) -> DataFrame:
    kind, a = tree.kind, tree.args
    spark = session.graph.spark
    if kind in ("explain", "profile"):
        from ..cypher.plan import Planner

        df = Planner(session.context(params)).run(a["query"])
        began = time.perf_counter()
        if kind == "profile":  # all rows are computed, none comes to the driver
            df.write.format("noop").mode("overwrite").save()
        spent = (time.perf_counter() - began) * 1000
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return spark.createDataFrame([(plan, spent)], "plan string, total_time_ms double") if kind == "profile" else spark.createDataFrame([(plan,)], "plan string")
    g = session.graph.copy()
    if kind == "copy":
        return copy(session, g, a)
    if kind == "backup":
        for name, df in g.nodes.items():
            df.write.mode("overwrite").parquet(f"{a['path']}/nodes/{name}")
        for name, e in g.edges.items():
            e.df.write.mode("overwrite").parquet(f"{a['path']}/edges/{name}")
        return done(session, "backed up")
    if kind in ("vacuum", "checkpoint"):
        return done(session, kind)
    if kind == "show":
        what = {"labels": "uni.schema.labels", "indexes": "uni.schema.indexes", "constraints": "uni.schema.constraints", "edge": "uni.schema.edgeTypes", "edges": "uni.schema.edgeTypes", "types": "uni.schema.edgeTypes", "procedures": None, "functions": None}
        ctx = session.context()
        if a["what"] in ("database", "config", "statistics", "snapshots"):
            return show(session, ctx, a["what"])
        if a["what"] not in what:
            raise CompileError(f"SHOW {a['what']} is unknown")
        if a["what"] == "procedures":
            return spark.createDataFrame([(p,) for p in sorted(ctx.procedures)], "name string")
        if a["what"] == "functions":
            from ..functions.scalar import SCALAR

            return spark.createDataFrame([(p,) for p in sorted({**SCALAR, **ctx.functions, **ctx.macros})], "name string")
        return ctx.procedures[what[a["what"]].lower()](ctx, [])
    verb, target = kind.split("_", 1)
    {"label": label_ddl, "edge_type": edge_ddl, "index": index_ddl, "constraint": constraint_ddl}[target](g, verb, a)
    session.graph = g
    return done(session, kind)


def show(session, ctx, what: str) -> DataFrame:
    g, spark = session.graph, session.graph.spark
    if what == "snapshots":
        return ctx.procedures["uni.admin.snapshot.list"](ctx, [])
    if what == "database":
        return spark.createDataFrame([(len(g.nodes), len(g.edges), len(g.indexes), len(g.constraints), len(session.snapshots))], "labels int, edge_types int, indexes int, constraints int, snapshots int")
    if what == "config":
        return spark.createDataFrame([(k, str(v)) for k, v in sorted(vars(session.settings).items())], "name string, value string")
    tables = [("label", n, d) for n, d in sorted(g.nodes.items())] + [("edge type", n, e.df) for n, e in sorted(g.edges.items())]
    counts = [d.agg(F.count("*").alias("rows")).select(F.lit(kind).alias("kind"), F.lit(n).alias("name"), "rows") for kind, n, d in tables]
    return reduce(DataFrame.unionAll, counts) if counts else spark.createDataFrame([], "kind string, name string, rows long")


def _fields(props: dict) -> str:
    return "".join(f", `{k}` {spark_type(t)}" for k, (t, _) in props.items())


def label_ddl(g, verb: str, a: dict) -> None:
    name = a["name"]
    if verb == "create":
        if name in g.nodes:
            if a["exists"]:
                return
            raise CompileError(f"{name} exists")
        g.nodes[name] = g.spark.createDataFrame([], f"{VID} bigint{_fields(a['props'])}")
        g.constraints += [{"name": f"{name}_{k}", "label": name, "kind": "exists", "props": [k]} for k, (_, needed) in a["props"].items() if needed]
        g.constraints += [{"name": f"{name}_{k}_unique", "label": name, "kind": "unique", "props": [k]} for k in a.get("unique", [])]
        return
    if name not in g.nodes:
        if a["exists"]:
            return
        raise CompileError(f"no label {name}")
    if verb == "drop":
        del g.nodes[name]
        g.constraints[:] = [c for c in g.constraints if c["label"] != name]
        g.indexes[:] = [i for i in g.indexes if i["label"] != name]
        return
    g.nodes[name] = _altered(g.nodes[name], a)


def _altered(df: DataFrame, a: dict) -> DataFrame:
    if "add" in a:
        return df.withColumn(a["add"][0], F.lit(None).cast(spark_type(a["add"][1])))
    if "drop" in a:
        return df.drop(a["drop"])
    return df.withColumnRenamed(*a["rename"]) if "rename" in a else df


def edge_ddl(g, verb: str, a: dict) -> None:
    name = a["name"]
    if verb == "create":
        if name in g.edges and not a["exists"]:
            raise CompileError(f"{name} exists")
        g.edges.setdefault(name, EdgeTable(g.spark.createDataFrame([], f"{EID} bigint, {SRC} bigint, {DST} bigint{_fields(a['props'])}"), tuple(a.get("from", ())), tuple(a.get("to", ()))))
    elif name not in g.edges:
        if not a["exists"]:
            raise CompileError(f"no edge type {name}")
    elif verb == "drop":
        del g.edges[name]
    else:
        g.edges[name] = EdgeTable(_altered(g.edges[name].df, a), g.edges[name].sources, g.edges[name].targets)


def index_ddl(g, verb: str, a: dict) -> None:
    if verb == "drop":
        g.indexes[:] = [i for i in g.indexes if i["name"] != a["name"]]
    else:
        name = a["name"] or f"{a['label']}_{'_'.join(a['props'])}"
        options = literal_map(a.get("options"))
        g.indexes.append({"name": name, "label": a["label"], "props": a["props"], "index_kind": a["index_kind"], "options": options})
        if a["index_kind"] == "vector" and str(options.get("type", "flat")).lower() != "flat":
            from ..operators.ann import build_cells

            g.indexes[-1]["cells"] = build_cells(g.nodes[a["label"]], a["props"][0], int(options.get("partitions", 64)), options.get("metric", "cosine"))


def literal_map(tree) -> dict:
    """The literal values of a map expression's tree; other entries are left out."""
    return {k: v[1] for k, v in tree[1] if v[0] == "lit"} if tree and tree[0] == "map" else {}


def constraint_ddl(g, verb: str, a: dict) -> None:
    if verb == "drop":
        g.constraints[:] = [c for c in g.constraints if c["name"] != a["name"]]
        return
    c = {"name": a["name"] or f"{a['label']}_{a['kind']}", **{k: a[k] for k in ("label", "kind", "props", "expr") if k in a}}
    g.constraints.append(c)
    if a["label"] in g.nodes:
        check_constraints(g, a["label"], g.nodes[a["label"]])


def copy(session, g, a: dict) -> DataFrame:
    """COPY <label or type> TO/FROM path; columns _vid or _eid, _src, _dst, then properties in order."""
    name, path, form = a["name"], a["path"], a["format"]
    if form not in ("parquet", "csv"):
        raise CompileError(f"unknown format {form}")
    node = name in g.nodes
    if not node and name not in g.edges:
        raise CompileError(f"no label or edge type {name}")
    old = g.nodes[name] if node else g.edges[name].df
    keys = [VID] if node else [EID, SRC, DST]
    props = sorted(c for c in old.columns if c not in keys and c != LABELS)
    if a["way"] == "to":
        out = old.select(*keys, *props)
        n = out.count()
        (out.write.mode("overwrite").option("header", True).csv(path) if form == "csv" else out.write.mode("overwrite").parquet(path))
        return g.spark.createDataFrame([(n,)], "rows long")
    df = g.spark.read.option("header", True).csv(path) if form == "csv" else g.spark.read.parquet(path)
    if missing := set(keys) - set(df.columns):
        raise ConstraintError(f"{path} has no column {sorted(missing)}")
    df = df.select(*[F.col(k).cast("long").alias(k) for k in keys], *[F.col(f"`{c}`") for c in df.columns if c not in keys])
    (append_nodes if node else append_edges)(g, name, df)
    session.graph = g
    return g.spark.createDataFrame([(df.count(),)], "rows long")


def bulk_vertices(session, label: str, rows, schema=None) -> list[int]:
    """Append rows (dicts, pandas or Arrow tables) as vertices; gives the first and last id."""
    from ..operators.writes import numbered
    from ..storage import keep

    g = session.graph.copy()
    df = rows if isinstance(rows, DataFrame) else g.spark.createDataFrame(rows, schema) if schema else g.spark.createDataFrame(rows)
    first = g.next_id()
    new = keep(numbered(df, first, VID), "bulk")
    append_nodes(g, label, new.select(VID, *[c for c in new.columns if c != VID]))
    session.graph = g
    return [first, first + new.count() - 1]


def bulk_edges(session, type_: str, rows, sources=(), targets=()) -> None:
    """Append (src, dst, properties) as edges."""
    from ..operators.writes import numbered
    from ..storage import keep

    g = session.graph.copy()
    df = rows if isinstance(rows, DataFrame) else g.spark.createDataFrame([{SRC: s, DST: d, **p} for s, d, p in rows])
    append_edges(g, type_, keep(numbered(df, g.next_id(), EID), "bulk"), sources, targets)
    session.graph = g


class Appender:
    """Row by row, or a batch at a time, into one label; rows are written when there are enough, and on close."""

    def __init__(self, session, label: str, size: int = 10_000):
        self.session, self.label, self.size, self.rows = session, label, size, []

    def append(self, **row) -> None:
        self.rows.append(row)
        if len(self.rows) >= self.size:
            self.flush()

    def append_arrow(self, table) -> None:
        self.flush()
        bulk_vertices(self.session, self.label, table.to_pandas())

    def flush(self) -> None:
        if self.rows:
            bulk_vertices(self.session, self.label, self.rows)
            self.rows = []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.flush()
