"""Procedures that change the session: schema, snapshots, declared functions, jobs.

They act at once, when the CALL is planned; a failure leaves the graph as it was.
"""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import functions as F

from ..errors import CompileError
from .procedures import PROCEDURES, _rows, arg, procedure


def success(ctx):
    return _rows(ctx, [(True,)], "success boolean")


def spec_of(value) -> dict:
    """A map argument, or its JSON text."""
    return json.loads(value) if isinstance(value, str) else dict(value or {})


def names_of(value) -> list[str]:
    """A list of names, or its JSON text, of strings or maps with a name."""
    found = json.loads(value) if isinstance(value, str) else value or []
    return [x["name"] if isinstance(x, dict) else x for x in found]


def properties_of(spec: dict) -> dict[str, tuple[str, bool]]:
    """Property -> (type, needed)."""
    out = {}
    for name, p in dict(spec.get("properties") or {}).items():
        p = {"type": p} if isinstance(p, str) else dict(p)
        out[name] = (p.get("type", "string"), p.get("nullable") is False)
    return out


def declare(ctx, command: str, args: dict):
    """Run a DDL function on a copy of the graph, which then becomes the session's."""
    from ..sources import commands

    graph = ctx.session.graph.copy()
    verb, target = command.split("_", 1)
    {"label": commands.label_ddl, "edge_type": commands.edge_ddl, "index": commands.index_ddl, "constraint": commands.constraint_ddl}[target](graph, verb, {"exists": False, "props": {}} | args)
    ctx.session.graph = graph


# --- schema -----------------------------------------------------------------------------------------------------
@procedure("uni.schema.createLabel")
def create_label(ctx, args):
    spec = spec_of(arg(args, 1))
    declare(ctx, "create_label", {"name": args[0], "props": properties_of(spec)})
    for index in spec.get("indexes") or []:
        index = dict(index)
        declare(ctx, "create_index", {"name": index.get("name"), "label": args[0], "props": index.get("properties") or [index["property"]], "index_kind": index.get("type", "scalar").lower()})
    for c in spec.get("constraints") or []:
        declare(ctx, "create_constraint", {"name": dict(c).get("name"), "label": args[0], "kind": dict(c)["type"].lower(), "props": list(dict(c)["properties"])})
    return success(ctx)


@procedure("uni.schema.createEdgeType")
def create_edge_type(ctx, args):
    declare(ctx, "create_edge_type", {"name": args[0], "from": arg(args, 1, []), "to": arg(args, 2, []), "props": properties_of(spec_of(arg(args, 3)))})
    return success(ctx)


@procedure("uni.schema.createIndex")
def create_index(ctx, args):
    spec = spec_of(arg(args, 2))
    declare(ctx, "create_index", {"name": spec.get("name"), "label": args[0], "props": [args[1]] if isinstance(args[1], str) else list(args[1]), "index_kind": spec.get("type", "scalar").lower()})
    return success(ctx)


@procedure("uni.schema.createConstraint")
def create_constraint(ctx, args):
    declare(ctx, "create_constraint", {"name": arg(args, 3), "label": args[0], "kind": args[1].lower(), "props": list(args[2])})
    return success(ctx)


for _name, _command in (("dropLabel", "drop_label"), ("dropEdgeType", "drop_edge_type"), ("dropIndex", "drop_index"), ("dropConstraint", "drop_constraint")):

    def _drop(ctx, args, command=_command):
        declare(ctx, command, {"name": args[0]})
        return success(ctx)

    procedure(f"uni.schema.{_name}")(_drop)


# --- snapshots --------------------------------------------------------------------------------------------------
@procedure("uni.admin.snapshot.create")
def snapshot_create(ctx, args):
    name = arg(args, 0, f"snapshot-{len(ctx.session.snapshots) + 1}")
    ctx.session.snapshot(name)
    return _rows(ctx, [(name,)], "snapshot_id string")


@procedure("uni.admin.snapshot.list")
def snapshot_list(ctx, args):
    s = ctx.session
    return _rows(ctx, [(n, n, float(s.snapshot_times[n]), i + 1) for i, n in enumerate(s.snapshots)], "snapshot_id string, name string, created double, version_hwm long").withColumn("created_at", F.timestamp_micros((F.col("created") * 1e6).cast("long"))).drop("created")


@procedure("uni.admin.snapshot.restore")
def snapshot_restore(ctx, args):
    ctx.session.graph = ctx.session.at_version(args[0]).copy()
    return _rows(ctx, [("restored",)], "status string")


@procedure("uni.admin.snapshot.delete")
def snapshot_delete(ctx, args):
    ctx.session.at_version(args[0])
    del ctx.session.snapshots[args[0]], ctx.session.snapshot_times[args[0]]
    return _rows(ctx, [("deleted",)], "status string")


# --- declarations -----------------------------------------------------------------------------------------------
def plain_names(text: str, names: list[str]) -> str:
    """``$name`` of the given names as plain names."""
    return re.sub(r"\$(\w+)", lambda m: m[1] if m[1] in names else m[0], text)


def recorded(ctx, name: str, kind: str):
    ctx.session.declarations[name] = kind
    return success(ctx)


@procedure("uni.plugin.declareFunction")
def declare_function(ctx, args):
    names = names_of(arg(args, 3, []))
    ctx.session.declare_function(args[0], names, plain_names(args[1], names))
    return recorded(ctx, args[0], "function")


@procedure("uni.plugin.declareAggregate")
def declare_aggregate(ctx, args):
    names = names_of(arg(args, 5, ["x"]))
    init, update, final = (re.sub(rf"\${names[0]}\b", "$value", t.replace("$state", "$acc")) for t in (args[1], args[2], arg(args, 3, "$state")))
    ctx.session.declare_aggregate(args[0], init, update, final)
    return recorded(ctx, args[0], "aggregate")


@procedure("uni.plugin.declareProcedure")
def declare_procedure(ctx, args):
    """A statement with parameters; READ ones must not write."""
    name, body, mode = args[0], args[1], arg(args, 2, "READ").upper()
    names = names_of(arg(args, 4, []))
    if mode == "READ":
        ctx.session.check_read_only(body)

    def call(context, values):
        return context.session.query(body, **dict(zip(names, values, strict=False)))

    ctx.session.register_procedure(name, call)
    return recorded(ctx, name, "procedure")


@procedure("uni.plugin.declareTrigger")
def declare_trigger(ctx, args):
    """``'CREATE ON :Label'`` and a statement that runs after a commit, once for each vertex or edge ($vid)."""
    from ..streaming.changes import Trigger

    name, event, body = args[:3]
    m = re.fullmatch(r"\s*(CREATE|UPDATE|DELETE)(?:\s+ON\s+:?(\w+))?\s*", event, re.IGNORECASE)
    if not m:
        raise CompileError(f"unknown event {event}")
    kinds = {"CREATE": {1, 4}, "UPDATE": {2, 5}, "DELETE": {3, 6}}[m[1].upper()]
    session = ctx.session

    # one statement for many changed rows: $vid is a row of $changed
    text = "UNWIND $changed AS vid WITH vid " + re.sub(r"\$vid\b", "vid", body)

    def fire(events):
        others, session.triggers = session.triggers, []  # what a trigger writes fires no trigger
        try:
            pending: list[int] = []
            for row in events.select("vid_or_eid").toLocalIterator():
                pending.append(row.vid_or_eid)
                if len(pending) == 10_000:
                    session.query(text, changed=pending)
                    pending = []
            if pending:
                session.query(text, changed=pending)
        finally:
            session.triggers = others

    session.triggers.append(Trigger(name, fire, kinds=kinds, labels={m[2]} if m[2] else None))
    return recorded(ctx, name, "trigger")


@procedure("uni.plugin.listDeclared")
def list_declared(ctx, args):
    return _rows(ctx, [(n, k, "session", True) for n, k in sorted(ctx.session.declarations.items())], "qname string, kind string, declared_by string, active boolean")


@procedure("uni.plugin.dropDeclared")
def drop_declared(ctx, args):
    session, name = ctx.session, args[0]
    found = session.declarations.pop(name, None) is not None
    session.drop_declared(name)
    session.procedures.pop(name.lower(), None)
    session.triggers = [t for t in session.triggers if getattr(t, "name", None) != name]
    return _rows(ctx, [(found,)], "dropped boolean")


@procedure("uni.plugin.help")
def plugin_help(ctx, args):
    known = {**PROCEDURES, **ctx.session.procedures}
    return _rows(ctx, [(n, (known[n].__doc__ or "").strip()) for n in sorted(known) if not args or args[0].lower() in n], "qname string, help string")


# --- jobs -------------------------------------------------------------------------------------------------------
@procedure("uni.periodic.schedule")
def schedule(ctx, args):
    """Register a job; a scheduler outside runs what is due by ``uni.periodic.runJob``."""
    kind, when = arg(args, 1, "manual"), arg(args, 2)
    if kind not in ("manual", "periodic", "cron"):
        raise CompileError(f"unknown kind of schedule {kind}")
    if kind == "periodic" and not str(when).isdigit() or kind == "cron" and len(str(when).split()) not in (5, 6):
        raise CompileError(f"bad schedule {when}")
    ctx.session.jobs = [j for j in ctx.session.jobs if j["qname"] != args[0]] + [{"qname": args[0], "kind": kind, "schedule": None if when is None else str(when), "status": "scheduled", "failures": 0}]
    return success(ctx)


@procedure("uni.periodic.cancel")
def cancel(ctx, args):
    left = [j for j in ctx.session.jobs if j["qname"] != args[0]]
    found, ctx.session.jobs = len(left) < len(ctx.session.jobs), left
    return _rows(ctx, [(found,)], "cancelled boolean")


@procedure("uni.periodic.list")
def jobs(ctx, args):
    return _rows(ctx, [(j["qname"], j["status"], j["failures"]) for j in ctx.session.jobs], "qname string, status string, consecutive_failures int")


@procedure("uni.plugin.runJob")
def run_job(ctx, args):
    """Call the procedure that a job names."""
    job = next((j for j in ctx.session.jobs if j["qname"] == args[0]), None)
    if job is None:
        raise CompileError(f"no job {args[0]}")
    try:
        ctx.session.query(f"CALL {args[0]}()")
        job |= {"status": "succeeded", "failures": 0}
    except Exception:
        job |= {"status": "failed", "failures": job["failures"] + 1}
        raise
    return success(ctx)


@procedure("uni.periodic.submit")
def submit(ctx, args):
    began = time.time()
    out = ctx.session.query(args[0])
    return _rows(ctx, [(out.count(), time.time() - began)], "rows long, seconds double")


@procedure("uni.periodic.iterate")
def iterate(ctx, args):
    """Run the second statement for the rows of the first, all at once: its columns are the rows' parameters in $rows."""
    rows = ctx.session.query(args[0])
    text = f"UNWIND $rows AS row WITH {', '.join(f'row.{c} AS {c}' for c in rows.columns)} {args[1]}"
    limit = spec_of(arg(args, 2)).get("batchSize", 10_000)
    done = batches = 0
    pending: list[dict] = []
    for row in rows.toLocalIterator():
        pending.append(row.asDict(recursive=True))
        if len(pending) == limit:
            ctx.session.query(text, rows=pending)
            done, batches, pending = done + len(pending), batches + 1, []
    if pending:
        ctx.session.query(text, rows=pending)
        done, batches = done + len(pending), batches + 1
    return _rows(ctx, [(batches, done)], "batches long, total long")


@procedure("uni.periodic.commit", "uni.system.statistics_refresh", "uni.system.compaction")
def nothing_to_do(ctx, args):
    """Tables are immutable and written whole, so there is nothing to flush, compact or count anew."""
    return success(ctx)


@procedure("uni.system.echo")
def echo(ctx, args):
    return _rows(ctx, [(str(args[0]),)], "message string")


@procedure("uni.system.ttl_sweep")
def ttl_sweep(ctx, args):
    """Delete the vertices whose ``__ttl`` (epoch milliseconds) is past."""
    graph, removed = ctx.session.graph.copy(), 0
    now = int(time.time() * 1000)
    for label, df in graph.nodes.items():
        if "__ttl" in df.columns:
            over = F.col("__ttl").isNotNull() & (F.col("__ttl").cast("long") <= now)
            removed += df.where(over).count()
            graph.nodes[label] = df.where(~over)
    ctx.session.graph = graph
    return _rows(ctx, [(removed,)], "removed long")


@procedure("uni.create.uuid")
def create_uuid(ctx, args):
    import uuid

    return _rows(ctx, [(str(uuid.uuid4()),)], "result string")
