"""Compiler: a syntax tree becomes one DataFrame.

Every name is a handful of flat columns, so Catalyst prunes what a query doesn't read; patterns become joins on ids,
EXISTS semi-joins, OPTIONAL MATCH and COUNT left joins. Only variable-length patterns without a small bound, shortest paths and
recursive queries run loops, over tables written to the shared folder.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import Graph
from ..errors import CompileError, IterationLimit, MissingParameter
from ..functions import aggregate, temporal, values
from ..functions.scalar import SCALAR, distance, similarity
from ..storage import keep
from . import ast as A
from .scope import Entry, Scope, State, fresh


@dataclass
class Settings:
    max_hops: int | None = None  # unbounded paths end where nothing new is found; beyond a limit that is set they are an error
    recursion_rounds: int = 1000
    knn_default: int = 100


@dataclass
class Context:
    """What a compilation needs besides the tree."""

    graph: Graph
    params: dict = field(default_factory=dict)
    functions: dict = field(default_factory=dict)  # user scalar functions: name -> builder(args, types)
    macros: dict = field(default_factory=dict)  # declared functions: name -> (parameters, expression)
    aggregates: dict = field(default_factory=dict)  # user aggregates: name -> builder(args)
    procedures: dict = field(default_factory=dict)  # name -> callable(context, args) -> DataFrame
    tables: dict = field(default_factory=dict)  # tables of WITH RECURSIVE and of rules, by name
    settings: Settings = field(default_factory=Settings)
    needs: dict = field(default_factory=dict)
    warnings: list = field(default_factory=list)
    windows: dict = field(default_factory=dict)  # user window functions: name -> builder(columns, ordered, whole)
    collations: dict = field(default_factory=dict)  # further names of collations

    @property
    def spark(self) -> SparkSession:
        return self.graph.spark


#: Names of collations, and what Spark calls them.
COLLATIONS = {"binary": "UTF8_BINARY", "nocase": "UTF8_LCASE", "lcase": "UTF8_LCASE", "unicode": "UNICODE", "unicode_ci": "UNICODE_CI", "unicode_ai": "UNICODE_AI"}


def collation(name: str, more: dict[str, str]) -> str:
    """Spark's collation of a registered or built-in name, or the name itself where it is one of Spark's."""
    return more.get(name.lower()) or COLLATIONS.get(name.lower()) or name


def walk(tree, visit) -> None:
    """Visit all tuples, lists and data classes of a tree."""
    visit(tree)
    if isinstance(tree, (tuple, list)):
        for x in tree:
            walk(x, visit)
    elif isinstance(tree, dict):
        for x in tree.values():
            walk(x, visit)
    elif hasattr(tree, "__dataclass_fields__"):
        for name in tree.__dataclass_fields__:
            walk(getattr(tree, name), visit)


def parameters_of(tree) -> set[str]:
    found: set[str] = set()

    def visit(x):
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "param":
            found.add(x[1])

    walk(tree, visit)
    return found


def property_needs(tree) -> dict[str | tuple[str, str], set[str]]:
    """Properties read of each name; '*' where the whole entity is used. ("same", name) is there where it is a key: grouped, counted apart or passed on."""
    needs: dict[str | tuple[str, str], set[str]] = {}

    def expr(e, parent=None):
        if not isinstance(e, tuple) or not e:
            return
        if e[0] == "prop" and isinstance(e[1], tuple) and e[1][0] == "var":
            needs.setdefault(e[1][1], set()).add(e[2])
            return
        if e[0] == "var":
            needs.setdefault(e[1], set()).add("*")
            return
        if e[0] == "mapproj":
            needs.setdefault(e[1], set()).update({"*"} if any(i[0] == "all" for i in e[2]) else {i[1] for i in e[2] if i[0] == "prop"})
        if e[0] == "fn" and e[1] in ("id", "elementid", "count", "type", "startnode", "endnode", "size", "length") and len(e[2]) == 1 and e[2][0][0] == "var":
            needs.setdefault(e[2][0][1], set())
            if e[1] in ("startnode", "endnode"):
                needs[e[2][0][1]].add("*")
            if e[1] == "count" and e[3:] and e[3]:
                needs.setdefault(("same", e[2][0][1]), set()).add("*")
            return
        if e[0] in ("isnull", "haslabel") and e[1][0] == "var":
            return
        for x in e[1:]:
            tree_(x)

    def tree_(x):
        if isinstance(x, tuple):
            if x and isinstance(x[0], str):
                expr(x)
            else:
                for y in x:
                    tree_(y)
        elif isinstance(x, list):
            for y in x:
                tree_(y)
        elif isinstance(x, dict):
            for y in x.values():
                tree_(y)
        elif isinstance(x, A.Projection):
            for e, alias in x.items:
                if e[0] == "var" and e[1] == alias and not x.final:
                    needs.setdefault(("same", e[1]), set()).add("*")
                    continue  # passed on under its name: later uses count
                tree_(e)
            if x.star:
                needs.setdefault(("same", "*"), set()).add("*")
            if x.star and x.final:
                needs.setdefault("*", set()).add("*")
            for y in (x.order, x.where, x.skip, x.limit):
                tree_(y)
        elif hasattr(x, "__dataclass_fields__"):
            for name in x.__dataclass_fields__:
                tree_(getattr(x, name))

    tree_(tree)
    return needs


def conjuncts(e) -> list:
    if e is None:
        return []
    return conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]


def names_in(tree) -> set[str]:
    found: set[str] = set()

    def visit(x):
        if isinstance(x, tuple) and len(x) == 2 and x[0] == "var":
            found.add(x[1])
        elif isinstance(x, tuple) and len(x) == 3 and x[0] == "mapproj":
            found.add(x[1])
        elif isinstance(x, (A.NodePat, A.RelPat, A.PathPat)) and x.var:
            found.add(x.var)

    walk(tree, visit)
    return found


class Expressions:
    """Compiles expressions over a state; ``locals`` are names bound inside lists."""

    def __init__(self, ctx: Context, state: State, local: dict | None = None):
        self.ctx, self.state, self.local = ctx, state, local or {}
        self._empty: DataFrame | None = None

    def child(self, **names) -> Expressions:
        out = Expressions(self.ctx, self.state, {**self.local, **names})
        out._empty = self._empty
        return out

    # --- types --------------------------------------------------------------------------------------------------
    def empty(self) -> DataFrame:
        if self._empty is None:
            schema = self.state.df.schema if self.state.df is not None else T.StructType([])
            self._empty = self.ctx.spark.createDataFrame([], schema)
        return self._empty

    def type(self, e) -> T.DataType:
        """Type of an expression, found by analysis over an empty table of the same columns."""
        if e[0] == "lit":
            return F_type(e[1])
        if e[0] == "var" and e[1] in self.local:
            return self.local[e[1]][1]
        dummy = Expressions(self.ctx, self.state, {n: (F.lit(None).cast(t), t) for n, (_, t) in self.local.items()})
        dummy._empty = self.empty()
        return self.type_of(dummy.column(e))

    def type_of(self, c: Column) -> T.DataType:
        return self.empty().select(c.alias("x")).schema[0].dataType

    def typed(self, e) -> tuple[Column, T.DataType]:
        return self.column(e), self.type(e)

    # --- columns ------------------------------------------------------------------------------------------------
    def column(self, e) -> Column:
        return getattr(self, "_" + e[0])(*e[1:])

    def boolean(self, e) -> Column:
        t = self.type(e)
        if isinstance(t, T.NullType):
            return F.lit(None).cast("boolean")
        if not isinstance(t, T.BooleanType):
            raise CompileError(f"a boolean is needed, not {t.simpleString()}")
        return self.column(e)

    def _lit(self, v):
        return literal(v)

    def _col(self, name):
        return F.col(name)

    def _param(self, name):
        if name not in self.ctx.params:
            raise MissingParameter(name)
        return literal(self.ctx.params[name])

    def _var(self, name):
        if name in self.local:
            return self.local[name][0]
        if name not in self.state.scope:
            raise CompileError(f"unknown name {name}")
        return self.state.scope[name].column()

    def _prop(self, base, key):
        if base[0] == "var" and base[1] not in self.local and base[1] in self.state.scope:
            entry = self.state.scope[base[1]]
            if entry.kind in ("node", "rel"):
                return F.col(entry.props[key]) if key in entry.props else F.lit(None)
        if base[0] == "param" and isinstance(self.ctx.params.get(base[1]), dict):
            return literal(self.ctx.params[base[1]].get(key))
        c, t = self.typed(base)
        if isinstance(t, T.StructType):
            if values.is_duration(t):
                out = temporal.accessor(c, t, key)
                if out is not None:
                    return out
            return c[key] if key in t.fieldNames() else F.lit(None)
        if isinstance(t, T.MapType):
            return F.try_element_at(c, F.lit(key))
        if values.is_temporal(t):
            out = temporal.accessor(c, t, key)
            return F.lit(None) if out is None else out
        if isinstance(t, T.VariantType):
            return F.try_variant_get(c, "$." + key, "variant")
        if isinstance(t, T.StringType):  # a JSON text
            return F.get_json_object(c, "$." + key)
        if isinstance(t, T.NullType):
            return F.lit(None)
        raise CompileError(f"{t.simpleString()} has no property {key}")

    def _or(self, a, b):
        return self.boolean(a) | self.boolean(b)

    def _and(self, a, b):
        return self.boolean(a) & self.boolean(b)

    def _xor(self, a, b):
        return self.boolean(a) != self.boolean(b)

    def _not(self, a):
        return ~self.boolean(a)

    def _neg(self, a):
        c, t = self.typed(a)
        if values.is_duration(t):
            return values.duration(-c["months"], -c["days"], -c["nanos"])
        return -c

    def _cmp(self, sign, a, b):
        if sign == "~=":
            return similarity(distance(self.column(a), self.column(b), "cosine"), "cosine") >= 0.5
        ca, ta = self.typed(a)
        cb, tb = self.typed(b)
        if sign == "=~":
            return F.rlike(ca, F.concat(F.lit(r"\A(?:"), cb, F.lit(r")\z"))) if isinstance(ta, T.StringType) else F.lit(None).cast("boolean")
        for entry, column in ((a, "ca"), (b, "cb")):
            if entry[0] == "var" and entry[1] in self.state.scope and entry[1] not in self.local and self.state.scope[entry[1]].kind in ("node", "rel"):
                ident, kind = F.col(self.state.scope[entry[1]].ident), T.LongType()
                if column == "ca":
                    ca, ta = ident, kind
                else:
                    cb, tb = ident, kind
        if isinstance(ta, T.StructType) and isinstance(tb, T.LongType) and "_vid" in ta.fieldNames():
            ca, ta = ca["_vid"], T.LongType()
        if isinstance(tb, T.StructType) and isinstance(ta, T.LongType) and "_vid" in tb.fieldNames():
            cb, tb = cb["_vid"], T.LongType()
        return values.compare(sign, ca, cb, ta, tb)

    def _str(self, kind, a, b):
        (ca, ta), (cb, tb) = self.typed(a), self.typed(b)
        if not isinstance(ta, T.StringType) or not isinstance(tb, T.StringType):
            return F.lit(None).cast("boolean")
        return {"starts": F.startswith, "ends": F.endswith, "contains": F.contains}[kind](ca, cb)

    def _in(self, a, b):
        (ca, ta), (cb, tb) = self.typed(a), self.typed(b)
        if b[0] == "list" and all(x[0] == "lit" and x[1] is not None for x in b[1]) and b[1] and values.comparable(ta, tb.elementType):
            return ca.isin([x[1] for x in b[1]])
        if b[0] == "param" and isinstance(self.ctx.params.get(b[1]), list) and self.ctx.params[b[1]] and None not in self.ctx.params[b[1]] and values.comparable(ta, tb.elementType):
            return ca.isin(self.ctx.params[b[1]])
        return values.member(ca, cb, ta, tb)

    def _isnull(self, a):
        if a[0] == "var" and a[1] in self.state.scope and a[1] not in self.local:
            return F.col(self.state.scope[a[1]].ident).isNull()
        return self.column(a).isNull()

    def _haslabel(self, e, labels):
        entry = self.state.scope.get(e[1]) if e[0] == "var" else None
        if entry is None or entry.kind == "value":
            c = self.column(e)["_labels"]
        elif entry.kind == "rel":
            return F.col(entry.labels).isin(labels)
        else:
            c = F.col(entry.labels)
        out = F.lit(True)
        for label in labels:
            out = out & F.array_contains(c, label)
        return out

    def _bin(self, sign, a, b):
        (ca, ta), (cb, tb) = self.typed(a), self.typed(b)
        return values.arithmetic(sign, ca, cb, ta, tb)

    def _list(self, items):
        if not items:
            return F.array().cast("array<void>")
        return F.array(*[self.column(x) for x in items])

    def _map(self, items):
        if not items:
            return F.create_map().cast("map<string,string>")
        return F.struct(*[self.column(e).alias(k) for k, e in items])

    def _mapproj(self, var, items):
        if var in self.local or self.state.scope[var].kind == "value":
            c, t = self.typed(("var", var))
            props = {n: c[n] for n in t.fieldNames() if not n.startswith("_")}
        else:
            props = {n: F.col(c) for n, c in self.state.scope[var].props.items()}
        out = []
        for item in items:
            if item[0] == "all":
                out += [c.alias(n) for n, c in sorted(props.items())]
            elif item[0] == "prop":
                out.append((props[item[1]] if item[1] in props else F.lit(None)).alias(item[1]))
            else:
                out.append(self.column(item[2]).alias(item[1]))
        return F.struct(*out)

    def _index(self, e, at):
        if e[0] == "var" and e[1] in self.state.scope and e[1] not in self.local and self.state.scope[e[1]].kind != "value":
            entry = self.state.scope[e[1]]
            if at[0] in ("lit", "param"):
                return self._prop(e, at[1] if at[0] == "lit" else self.ctx.params[at[1]])
            texts = F.create_map(*[x for n, c in sorted(entry.props.items()) for x in (F.lit(n), F.col(c).cast("string"))])
            return F.try_element_at(texts, self.column(at))
        (c, t), (i, ti) = self.typed(e), self.typed(at)
        if isinstance(t, T.StructType) and at[0] == "lit":
            return self._prop(e, at[1])
        if isinstance(t, T.NullType) or isinstance(ti, T.NullType):
            return F.lit(None)
        return values.index(c, i, t)

    def _slice(self, e, low, high):
        return values.part(self.column(e), None if low is None else self.column(low), None if high is None else self.column(high))

    def _case(self, operand, whens, default):
        out = None
        for cond, then in whens:
            c = self.boolean(cond) if operand is None else self._cmp("=", operand, cond)
            out = F.when(c, self.column(then)) if out is None else out.when(c, self.column(then))
        return out.otherwise(self.column(default)) if default is not None else out

    def _items(self, e) -> tuple[Column, T.DataType]:
        c, t = self.typed(e)
        if isinstance(t, T.NullType):
            return F.lit(None).cast("array<string>"), T.StringType()
        if not isinstance(t, T.ArrayType):
            raise CompileError("a list is needed")
        return c, t.elementType

    def _comp(self, var, source, where, out):
        c, t = self._items(source)
        if where is not None:
            c = F.filter(c, lambda x: self.child(**{var: (x, t)}).boolean(where))
        return F.transform(c, lambda x: self.child(**{var: (x, t)}).column(out)) if out is not None else c

    def _quant(self, kind, var, source, pred):
        c, t = self._items(source)
        return values.quantifier(kind, c, lambda x: self.child(**{var: (x, t)}).boolean(pred))

    def _reduce(self, acc, init, var, source, body):
        c, t = self._items(source)
        start, ts = self.typed(init)
        result = self.child(**{acc: (F.lit(None).cast(ts), ts), var: (F.lit(None).cast(t), t)}).type(body)
        return F.aggregate(c, start.cast(result), lambda a, x: self.child(**{acc: (a, result), var: (x, t)}).column(body).cast(result))

    def _over(self, call, partition, order):
        _, name, args, distinct = call
        star = bool(args) and args[0] == ("star",)
        cols = [] if star else [self.column(a) for a in args]
        types = [] if star else [self.type(a) for a in args]
        literals = [a[1] if a[0] == "lit" else self.ctx.params.get(a[1]) if a[0] == "param" else None for a in args]
        keys = [values.order(self.column(e), self.type(e), down) for e, down in order]
        if name in self.ctx.windows:
            return self.ctx.windows[name](cols, *aggregate.windows([self.column(p) for p in partition], keys))
        return aggregate.window(name, cols, types, distinct, star, [self.column(p) for p in partition], keys, literals)

    def _fn(self, name, args, distinct):
        ctx = self.ctx
        if name in ctx.macros:
            params, body = ctx.macros[name]
            return self.column(substitute(body, dict(zip(params, args, strict=True))))
        if name in ("id", "elementid") and args[0][0] == "var" and args[0][1] in self.state.scope and args[0][1] not in self.local:
            c = F.col(self.state.scope[args[0][1]].ident)
            return c if name == "id" else c.cast("string")
        if name in ("id", "elementid"):
            c, t = self.typed(args[0])
            c = c["_vid" if "_vid" in t.fieldNames() else "_eid"]
            return c if name == "id" else c.cast("string")
        if name == "type":
            entry = self.state.scope.get(args[0][1]) if args[0][0] == "var" else None
            return F.col(entry.labels) if entry and args[0][1] not in self.local else self.column(args[0])["_type"]
        if name == "labels":
            entry = self.state.scope.get(args[0][1]) if args[0][0] == "var" else None
            return F.col(entry.labels) if entry and args[0][1] not in self.local and entry.kind == "node" else self.column(args[0])["_labels"]
        if name == "haslabel":
            return self._haslabel(args[0], [args[1][1]])
        if name in ("startnode", "endnode"):
            entry = self.state.scope[args[0][1]]
            return F.struct(F.col(entry.src if name == "startnode" else entry.dst).alias("_vid"))
        if name == "uni.temporal.validat" and len(args) == 4:
            ent, start, end, at = args
            start, end = (self._prop(ent, x[1]) if x[0] == "lit" else self.column(x) for x in (start, end))
            return SCALAR[name]([start, end, self.column(at)], [])
        if name == "vector_distance" or name == "uni.vector.distance":
            metric = args[2][1] if len(args) > 2 else "cosine"
            return distance(self.column(args[0]), self.column(args[1]), metric)
        if name == "similar_to":
            return self._similar_to(args)
        if name == "collate":
            if args[1][0] != "lit":
                raise CompileError("a collation is named by a literal")
            return F.collate(self.column(args[0]), collation(args[1][1], self.ctx.collations))
        if name == "nodes" and args[0][0] == "var":
            return self.column(args[0])["nodes"]
        if name in aggregate.AGGREGATES or name in ctx.aggregates:
            return self._aggregate(name, args, distinct)
        if name in ctx.functions:
            cols = [self.column(a) for a in args]
            return ctx.functions[name](cols, [self.type(a) for a in args])
        if name == "btic" and len(args) == 1 and args[0][0] == "lit":
            from ..functions.btic import literal as btic_literal

            return btic_literal(args[0][1])
        if name == "apoc.create.uuids":
            return F.transform(F.sequence(F.lit(1), self.column(args[0]).cast("int")), lambda _: F.call_function("uuid"))
        if name not in SCALAR:
            raise CompileError(f"unknown function {name}")
        cols = [self.column(a) for a in args]
        return SCALAR[name](cols, [self.type(a) for a in args])

    def _similar_to(self, args):
        """Cosine score, or the mean of those of several sources."""
        if args[0][0] == "list" and args[1][0] == "list":
            pairs = list(zip(args[0][1], args[1][1], strict=True))
            if self.ctx.warnings is not None and len(pairs) > 1:
                self.ctx.warnings.append("several sources of one row are fused by their mean: ranks need all rows")
            scores = [similarity(distance(self.column(a), self.column(b), "cosine"), "cosine") for a, b in pairs]
            return sum(scores[1:], scores[0]) / len(scores)
        return similarity(distance(self.column(args[0]), self.column(args[1]), "cosine"), "cosine")

    def _aggregate(self, name, args, distinct):
        star = args[0] == ("star",)
        if name in self.ctx.aggregates:
            return self.ctx.aggregates[name]([self.column(a) for a in args])
        if star:
            return aggregate.build(name, [], [], distinct, True)
        cols, types = [], []
        for a in args:
            if a[0] == "var" and a[1] in self.state.scope and a[1] not in self.local and self.state.scope[a[1]].kind != "value" and name == "count":
                cols.append(F.col(self.state.scope[a[1]].ident))
                types.append(T.LongType())
            else:
                cols.append(self.column(a))
                types.append(self.type(a))
        return aggregate.build(name, cols, types, distinct)


def F_type(v) -> T.DataType:
    return T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()


def literal(v) -> Column:
    """A Python value as a column; integers are longs, dicts structs."""
    if isinstance(v, bool) or v is None:
        return F.lit(v)
    if isinstance(v, int):
        return F.lit(v).cast("long")
    if isinstance(v, (list, tuple)):
        return F.array(*[literal(x) for x in v]) if v else F.array().cast("array<void>")
    if isinstance(v, dict):
        return F.struct(*[literal(x).alias(k) for k, x in v.items()])
    return F.lit(v)


def substitute(e, names: dict):
    """The expression with names and $names replaced."""
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] in ("var", "param") and e[1] in names:
            return names[e[1]]
        return tuple(substitute(x, names) for x in e)
    if isinstance(e, list):
        return [substitute(x, names) for x in e]
    return e


def has_aggregate(e, ctx: Context) -> bool:
    if not isinstance(e, tuple) or not e:
        return isinstance(e, list) and any(has_aggregate(x, ctx) for x in e)
    if e[0] == "over" or e[0] == "subquery":
        return False
    if e[0] == "fn" and (e[1] in aggregate.AGGREGATES or e[1] in ctx.aggregates):
        return True
    return any(has_aggregate(x, ctx) for x in e if isinstance(x, (tuple, list)))
