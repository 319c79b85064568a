"""Scalar functions: name -> builder of a column from argument columns and their types."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from . import btic, spatial, temporal
from .values import INTEGRAL, is_numeric, text_of

Builder = Callable[[list[Column], list[T.DataType]], Column]
SCALAR: dict[str, Builder] = {}


def register(*names: str):
    def wrap(f: Builder) -> Builder:
        for name in names:
            SCALAR[name] = f
        return f

    return wrap


def simple(names: str, f: Callable[..., Column], numbers: bool = False, low: int = 1, high: int | None = None) -> None:
    """Register functions of columns alone; ``numbers``: arguments of other types are an error."""

    def build(args: list[Column], types: list[T.DataType]) -> Column:
        if not low <= len(args) <= (high or max(low, 1)):
            raise CompileError(f"{names.split()[0]} takes {low} to {high or low} arguments")
        if numbers and any(not is_numeric(t) and not isinstance(t, T.NullType) for t in types):
            raise CompileError(f"{names.split()[0]} takes numbers")
        return f(*args)

    for name in names.split():
        SCALAR[name] = build


d = lambda c: c.cast("double")

# --- text
simple("tolower lower apoc.text.tolower", F.lower)
simple("toupper upper apoc.text.toupper", F.upper)
simple("trim apoc.text.trim", F.trim)
simple("ltrim apoc.text.ltrim", F.ltrim)
simple("rtrim apoc.text.rtrim", F.rtrim)
simple("left", lambda s, n: F.left(s, n.cast("int")), low=2)
simple("right", lambda s, n: F.right(s, n.cast("int")), low=2)
simple("substring", lambda s, a, n=None: F.substring(s, a.cast("int") + 1, n.cast("int") if n is not None else F.greatest(F.length(s), F.lit(0))), low=2, high=3)
simple("replace apoc.text.replace", lambda s, a, b: F.replace(s, a, b), low=3)
simple("split", lambda s, by: F.split(s, F.concat(F.lit(r"\Q"), by, F.lit(r"\E"))), low=2)
simple("lpad", lambda s, n, by=None: F.lpad(s, n.cast("int"), by if by is not None else F.lit(" ")), low=2, high=3)
simple("rpad", lambda s, n, by=None: F.rpad(s, n.cast("int"), by if by is not None else F.lit(" ")), low=2, high=3)
simple("char_length character_length apoc.text.length", F.char_length)
simple("apoc.text.reverse", F.reverse)
simple("apoc.text.contains", lambda s, x: F.contains(s, x), low=2)
simple("apoc.text.startswith", lambda s, x: F.startswith(s, x), low=2)
simple("apoc.text.endswith", lambda s, x: F.endswith(s, x), low=2)
simple("apoc.text.repeat", lambda s, n: F.repeat(s, n.cast("int")), low=2)
simple("apoc.text.indexof", lambda s, x: (F.instr(s, x) - 1).cast("long"), low=2)

# --- numbers
simple("abs", F.abs, True)
simple("ceil ceiling", lambda x: F.ceil(d(x)).cast("double"), True)
simple("floor", lambda x: F.floor(d(x)).cast("double"), True)
simple("round apoc.math.round", lambda x, n=None: F.round(d(x), n.cast("int")) if n is not None else F.round(d(x)), True, 1, 2)
simple("sign", lambda x: F.signum(d(x)).cast("long"), True)
simple("sqrt", lambda x: F.when(d(x) < 0, F.lit(float("nan"))).otherwise(F.sqrt(d(x))), True)
simple("exp", lambda x: F.exp(d(x)), True)
simple("log ln", lambda x: F.when(d(x) > 0, F.ln(d(x))).when(d(x) == 0, F.lit(float("-inf"))).when(d(x) < 0, F.lit(float("nan"))), True)
simple("log10", lambda x: F.when(d(x) > 0, F.log10(d(x))).when(d(x) == 0, F.lit(float("-inf"))).when(d(x) < 0, F.lit(float("nan"))), True)
simple("pow power", lambda x, y: F.pow(d(x), d(y)), True, 2)
for _name in ("sin", "cos", "tan", "asin", "acos", "atan", "degrees", "radians", "tanh", "cosh", "sinh"):
    simple(_name, lambda x, f=getattr(F, _name): f(d(x)), True, 1, 1)
    if _name in ("tanh", "cosh", "sinh"):
        SCALAR["apoc.math." + _name] = SCALAR.pop(_name)
simple("atan2", lambda y, x: F.atan2(d(y), d(x)), True, 2)
simple("cot", lambda x: F.cot(d(x)), True)
simple("haversin", lambda x: (1 - F.cos(d(x))) / 2, True)
simple("apoc.math.sigmoid", lambda x: 1 / (1 + F.exp(-d(x))), True)
simple("apoc.math.coth", lambda x: F.when(d(x) != 0, F.cosh(d(x)) / F.sinh(d(x))), True)
SCALAR["pi"] = lambda a, t: F.lit(math.pi)
SCALAR["e"] = lambda a, t: F.lit(math.e)
SCALAR["rand"] = lambda a, t: F.rand()
SCALAR["randomuuid"] = SCALAR["apoc.create.uuid"] = lambda a, t: F.call_function("uuid")
SCALAR["apoc.math.maxlong"] = lambda a, t: F.lit(2**63 - 1)
SCALAR["apoc.math.minlong"] = lambda a, t: F.lit(-(2**63))
SCALAR["apoc.math.maxdouble"] = lambda a, t: F.lit(1.7976931348623157e308)
SCALAR["apoc.math.mindouble"] = lambda a, t: F.lit(4.9e-324)
simple("isnan", lambda x: F.isnan(d(x)), True)

# --- bits
for _prefix in ("bitwise_", "uni.bitwise.", "apoc.bitwise."):
    simple(_prefix + "and", lambda a, b: a.cast("long").bitwiseAND(b.cast("long")), True, 2)
    simple(_prefix + "or", lambda a, b: a.cast("long").bitwiseOR(b.cast("long")), True, 2)
    simple(_prefix + "xor", lambda a, b: a.cast("long").bitwiseXOR(b.cast("long")), True, 2)
    simple(_prefix + "not", lambda a: F.bitwise_not(a.cast("long")), True)
for _name in ("shift_left", "uni.bitwise.shiftleft", "apoc.bitwise.leftshift"):
    simple(_name, lambda a, n: F.call_function("shiftleft", a.cast("long"), n.cast("int")), True, 2)
for _name in ("shift_right", "uni.bitwise.shiftright", "apoc.bitwise.rightshift"):
    simple(_name, lambda a, n: F.call_function("shiftright", a.cast("long"), n.cast("int")), True, 2)


# --- conversion: bad input gives null, other types are an error
@register("tointeger", "tointegerornull", "apoc.convert.tointeger", "apoc.number.parseint")
def _to_integer(args, types):
    (c, *_), (t, *_) = args, types
    if isinstance(t, T.BooleanType):
        return c.cast("long")
    if isinstance(t, T.StringType):
        return F.coalesce(c.try_cast("long"), F.when(~F.isnan(c.try_cast("double")), c.try_cast("double").try_cast("long")))
    return c.try_cast("double").try_cast("long") if not isinstance(t, INTEGRAL) else c.cast("long")


@register("tofloat", "tofloatornull", "apoc.convert.tofloat", "apoc.number.parsefloat")
def _to_float(args, types):
    return args[0].try_cast("double")


@register("toboolean", "tobooleanornull", "apoc.convert.toboolean")
def _to_boolean(args, types):
    c, t = args[0], types[0]
    if isinstance(t, T.StringType):
        low = F.lower(F.trim(c))
        return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))
    return c.cast("boolean")


@register("tostring", "tostringornull", "apoc.convert.tostring", "apoc.number.tostring")
def _to_string(args, types):
    if isinstance(types[0], (T.MapType, T.ArrayType)):
        return F.to_json(args[0])
    return text_of(args[0], types[0])


@register("tojson", "apoc.convert.tojson")
def _to_json(args, types):
    return F.to_json(args[0])


# --- lists and maps
@register("size", "length")
def _size(args, types):
    c, t = args[0], types[0]
    if isinstance(t, T.StringType):
        return F.char_length(c).cast("long")
    if isinstance(t, T.StructType) and "relationships" in t.fieldNames():
        return F.when(c.isNotNull(), F.size(c["relationships"])).cast("long")
    if isinstance(t, (T.ArrayType, T.MapType)):
        return F.when(c.isNotNull(), F.size(c)).cast("long")
    if isinstance(t, T.NullType):
        return F.lit(None).cast("long")
    raise CompileError("size takes a list, a map, a string or a path")


simple("head", lambda x: F.try_element_at(x, F.lit(1)))
simple("last", lambda x: F.try_element_at(x, F.lit(-1)))
simple("tail", lambda x: F.when(x.isNotNull(), F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1)))))
simple("reverse", F.reverse)
simple("coalesce", F.coalesce, low=1, high=99)
simple("nullif", F.nullif, low=2)
simple("array_contains_any", F.arrays_overlap, low=2)
simple("array_contains_all", lambda a, b: F.size(F.array_except(b, a)) == 0, low=2)
simple("apoc.coll.toset", F.array_distinct)
simple("apoc.coll.sort", F.array_sort)
simple("apoc.coll.flatten", F.flatten)
simple("apoc.coll.union", F.array_union, low=2)
simple("apoc.coll.intersection", F.array_intersect, low=2)
simple("apoc.coll.subtract", F.array_except, low=2)
simple("apoc.coll.contains", lambda a, x: F.array_contains(a, x), low=2)
simple("apoc.coll.sum", lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")))
simple("apoc.coll.max", F.array_max)
simple("apoc.coll.min", F.array_min)


@register("range")
def _range(args, types):
    a, b = args[0].cast("long"), args[1].cast("long")
    step = args[2].cast("long") if len(args) > 2 else F.lit(1).cast("long")
    filled = F.when(step > 0, b >= a).otherwise(b <= a)
    # sequence() raises where the bounds run against the step, so they are moved together there
    return F.when(filled, F.sequence(a, F.when(filled, b).otherwise(a), step)).otherwise(F.array().cast("array<bigint>"))


@register("keys")
def _keys(args, types):
    c, t = args[0], types[0]
    if isinstance(t, T.MapType):
        return F.map_keys(c)
    if isinstance(t, T.StructType):
        names = [n for n in t.fieldNames() if not n.startswith("_")]
        return F.when(c.isNotNull(), F.filter(F.array(*[F.when(c[n].isNotNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull()) if names else F.array().cast("array<string>"))
    raise CompileError("keys takes a map or an entity")


@register("properties")
def _properties(args, types):
    t = types[0]
    if isinstance(t, T.StructType):
        return F.struct(*[args[0][n].alias(n) for n in t.fieldNames() if not n.startswith("_")])
    return args[0]


@register("nodes")
def _nodes(args, types):
    return args[0]["nodes"]


@register("relationships", "rels")
def _relationships(args, types):
    return args[0]["relationships"]


@register("typeof", "apoc.meta.type")
def _typeof(args, types):
    return F.lit(types[0].simpleString())


# --- vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distances; cosine of a zero vector is 1, l2 is squared."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric in ("l2", "euclidean"):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "dot":
        return -dot(a, b)
    if metric in ("l1", "manhattan"):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    if metric == "hamming":
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
    if metric == "jaccard":
        both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
        either = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseOR(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)
        return F.when(either == 0, F.lit(0.0)).otherwise(1 - both / F.nullif(either, F.lit(0.0)))
    raise CompileError(f"unknown metric {metric}")


def similarity(dist: Column, metric: str) -> Column:
    """Score of a distance: cosine (2-d)/2, l2 and others 1/(1+d), dot the product itself."""
    return (2 - dist) / 2 if metric == "cosine" else -dist if metric == "dot" else 1 / (1 + dist)


simple("vector_similarity uni.vector.similarity", cosine, low=2)
simple("sparse_similar_to", lambda a, b: sparse_dot(a, b), low=2)


def sparse_dot(a: Column, b: Column) -> Column:
    """Dot product of structs (indices, values)."""
    to_map = F.map_from_arrays(b["indices"], b["values"])
    pairs = F.zip_with(a["indices"], a["values"], lambda i, v: v.cast("double") * F.coalesce(F.try_element_at(to_map, i).cast("double"), F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


simple("l2_norm", lambda a: F.sqrt(F.aggregate(a["values"], F.lit(0.0), lambda s, x: s + x.cast("double") * x)), low=1)


@register("prune_top_k")
def _prune_top_k(args, types):
    """The k entries of largest weight of a sparse vector, by index; ties go to the smaller index."""
    pairs = F.zip_with(args[0]["indices"], args[0]["values"], lambda i, v: F.struct((-F.abs(v)).alias("w"), i.alias("i"), v.alias("v")))
    kept = F.array_sort(F.transform(F.slice(F.array_sort(pairs), F.lit(1), args[1].cast("int")), lambda x: F.struct(x["i"], x["v"])))
    return F.struct(F.transform(kept, lambda x: x["i"]).alias("indices"), F.transform(kept, lambda x: x["v"]).alias("values"))


# --- validity of periods, half-open
@register("uni.temporal.validat")
def _valid_at(args, types):
    start, end, at = args[-3], args[-2], args[-1]
    return (start <= at) & (end.isNull() | (end > at))


simple("uni.temporal.overlaps", lambda s, e, a, b: (s < b) & (e.isNull() | (e > a)), low=4)
simple("uni.temporal.precedes", lambda e, at: e.isNotNull() & (e <= at), low=2)
simple("uni.temporal.succeeds", lambda s, at: s >= at, low=2)
simple("uni.temporal.isongoing", lambda e: e.isNull())
simple("uni.temporal.hasclosed", lambda e: e.isNotNull())

temporal.register_all(SCALAR)
spatial.register_all(SCALAR)
btic.register_all(SCALAR)
