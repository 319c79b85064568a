"""Primitives of graph programs as functions over DataFrames: frontiers and values by vertex id.

A set is a table (id), a value table (id, v), edges are those of a :class:`lattica.operators.graphs.Projection`. Each is one lazy
plan; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CompileError
from .graphs import Projection, degrees, similar_vertices

__all__ = ["arg_reduce", "compare", "degrees", "difference", "ewise", "expand", "frontier", "intersection", "mask", "neighbourhood_overlap", "normalise", "reduce_values", "sample_edges", "scatter", "segmented_reduce", "spmv", "top", "union"]

EWISE = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: F.try_divide(a, b), "min": F.least, "max": F.greatest}
COMPARE = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b}
REDUCE = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "count": F.count, "any": F.bool_or, "all": F.bool_and}


def _one(table: dict, name: str):
    if name not in table:
        raise CompileError(f"unknown operation {name}; there are {', '.join(sorted(table))}")
    return table[name]


def frontier(p: Projection, condition: Column | None = None) -> DataFrame:
    """The vertices (id) of a projection, those that meet a condition over ``id``."""
    ids = p.ids.select("id").distinct()
    return ids if condition is None else ids.where(condition)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").unionAll(b.select("id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").distinct().join(b.select("id"), "id", "left_anti")


def ewise(a: DataFrame, b: DataFrame, operation: str, missing: float | None = None) -> DataFrame:
    """(id, v): an operation on the values of equal ids; with ``missing`` an id of one side alone meets that value."""
    f = _one(EWISE, operation)
    joined = a.select("id", F.col("v").alias("_a")).join(b.select("id", F.col("v").alias("_b")), "id", "inner" if missing is None else "full")
    side = lambda c: F.col(c) if missing is None else F.coalesce(c, F.lit(missing))
    return joined.select("id", f(side("_a"), side("_b")).alias("v"))


def compare(a: DataFrame, operation: str, other: DataFrame | float) -> DataFrame:
    """(id, v BOOLEAN): a comparison with another table's values or a constant."""
    f = _one(COMPARE, operation)
    if not isinstance(other, DataFrame):
        return a.select("id", f(F.col("v"), F.lit(other)).alias("v"))
    return a.select("id", F.col("v").alias("_a")).join(other.select("id", F.col("v").alias("_b")), "id").select("id", f(F.col("_a"), F.col("_b")).alias("v"))


def mask(values: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """The values of a set's vertices, or of all others."""
    return values.join(ids.select("id").distinct(), "id", "left_semi" if keep else "left_anti")


def scatter(values: DataFrame, updates: DataFrame) -> DataFrame:
    """Values with those of ``updates`` in their place; new ids are added."""
    return values.join(updates.select("id"), "id", "left_anti").select("id", "v").unionByName(updates.select("id", "v"))


def normalise(values: DataFrame, norm: str = "l1") -> DataFrame:
    """Values divided by their l1, l2 or max norm; a norm of 0 leaves them."""
    total = {"l1": F.sum(F.abs("v")), "l2": F.sqrt(F.sum(F.col("v") * F.col("v"))), "max": F.max(F.abs("v"))}
    whole = values.agg(_one(total, norm).alias("_n"))  # one row
    return values.crossJoin(F.broadcast(whole)).select("id", F.when(F.col("_n") > 0, F.col("v") / F.col("_n")).otherwise(F.col("v")).alias("v"))


def reduce_values(values: DataFrame, operation: str = "sum") -> DataFrame:
    """One row (v): all values folded."""
    return values.agg(_one(REDUCE, operation)("v").alias("v"))


def arg_reduce(values: DataFrame, greatest: bool = True) -> DataFrame:
    """One row (id, v): the greatest or least value, of several the least id."""
    return values.orderBy(F.col("v").desc() if greatest else F.col("v").asc(), "id").limit(1)


def top(values: DataFrame, k: int) -> DataFrame:
    """The k greatest values, ties to the lesser id."""
    return values.orderBy(F.col("v").desc_nulls_last(), "id").limit(k)


def expand(p: Projection, ids: DataFrame, reverse: bool = False) -> DataFrame:
    """(id): vertices that an edge joins to one of the set."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    return p.edges.join(ids.select(F.col("id").alias("_i")).distinct(), F.col(near) == F.col("_i"), "left_semi").select(F.col(far).alias("id")).distinct()


def spmv(p: Projection, values: DataFrame, operation: str = "sum", combine: str = "mul") -> DataFrame:
    """(id, v): over in-edges the fold of the source's value combined with the weight (1 without one)."""
    message = _one(EWISE, combine)(F.col("v"), F.coalesce("w", F.lit(1.0)))
    return values.select("id", "v").join(p.edges, F.col("id") == F.col("src")).groupBy("dst").agg(_one(REDUCE, operation)(message).alias("v")).withColumnRenamed("dst", "id")


def segmented_reduce(values: DataFrame, segments: DataFrame, operation: str = "sum") -> DataFrame:
    """(id, v): values folded by the segment that (id, segment) gives a vertex; the segment is the new id."""
    return values.join(segments.select("id", "segment"), "id").groupBy("segment").agg(_one(REDUCE, operation)("v").alias("v")).withColumnRenamed("segment", "id")


def sample_edges(p: Projection, per_vertex: int, seed: int = 0) -> DataFrame:
    """At most ``per_vertex`` out-edges of each vertex, drawn by a hash: the same for the same seed."""
    w = Window.partitionBy("src").orderBy(F.xxhash64("eid", "dst", F.lit(seed)), "eid")
    return p.edges.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_vertex).drop("_r")


def neighbourhood_overlap(p: Projection, metric: str = "JACCARD", cutoff: float = 0.1, k: int = 10) -> DataFrame:
    """(node1, node2, similarity) of out-neighbourhoods."""
    return similar_vertices(p, metric, cutoff, k)
