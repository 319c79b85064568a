"""Aggregate and window functions of the query language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError
from .values import INTEGRAL, is_numeric

AGGREGATES = {"count", "sum", "avg", "min", "max", "collect", "percentiledisc", "percentilecont", "stdev", "stdevp", "variance", "variancep", "btic_min", "btic_max", "btic_span_agg", "btic_count_at"}
WINDOWS = {"row_number", "rank", "dense_rank", "lag", "lead", "ntile", "first_value", "last_value", "nth_value", "percent_rank", "cume_dist"}


def _numeric(name: str, t: T.DataType) -> None:
    if not is_numeric(t) and not isinstance(t, T.NullType):
        raise CompileError(f"{name} takes numbers, not {t.simpleString()}")


def build(name: str, args: list[Column], types: list[T.DataType], distinct: bool, star: bool = False) -> Column:
    """The column of an aggregate call."""
    if star:
        return F.count(F.lit(1))
    c, t = args[0], types[0]
    if isinstance(t, T.StructType) and "_vid" in t.fieldNames() and name == "count":
        c = c["_vid"]
    if name == "count":
        return F.countDistinct(c) if distinct else F.count(c)
    if name == "sum":
        _numeric(name, t)
        if isinstance(t, INTEGRAL):  # beyond 64 bits the sum goes on as a float
            exact = F.try_sum(c) if not distinct else F.sum_distinct(c)
            return F.coalesce(exact, F.lit(0).cast("long")) if distinct else F.coalesce(exact, F.when(F.count(c) == 0, F.lit(0).cast("long")).otherwise(F.sum(c.cast("double")).try_cast("long")))
        return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), F.lit(0.0))
    if name == "avg":
        if isinstance(t, T.StructType) and "months" in t.fieldNames():
            return F.struct(*[F.avg(c[f]).cast("long").alias(f) for f in ("months", "days", "nanos")])
        _numeric(name, t)
        c = c.cast("double")
        return F.sum_distinct(c) / F.nullif(F.countDistinct(c), F.lit(0)) if distinct else F.avg(c)
    if name in ("min", "max"):
        return F.min(c) if name == "min" else F.max(c)
    if name == "collect":
        return F.collect_set(c) if distinct else F.collect_list(c)
    if name in ("stdev", "stdevp", "variance", "variancep"):
        _numeric(name, t)
        f = {"stdev": F.stddev_samp, "stdevp": F.stddev_pop, "variance": F.var_samp, "variancep": F.var_pop}[name]
        return F.coalesce(f(c.cast("double")), F.when(F.count(c) > 0, F.lit(0.0)), F.lit(0.0))
    if name == "percentilecont":
        _numeric(name, t)
        return F.percentile(c.cast("double"), args[1])
    if name == "percentiledisc":
        _numeric(name, t)
        ordered = F.array_sort(F.collect_list(c))
        at = F.round(args[1].cast("double") * (F.size(ordered) - 1)).cast("int")
        return F.when(F.size(ordered) > 0, F.try_element_at(ordered, at + 1))
    if name in ("btic_min", "btic_max"):
        return F.min(c) if name == "btic_min" else F.max(c)
    if name == "btic_span_agg":
        return F.when(F.count(c) > 0, F.struct(F.min(c["lo"]).alias("lo"), F.max(c["hi"]).alias("hi"), F.min(c["meta"]).alias("meta")))
    if name == "btic_count_at":
        return F.count_if((c["lo"] <= args[1].cast("long")) & (args[1].cast("long") < c["hi"]))
    raise CompileError(f"unknown aggregate {name}")


def windows(partition: list[Column], order: list[Column]):
    """The window up to a row, and that over its whole partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))
    ordered = w.orderBy(*order) if order else w.orderBy(F.lit(1))
    return ordered, ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def window(name: str, args: list[Column], types: list[T.DataType], distinct: bool, star: bool, partition: list[Column], order: list[Column], literals: list) -> Column:
    """A call with OVER; last_value and nth_value see the whole partition."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(1))
    ordered, whole = windows(partition, order)
    if name in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
        return getattr(F, name)().over(ordered)
    if name in ("lag", "lead"):
        f = F.lag if name == "lag" else F.lead
        return f(args[0], int(literals[1]) if len(args) > 1 else 1, literals[2] if len(args) > 2 else None).over(ordered)
    if name == "ntile":
        if int(literals[0]) < 1:
            raise CompileError("ntile needs a positive number")
        return F.ntile(int(literals[0])).over(ordered)
    if name == "first_value":
        return F.first(args[0]).over(whole)
    if name == "last_value":
        return F.last(args[0]).over(whole)
    if name == "nth_value":
        return F.nth_value(args[0], int(literals[1])).over(whole)
    frame = w.orderBy(*order) if order else w
    if distinct and name in ("count", "sum"):
        seen = F.collect_set(args[0]).over(frame)
        return F.size(seen).cast("long") if name == "count" else F.aggregate(seen, F.lit(0).cast(types[0]), lambda s, x: (s + x).cast(types[0]))
    if name == "sum":
        return F.sum(args[0]).over(frame)
    if name in ("count", "avg", "min", "max", "collect", "stdev", "stdevp", "variance", "variancep"):
        simple = {"count": lambda: F.count(F.lit(1)) if star else F.count(args[0]), "avg": lambda: F.avg(args[0].cast("double")), "min": lambda: F.min(args[0]), "max": lambda: F.max(args[0]), "collect": lambda: F.collect_list(args[0]), "stdev": lambda: F.stddev_samp(args[0]), "stdevp": lambda: F.stddev_pop(args[0]), "variance": lambda: F.var_samp(args[0]), "variancep": lambda: F.var_pop(args[0])}
        return simple[name]().over(frame)
    raise CompileError(f"{name} isn't a window function")
