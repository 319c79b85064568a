"""Comparison, arithmetic and list semantics that differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FLOATING


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_duration(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == ["months", "days", "nanos"]


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def text_of(c: Column, t: T.DataType) -> Column:
    """Rendering of a value in a string; whole floats keep their ``.0``."""
    if isinstance(t, T.BooleanType):
        return F.when(c, "true").when(~c, "false")
    if is_duration(t):
        return duration_text(c)
    if isinstance(t, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if is_temporal(t):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def compare(sign: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """Three-valued comparison; NaN equals nothing and is neither less nor greater."""
    if isinstance(ta, T.StructType) and {"_vid"} <= set(ta.fieldNames()) and isinstance(tb, T.StructType):
        a, b = a["_vid"], b["_vid"]
        ta = tb = T.LongType()
    if isinstance(ta, T.NullType) or isinstance(tb, T.NullType):
        return F.lit(None).cast("boolean")
    if is_temporal(ta) and isinstance(tb, T.StringType):
        b = b.cast(ta)
    elif is_temporal(tb) and isinstance(ta, T.StringType):
        a = a.cast(tb)
    elif not comparable(ta, tb):
        if sign == "=":
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(False))
        if sign == "<>":
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(True))
        return F.lit(None).cast("boolean")
    if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType) and sign in ("=", "<>"):
        inner = F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
        equal = F.when(F.size(a) != F.size(b), F.lit(False)).when(inner, F.lit(None).cast("boolean")).otherwise(a == b)
        return equal if sign == "=" else ~equal
    out = {"=": a == b, "<>": a != b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[sign]
    nan = [F.isnan(x) for x, t in ((a, ta), (b, tb)) if isinstance(t, (T.FloatType, T.DoubleType))]
    if nan:
        any_nan = nan[0] if len(nan) == 1 else nan[0] | nan[1]
        out = F.when(any_nan, F.lit(sign == "<>")).otherwise(out)
    return out


def comparable(ta: T.DataType, tb: T.DataType) -> bool:
    if is_numeric(ta) and is_numeric(tb):
        return True
    if is_temporal(ta) and is_temporal(tb):
        return True
    if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
        return isinstance(ta.elementType, T.NullType) or isinstance(tb.elementType, T.NullType) or comparable(ta.elementType, tb.elementType)
    return type(ta) is type(tb)


def arithmetic(sign: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """``+`` joins strings and lists, ``/`` of integers is integer division, ``^`` is always a float."""
    null_a, null_b = isinstance(ta, T.NullType), isinstance(tb, T.NullType)
    if null_a or null_b:
        other = tb if null_a else ta
        return F.lit(None).cast(other if not isinstance(other, T.NullType) else "string")
    if sign == "+":
        if isinstance(ta, T.ArrayType) and isinstance(tb, T.ArrayType):
            return F.concat(a, b)
        if isinstance(ta, T.ArrayType):
            return F.when(a.isNotNull(), F.concat(a, F.array(b.cast(ta.elementType))))
        if isinstance(tb, T.ArrayType):
            return F.when(b.isNotNull(), F.concat(F.array(a.cast(tb.elementType)), b))
        if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
            return F.concat(text_of(a, ta), text_of(b, tb))
    if is_duration(ta) or is_duration(tb):
        return _temporal(sign, a, b, ta, tb)
    if not (is_numeric(ta) and is_numeric(tb)):
        raise CompileError(f"operands of {sign} must be numbers: {ta.simpleString()}, {tb.simpleString()}")
    if sign == "^":
        return F.pow(a.cast("double"), b.cast("double"))
    integral = isinstance(ta, INTEGRAL) and isinstance(tb, INTEGRAL)
    if integral:
        a, b = a.cast("long"), b.cast("long")
    if sign == "/":
        if not integral:  # a float divided by zero is infinite or not a number, as floats are
            a, b = a.cast("double"), b.cast("double")
            return F.when(b == 0, F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))).otherwise(F.try_divide(a, b))
        return F.call_function("div", a, b)
    if sign == "%":
        return a % b
    return {"+": a + b, "-": a - b, "*": a * b}[sign]


def duration(months, days, nanos) -> Column:
    return F.struct(F.lit(months).cast("long").alias("months") if not isinstance(months, Column) else months.cast("long").alias("months"), (days if isinstance(days, Column) else F.lit(days)).cast("long").alias("days"), (nanos if isinstance(nanos, Column) else F.lit(nanos)).cast("long").alias("nanos"))


def _temporal(sign: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    if is_duration(ta) and is_duration(tb):
        s = 1 if sign == "+" else -1
        return F.when(a.isNotNull() & b.isNotNull(), duration(a["months"] + b["months"] * s, a["days"] + b["days"] * s, a["nanos"] + b["nanos"] * s))
    if is_duration(ta) and is_numeric(tb) and sign in "*/":
        f = (lambda x: F.call_function("div", x * 1, b.cast("long"))) if sign == "/" else (lambda x: (x * b).cast("long"))
        return duration(f(a["months"]), f(a["days"]), f(a["nanos"]))
    if is_duration(tb) and is_numeric(ta) and sign == "*":
        return _temporal("*", b, a, tb, ta)
    if is_duration(tb) and is_temporal(ta) and sign in "+-":
        s = 1 if sign == "+" else -1
        interval = F.make_dt_interval((b["days"] * s).cast("int"), F.lit(0), F.lit(0), (b["nanos"] * s / 1e9).cast("decimal(18,6)"))
        moved = F.add_months(a.cast("date"), (b["months"] * s).cast("int"))
        if isinstance(ta, T.DateType):
            return F.date_add(moved, (b["days"] * s + F.call_function("div", b["nanos"] * s, F.lit(86_400_000_000_000))).cast("int"))
        time_of_day = a.cast("timestamp_ntz") - F.date_trunc("day", a).cast("timestamp_ntz")
        return (moved.cast("timestamp_ntz") + time_of_day + interval).cast(ta)
    if is_duration(ta) and is_temporal(tb) and sign == "+":
        return _temporal("+", b, a, tb, ta)
    raise CompileError(f"no {sign} for {ta.simpleString()} and {tb.simpleString()}")


def duration_text(c: Column) -> Column:
    """ISO 8601 text of a duration."""
    div = lambda x, n: F.call_function("div", x, F.lit(n))
    seconds = div(c["nanos"], 1_000_000_000)
    rest = c["nanos"] % 1_000_000_000
    part = lambda x, unit: F.when(x != 0, F.concat(x.cast("string"), F.lit(unit))).otherwise("")
    date = F.concat(part(div(c["months"], 12), "Y"), part(c["months"] % 12, "M"), part(c["days"], "D"))
    fraction = F.when(rest != 0, F.concat(F.lit("."), F.rtrim(F.lpad(F.abs(rest).cast("string"), 9, "0"), F.lit("0")))).otherwise("")
    s = seconds % 60
    sec = F.when((s != 0) | (rest != 0), F.concat(F.when((s == 0) & (rest < 0), "-").otherwise(""), s.cast("string"), fraction, F.lit("S"))).otherwise("")
    time = F.concat(part(div(seconds, 3600), "H"), part(div(seconds, 60) % 60, "M"), sec)
    out = F.concat(F.lit("P"), date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(c.isNotNull(), F.when(out == "P", "PT0S").otherwise(out))


def member(a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
    """``IN``: false for an empty list, otherwise three-valued."""
    if isinstance(tb, T.NullType):
        return F.lit(None).cast("boolean")
    if not isinstance(tb, T.ArrayType):
        raise CompileError("IN needs a list")
    if isinstance(tb.elementType, T.NullType):
        return F.when(F.size(b) == 0, F.lit(False))
    if isinstance(ta, T.NullType):
        return F.when(F.size(b) == 0, F.lit(False))
    if not comparable(ta, tb.elementType):
        return F.when(F.size(b) == 0, F.lit(False)).when(a.isNull() | F.exists(b, lambda x: x.isNull()), F.lit(None).cast("boolean")).otherwise(F.when(b.isNotNull(), F.lit(False)))
    return F.when(F.size(b) == 0, F.lit(False)).otherwise(F.exists(b, lambda x: compare("=", a, x, ta, tb.elementType)))


def quantifier(kind: str, source: Column, pred) -> Column:
    """ALL, ANY, SINGLE and NONE, three-valued."""
    if kind == "any":
        return F.exists(source, pred)
    if kind == "all":
        return F.forall(source, pred)
    if kind == "none":
        return ~F.exists(source, pred)
    true = F.size(F.filter(source, pred))
    unknown = F.size(F.filter(source, lambda x: pred(x).isNull()))
    return F.when(true > 1, F.lit(False)).when(source.isNull() | (unknown > 0), F.lit(None).cast("boolean")).otherwise(true == 1)


def index(source: Column, at: Column, t: T.DataType) -> Column:
    """0-based element, negative from the end, null beyond; or the value of a key."""
    if isinstance(t, T.ArrayType):
        at = at.cast("int")
        return F.try_element_at(source, F.when(at >= 0, at + 1).otherwise(at))
    if isinstance(t, T.MapType):
        return F.try_element_at(source, at)
    raise CompileError("only lists and maps can be indexed")


def part(source: Column, low: Column | None, high: Column | None) -> Column:
    """0-based half-open slice; negative bounds count from the end."""
    n = F.size(source)
    fix = lambda x: F.when(x < 0, F.greatest(n + x, F.lit(0))).otherwise(F.least(x, n))
    a = fix(low.cast("int")) if low is not None else F.lit(0)
    b = fix(high.cast("int")) if high is not None else n
    known = F.lit(True)
    for x in (low, high):
        known = known & x.isNotNull() if x is not None else known
    return F.when(known & source.isNotNull(), F.slice(source, a + 1, F.greatest(b - a, F.lit(0))))


RANK = {"map": 0, "node": 1, "rel": 2, "list": 3, "path": 4, "string": 5, "boolean": 6, "temporal": 7, "number": 8}


def order(c: Column, t: T.DataType, down: bool) -> Column:
    """Sort key with null last when ascending and first when descending; NaN is the largest number."""
    if isinstance(t, T.MapType):
        c = F.to_json(c)
    elif isinstance(t, T.StructType) and "_vid" in t.fieldNames():
        c = c["_vid"]
    return c.desc_nulls_first() if down else c.asc_nulls_last()
