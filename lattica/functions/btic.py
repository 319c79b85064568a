"""Time intervals of stated granularity and certainty: structs (lo, hi, meta) of milliseconds, half-open.

``meta`` holds the granularity of lo and hi (4 bits each) and the certainty of lo and hi (2 bits each). Text forms: ``1985``,
``1985-03``, ``1985-03-15``, with ``/`` between bounds (an empty bound is open), ``~`` for approximate, ``?`` for uncertain, BCE years with ``BCE``.
"""

from __future__ import annotations

import re

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError

OPEN_LO, OPEN_HI = -(2**63), 2**63 - 1
GRANULARITY = ["millisecond", "second", "minute", "hour", "day", "month", "quarter", "year", "decade", "century", "millennium"]
CERTAINTY = ["definite", "approximate", "uncertain", "unknown"]
DAY_MS = 86_400_000
STRUCT = T.StructType([T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("meta", T.LongType())])


def days_from_civil(y: int, m: int, d: int) -> int:
    """Days since 1970-01-01 of a date in the proleptic calendar with a year 0."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


_BOUND = re.compile(r"^(?P<mark>[~?]?)\s*(?P<y>-?\d{1,6})(?:-(?P<m>\d{2})(?:-(?P<d>\d{2})(?:T(?P<h>\d{2})(?::(?P<mi>\d{2})(?::(?P<s>\d{2})(?:\.(?P<f>\d{1,3}))?)?)?Z?)?)?)?(?P<decade>0s)?\s*(?P<era>BCE|BC|CE|AD)?$", re.IGNORECASE)


def _bound(text: str) -> tuple[int, int, int, int]:
    """(lo, hi, granularity, certainty) of one bound."""
    m = _BOUND.match(text.strip())
    if not m:
        raise ValueError(f"not an interval bound: {text!r}")
    certainty = {"": 0, "~": 1, "?": 2}[m["mark"]]
    year = int(m["y"])
    if (m["era"] or "").upper() in ("BCE", "BC"):
        year = 1 - year
    if m["m"] is None:
        return days_from_civil(year, 1, 1) * DAY_MS, days_from_civil(year + 1, 1, 1) * DAY_MS, 7, certainty
    month = int(m["m"])
    if not 1 <= month <= 12:
        raise ValueError(f"no such month: {text!r}")
    after = (year + month // 12, month % 12 + 1)
    if m["d"] is None:
        return days_from_civil(year, month, 1) * DAY_MS, days_from_civil(*after, 1) * DAY_MS, 5, certainty
    day = int(m["d"])
    start = days_from_civil(year, month, day)
    if not days_from_civil(year, month, 1) <= start < days_from_civil(*after, 1):
        raise ValueError(f"no such day: {text!r}")
    lo = start * DAY_MS
    if m["h"] is None:
        return lo, lo + DAY_MS, 4, certainty
    lo += int(m["h"]) * 3_600_000
    if m["mi"] is None:
        return lo, lo + 3_600_000, 3, certainty
    lo += int(m["mi"]) * 60_000
    if m["s"] is None:
        return lo, lo + 60_000, 2, certainty
    lo += int(m["s"]) * 1000
    if m["f"] is None:
        return lo, lo + 1000, 1, certainty
    lo += int(m["f"].ljust(3, "0"))
    return lo, lo + 1, 0, certainty


def parse(text: str | None) -> tuple[int, int, int] | None:
    """(lo, hi, meta) of an interval's text; null for null."""
    if text is None:
        return None
    left, slash, right = text.partition("/")
    if not slash:
        lo, hi, g, c = _bound(left)
        return lo, hi, g | g << 4 | c << 8 | c << 10
    lo, g1, c1 = OPEN_LO, 0, 0
    hi, g2, c2 = OPEN_HI, 0, 0
    if left.strip():
        lo, _, g1, c1 = _bound(left)
    if right.strip():
        _, hi, g2, c2 = _bound(right)
    if hi <= lo:
        raise ValueError(f"an interval must not end before it starts: {text!r}")
    return lo, hi, g1 | g2 << 4 | c1 << 8 | c2 << 10


def literal(text: str) -> Column:
    lo, hi, meta = parse(text)
    return F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(meta).cast("long").alias("meta"))


def parse_column(c: Column) -> Column:
    """Intervals of a column of texts, in Arrow batches; a malformed text gives null."""

    @F.pandas_udf(STRUCT)
    def run(texts: pd.Series) -> pd.DataFrame:
        def one(x):
            try:
                return parse(x) or (None, None, None)
            except (ValueError, TypeError):
                return (None, None, None)

        return pd.DataFrame([one(x) for x in texts], columns=["lo", "hi", "meta"]).astype("Int64")

    parsed = run(c)
    return F.when(parsed["lo"].isNotNull(), parsed)


def _btic(args, types):
    if len(args) == 1:
        return parse_column(args[0])
    if len(args) == 2:
        return F.struct(args[0].cast("long").alias("lo"), args[1].cast("long").alias("hi"), F.lit(0).cast("long").alias("meta"))
    raise CompileError("btic takes a text, or two bounds in milliseconds")


def _name(names, shift):
    def build(args, types):
        mask = 15 if names is GRANULARITY else 3
        return F.try_element_at(F.array(*[F.lit(n) for n in names]), (F.shiftright(args[0]["meta"], shift).bitwiseAND(F.lit(mask)) + 1).cast("int"))

    return build


def register_all(table: dict) -> None:
    two = lambda f: lambda args, types: f(args[0], args[1])
    meet = lambda a, b: F.struct(F.greatest(a["lo"], b["lo"]).alias("lo"), F.least(a["hi"], b["hi"]).alias("hi"), F.when(a["lo"] >= b["lo"], a["meta"]).otherwise(b["meta"]).alias("meta"))
    table |= {
        "btic": _btic,
        "btic_lo": lambda a, t: a[0]["lo"],
        "btic_hi": lambda a, t: a[0]["hi"],
        "btic_duration": lambda a, t: F.when((a[0]["lo"] != OPEN_LO) & (a[0]["hi"] != OPEN_HI), F.try_subtract(a[0]["hi"], a[0]["lo"])),
        "btic_granularity": _name(GRANULARITY, 0),
        "btic_lo_granularity": _name(GRANULARITY, 0),
        "btic_hi_granularity": _name(GRANULARITY, 4),
        "btic_certainty": _name(CERTAINTY, 8),
        "btic_lo_certainty": _name(CERTAINTY, 8),
        "btic_hi_certainty": _name(CERTAINTY, 10),
        "btic_is_instant": lambda a, t: F.coalesce(F.try_subtract(a[0]["hi"], a[0]["lo"]) == 1, F.lit(False)),
        "btic_is_unbounded": lambda a, t: (a[0]["lo"] == OPEN_LO) | (a[0]["hi"] == OPEN_HI),
        "btic_is_finite": lambda a, t: (a[0]["lo"] != OPEN_LO) & (a[0]["hi"] != OPEN_HI),
        "btic_contains_point": lambda a, t: (a[0]["lo"] <= a[1].cast("long")) & (a[1].cast("long") < a[0]["hi"]),
        "btic_overlaps": two(lambda a, b: (a["lo"] < b["hi"]) & (b["lo"] < a["hi"])),
        "btic_contains": two(lambda a, b: (a["lo"] <= b["lo"]) & (b["hi"] <= a["hi"])),
        "btic_before": two(lambda a, b: a["hi"] <= b["lo"]),
        "btic_after": two(lambda a, b: a["lo"] >= b["hi"]),
        "btic_meets": two(lambda a, b: a["hi"] == b["lo"]),
        "btic_adjacent": two(lambda a, b: (a["hi"] == b["lo"]) | (b["hi"] == a["lo"])),
        "btic_disjoint": two(lambda a, b: (a["hi"] <= b["lo"]) | (b["hi"] <= a["lo"])),
        "btic_equals": two(lambda a, b: (a["lo"] == b["lo"]) & (a["hi"] == b["hi"])),
        "btic_starts": two(lambda a, b: (a["lo"] == b["lo"]) & (a["hi"] < b["hi"])),
        "btic_during": two(lambda a, b: (a["lo"] > b["lo"]) & (a["hi"] < b["hi"])),
        "btic_finishes": two(lambda a, b: (a["hi"] == b["hi"]) & (a["lo"] > b["lo"])),
        "btic_intersection": two(lambda a, b: F.when((a["lo"] < b["hi"]) & (b["lo"] < a["hi"]), meet(a, b))),
        "btic_span": two(lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a["lo"], b["lo"]).alias("lo"), F.greatest(a["hi"], b["hi"]).alias("hi"), a["meta"].alias("meta")))),
        "btic_gap": two(lambda a, b: F.when(a["hi"] < b["lo"], F.struct(a["hi"].alias("lo"), b["lo"].alias("hi"), a["meta"].alias("meta"))).when(b["hi"] < a["lo"], F.struct(b["hi"].alias("lo"), a["lo"].alias("hi"), a["meta"].alias("meta")))),
    }
