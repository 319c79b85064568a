"""Dates, times and durations. Durations are structs (months, days, nanos)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .values import duration, is_duration

NANOS = {"hours": 3_600_000_000_000, "minutes": 60_000_000_000, "seconds": 1_000_000_000, "milliseconds": 1_000_000, "microseconds": 1000, "nanoseconds": 1}


def _field(c, t: T.DataType, *names):
    for n in names:
        if isinstance(t, T.StructType) and n in t.fieldNames():
            return c[n]
    return None


def _from_map(c, t, time: bool):
    whole = lambda n, default: (_field(c, t, n) if _field(c, t, n) is not None else F.lit(default)).cast("int")
    if _field(c, t, "week") is not None:
        monday = F.date_add(F.date_trunc("week", F.make_date(whole("year", 1970), F.lit(1), F.lit(4))).cast("date"), (whole("week", 1) - 1) * 7)
        date = F.date_add(monday, whole("dayOfWeek", 1) - 1)
    elif _field(c, t, "ordinalDay") is not None:
        date = F.date_add(F.make_date(whole("year", 1970), F.lit(1), F.lit(1)), whole("ordinalDay", 1) - 1)
    elif _field(c, t, "quarter") is not None:
        date = F.date_add(F.make_date(whole("year", 1970), (whole("quarter", 1) - 1) * 3 + 1, F.lit(1)), whole("dayOfQuarter", 1) - 1)
    else:
        date = F.make_date(whole("year", 1970), whole("month", 1), whole("day", 1))
    if not time:
        return date
    nanos = whole("nanosecond", 0).cast("double") / 1e9 + whole("microsecond", 0).cast("double") / 1e6 + whole("millisecond", 0).cast("double") / 1e3
    return F.make_timestamp_ntz(F.year(date), F.month(date), F.dayofmonth(date), whole("hour", 0), whole("minute", 0), (whole("second", 0).cast("double") + nanos).cast("decimal(16,6)"))


def date(args, types):
    if not args:
        return F.current_date()
    c, t = args[0], types[0]
    if isinstance(t, T.StructType):
        return _from_map(c, t, False)
    if isinstance(t, T.StringType):
        compact = F.when(c.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))).when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01"))).when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).otherwise(c)
        return compact.cast("date")
    return c.cast("date")


def _stamp(args, types, kind):
    if not args:
        return F.current_timestamp().cast(kind)
    c, t = args[0], types[0]
    if isinstance(t, T.StructType):
        return _from_map(c, t, True).cast(kind)
    return c.cast(kind)


def datetime(args, types):
    return _stamp(args, types, "timestamp")


def localdatetime(args, types):
    return _stamp(args, types, "timestamp_ntz")


def localtime(args, types):
    """Time of day as text HH:mm:ss[.ffffff]."""
    c = F.current_timestamp().cast("timestamp_ntz") if not args else F.concat(F.lit("1970-01-01T"), args[0]).cast("timestamp_ntz") if isinstance(types[0], T.StringType) else _from_map(args[0], types[0], True) if isinstance(types[0], T.StructType) else args[0].cast("timestamp_ntz")
    return F.regexp_replace(F.date_format(c, "HH:mm:ss.SSSSSS"), r"\.?0{1,6}$", "")


def time(args, types):
    """The same with the zone that a text gives, Z or +hh:mm."""
    if not args or not isinstance(types[0], T.StringType):
        return localtime(args, types)
    zone = F.regexp_extract(args[0], r"(Z|[+-]\d\d(?::?\d\d)?)$", 1)
    return F.concat(localtime([F.regexp_replace(args[0], r"(Z|[+-]\d\d(?::?\d\d)?)$", "")], types), zone)


def of_duration(args, types):
    c, t = args[0], types[0]
    if is_duration(t):
        return c
    if isinstance(t, T.StructType):
        get = lambda *n: (_field(c, t, *n) if _field(c, t, *n) is not None else F.lit(0)).cast("double")
        months = get("years") * 12 + get("quarters") * 3 + get("months")
        whole_months = F.floor(months)
        days = get("weeks") * 7 + get("days")
        whole_days = F.floor(days)
        nanos = sum((get(n) * k for n, k in NANOS.items()), (days - whole_days) * 86_400_000_000_000.0)
        return duration(whole_months, whole_days, F.round(nanos))
    # ISO 8601 text
    number = lambda unit, s: F.coalesce(F.nullif(F.regexp_extract(s, rf"(-?[0-9.]+){unit}", 1), F.lit("")).cast("double"), F.lit(0.0))
    day_part, time_part = F.split_part(c, F.lit("T"), F.lit(1)), F.split_part(c, F.lit("T"), F.lit(2))
    months = number("Y", day_part) * 12 + number("M", day_part)
    days = number("W", day_part) * 7 + number("D", day_part)
    nanos = number("H", time_part) * NANOS["hours"] + number("M", time_part) * NANOS["minutes"] + number("S", time_part) * NANOS["seconds"]
    return duration(F.floor(months), F.floor(days), F.round(nanos + (days - F.floor(days)) * 86_400_000_000_000.0))


def _micros(c):
    return F.unix_micros(c.cast("timestamp"))


def between(args, types):
    a, b = (c.cast("timestamp_ntz") for c in args)
    months = F.months_between(b.cast("timestamp"), a.cast("timestamp"), False)
    whole = F.when(months >= 0, F.floor(months)).otherwise(F.ceil(months)).cast("int")
    moved = F.add_months(a.cast("date"), whole)
    rest = (_micros(b) - (_micros(moved) + _micros(a) - _micros(F.date_trunc("day", a))))
    day = F.lit(86_400_000_000)
    return duration(whole, F.call_function("div", rest, day), (rest % day) * 1000)


def in_months(args, types):
    whole = between(args, types)["months"]
    return duration(whole, 0, 0)


def in_days(args, types):
    a, b = args
    return duration(0, F.call_function("div", _micros(b) - _micros(a), F.lit(86_400_000_000)), 0)


def in_seconds(args, types):
    a, b = args
    return duration(0, 0, (_micros(b) - _micros(a)) * 1000)


def truncate(args, types):
    unit, c = args
    return F.date_trunc(unit, c)


def accessor(c, t: T.DataType, key: str):
    """Component of a temporal value by its name, or None."""
    if is_duration(t):
        div = lambda x, n: F.call_function("div", x, F.lit(n))
        return {"years": lambda: div(c["months"], 12), "months": lambda: c["months"], "days": lambda: c["days"], "weeks": lambda: div(c["days"], 7), "hours": lambda: div(c["nanos"], NANOS["hours"]), "minutes": lambda: div(c["nanos"], NANOS["minutes"]), "seconds": lambda: div(c["nanos"], NANOS["seconds"]), "milliseconds": lambda: div(c["nanos"], NANOS["milliseconds"]), "nanoseconds": lambda: c["nanos"], "monthsOfYear": lambda: c["months"] % 12, "quarters": lambda: div(c["months"], 3), "secondsOfMinute": lambda: div(c["nanos"], NANOS["seconds"]) % 60, "minutesOfHour": lambda: div(c["nanos"], NANOS["minutes"]) % 60, "nanosecondsOfSecond": lambda: c["nanos"] % NANOS["seconds"]}.get(key, lambda: None)()
    simple = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "week": F.weekofyear, "ordinalDay": F.dayofyear, "dayOfYear": F.dayofyear}
    if key in simple:
        return simple[key](c).cast("long")
    if key in ("dayOfWeek", "weekDay"):
        return (F.weekday(c) + 1).cast("long")
    if key == "weekYear":
        return F.extract(F.lit("YEAROFWEEK"), c).cast("long")
    if key == "millisecond":
        return F.call_function("div", _micros(c) % 1_000_000, F.lit(1000))
    if key == "microsecond":
        return _micros(c) % 1_000_000
    if key == "epochSeconds":
        return F.call_function("div", _micros(c), F.lit(1_000_000))
    if key == "epochMillis":
        return F.call_function("div", _micros(c), F.lit(1000))
    if key in ("timezone", "offset"):
        return F.lit("Z")
    return None


def register_all(table: dict) -> None:
    table |= {"date": date, "datetime": datetime, "localdatetime": localdatetime, "time": time, "localtime": localtime, "duration": of_duration, "duration.between": between, "duration.inmonths": in_months, "duration.indays": in_days, "duration.inseconds": in_seconds, "date.truncate": truncate, "datetime.truncate": truncate, "localdatetime.truncate": truncate}
    for clock in ("transaction", "statement", "realtime"):
        table |= {f"datetime.{clock}": lambda a, t: F.current_timestamp(), f"date.{clock}": lambda a, t: F.current_date()}
    table["datetime.fromepoch"] = lambda a, t: F.timestamp_micros(a[0].cast("long") * 1_000_000 + (F.call_function("div", a[1].cast("long"), F.lit(1000)) if len(a) > 1 else 0))
    table["datetime.fromepochmillis"] = lambda a, t: F.timestamp_millis(a[0].cast("long"))
    table["timestamp"] = lambda a, t: F.unix_millis(F.current_timestamp())
