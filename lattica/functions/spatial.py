"""Points: constructor, distance, bounding box. WGS84 points are x = longitude, y = latitude in degrees."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CompileError

RADIUS_M = 6_371_000.0


def point(args, types):
    """A struct (crs, x, y, z) of a map with x, y[, z] or longitude, latitude[, height]."""
    t, c = types[0], args[0]
    if isinstance(t, T.StructType):
        names, get = t.fieldNames(), lambda n: c[n].cast("double")
    else:
        raise CompileError("point takes a map")
    wgs = "longitude" in names or "lon" in names
    first = lambda *options: next((get(n) for n in options if n in names), F.lit(None).cast("double"))
    x, y, z = (first("longitude", "lon"), first("latitude", "lat"), first("height")) if wgs else (first("x"), first("y"), first("z"))
    crs = ("wgs-84" if wgs else "cartesian") + ("-3d" if {"z", "height"} & set(names) else "")
    bad = (F.abs(y) > 90) | (F.abs(x) > 180)
    if wgs:
        x = F.when(bad, F.raise_error(F.lit("coordinates are out of range")).cast("double")).otherwise(x)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(F.lit(crs).alias("crs"), x.alias("x"), y.alias("y"), z.alias("z")))


def distance(args, types):
    """Metres on the sphere for WGS84, Euclidean otherwise; null for points of different systems."""
    a, b = args
    dy, dx = F.radians(b["y"] - a["y"]), F.radians(b["x"] - a["x"])
    h = F.pow(F.sin(dy / 2), 2) + F.cos(F.radians(a["y"])) * F.cos(F.radians(b["y"])) * F.pow(F.sin(dx / 2), 2)
    sphere = 2 * RADIUS_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    dz = F.coalesce(b["z"] - a["z"], F.lit(0.0))
    flat = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2) + F.pow(dz, 2))
    return F.when(a["crs"] == b["crs"], F.when(a["crs"].startswith("wgs"), sphere).otherwise(flat))


def within(args, types):
    """Whether a point lies in the box of a lower left and an upper right corner."""
    p, a, b = args
    wraps = a["x"] > b["x"]
    inside = F.when(wraps & p["crs"].startswith("wgs"), (p["x"] >= a["x"]) | (p["x"] <= b["x"])).otherwise((p["x"] >= a["x"]) & (p["x"] <= b["x"]))
    return F.when((p["crs"] == a["crs"]) & (p["crs"] == b["crs"]), inside & (p["y"] >= a["y"]) & (p["y"] <= b["y"]))


def register_all(table: dict) -> None:
    table |= {"point": point, "distance": distance, "point.distance": distance, "point.withinbbox": within}
