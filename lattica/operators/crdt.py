"""Merging replicated values: states of replicas are rows, a merge is an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gcounter_merge(states: DataFrame) -> DataFrame:
    """Grow-only counters: states (key, actor, count) -> (key, value); the greatest count of each actor, added."""
    return states.groupBy("key", "actor").agg(F.max("count").alias("count")).groupBy("key").agg(F.sum("count").alias("value"))


def gset_merge(states: DataFrame) -> DataFrame:
    """Grow-only sets: states (key, elements ARRAY) -> their union."""
    return states.select("key", F.explode("elements").alias("e")).distinct().groupBy("key").agg(F.array_sort(F.collect_list("e")).alias("elements"))


def lww_merge(states: DataFrame) -> DataFrame:
    """Registers (and maps, with the field in the key): states (key, value, ts, actor) -> the latest, ties to the greater actor."""
    return states.groupBy("key").agg(F.max(F.struct("ts", "actor", "value")).alias("s")).select("key", "s.value", "s.ts", "s.actor")


def orset_merge(left: DataFrame, right: DataFrame, left_seen: DataFrame, right_seen: DataFrame) -> DataFrame:
    """Add-wins sets: dots (key, element, actor, seq) and version vectors (key, actor, seq).

    A dot stays if both have it, or one has it and the other hasn't seen it yet.
    """
    dot = ["key", "element", "actor", "seq"]
    both = left.join(right, dot, "left_semi")

    def unseen(mine: DataFrame, other: DataFrame, seen: DataFrame) -> DataFrame:
        only = mine.join(other, dot, "left_anti")
        v = seen.select("key", "actor", F.col("seq").alias("known"))
        return only.join(v, ["key", "actor"], "left").where("known is null or seq > known").select(*dot)

    return both.select(*dot).unionAll(unseen(left, right, right_seen)).unionAll(unseen(right, left, left_seen)).distinct()


def vector_clock_merge(clocks: DataFrame) -> DataFrame:
    """(key, actor, seq): pointwise greatest."""
    return clocks.groupBy("key", "actor").agg(F.max("seq").alias("seq"))


def causal_register_merge(states: DataFrame) -> DataFrame:
    """Values (key, value, clock MAP) that no other value's clock follows; concurrent ones all stay."""
    a, b = states.alias("a"), states.alias("b")
    actors = F.array_union(F.map_keys("a.clock"), F.map_keys("b.clock"))
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    behind = F.forall(actors, lambda k: at(F.col("a.clock"), k) <= at(F.col("b.clock"), k)) & F.exists(actors, lambda k: at(F.col("a.clock"), k) < at(F.col("b.clock"), k))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & behind, "left_anti").dropDuplicates(["key", "value"])


def sequence_merge(ops: DataFrame) -> DataFrame:
    """Growable arrays: inserts (key, id, after, value, deleted) in tree order, later ids first among siblings."""

    def order(pdf):
        import pandas as pd

        kids: dict = {}
        rows = {r.id: r for r in pdf.sort_values(["id", "deleted"]).itertuples()}
        for r in rows.values():
            kids.setdefault(None if pd.isna(r.after) else r.after, []).append(r.id)
        out, stack = [], sorted(kids.get(None, []))
        while stack:
            i = stack.pop()
            if not rows[i].deleted:
                out.append(rows[i].value)
            stack += sorted(kids.get(i, []))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "items": [out]})

    return ops.groupBy("key").applyInPandas(order, "key long, items array<string>")
