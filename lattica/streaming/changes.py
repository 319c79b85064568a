"""Change events of a commit, triggers on them, a change log as a stream source, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import DST, EID, SRC, VID
from ..errors import ConstraintError

#: Kinds of events.
NODE_CREATED, NODE_UPDATED, NODE_DELETED, EDGE_CREATED, EDGE_UPDATED, EDGE_DELETED = range(1, 7)
SCHEMA = "event_kind int, vid_or_eid bigint, label string, properties_old string, properties_new string"


def _diff(old: DataFrame | None, new: DataFrame | None, key: str, label: str, kinds: tuple[int, int, int]) -> DataFrame:
    json = lambda df: df.select(F.col(key).alias("k"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("p"))
    spark = (old if old is not None else new).sparkSession
    empty = spark.createDataFrame([], "k bigint, p string")
    a, b = json(old) if old is not None else empty, json(new) if new is not None else empty
    j = a.select("k", F.col("p").alias("old")).join(b.select("k", F.col("p").alias("new")), "k", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    kind = F.when(F.col("old").isNull(), kinds[0]).when(F.col("new").isNull(), kinds[2]).otherwise(kinds[1])
    return j.select(kind.alias("event_kind"), F.col("k").alias("vid_or_eid"), F.lit(label).alias("label"), F.col("old").alias("properties_old"), F.col("new").alias("properties_new"))


def changes_between(before, graph) -> DataFrame:
    """Events of the tables that differ between two versions."""
    nodes, edges = before
    parts = []
    for label in {**nodes, **graph.nodes}:
        if nodes.get(label) is not graph.nodes.get(label):
            parts.append(_diff(nodes.get(label), graph.nodes.get(label), VID, label, (NODE_CREATED, NODE_UPDATED, NODE_DELETED)))
    for t in {**edges, **graph.edges}:
        old, new = edges.get(t), graph.edges.get(t)
        if old is not new:
            parts.append(_diff(old.df if old else None, new.df if new else None, EID, t, (EDGE_CREATED, EDGE_UPDATED, EDGE_DELETED)))
    return reduce(DataFrame.unionByName, parts) if parts else graph.spark.createDataFrame([], SCHEMA)


@dataclass
class Trigger:
    """A callback on events, in a phase; before_commit may veto by raising or returning False.

    After a commit it runs at once (``sync``), on a thread (``async``), or when the session drains (``eventual``); errors of a thread
    are raised by the drain.
    """

    name: str
    callback: Callable
    phase: str = "after_commit"
    kinds: set[int] = field(default_factory=lambda: set(range(1, 7)))
    labels: set[str] | None = None
    predicate: str | None = None
    mode: str = "sync"
    waiting: list = field(default_factory=list)

    def fire(self, events: DataFrame, phase: str, session) -> None:
        if phase != self.phase:
            return
        own = events.where(F.col("event_kind").isin(sorted(self.kinds)))
        if self.labels is not None:
            own = own.where(F.col("label").isin(sorted(self.labels)))
        if self.predicate:
            own = own.where(self.predicate)
        if self.mode == "eventual" and phase == "after_commit":
            self.waiting.append(own)
            return
        if self.mode == "async" and phase == "after_commit":
            self.waiting.append(_threads().submit(self.run, own))
            return
        if own.isEmpty():
            return
        if self.callback(own) is False and phase == "before_commit":
            raise ConstraintError(f"trigger {self.name} refused the commit")

    def run(self, events: DataFrame) -> None:
        if not events.isEmpty():
            self.callback(events)

    def drain(self) -> None:
        while self.waiting:
            found = self.waiting.pop(0)
            if isinstance(found, DataFrame):
                self.run(found)
            else:
                found.result()


@cache
def _threads() -> ThreadPoolExecutor:
    return ThreadPoolExecutor(max_workers=4, thread_name_prefix="trigger")


class ChangeLog:
    """Every commit's events as a numbered folder of Parquet files; a file stream reads them in order."""

    def __init__(self, session, path: str):
        self.session, self.path, self.sequence = session, path, 0
        session.triggers.append(Trigger("change log", self.write))

    def write(self, events: DataFrame) -> None:
        self.sequence += 1
        events.withColumn("sequence", F.lit(self.sequence).cast("long")).write.mode("append").parquet(self.path)

    def read(self, after: int = 0) -> DataFrame:
        return self.session.graph.spark.read.parquet(self.path).where(F.col("sequence") > after)

    def stream(self) -> DataFrame:
        spark = self.session.graph.spark
        return spark.readStream.schema(SCHEMA + ", sequence bigint").parquet(self.path)


def tumbling(events: DataFrame, every: str, time: str = "ts", late: str = "1 hour", keys: list[str] = ()) -> DataFrame:
    """Counts and sums of ``value`` by window; with a watermark on streams."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(F.col(time), every).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events without a pause of ``gap``."""
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.session_window(F.col(time), gap).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def graph_of_stream(batch: DataFrame) -> DataFrame:
    """User-to-event edges of a micro-batch."""
    return batch.select(F.col("event_id").alias(EID), F.col("user_id").alias(SRC), F.col("event_id").alias(DST))
