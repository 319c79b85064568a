"""Property graphs: a table for each vertex label and each edge type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CompileError

VID, LABELS, EID, SRC, DST, TYPE = "_vid", "_labels", "_eid", "_src", "_dst", "_type"


class Later:
    """A table that is opened when it is first used."""

    def __init__(self, make: Callable):
        self.make, self.made = make, None

    def get(self):
        if self.made is None:
            self.made = self.make()
        return self.made


class Tables(dict):
    """Tables by name, some of them opened when they are first used; a copy opens none and shares what is opened later."""

    def later(self, name: str, make: Callable) -> None:
        super().__setitem__(name, Later(make))

    def __getitem__(self, name):
        found = super().__getitem__(name)
        return found.get() if isinstance(found, Later) else found

    def get(self, name, default=None):
        return self[name] if name in self else default

    def __iter__(self):  # dict() and ** copy by this and __getitem__, so they get tables
        return iter(list(super().keys()))

    def keys(self):
        return list(super().keys())

    def values(self):
        return [self[n] for n in self]

    def items(self):
        return [(n, self[n]) for n in self]

    def copy(self) -> Tables:
        out = Tables()
        for name, found in super().items():
            out.__setitem__(name, found)
        return out

    def opened(self) -> list:
        """The tables that don't wait."""
        return [t.made if isinstance(t, Later) else t for t in super().values() if not isinstance(t, Later) or t.made is not None]


@dataclass(frozen=True)
class EdgeTable:
    df: DataFrame
    sources: tuple[str, ...] = ()  # labels of the endpoints; empty: any
    targets: tuple[str, ...] = ()


@dataclass
class Graph:
    """A catalog of immutable tables; a write makes new tables for the same names.

    Vertices: ``_vid`` and properties (``_labels`` where vertices have further labels); edges: ``_eid``, ``_src``, ``_dst``
    and properties.
    """

    spark: SparkSession
    nodes: dict[str, DataFrame] = field(default_factory=Tables)
    edges: dict[str, EdgeTable] = field(default_factory=Tables)
    constraints: list[dict] = field(default_factory=list)
    indexes: list[dict] = field(default_factory=list)
    projections: dict[str, tuple] = field(default_factory=dict)
    providers: list = field(default_factory=list)  # replacement scans: callable(name) -> DataFrame or None

    def copy(self) -> Graph:
        return replace(self, nodes=self.nodes.copy(), edges=self.edges.copy(), constraints=list(self.constraints), indexes=list(self.indexes), projections=dict(self.projections))

    def add_nodes(self, label: str, df: DataFrame) -> Graph:
        """Register a label; any DataFrame with ``_vid`` will do, so an external source is a label too."""
        if VID not in df.columns:
            raise CompileError(f"vertices of {label} need a column {VID}")
        self.nodes[label] = df
        return self

    def add_edges(self, type_: str, df: DataFrame, sources: tuple[str, ...] | str = (), targets: tuple[str, ...] | str = ()) -> Graph:
        """Register an edge type with the labels of its endpoints, where they are fixed."""
        if missing := {EID, SRC, DST} - set(df.columns):
            raise CompileError(f"edges of {type_} need columns {sorted(missing)}")
        as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
        self.edges[type_] = EdgeTable(df, as_tuple(sources), as_tuple(targets))
        return self

    def multi_labelled(self) -> bool:
        """Whether vertices of some table have labels of their own; tables that wait to be opened have none."""
        tables = self.nodes.opened() if isinstance(self.nodes, Tables) else self.nodes.values()
        return any(LABELS in d.columns for d in tables)

    def resolve_label(self, label: str) -> DataFrame | None:
        if label in self.nodes:
            return self.nodes[label]
        for provider in self.providers:
            if (df := provider(label)) is not None:
                return df
        return None

    def labelled(self, label: str) -> DataFrame | None:
        """Vertices of one label table, with ``_labels``."""
        df = self.resolve_label(label)
        return None if df is None else df if LABELS in df.columns else df.withColumn(LABELS, F.array(F.lit(label)))

    def scan_nodes(self, groups: list[list[str]]) -> DataFrame:
        """Vertices that have a label of every group; of no group: all. One label table is read alone where that suffices."""
        if not groups:
            frames = [self.labelled(x) for x in self.nodes]
        else:
            frames = []
            for label in groups[0]:
                df = self.labelled(label)
                if df is not None:
                    frames.append(df)
                elif self.multi_labelled():
                    frames += [d.where(F.array_contains(LABELS, label)) for d in self.nodes.values() if LABELS in d.columns]
            for label in groups[0] if self.multi_labelled() else []:
                frames += [d.where(F.array_contains(LABELS, label)) for name, d in self.nodes.items() if name not in groups[0] and LABELS in d.columns and self.resolve_label(label) is not None]
        if not frames:
            return self.spark.createDataFrame([], f"{VID} long, {LABELS} array<string>")
        df = union_all(frames)
        for group in groups[1:]:
            df = df.where(F.arrays_overlap(LABELS, F.array(*[F.lit(x) for x in group])))
        return df.dropDuplicates([VID]) if len(frames) > 1 and self.multi_labelled() else df

    def edge_tables(self, types: list[str]) -> list[tuple[str, EdgeTable]]:
        return [(t, self.edges[t]) for t in (types or self.edges) if t in self.edges]

    def scan_edges(self, types: list[str]) -> DataFrame:
        """Edges of the given types, of all types if none is given, with ``_type``."""
        frames = [e.df.withColumn(TYPE, F.lit(t)) for t, e in self.edge_tables(types)]
        return union_all(frames) if frames else self.spark.createDataFrame([], f"{EID} long, {SRC} long, {DST} long, {TYPE} string")

    def endpoint_labels(self, types: list[str], end: str) -> set[str] | None:
        """Labels that an endpoint can have by the edge types' declarations; None if any."""
        out: set[str] = set()
        for _, e in self.edge_tables(types):
            own = e.sources if end == SRC else e.targets
            if not own:
                return None
            out |= set(own)
        return out

    def next_id(self) -> int:
        """One more than any vertex or edge id."""
        frames = [d.agg(F.max(VID).alias("m")) for d in self.nodes.values()] + [e.df.agg(F.max(EID).alias("m")) for e in self.edges.values()]
        found = reduce(DataFrame.unionAll, frames).agg(F.max("m")).first()[0] if frames else None
        return (found if found is not None else -1) + 1


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column whose types differ becomes a string."""
    types: dict[str, set[str]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            types.setdefault(name, set()).add(kind)
    mixed = {name for name, kinds in types.items() if len(kinds) > 1}
    numeric = {"int", "bigint", "smallint", "tinyint", "float", "double"}
    casts = {name: "double" if types[name] <= numeric and types[name] & {"float", "double"} else "long" if types[name] <= numeric else "string" for name in mixed}
    frames = [df.withColumns({n: F.col(f"`{n}`").cast(k) for n, k in casts.items() if n in df.columns}) if casts else df for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
