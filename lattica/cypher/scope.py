"""What a name means at a place of a query: a node, a relationship, a path or a value, and its columns."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_counter = itertools.count(1)


def fresh(kind: str = "c") -> str:
    return f"_{kind}{next(_counter)}"


@dataclass
class Entry:
    kind: str  # node, rel, value
    ident: str  # column of the id, or of the value
    props: dict[str, str] = field(default_factory=dict)
    labels: str | None = None  # column of labels or of the type
    label_names: tuple[str, ...] = ()  # known labels of a node, for scans
    src: str | None = None
    dst: str | None = None
    group: str | None = None  # for lists of relationships: the kind of items

    def columns(self) -> list[str]:
        return [c for c in [self.ident, self.labels, self.src, self.dst, *self.props.values()] if c]

    def column(self) -> Column:
        """The whole entity as a struct, or the value."""
        if self.kind == "value":
            return F.col(self.ident)
        fields = [F.col(self.ident).alias("_vid" if self.kind == "node" else "_eid")]
        if self.kind == "rel":
            fields += [F.col(self.src).alias("_src"), F.col(self.dst).alias("_dst")]
            if self.labels:
                fields.append(F.col(self.labels).alias("_type"))
        elif self.labels:
            fields.append(F.col(self.labels).alias("_labels"))
        fields += [F.col(c).alias(p) for p, c in sorted(self.props.items())]
        return F.when(F.col(self.ident).isNotNull(), F.struct(*fields))


Scope = dict[str, Entry]


@dataclass
class State:
    """Rows so far and what names mean."""

    df: DataFrame | None
    scope: Scope

    def with_(self, **changes) -> State:
        return replace(self, **changes)
