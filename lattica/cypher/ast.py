"""Syntax trees. Expressions are tuples whose first item names their kind; clauses and patterns are data classes."""

from __future__ import annotations

from dataclasses import dataclass, field

Expr = tuple


@dataclass
class NodePat:
    var: str | None
    labels: list[list[str]] = field(default_factory=list)  # conjunction of disjunctions
    props: dict[str, Expr] = field(default_factory=dict)
    where: Expr | None = None


@dataclass
class RelPat:
    var: str | None
    types: list[str] = field(default_factory=list)
    direction: str = "both"  # out, in, both
    low: int | None = None  # of a variable length
    high: int | None = None
    variable: bool = False
    props: dict[str, Expr] = field(default_factory=dict)
    where: Expr | None = None


@dataclass
class GroupPat:
    """A quantified path pattern: its elements (nodes and relationships) low..high times."""

    elements: list
    low: int
    high: int | None
    where: Expr | None = None


@dataclass
class PathPat:
    var: str | None
    elements: list
    selector: str | None = None  # shortest, all_shortest, k
    k: int = 1
    mode: str = "trail"  # walk, trail, acyclic, simple


@dataclass
class Match:
    patterns: list[PathPat]
    where: Expr | None = None
    optional: bool = False


@dataclass
class Unwind:
    expr: Expr
    var: str


@dataclass
class Projection:
    items: list[tuple[Expr, str]]
    star: bool = False
    distinct: bool = False
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    skip: Expr | None = None
    limit: Expr | None = None
    where: Expr | None = None
    final: bool = False


@dataclass
class Call:
    name: str
    args: list[Expr]
    yields: list[tuple[str, str]] | None = None
    where: Expr | None = None


@dataclass
class SubCall:
    query: Query
    imports: list[str] | None = None
    optional: bool = False


@dataclass
class Create:
    patterns: list[PathPat]


@dataclass
class Merge:
    pattern: PathPat
    on_create: list = field(default_factory=list)
    on_match: list = field(default_factory=list)


@dataclass
class SetItems:
    items: list[tuple]  # (prop, var, key, expr) | (plus, var, expr) | (all, var, expr) | (label, var, labels)


@dataclass
class Remove:
    items: list[tuple]  # (prop, var, key) | (label, var, labels)


@dataclass
class Delete:
    exprs: list[Expr]
    detach: bool = False


@dataclass
class Foreach:
    var: str
    expr: Expr
    body: list


@dataclass
class Query:
    clauses: list


@dataclass
class Union:
    parts: list[Query]
    all: bool = False


@dataclass
class Recursive:
    name: str
    columns: list[str]
    anchor: object
    step: object
    rest: Query


@dataclass
class Command:
    """A statement that isn't a query: DDL, COPY, SHOW, EXPLAIN, BACKUP and the like."""

    kind: str
    args: dict
