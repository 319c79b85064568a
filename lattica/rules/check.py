"""Compile-time checks and the order of evaluation."""

from __future__ import annotations

from ..errors import ClauseMismatch, CyclicNegation, RuleError, UndefinedRule
from .parser import Clause

MONOTONE = {"msum", "mmax", "mmin", "mcount", "mnor", "mprod", "min", "max", "count", "collect"}
FOLDS = MONOTONE | {"sum", "avg"}


def grouped(clauses: list[Clause]) -> dict[str, list[Clause]]:
    out: dict[str, list[Clause]] = {}
    for c in clauses:
        out.setdefault(c.rule, []).append(c)
    return out


def components(graph: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components, dependencies first."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []

    def visit(v: str) -> None:
        index[v] = low[v] = len(index)
        stack.append(v)
        for w in sorted(graph.get(v, ())):
            if w not in index:
                visit(w)
                low[v] = min(low[v], low[w])
            elif w in stack:
                low[v] = min(low[v], index[w])
        if low[v] == index[v]:
            part = []
            while True:
                w = stack.pop()
                part.append(w)
                if w == v:
                    break
            out.append(sorted(part))

    for v in sorted(graph):
        if v not in index:
            visit(v)
    return out


def strata(rules: dict[str, list[Clause]], aggregates: dict) -> list[list[str]]:
    """Rules in the order of evaluation, mutually recursive ones together; raises what is ill-formed."""
    for name, clauses in rules.items():
        shapes = {tuple((y.name, y.key, y.prob) for y in c.yields) for c in clauses if c.yields}
        if len(shapes) > 1:
            raise ClauseMismatch(f"clauses of {name} yield different columns")
        tails = {repr(([(n, agg, distinct) for n, agg, _, distinct in c.folds], c.require, c.having, c.best)) for c in clauses if c.folds}
        if len(tails) > 1:
            raise ClauseMismatch(f"clauses of {name} fold differently")
        for c in clauses:
            for fold in c.folds:
                if fold[1] not in FOLDS and fold[1] not in aggregates:
                    raise RuleError(f"{fold[1]} isn't a fold")
            if c.best and any(f[1].startswith("m") and f[1] not in ("min", "max") for f in c.folds):
                raise RuleError("BEST BY doesn't go with monotone folds")
            for r in c.refs:
                if r.rule not in rules:
                    raise UndefinedRule(r.rule)
    graph = {n: {r.rule for c in cs for r in c.refs} for n, cs in rules.items()}
    parts = components(graph)
    for part in parts:
        for n in part:
            for c in rules[n]:
                if any(r.negated and r.rule in part for r in c.refs):
                    raise CyclicNegation(f"{n} depends on its own complement")
                recursive = any(r.rule in part for r in c.refs)
                for _, agg, _, distinct in c.folds if recursive else ():
                    if distinct:
                        raise RuleError("DISTINCT folds can't be recursive")
                    if agg in ("sum", "avg") or agg not in MONOTONE and not aggregates.get(agg, {}).get("monotone"):
                        raise RuleError(f"{agg} can't be recursive")
    return parts
