"""Evaluation: strata in order, semi-naive rounds inside a recursive one, then commands in program order.

A rule's facts are a table. Non-recursive clauses are plain query plans. In a recursive stratum a round joins the facts that
are new, written to the shared folder, and stops when none is new; with FOLD a round reads the folded facts of the last one and
stops when they don't change.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher import ast as A
from ..cypher.compiler import Expressions, names_in, property_needs
from ..cypher.plan import Planner, _merged
from ..cypher.scope import Entry, State, fresh
from ..errors import IterationLimit, RuleError, UndefinedRule
from ..functions import values
from ..operators.writes import create as create_pattern
from ..storage import keep
from .check import grouped, strata
from .parser import Clause, Program, parse_program

PROB = "_prob"


@dataclass
class Config:
    rounds: int = 1000
    semiring: str = "add_mult"  # or max_min
    strict_probabilities: bool = False
    abduce_candidates: int = 20
    abduce_results: int = 10


@dataclass
class Relation:
    """Facts of a rule: columns by name; nodes are ids."""

    df: DataFrame
    keys: list[str]
    others: list[str]
    kinds: dict[str, Entry]
    prob: str | None = None

    @property
    def columns(self) -> list[str]:
        return self.keys + self.others


@dataclass
class Result:
    derived: dict[str, Relation]
    results: list = field(default_factory=list)
    profile: list = field(default_factory=list)

    def rows(self, at: int = -1) -> DataFrame:
        return self.results[at]


class Engine:
    def __init__(self, session, params: dict, config: Config | None = None):
        self.session, self.params, self.config = session, params, config or Config()
        self.rules: dict[str, list[Clause]] = {}
        self.facts: dict[str, Relation] = {}
        self.profile: list[tuple[str, int, float]] = []
        self.models: dict[str, dict] = getattr(session, "models", {})

    # --- facts --------------------------------------------------------------------------------------------------
    def derive_all(self, only: set[str] | None = None) -> None:
        for part in strata(self.rules, self.session.rules.get("aggregates", {})):
            if only is not None and not set(part) & only:
                continue
            if all(c.derive or c.merge for n in part for c in self.rules[n]):
                continue
            self.stratum(part)

    def affected(self, names: set[str]) -> set[str]:
        out = set(names)
        while True:
            more = {n for n, cs in self.rules.items() for c in cs for r in c.refs if r.rule in out} | out
            if more == out:
                return out
            out = more

    def stratum(self, part: list[str]) -> None:
        recursive = any(r.rule in part for n in part for c in self.rules[n] for r in c.refs)
        if not recursive:
            name = part[0]
            rows = [self.clause(c, {}) for c in self.rules[name]]
            self.facts[name] = self.finish(name, self.union(rows))
            return
        folding = {n for n in part for c in self.rules[n] if c.folds}
        if folding or any(y.prob for n in part for c in self.rules[n] for y in c.yields):
            self.recursive_fold(part)
        else:
            self.semi_naive(part)

    def base_and_steps(self, name: str, part: list[str]) -> tuple[list[Clause], list[Clause]]:
        base = [c for c in self.rules[name] if not any(r.rule in part for r in c.refs)]
        return base, [c for c in self.rules[name] if c not in base]

    def semi_naive(self, part: list[str]) -> None:
        bag = {n: any(c.along for c in self.rules[n]) for n in part}
        best = {n: next((c.best for c in self.rules[n] if c.best), None) for n in part}
        known, delta = {}, {}
        pending = list(part)
        while pending:
            ready = [n for n in pending if self.base_and_steps(n, part)[0]]
            if not ready:
                raise RuleError(f"no clause of {', '.join(pending)} begins the recursion")
            for n in ready:
                rel = self.union([self.clause(c, {}) for c in self.base_and_steps(n, part)[0]])
                df = rel.df if bag[n] else rel.df.distinct()
                df = keep(self.best_rows(df, rel, best[n]), n)
                known[n] = delta[n] = self.with_df(rel, df)
                pending.remove(n)
            for n in [p for p in pending]:
                shape = self.shape_of(n, known)
                if shape is not None:
                    known[n] = delta[n] = shape
                    pending.remove(n)
        for round_ in range(self.config.rounds):
            fresh_rows: dict[str, DataFrame] = {}
            for n in part:
                rows = []
                for c in self.base_and_steps(n, part)[1]:
                    at = [i for i, r in enumerate(c.refs) if r.rule in part and not r.negated]
                    for i in at:  # one reference reads what is new, the others all that is known
                        rows.append(self.clause(c, {**known}, {i: delta[c.refs[i].rule]}))
                if not rows:
                    fresh_rows[n] = known[n].df.limit(0)
                    continue
                rel = self.union(rows, known[n])
                df = rel.df
                if best[n]:
                    merged = self.best_rows(known[n].df.unionByName(df.select(*known[n].df.columns)), known[n], best[n])
                    df = self.minus(merged, known[n].df)
                elif not bag[n]:
                    df = self.minus(df.distinct(), known[n].df)
                fresh_rows[n] = keep(df.select(*known[n].df.columns), n)
            sizes = {n: fresh_rows[n].count() for n in part}
            self.profile += [(n, round_, s) for n, s in sizes.items()]
            if not any(sizes.values()):
                for n in part:
                    self.facts[n] = self.finish(n, known[n], folded=True)
                return
            for n in part:
                delta[n] = self.with_df(known[n], fresh_rows[n])
                df = known[n].df.unionByName(fresh_rows[n])
                known[n] = self.with_df(known[n], keep(self.best_rows(df, known[n], best[n]), n) if best[n] else df)
        raise IterationLimit(f"{', '.join(part)}: no end after {self.config.rounds} rounds")

    def shape_of(self, name: str, known: dict) -> Relation | None:
        """An empty relation of a rule whose clauses all recurse, once what they read is known."""
        for c in self.rules[name]:
            if all(r.rule in known or r.rule in self.facts for r in c.refs):
                rel = self.clause(c, known)
                return self.with_df(rel, keep(rel.df.limit(0), name))
        return None

    def recursive_fold(self, part: list[str]) -> None:
        known: dict[str, Relation] = {}
        raw_base = {n: [self.clause(c, {}) for c in self.base_and_steps(n, part)[0]] for n in part}
        for n in part:
            if raw_base[n]:
                known[n] = self.fold(n, self.union(raw_base[n]))
                known[n] = self.with_df(known[n], keep(known[n].df, n))
        for n in part:
            if n not in known and (shape := self.shape_of(n, known)) is not None:
                known[n] = shape
        for round_ in range(self.config.rounds):
            now = {}
            for n in part:
                rows = raw_base[n] + [self.clause(c, known) for c in self.base_and_steps(n, part)[1]]
                rel = self.fold(n, self.union(rows))
                now[n] = self.with_df(rel, keep(rel.df, n))
            same = all(self.minus(now[n].df, known[n].df).isEmpty() and self.minus(known[n].df, now[n].df).isEmpty() for n in part)
            self.profile += [(n, round_, now[n].df.count()) for n in part]
            known = now
            if same:
                for n in part:
                    self.facts[n] = self.finish(n, known[n], folded=True)
                return
        raise IterationLimit(f"{', '.join(part)}: no end after {self.config.rounds} rounds")

    def with_df(self, rel: Relation, df: DataFrame) -> Relation:
        return Relation(df, rel.keys, rel.others, rel.kinds, rel.prob)

    def minus(self, a: DataFrame, b: DataFrame) -> DataFrame:
        right = b.select(*[F.col(f"`{c}`").alias(f"_r_{i}") for i, c in enumerate(a.columns)])
        return a.join(right, [F.col(f"`{c}`").eqNullSafe(F.col(f"_r_{i}")) for i, c in enumerate(a.columns)], "left_anti")

    def union(self, rels: list[Relation], like: Relation | None = None) -> Relation:
        first = like or rels[0]
        types = {f.name: f.dataType for f in first.df.schema}
        frames = []
        for r in rels:
            frames.append(r.df.select(*[F.col(f"`{c}`").cast(types[c] if like or not isinstance(types[c], T.NullType) else "double").alias(c) for c in first.df.columns]))
        return self.with_df(rels[0], reduce(DataFrame.unionByName, frames))

    def finish(self, name: str, rel: Relation, folded: bool = False) -> Relation:
        clause = next((c for c in self.rules[name] if c.folds), self.rules[name][0])
        if not folded:
            rel = self.fold(name, rel)
        df = rel.df
        if len({c.priority for c in self.rules[name]}) > 1:
            w = Window.partitionBy(*[F.col(k) for k in rel.keys]) if rel.keys else Window.partitionBy(F.lit(1))
            df = df.withColumn("_top", F.max("_priority").over(w)).where("_priority = _top").drop("_top")
        if "_priority" in df.columns:
            df = df.drop("_priority")
        rel = self.with_df(rel, df)
        for e in clause.having:
            rel = self.with_df(rel, rel.df.where(self.over(rel).boolean(e)))
        best = next((c.best for c in self.rules[name] if c.best), None)
        df = self.best_rows(rel.df, rel, best)
        if not clause.folds and not any(c.along for c in self.rules[name]):
            df = df.distinct()
        return self.with_df(rel, keep(df, name))

    def over(self, rel: Relation) -> Expressions:
        scope = {c: Entry("value", c) for c in rel.columns}
        return Expressions(self.context(), State(rel.df, scope))

    def best_rows(self, df: DataFrame, rel: Relation, best) -> DataFrame:
        if not best:
            return df
        ex = Expressions(self.context(), State(df, {c: Entry("value", c) for c in rel.columns}))
        order = [values.order(ex.column(e), ex.type(e), down) for e, down in best]
        rest = [F.col(c).asc_nulls_last() for c in rel.others]
        w = Window.partitionBy(*[F.col(k) for k in rel.keys]).orderBy(*order, *rest)
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def fold(self, name: str, rel: Relation) -> Relation:
        """Group the rows of all clauses by the KEY columns."""
        clause = next((c for c in self.rules[name] if c.folds), None)
        if clause is None:
            if rel.prob and any(r.rule == name for c in self.rules[name] for r in c.refs):
                agg = F.max(rel.prob) if self.config.semiring == "max_min" else 1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col(rel.prob), F.lit(1e-300)))))
                df = rel.df.groupBy(*rel.keys, *[c for c in rel.others if c != rel.prob]).agg(agg.alias(rel.prob))
                return self.with_df(rel, df.select(*rel.columns))
            return rel
        items = {y.name: y for y in clause.yields}
        aggs, after = [], []
        folded = {n: (agg, distinct) for n, agg, _, distinct in clause.folds}
        for n, (agg, distinct) in folded.items():
            aggs.append(self.aggregate(agg, F.col(f"_f_{n}"), rel.df.schema[f"_f_{n}"].dataType, distinct).alias(n))
        keys = [c for c in rel.keys]
        df = rel.df.groupBy(*keys, *(["_priority"] if "_priority" in rel.df.columns else [])).agg(*aggs)
        ex = Expressions(self.context(), State(df, {c: Entry("value", c) for c in df.columns}))
        for y in clause.yields:
            if not y.key:
                after.append(ex.column(y.expr).alias(y.name))
        df = df.select(*keys, *after, *(["_priority"] if "_priority" in df.columns else []))
        out = Relation(df, rel.keys, [y.name for y in clause.yields if not y.key], rel.kinds, next((y.name for y in clause.yields if y.prob), None))
        del items
        for e in clause.require:
            out = self.with_df(out, out.df.where(self.over(out).boolean(e)))
        return out

    def aggregate(self, name: str, c, t: T.DataType, distinct: bool):
        from ..functions.aggregate import build

        own = self.session.rules.get("aggregates", {}).get(name)
        if own:
            return own["builder"](c)
        if name == "mnor" or name == "mprod":
            p = c.cast("double")
            if self.config.strict_probabilities:
                p = F.when((p < 0) | (p > 1), F.raise_error(F.lit("a probability must lie in [0, 1]")).cast("double")).otherwise(p)
            p = F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0))
            return 1 - F.product(1 - p) if name == "mnor" else F.product(p)
        plain = {"msum": "sum", "mmax": "max", "mmin": "min", "mcount": "count"}.get(name, name)
        return build(plain, [c], [t], distinct)

    # --- one clause ---------------------------------------------------------------------------------------------
    def context(self):
        ctx = self.session.context(self.params)
        for name, m in self.models.items():
            ctx.functions[name.lower()] = m["builder"]
        return ctx

    def clause(self, c: Clause, overrides: dict[str, Relation], at: dict[int, Relation] | None = None) -> Relation:
        ctx = self.context()
        planner = Planner(ctx)
        tree = [c.where, c.along, c.folds, c.having, c.best, [y.expr for y in c.yields], [g[1] for g in c.generators]]
        ctx.needs = _merged(property_needs([t for t in tree]), property_needs([A.Match(c.patterns)]))
        entity = {y.expr[1] for y in c.yields if y.expr[0] == "var"}
        for n in entity:  # a yielded node is its id
            if ctx.needs.get(n) == {"*"}:
                ctx.needs[n] = set()
            elif n in ctx.needs:
                ctx.needs[n].discard("*")
        bound_by_refs = {n for r in c.refs if not r.negated for n in r.names}
        patterns, held = c.patterns, []
        state = planner.match(A.Match(patterns), State(None, {}))
        del held, bound_by_refs
        prob = None
        prev: dict[str, str] = {}
        for i, ref in enumerate(c.refs):
            if not ref.negated:
                rel = (at or {}).get(i) or overrides.get(ref.rule) or self.relation(ref.rule)
                state, p, exposed = self.positive(state, ref, rel, planner)
                prev |= exposed
                if p is not None:
                    prob = p if prob is None else self.times(prob, p)
        for name, args, outs in c.generators:
            state = self.generate(state, name, args, outs, planner)
        for e in c.where:
            state = planner.filter(state, e)
        for ref in c.refs:
            if ref.negated:
                state, p = self.negative(state, ref, overrides.get(ref.rule) or self.relation(ref.rule))
                if p is not None:
                    prob = p if prob is None else self.times(prob, p)
        if c.along:
            adds = {}
            for name, e in c.along:
                col = fresh("a")
                adds[name] = (col, Expressions(ctx, state).column(_previous(e, prev)))
            state = State(state.df.withColumns({col: x for col, x in adds.values()}), {**state.scope, **{n: Entry("value", col) for n, (col, _) in adds.items()}})
        return self.project(c, state, prob, ctx)

    def times(self, a, b):
        return F.least(a, b) if self.config.semiring == "max_min" else a * b

    def relation(self, name: str) -> Relation:
        if name not in self.facts:
            if name not in self.rules:
                raise UndefinedRule(name)
            raise RuleError(f"{name} has no facts yet")
        return self.facts[name]

    def positive(self, state: State, ref, rel: Relation, planner: Planner):
        names = {c: fresh("i") for c in rel.columns}
        right = rel.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        if len(ref.names) > len(rel.columns):
            raise RuleError(f"{ref.rule} has {len(rel.columns)} columns")
        on, new, exposed = [], {}, {}
        for var, column in zip(ref.names, rel.columns, strict=False):
            kind = rel.kinds[column]
            if var in state.scope:
                known = state.scope[var]
                if (known.kind == "value") != (kind.kind == "value"):
                    raise RuleError(f"{var} is a {known.kind}, but {ref.rule}'s column {column} is a {kind.kind}")
                on.append(F.col(known.ident) == F.col(names[column]))
            else:
                new[var] = Entry(kind.kind, names[column], {}, None, kind.label_names)
        taken = rel.columns[: len(ref.names)]
        for c in rel.columns:
            exposed[c] = names[c]
            if c not in taken and c not in rel.keys and c not in state.scope:
                new.setdefault(c, Entry(rel.kinds[c].kind, names[c], {}, None, rel.kinds[c].label_names))
        df = state.df.join(right, reduce(lambda a, b: a & b, on)) if on else state.df.crossJoin(right)
        state = State(df, {**state.scope, **new})
        for var, e in list(new.items()):
            if e.kind == "node" and planner.needs(var):
                state = planner.hydrate(var, state)
        return state, (F.col(names[rel.prob]) if rel.prob else None), exposed

    def negative(self, state: State, ref, rel: Relation):
        on = []
        names = {c: fresh("i") for c in rel.columns}
        for var, column in zip(ref.names, rel.columns, strict=False):
            if column in rel.keys:
                if var not in state.scope:
                    raise RuleError(f"{var} of a negated reference isn't bound")
                on.append(F.col(state.scope[var].ident) == F.col(names[column]))
            elif var in state.scope:
                raise RuleError(f"IS NOT can't test the value {column}")
        cond = reduce(lambda a, b: a & b, on)
        if rel.prob is None:
            right = rel.df.select(*[F.col(f"`{c}`").alias(names[c]) for c in rel.keys])
            return State(state.df.join(right, cond, "left_anti"), state.scope), None
        right = rel.df.groupBy(*rel.keys).agg(F.max(rel.prob).alias("_p")).select(*[F.col(f"`{c}`").alias(names[c]) for c in rel.keys], F.col("_p").alias(names[rel.prob]))
        df = state.df.join(right, cond, "left")
        return State(df, state.scope), 1 - F.coalesce(F.col(names[rel.prob]), F.lit(0.0))

    def generate(self, state: State, name: str, args, outs, planner: Planner) -> State:
        """A function that gives a list of structs (or values): one row for each."""
        builder = planner.ctx.functions.get(name)
        if builder is None:
            raise RuleError(f"unknown generator {name}")
        ex = Expressions(planner.ctx, state)
        c = builder([ex.column(a) for a in args], [ex.type(a) for a in args])
        g = fresh("g")
        df = state.df.select("*", F.explode(c).alias(g))
        t = df.schema[g].dataType
        cols = {o: fresh("g") for o in outs}
        fields = t.fieldNames() if isinstance(t, T.StructType) else [None]
        df = df.withColumns({cols[o]: F.col(g)[f] if f else F.col(g) for o, f in zip(outs, fields, strict=True)})
        return State(df, {**state.scope, **{o: Entry("value", x) for o, x in cols.items()}})

    def project(self, c: Clause, state: State, prob, ctx) -> Relation:
        ex = Expressions(ctx, state)
        folded = {n for n, *_ in c.folds}
        select, kinds, keys, others = [], {}, [], []
        prob_name = next((y.name for y in c.yields if y.prob), None)
        template = next((d for d in self.rules[c.rule] if d.folds), None)
        for y in c.yields:
            (keys if y.key else others).append(y.name)
            if not y.key and folded:
                continue
            entry = state.scope.get(y.expr[1]) if y.expr[0] == "var" else None
            if entry is not None and entry.kind != "value":
                select.append(F.col(entry.ident).alias(y.name))
                kinds[y.name] = Entry(entry.kind, y.name, {}, None, entry.label_names)
            else:
                col = ex.column(y.expr)
                if y.prob and prob is not None and not _reads_prob(y.expr, c, self):
                    col = self.times(col.cast("double"), prob)
                select.append((col.cast("double") if y.prob else col).alias(y.name))
                kinds[y.name] = Entry("value", y.name)
        for n, agg, e, _ in c.folds:
            if e == ("star",):
                col = F.lit(1)
            elif e[0] == "var" and e[1] in state.scope and state.scope[e[1]].kind != "value":
                col = F.col(state.scope[e[1]].ident)
            else:
                col = ex.column(e)
            if agg in ("mnor", "mprod") and prob is not None and not _reads_prob(e, c, self):
                col = self.times(col.cast("double"), prob)
            select.append(col.alias(f"_f_{n}"))
        if template is not None and not c.folds:  # a seed: its values are inputs of the fold
            for n, *_ in template.folds:
                y = next((y for y in c.yields if y.name == n), None)
                select.append((ex.column(y.expr) if y else F.lit(None)).alias(f"_f_{n}"))
            select = [s for s, y in zip(select, c.yields, strict=False) if y.key] + select[len(c.yields) :]
        for y in c.yields:
            kinds.setdefault(y.name, Entry("value", y.name))
        if len({d.priority for d in self.rules[c.rule]}) > 1:
            select.append(F.lit(c.priority).alias("_priority"))
        return Relation(state.df.select(*select), keys, others, kinds, prob_name)

    # --- commands -----------------------------------------------------------------------------------------------
    def goal(self, args: dict) -> DataFrame:
        rel = self.relation(args["rule"])
        ctx = self.context()
        planner = Planner(ctx)
        ret = args.get("return")
        ctx.needs = property_needs([args.get("where"), ret] if ret else [args.get("where")])
        names = {c: fresh("q") for c in rel.columns}
        df = rel.df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
        state = State(df, {c: Entry(rel.kinds[c].kind, n, {}, None, rel.kinds[c].label_names) for c, n in names.items()})
        wanted = names_in([args.get("where"), ret.items if ret else [], ret.order if ret else []])
        if unknown := wanted - set(rel.columns) - {a for _, a in (ret.items if ret else [])}:
            raise RuleError(f"{args['rule']} doesn't yield {', '.join(sorted(unknown))}")
        for c in rel.columns:
            if rel.kinds[c].kind == "node" and planner.needs(c):
                state = planner.hydrate(c, state)
        if args.get("where") is not None:
            state = planner.filter(state, args["where"])
        if ret is None:
            return state.df.select(*[F.col(state.scope[c].ident).alias(c) for c in rel.columns])
        return planner.output(planner.project(ret, state))

    def derive(self, args: dict) -> DataFrame:
        """Write the edges of a rule's DERIVE clauses, or of its facts."""
        name = args["rule"]
        work = self.session.graph.copy()
        count = 0
        for c in self.rules.get(name, ()):
            ctx = self.context()
            ctx.graph = work
            planner = Planner(ctx)
            ctx.needs = _merged(property_needs([c.where, args.get("where"), c.derive]), {})
            state = planner.match(A.Match(c.patterns), State(None, {}))
            for ref in c.refs:
                if not ref.negated:
                    state, _, _ = self.positive(state, ref, self.relation(ref.rule), planner)
            for e in c.where:
                state = planner.filter(state, e)
            for ref in c.refs:
                if ref.negated:
                    state, _ = self.negative(state, ref, self.relation(ref.rule))
            if args.get("where") is not None:
                state = planner.filter(state, args["where"])
            idents = [state.scope[x.var].ident for p in c.derive for x in p.elements[0::2] if x.var in state.scope]
            state = State(keep(state.df.dropDuplicates(idents) if idents else state.df, "derive"), state.scope)
            count += state.df.count()
            for p in c.derive:
                state = create_pattern(planner, p, state)
        self.session.graph = work
        return self.session.graph.spark.createDataFrame([(count,)], "affected long")

    def explain(self, args: dict) -> DataFrame:
        """The clauses that derive each fact, with the facts they read: one row for a derivation."""
        name = args["rule"]
        goal = self.goal({"rule": name, "where": args.get("where")})
        rel = self.relation(name)
        parts = []
        for i, c in enumerate(self.rules[name]):
            one = self.clause(c, {})
            keys = one.df.select(*[F.col(f"`{k}`").alias(k) for k in rel.keys])
            parts.append(keys.select(*rel.keys, F.lit(i).alias("clause"), F.lit(", ".join(r.rule for r in c.refs)).alias("reads")).distinct())
        tree = reduce(DataFrame.unionByName, parts)
        right = goal.select(*[F.col(k).alias(f"_g_{k}") for k in rel.keys]).distinct()
        return tree.join(right, [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in rel.keys], "left_semi").select(F.lit(name).alias("rule"), *rel.keys, "clause", "reads", F.xxhash64(*rel.keys).alias("fact_id"))

    def assume(self, args: dict) -> Result:
        """Run a body over a hypothetical graph; nothing of it stays."""
        saved, facts, rules = self.session.graph, dict(self.facts), dict(self.rules)
        try:
            for tree in args["writes"]:
                work = self.session.graph.copy()
                ctx = self.context()
                ctx.graph = work
                Planner(ctx).run(tree).collect()
                self.session.graph = work
            body: Program = args["body"]
            for c in body.clauses:
                self.rules.setdefault(c.rule, []).append(c)
            self.derive_all()
            derived = dict(self.facts)
            return Result(derived, [self.step(s) for s in body.steps], self.profile)
        finally:
            self.session.graph, self.facts, self.rules = saved, facts, rules

    def abduce(self, args: dict) -> DataFrame:
        """Single edits after which the conclusion holds, or doesn't; each is tried on its own."""
        spark = self.session.graph.spark
        name, negated = args["rule"], args["negated"]
        rules = {name}
        while True:
            more = rules | {r.rule for n in rules for c in self.rules[n] for r in c.refs}
            if more == rules:
                break
            rules = more
        rels = [(x, a, b) for n in sorted(rules) for c in self.rules[n] for p in c.patterns for a, x, b in zip(p.elements[0::2], p.elements[1::2], p.elements[2::2], strict=False) if isinstance(x, A.RelPat) and x.types]
        candidates: list[tuple[str, float, dict]] = []
        graph = self.session.graph
        for x, a, b in rels:
            for t in x.types:
                if t not in graph.edges:
                    continue
                df = graph.edges[t].df
                room = self.config.abduce_candidates - len(candidates)
                if room <= 0:
                    break
                if negated:
                    candidates += [("remove_edge", 1.0, {"type": t, "eid": r["_eid"], "source": r["_src"], "target": r["_dst"]}) for r in df.orderBy("_eid").limit(room).collect()]
                    numeric = [f.name for f in df.schema if not f.name.startswith("_") and values.is_numeric(f.dataType)]
                    for prop in numeric:
                        room = self.config.abduce_candidates - len(candidates)
                        candidates += [("zero_property", 0.5, {"type": t, "eid": r["_eid"], "property": prop}) for r in df.where(F.col(prop) != 0).orderBy("_eid").limit(max(room, 0)).collect()]
                else:
                    frm = graph.scan_nodes(a.labels).select(F.col("_vid").alias("s")).orderBy("s").limit(room)
                    to = graph.scan_nodes(b.labels).select(F.col("_vid").alias("d")).orderBy("d").limit(room)
                    pairs = frm.crossJoin(to).where("s <> d").join(df, (F.col("s") == F.col("_src")) & (F.col("d") == F.col("_dst")), "left_anti").orderBy("s", "d").limit(room)  # at most room x room rows
                    candidates += [("add_edge", 1.5, {"type": t, "source": r.s, "target": r.d}) for r in pairs.collect()]
        out = []
        for kind, cost, edit in list({repr(c): c for c in candidates}.values())[: self.config.abduce_candidates]:
            work = graph.copy()
            table = work.edges[edit["type"]]
            if kind == "remove_edge":
                df = table.df.where(F.col("_eid") != edit["eid"])
            elif kind == "zero_property":
                p = edit["property"]
                df = table.df.withColumn(p, F.when(F.col("_eid") == edit["eid"], F.lit(0).cast(table.df.schema[p].dataType)).otherwise(F.col(p)))
            else:
                df = table.df.unionByName(spark.createDataFrame([(-1, edit["source"], edit["target"])], "_eid long, _src long, _dst long"), allowMissingColumns=True)
            work.edges[edit["type"]] = type(table)(df, table.sources, table.targets)
            saved, facts = self.session.graph, dict(self.facts)
            self.session.graph = work
            try:
                self.derive_all()
                holds = not self.goal({"rule": name, "where": args.get("where")}).isEmpty()
            finally:
                self.session.graph, self.facts = saved, facts
            out.append((kind, edit["type"], edit.get("eid"), edit.get("source"), edit.get("target"), edit.get("property"), cost, holds != negated))
        out.sort(key=lambda r: (not r[7], r[6]))
        return spark.createDataFrame(out[: self.config.abduce_results], "kind string, type string, eid long, source long, target long, property string, cost double, validated boolean")

    def step(self, s):
        if s.kind == "query":
            return self.goal(s.args)
        if s.kind == "derive":
            out = self.derive(s.args)
            self.derive_all()
            return out
        if s.kind == "explain":
            return self.explain(s.args)
        if s.kind == "assume":
            return self.assume(s.args)
        if s.kind == "abduce":
            return self.abduce(s.args)
        if s.kind == "cypher":
            from ..session import is_write

            tree = s.args["tree"]
            ctx = self.context()
            if is_write(tree):
                work = self.session.graph.copy()
                ctx.graph = work
                df = Planner(ctx).run(tree)
                df = keep(df, "write") if df.columns else df
                self.session.graph = work
                self.derive_all()
                return df
            return Planner(ctx).run(tree)
        from .models import run_model_step

        return run_model_step(self, s)


def _previous(e, prev: dict[str, str], identity=None):
    """``prev.x`` becomes the referenced rule's column; without a reference the neutral element of its operation."""
    if isinstance(e, tuple) and e:
        if e[0] == "prop" and e[1] == ("var", "prev"):
            return ("col", prev[e[2]]) if e[2] in prev else ("lit", identity)
        if e[0] == "bin":
            neutral = {"+": 0, "-": 0, "*": 1, "/": 1}.get(e[1], identity)
            return ("bin", e[1], _previous(e[2], prev, neutral), _previous(e[3], prev, neutral))
        return tuple(_previous(x, prev, identity) for x in e)
    if isinstance(e, list):
        return [_previous(x, prev, identity) for x in e]
    return e


def _reads_prob(e, c: Clause, engine: Engine) -> bool:
    """Whether an expression reads a referenced rule's probability itself."""
    read = names_in([e])
    for ref in c.refs:
        rel = engine.facts.get(ref.rule)
        prob = rel.prob if rel else next((y.name for d in engine.rules.get(ref.rule, ()) for y in d.yields if y.prob), None)
        if prob and prob in read:
            return True
    return False


def run_program(session, text: str, params: dict, config: Config | None = None) -> Result:
    """Derive all rules of a program, then run its commands in order."""
    program = parse_program(text)
    engine = Engine(session, params, config)
    modules = session.rules.setdefault("modules", {})
    for name, only in program.uses:
        if name not in modules:
            raise UndefinedRule(f"no module {name}")
        for c in modules[name]:
            if only is None or c.rule in only:
                engine.rules.setdefault(c.rule, []).append(c)
    for c in session.rules.get("registered", []):
        engine.rules.setdefault(c.rule, []).append(c)
    for c in program.clauses:
        engine.rules.setdefault(c.rule, []).append(c)
    if program.module:
        modules[program.module] = program.clauses
    grouped(program.clauses)
    for s in program.steps:
        if s.kind == "model":
            engine.step(s)
    engine.derive_all()
    result = Result(dict(engine.facts), [], engine.profile)
    for s in program.steps:
        if s.kind != "model":
            result.results.append(engine.step(s))
    return result


def register_aggregate(session, name: str, builder, monotone: bool = False) -> None:
    """A fold: ``builder(column)`` gives an aggregate column; monotone ones may be recursive."""
    session.rules.setdefault("aggregates", {})[name.lower()] = {"builder": builder, "monotone": monotone}


def register_rules(session, text: str) -> None:
    """Rules that every later program of the session sees."""
    session.rules.setdefault("registered", []).extend(parse_program(text).clauses)
