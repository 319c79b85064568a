"""Programs: rules and the commands that run on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..cypher import ast as A
from ..cypher.parser import Parser


@dataclass
class Ref:
    """``(x, y) IS rule TO z``: subjects take the rule's KEY columns, then its others."""

    names: list[str]
    rule: str
    negated: bool = False


@dataclass
class Yield:
    expr: tuple
    name: str
    key: bool = False
    prob: bool = False


@dataclass
class Clause:
    rule: str
    priority: int
    patterns: list
    where: list = field(default_factory=list)
    refs: list[Ref] = field(default_factory=list)
    generators: list = field(default_factory=list)  # (function, args, names)
    along: list = field(default_factory=list)  # (name, expr)
    folds: list = field(default_factory=list)  # (name, aggregate, arg, distinct)
    require: list = field(default_factory=list)
    having: list = field(default_factory=list)
    best: list = field(default_factory=list)  # (expr, down)
    yields: list[Yield] = field(default_factory=list)
    derive: list = field(default_factory=list)
    merge: list = field(default_factory=list)


@dataclass
class Step:
    """A command: query, derive, explain, assume, abduce, cypher, model, calibrate, validate."""

    kind: str
    args: dict


@dataclass
class Program:
    module: str | None = None
    uses: list = field(default_factory=list)
    clauses: list[Clause] = field(default_factory=list)
    steps: list = field(default_factory=list)


class RuleParser(Parser):
    def program(self, until: str | None = None) -> Program:
        out = Program()
        while self.tok.kind != "end" and not (until and self.sign(until)):
            if self.accept(";"):
                continue
            if self.accept_words("module"):
                out.module = self.dotted()
            elif self.accept_words("use"):
                name = self.dotted()
                only = None
                if self.accept("{"):
                    only = self._names()
                    self.expect("}")
                out.uses.append((name, only))
            elif self.words("create", "rule"):
                self.at += 2
                out.clauses.append(self.rule())
            else:
                out.steps.append(self.step())
        return out

    def rule(self) -> Clause:
        name = self.dotted()
        priority = int(self.take().value) if self.accept_words("priority") else 0
        self.expect_word("as")
        self.expect_word("match")
        out = Clause(name, priority, self.patterns())
        if self.accept_words("where"):
            self.conditions(out)
        if self.accept_words("along"):
            while True:
                n = self.name()
                self.expect("=")
                out.along.append((n, self.expr()))
                if not self.accept(","):
                    break
        if self.accept_words("fold"):
            while True:
                n = self.name()
                self.expect("=")
                e = self.expr()
                if e[0] != "fn":
                    self.fail("FOLD needs an aggregate")
                out.folds.append((n, e[1], e[2][0] if e[2] else ("star",), e[3]))
                if not self.accept(","):
                    break
        if self.accept_words("require"):
            out.require.append(self.expr())
        if self.accept_words("where"):
            out.having.append(self.expr())
        if self.accept_words("best", "by"):
            out.best = self._order()
        if self.accept_words("yield"):
            while True:
                key = self.accept_words("key")
                e = self.expr()
                prob = False
                name_ = e[1] if e[0] == "var" else e[2] if e[0] == "prop" else f"c{len(out.yields)}"
                if self.accept_words("as"):
                    if self.word("prob") and not self.words("prob", "as"):
                        self.take()
                        prob = True
                    else:
                        name_ = self.name()
                        prob = self.accept_words("prob")
                elif self.accept_words("prob"):
                    prob = True
                out.yields.append(Yield(e, name_, key, prob))
                if not self.accept(","):
                    break
        elif self.accept_words("derive"):
            if self.accept_words("merge"):
                out.merge = [self.name()]
                while self.accept(","):
                    out.merge.append(self.name())
            else:
                out.derive = self.patterns()
        else:
            self.fail("expected YIELD or DERIVE")
        return out

    def conditions(self, out: Clause) -> None:
        while True:
            if (ref := self.reference()) is not None:
                out.refs.append(ref)
            elif (gen := self.generator()) is not None:
                out.generators.append(gen)
            else:
                e = self._xor_without_and()
                out.where.append(e)
            if not (self.accept_words("and") or self.accept(",")):
                return

    def _xor_without_and(self):
        """One condition; OR binds it together, AND ends it."""
        e = self._not()
        while self.word("or", "xor"):
            kind = self.take().text.lower()
            e = (kind, e, self._not())
        return e

    def reference(self) -> Ref | None:
        mark = self.at
        negated = self.accept_words("not")
        names = []
        if self.tok.kind == "name" and self.word("is", n=1) and not self.word("null", n=2) and not (self.word("not", n=2) and self.word("null", n=3)):
            names = [self.name()]
        elif self.sign("("):
            self.take()
            while self.tok.kind == "name":
                names.append(self.name())
                if not self.accept(","):
                    break
            if not names or not self.accept(")") or not self.word("is") or self.word("null", n=1):
                self.at = mark
                return None
        else:
            self.at = mark
            return None
        self.expect_word("is")
        negated = self.accept_words("not") or negated
        rule = self.dotted()
        if self.accept_words("to"):
            names.append(self.name())
        return Ref(names, rule, negated)

    def generator(self):
        mark = self.at
        if self.tok.kind == "name" and self.sign("(", n=1):
            from ..errors import ParseError

            try:
                name = self.dotted()
                self.expect("(")
                args = self._args()
                if self.accept("->") or (self.accept("-") and self.accept(">")):
                    self.expect("(")
                    outs = self._names()
                    self.expect(")")
                    return name.lower(), args, outs
            except ParseError:
                pass
        self.at = mark
        return None

    def step(self) -> Step:
        if self.accept_words("query"):
            return self._goal("query")
        if self.accept_words("explain", "rule"):
            return self._goal("explain")
        if self.accept_words("abduce"):
            negated = self.accept_words("not")
            step = self._goal("abduce")
            step.args["negated"] = negated
            return step
        if self.word("derive"):
            self.take()
            return self._goal("derive")
        if self.accept_words("assume"):
            self.expect("{")
            writes = []
            while not self.accept("}"):
                if not self.accept(";"):
                    writes.append(self.query())
            self.expect_word("then")
            self.expect("{")
            body = self.program("}")
            self.expect("}")
            return Step("assume", {"writes": writes, "body": body})
        if self.words("create", "model"):
            self.at += 2
            return self._model()
        if self.word("calibrate", "validate"):
            kind = self.take().text.lower()
            args: dict = {"model": self.dotted()}
            self.expect_word("on")
            self.expect_word("match")
            args["patterns"] = self.patterns()
            args["where"] = self.expr() if self.accept_words("where") else None
            self.expect_word("target")
            args["target"] = self.expr()
            if kind == "calibrate":
                self.expect_word("method")
                args["method"] = self.name()
                args["holdout"] = self.take().value if self.accept_words("holdout") else 0
            else:
                self.expect_word("metrics")
                args["metrics"] = self._names()
            return Step(kind, args)
        return Step("cypher", {"tree": self.query()})

    def _model(self) -> Step:
        name = self.dotted()
        self.expect_word("as")
        args: dict = {"name": name, "features": [], "calibration": None}
        self.expect_word("input")
        self.expect("(")
        args["input"] = self.name()
        args["label"] = self.name() if self.accept(":") else None
        self.expect(")")
        while self.accept_words("features"):
            args["features"].append(self.expr())
            while self.accept(","):
                args["features"].append(self.expr())
        self.expect_word("output")
        args["kind"] = self.name().lower()
        args["output"] = self.name()
        self.expect_word("using")
        self.name()
        self.expect("(")
        args["provider"] = self._string()
        while not self.accept(")"):
            self.take()
        if self.accept_words("calibration"):
            args["calibration"] = self.name()
        if self.accept_words("version"):
            args["version"] = self._string()
        return Step("model", args)

    def _goal(self, kind: str) -> Step:
        args: dict = {"rule": self.dotted()}
        args["where"] = self.expr() if self.accept_words("where") else None
        if self.accept_words("return"):
            args["return"] = self._projection(final=True)
        return Step(kind, args)


def parse_program(text: str) -> Program:
    return RuleParser(text).program()


__all__ = ["A", "Clause", "Program", "Ref", "Step", "Yield", "parse_program"]
