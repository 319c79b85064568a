"""Recursive-descent parser of the query language."""

from __future__ import annotations

from . import ast as A
from .lexer import Token, tokens_of
from ..errors import ParseError

_COMPARE = {"=", "<>", "!=", "<", ">", "<=", ">=", "=~", "~="}
_STOP = {"match", "optional", "where", "return", "with", "unwind", "call", "create", "merge", "set", "delete", "detach", "remove", "foreach", "union", "order", "skip", "limit", "on", "yield", "as", "asc", "desc", "ascending", "descending"}


def without_variable(e, var: str | None):
    """``var.p`` as plain ``p``: what a check says of a row."""
    if isinstance(e, tuple):
        return ("var", e[2]) if e[:1] == ("prop",) and e[1] == ("var", var) else tuple(without_variable(x, var) for x in e)
    return [without_variable(x, var) for x in e] if isinstance(e, list) else e


class Parser:
    """State over the tokens of one text."""

    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, tokens_of(text), 0
        self.fresh = 0

    # --- tokens -------------------------------------------------------------------------------------------------
    @property
    def tok(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def word(self, *words: str, n: int = 0) -> bool:
        t = self.ahead(n)
        return t.kind == "name" and t.value != "quoted" and t.text.lower() in words

    def words(self, *sequence: str) -> bool:
        return all(self.word(w, n=i) for i, w in enumerate(sequence))

    def sign(self, *signs: str, n: int = 0) -> bool:
        t = self.ahead(n)
        return t.kind == "sign" and t.text in signs

    def take(self) -> Token:
        t = self.tok
        self.at += 1
        return t

    def accept(self, *signs: str) -> str | None:
        return self.take().text if self.sign(*signs) else None

    def accept_words(self, *sequence: str) -> bool:
        if self.words(*sequence):
            self.at += len(sequence)
            return True
        return False

    def expect(self, sign: str) -> None:
        if not self.accept(sign):
            self.fail(f"expected {sign!r}")

    def expect_word(self, *sequence: str) -> None:
        if not self.accept_words(*sequence):
            self.fail(f"expected {' '.join(sequence).upper()}")

    def fail(self, why: str) -> None:
        raise ParseError(f"{why} at {self.tok.start}, before {self.text[self.tok.start : self.tok.start + 30]!r}")

    def name(self) -> str:
        if self.tok.kind != "name":
            self.fail("expected a name")
        return self.take().text

    def dotted(self) -> str:
        parts = [self.name()]
        while self.accept("."):
            parts.append(self.name())
        return ".".join(parts)

    def hidden(self, kind: str = "v") -> str:
        self.fresh += 1
        return f"_{kind}{self.fresh}"

    # --- statements ---------------------------------------------------------------------------------------------
    def statement(self):
        out = self._statement()
        self.accept(";")
        if self.tok.kind != "end":
            self.fail("unexpected text")
        return out

    def _statement(self):
        if self.word("explain", "profile"):
            kind = self.take().text.lower()
            return A.Command(kind, {"query": self._statement()})
        if self.word("copy", "backup", "vacuum", "checkpoint", "show", "drop", "alter") or (self.word("create") and self.word("label", "edge", "index", "constraint", "vector", "fulltext", "sparse", "scalar", "json", n=1)):
            return self._command()
        return self.query()

    def _command(self):
        start = self.take().text.lower()
        if start == "copy":
            name = self.name()
            way = "to" if self.accept_words("to") else (self.expect_word("from") or "from")
            path = self._string()
            form = self.name().lower() if self.accept_words("format") else "parquet"
            return A.Command("copy", {"name": name, "way": way, "path": path, "format": form})
        if start == "backup":
            return A.Command("backup", {"path": self._string()})
        if start in ("vacuum", "checkpoint"):
            return A.Command(start, {})
        if start == "show":
            what = self.name().lower()
            if what == "edge":
                self.accept_words("types")
            return A.Command("show", {"what": what})
        verb = start
        kind = self.name().lower()
        if kind in ("vector", "fulltext", "sparse", "scalar", "json"):
            index_kind, kind = kind, self.name().lower()
            if kind == "fulltext":
                index_kind, kind = "json_fulltext", self.name().lower()
        else:
            index_kind = "scalar"
        if kind == "edge":
            self.expect_word("type")
            kind = "edge_type"
        exists = False
        if self.accept_words("if", "not", "exists") or self.accept_words("if", "exists"):
            exists = True
        if kind in ("label", "edge_type"):
            name = self.name()
            args: dict = {"name": name, "exists": exists or self.accept_words("if", "exists"), "props": {}}
            if verb == "alter":
                if self.accept_words("add"):
                    self.accept_words("property")
                    args["add"] = (self.name(), self._type())
                elif self.accept_words("drop"):
                    self.accept_words("property")
                    args["drop"] = self.name()
                elif self.accept_words("rename"):
                    self.accept_words("property")
                    old = self.name()
                    self.expect_word("to")
                    args["rename"] = (old, self.name())
            if self.accept("("):
                while not self.accept(")"):
                    key, type_ = self.name(), self._type()
                    args["props"][key] = (type_, self.accept_words("not", "null"))
                    if self.accept_words("unique"):
                        args.setdefault("unique", []).append(key)
                    self.accept(",")
            if self.accept_words("from"):
                args["from"] = self._names()
                self.expect_word("to")
                args["to"] = self._names()
            return A.Command(f"{verb}_{kind}", args)
        name = None if self.word("on", "for") else self.name()
        args = {"name": name, "exists": exists, "index_kind": index_kind}
        if verb == "drop":
            args["exists"] = exists or self.accept_words("if", "exists")
            return A.Command(f"drop_{kind}", args)
        if not (self.accept_words("on") or self.accept_words("for")):
            self.fail("expected ON or FOR")
        self.expect("(")
        edge = self.accept(")")
        if edge:
            self.expect("-")
            self.expect("[")
        var = self.name() if self.tok.kind == "name" and self.sign(":", n=1) else None
        self.expect(":")
        args["label"] = self.name()
        if edge:
            self.expect("]")
            self.accept("-", "->")
            self.expect("(")
        self.expect(")")
        if kind == "index":
            self.accept_words("on")
            self.accept_words("each")
            close = ")" if self.accept("(") else "]" if self.accept("[") else None
            args["props"] = [self._last_of_dotted()]
            while self.accept(","):
                args["props"].append(self._last_of_dotted())
            if close:
                self.expect(close)
            if self.accept_words("options") or self.accept_words("with"):
                args["options"] = self.expr()
        else:
            if not (self.accept_words("assert") or self.accept_words("require")):
                self.fail("expected ASSERT")
            if self.accept_words("exists"):
                self.expect("(")
                args |= {"kind": "exists", "props": [self._last_of_dotted()]}
                self.expect(")")
            elif self.accept_words("check"):
                args |= {"kind": "check", "expr": without_variable(self.expr(), var)}
            else:
                start, paren = self.at, self.accept("(")
                props = [self._last_of_dotted()]
                while self.accept(","):
                    props.append(self._last_of_dotted())
                if paren:
                    self.accept(")")
                if not self.accept_words("is"):  # any other assertion is a check
                    self.at = start
                    return A.Command(f"{verb}_{kind}", args | {"kind": "check", "expr": without_variable(self.expr(), var)})
                kind_ = "exists" if self.accept_words("not", "null") else "key" if self.accept_words("node", "key") or self.accept_words("key") else (self.expect_word("unique") or "unique")
                args |= {"kind": kind_, "props": props}
        return A.Command(f"{verb}_{kind}", args)

    def _last_of_dotted(self) -> str:
        return self.dotted().rsplit(".", 1)[-1]

    def _names(self) -> list[str]:
        out = [self.name()]
        while self.accept(",", "|"):
            out.append(self.name())
        return out

    def _type(self) -> str:
        out = self.name()
        if self.accept("("):
            inner = []
            while not self.accept(")"):
                inner.append(self.take().text)
            out += "(" + "".join(inner) + ")"
        if self.accept("<"):
            out += "<" + self._type() + ">"
            self.expect(">")
        return out

    def _string(self) -> str:
        if self.tok.kind != "string":
            self.fail("expected a string")
        return self.take().value

    def query(self):
        if self.words("with", "recursive"):
            self.at += 2
            name, columns = self.name(), []
            if self.accept("("):
                columns = self._names()
                self.expect(")")
            self.expect_word("as")
            self.expect("(")
            anchor = self._single()
            self.expect_word("union")
            self.accept_words("all")
            step = self._single()
            self.expect(")")
            return A.Recursive(name, columns, anchor, step, self._single())
        parts, kinds = [self._single()], set()
        while self.accept_words("union"):
            kinds.add(self.accept_words("all"))
            parts.append(self._single())
        if len(kinds) > 1:
            raise ParseError("UNION and UNION ALL can't be mixed")
        return A.Union(parts, kinds.pop()) if kinds else parts[0]

    def _single(self) -> A.Query:
        clauses = []
        while clause := self.clause():
            clauses.append(clause)
        if not clauses:
            self.fail("expected a clause")
        return A.Query(clauses)

    def clause(self):
        if self.accept_words("optional", "match"):
            return self._match(True)
        if self.accept_words("match"):
            return self._match(False)
        if self.accept_words("unwind"):
            e = self.expr()
            self.expect_word("as")
            return A.Unwind(e, self.name())
        if self.accept_words("return"):
            return self._projection(final=True)
        if self.word("with"):
            self.take()
            return self._projection(final=False)
        if self.words("optional", "call") or self.word("call"):
            optional = self.accept_words("optional")
            self.take()
            return self._call(optional)
        if self.accept_words("create"):
            return A.Create(self.patterns())
        if self.accept_words("merge"):
            out = A.Merge(self.path())
            while self.word("on"):
                self.take()
                target = out.on_create if self.accept_words("create") else (self.expect_word("match") or out.on_match)
                self.expect_word("set")
                target += self._set_items()
            return out
        if self.accept_words("set"):
            return A.SetItems(self._set_items())
        if self.accept_words("remove"):
            items = []
            while True:
                var = self.name()
                if self.accept("."):
                    items.append(("prop", var, self.name()))
                else:
                    items.append(("label", var, self._label_names()))
                if not self.accept(","):
                    return A.Remove(items)
        if self.word("detach", "delete"):
            detach = self.accept_words("detach")
            self.expect_word("delete")
            exprs = [self.expr()]
            while self.accept(","):
                exprs.append(self.expr())
            return A.Delete(exprs, detach)
        if self.accept_words("foreach"):
            self.expect("(")
            var = self.name()
            self.expect_word("in")
            e = self.expr()
            self.expect("|")
            body = []
            while not self.accept(")"):
                body.append(self.clause() or self.fail("expected a clause"))
            return A.Foreach(var, e, body)
        return None

    def _label_names(self) -> list[str]:
        out = []
        while self.accept(":"):
            out.append(self.name())
        return out

    def _set_items(self) -> list[tuple]:
        items = []
        while True:
            var = self.name()
            if self.accept("."):
                key = self.name()
                self.expect("=")
                items.append(("prop", var, key, self.expr()))
            elif self.accept("+="):
                items.append(("plus", var, self.expr()))
            elif self.accept("="):
                items.append(("all", var, self.expr()))
            else:
                items.append(("label", var, self._label_names()))
            if not self.accept(","):
                return items

    def _match(self, optional: bool) -> A.Match:
        patterns = self.patterns()
        return A.Match(patterns, self.expr() if self.accept_words("where") else None, optional)

    def _call(self, optional: bool):
        if self.sign("{") or self.sign("("):
            imports = None
            if self.accept("("):
                imports = []
                while not self.accept(")"):
                    imports.append("*" if self.accept("*") else self.name())
                    self.accept(",")
            self.expect("{")
            inner = self.query()
            self.expect("}")
            return A.SubCall(inner, imports, optional)
        name, args = self.dotted(), []
        if self.accept("("):
            args = self._args()
        out = A.Call(name, args)
        if self.accept_words("yield"):
            out.yields = []
            while True:
                if self.accept("*"):
                    out.yields = None
                    break
                source = self.name()
                out.yields.append((source, self.name() if self.accept_words("as") else source))
                if not self.accept(","):
                    break
            if self.accept_words("where"):
                out.where = self.expr()
        return out

    def _args(self) -> list:
        args = []
        while not self.accept(")"):
            args.append(self.expr())
            if not self.sign(")"):
                self.expect(",")
        return args

    def _projection(self, final: bool) -> A.Projection:
        out = A.Projection([], final=final, distinct=self.accept_words("distinct"))
        if self.accept("*"):
            out.star = True
        if not out.star or self.accept(","):
            while True:
                start = self.tok.start
                e = self.expr()
                end = self.tokens[self.at - 1]
                text = self.text[start : end.start + len(end.text) + (2 if end.value == "quoted" else 0)].strip()
                alias = self.name() if self.accept_words("as") else (e[1] if e[0] == "var" else text)
                out.items.append((e, alias))
                if not self.accept(","):
                    break
        if self.accept_words("order", "by"):
            out.order = self._order()
        if self.accept_words("skip") or self.accept_words("offset"):
            out.skip = self.expr()
        if self.accept_words("limit"):
            out.limit = self.expr()
        if not final and self.accept_words("where"):
            out.where = self.expr()
        return out

    def _order(self) -> list[tuple]:
        out = []
        while True:
            e = self.expr()
            down = self.accept_words("desc") or self.accept_words("descending")
            if not down:
                self.accept_words("asc") or self.accept_words("ascending")
            out.append((e, down))
            if not self.accept(","):
                return out

    # --- patterns -----------------------------------------------------------------------------------------------
    def patterns(self) -> list[A.PathPat]:
        out = [self.path()]
        while self.accept(","):
            out.append(self.path())
        return out

    def path(self) -> A.PathPat:
        var = None
        if self.tok.kind == "name" and self.sign("=", n=1):
            var = self.name()
            self.take()
        out = A.PathPat(var, [])
        if self.word("shortestpath", "allshortestpaths") and self.sign("(", n=1):
            out.selector = "shortest" if self.take().text.lower() == "shortestpath" else "all_shortest"
            self.expect("(")
            out.elements = self._elements()
            self.expect(")")
            return out
        if self.words("all", "shortest"):
            self.at += 2
            out.selector = "all_shortest"
        elif self.words("any", "shortest") or self.words("any"):
            self.take()
            self.accept_words("shortest")
            out.selector = "shortest"
        elif self.word("shortest") and self.ahead().kind == "number":
            self.take()
            out.selector, out.k = "k", int(self.take().value)
        if self.word("walk", "trail", "acyclic", "simple"):
            out.mode = self.take().text.lower()
        self.accept_words("path") or self.accept_words("paths")
        out.elements = self._elements()
        return out

    def _elements(self) -> list:
        out = [self._node_or_group()]
        while self.sign("-", "<-", "<") or self.sign("("):
            if self.sign("("):  # a node and a group side by side
                out.append(self._node_or_group())
                continue
            out.append(self._rel())
            out.append(self._node_or_group())
        return out

    def _node_or_group(self):
        if self.sign("(") and self.sign("(", n=1):
            self.expect("(")
            inner = self._elements()
            where = self.expr() if self.accept_words("where") else None
            self.expect(")")
            low, high = self._quantifier() or (1, 1)
            return A.GroupPat(inner, low, high, where)
        return self._node()

    def _quantifier(self) -> tuple[int, int | None] | None:
        if self.accept("*"):
            return 0, None
        if self.accept("+"):
            return 1, None
        if self.accept("{"):
            low = int(self.take().value) if self.tok.kind == "number" else 0
            high: int | None = low
            if self.accept(","):
                high = int(self.take().value) if self.tok.kind == "number" else None
            self.expect("}")
            return low, high
        return None

    def _node(self) -> A.NodePat:
        self.expect("(")
        out = A.NodePat(None)
        if self.tok.kind == "name" and not self.word("where"):
            out.var = self.name()
        while self.accept(":") or self.accept("&"):
            group = [self.name()]
            while self.accept("|"):
                self.accept(":")
                group.append(self.name())
            out.labels.append(group)
        if self.sign("{"):
            out.props = self._props()
        elif self.tok.kind == "param":
            out.props = {"*": ("param", self.take().text)}
        if self.accept_words("where"):
            out.where = self.expr()
        self.expect(")")
        return out

    def _props(self) -> dict:
        self.expect("{")
        out = {}
        while not self.accept("}"):
            key = self.take().value if self.tok.kind == "string" else self.name()
            self.expect(":")
            out[key] = self.expr()
            if not self.sign("}"):
                self.expect(",")
        return out

    def _rel(self) -> A.RelPat:
        left = bool(self.accept("<-")) or (self.sign("<") and self.sign("-", n=1) and bool(self.take()) and bool(self.take()))
        if not left:
            self.expect("-")
        out = A.RelPat(None)
        if self.accept("["):
            if self.tok.kind == "name" and not self.word("where"):
                out.var = self.name()
            if self.accept(":"):
                out.types.append(self.name())
                while self.accept("|"):
                    self.accept(":")
                    out.types.append(self.name())
            if self.accept("*"):
                out.variable, out.low, out.high = True, 1, None
                if self.tok.kind == "number":
                    out.low = out.high = int(self.take().value)
                    if self.accept(".."):
                        out.high = None
                elif self.accept(".."):
                    out.low = 1
                    if self.tok.kind == "number":
                        out.high = int(self.take().value)
                if out.high is None and self.tok.kind == "number":
                    out.high = int(self.take().value)
            if self.sign("{"):
                out.props = self._props()
            if self.accept_words("where"):
                out.where = self.expr()
            self.expect("]")
            right = bool(self.accept("->"))
            if not right:
                self.expect("-")
        else:
            right = bool(self.accept("->")) or (bool(self.accept("-")) and False)
        if not self.sign("(") and (q := self._quantifier()):
            out.variable, (out.low, out.high) = True, q
        out.direction = "both" if left == right else "in" if left else "out"
        return out

    # --- expressions --------------------------------------------------------------------------------------------
    def expr(self) -> A.Expr:
        return self._or()

    def _or(self):
        e = self._xor()
        while self.accept_words("or"):
            e = ("or", e, self._xor())
        return e

    def _xor(self):
        e = self._and()
        while self.accept_words("xor"):
            e = ("xor", e, self._and())
        return e

    def _and(self):
        e = self._not()
        while self.accept_words("and"):
            e = ("and", e, self._not())
        return e

    def _not(self):
        if self.accept_words("not"):
            return ("not", self._not())
        return self._comparison()

    def _comparison(self):
        e = self._additive()
        parts, signs = [e], []
        while self.tok.kind == "sign" and self.tok.text in _COMPARE:
            signs.append(self.take().text.replace("!=", "<>"))
            parts.append(self._additive())
        if not signs:
            return e
        compared = [("cmp", s, a, b) for s, a, b in zip(signs, parts, parts[1:], strict=False)]
        out = compared[0]
        for c in compared[1:]:
            out = ("and", out, c)
        return out

    def _predicates(self, e):
        while True:
            if self.accept_words("starts", "with"):
                e = ("str", "starts", e, self._additive())
            elif self.accept_words("ends", "with"):
                e = ("str", "ends", e, self._additive())
            elif self.accept_words("contains"):
                e = ("str", "contains", e, self._additive())
            elif self.accept_words("in"):
                e = ("in", e, self._additive())
            elif self.words("not", "in"):
                self.at += 2
                e = ("not", ("in", e, self._additive()))
            elif self.accept_words("is", "null"):
                e = ("isnull", e)
            elif self.accept_words("is", "not", "null"):
                e = ("not", ("isnull", e))
            elif self.accept_words("valid_at"):
                e = ("fn", "uni.temporal.validat", [e, ("lit", "valid_from"), ("lit", "valid_to"), self._additive()], False)
            else:
                return e

    def _additive(self):
        e = self._multiplicative()
        while s := self.accept("+", "-"):
            e = ("bin", s, e, self._multiplicative())
        return self._predicates(e)

    def _multiplicative(self):
        e = self._power()
        while s := self.accept("*", "/", "%"):
            e = ("bin", s, e, self._power())
        return e

    def _power(self):
        e = self._unary()
        while self.accept("^"):
            e = ("bin", "^", e, self._unary())
        return e

    def _unary(self):
        if self.accept("-"):
            inner = self._unary()
            return ("lit", -inner[1]) if inner[0] == "lit" and isinstance(inner[1], (int, float)) and not isinstance(inner[1], bool) else ("neg", inner)
        if self.accept("+"):
            return self._unary()
        return self._postfix()

    def _postfix(self):
        e = self._atom()
        while True:
            if self.sign(".") and self.ahead().kind == "name":
                self.take()
                key = self.name()
                e = ("prop", e, key)
                if self.sign("("):
                    name = _dotted_name(e)
                    if name:
                        self.take()
                        distinct = self.accept_words("distinct")
                        e = self._after_call(("fn", name.lower(), self._args(), distinct))
            elif self.accept("["):
                if self.accept(".."):
                    high = None if self.sign("]") else self.expr()
                    e = ("slice", e, None, high)
                else:
                    low = self.expr()
                    if self.accept(".."):
                        e = ("slice", e, low, None if self.sign("]") else self.expr())
                    else:
                        e = ("index", e, low)
                self.expect("]")
            elif self.sign(":") and self.ahead().kind == "name" and e[0] == "var":
                e = ("haslabel", e, self._label_names())
            elif self.sign("{") and e[0] == "var" and (self.sign(".", n=1) or self.sign("}", n=1) or (self.ahead().kind == "name" and self.sign(":", ",", "}", n=2))):
                e = self._map_projection(e[1])
            else:
                return e

    def _map_projection(self, var: str):
        self.expect("{")
        items = []
        while not self.accept("}"):
            if self.accept("."):
                items.append(("all",) if self.accept("*") else ("prop", self.name()))
            else:
                key = self.name()
                items.append(("expr", key, self.expr()) if self.accept(":") else ("expr", key, ("var", key)))
            if not self.sign("}"):
                self.expect(",")
        return ("mapproj", var, items)

    def _after_call(self, call):
        if self.accept_words("over"):
            self.expect("(")
            partition, order = [], []
            if self.accept_words("partition", "by"):
                partition = [self.expr()]
                while self.accept(","):
                    partition.append(self.expr())
            if self.accept_words("order", "by"):
                order = self._order()
            self.expect(")")
            return ("over", call, partition, order)
        return call

    def _atom(self):
        t = self.tok
        if t.kind == "number" or t.kind == "string":
            self.take()
            return ("lit", t.value)
        if t.kind == "param":
            self.take()
            return ("param", t.text)
        if self.sign("("):
            if (pattern := self._try_pattern()) is not None:
                return pattern
            self.take()
            e = self.expr()
            self.expect(")")
            return e
        if self.sign("["):
            return self._list()
        if self.sign("{"):
            return ("map", list(self._props().items()))
        if self.word("true", "false") and not self.sign("(", n=1):
            return ("lit", self.take().text.lower() == "true")
        if self.word("null"):
            self.take()
            return ("lit", None)
        if self.word("case"):
            return self._case()
        if self.word("exists", "count", "collect") and self.sign("{", n=1):
            kind = self.take().text.lower()
            self.expect("{")
            if self.word("match", "optional", "with", "unwind", "call", "return"):
                inner = self.query()
            else:
                inner = A.Query([self._match(False)])
            self.expect("}")
            return ("subquery", kind, inner)
        if self.word("exists") and self.sign("(", n=1):
            mark = self.at
            self.at += 1
            if (pattern := self._try_pattern(wrapped=True)) is not None:
                return pattern
            self.at = mark + 2
            e = self.expr()
            self.expect(")")
            return ("not", ("isnull", e))
        if self.word("all", "any", "single", "none") and self.sign("(", n=1):
            mark, kind = self.at, self.take().text.lower()
            self.expect("(")
            if self.tok.kind == "name" and self.word("in", n=1):
                var = self.name()
                self.take()
                source = self.expr()
                pred = self.expr() if self.accept_words("where") else ("lit", True)
                self.expect(")")
                return ("quant", kind, var, source, pred)
            self.at = mark
        if self.word("reduce") and self.sign("(", n=1):
            self.at += 2
            acc = self.name()
            self.expect("=")
            init = self.expr()
            self.expect(",")
            var = self.name()
            self.expect_word("in")
            source = self.expr()
            self.expect("|")
            body = self.expr()
            self.expect(")")
            return ("reduce", acc, init, var, source, body)
        if self.word("shortestpath", "allshortestpaths") and self.sign("(", n=1):
            return ("pathexpr", self.path())
        if t.kind == "name":
            name = self.name()
            if self.sign("(") and t.value != "quoted":
                self.take()
                if self.accept("*"):
                    self.expect(")")
                    return self._after_call(("fn", name.lower(), [("star",)], False))
                distinct = self.accept_words("distinct")
                return self._after_call(("fn", name.lower(), self._args(), distinct))
            return ("var", name)
        self.fail("expected an expression")

    def _try_pattern(self, wrapped: bool = False):
        """A pattern used as predicate, if the text at this place is one with at least one relationship."""
        mark, fresh = self.at, self.fresh
        try:
            if wrapped:
                self.expect("(")
            elements = self._elements()
            if len(elements) < 3:
                raise ParseError("no relationship")
            if wrapped:
                self.expect(")")
            return ("subquery", "exists", A.Query([A.Match([A.PathPat(None, elements)])]))
        except ParseError:
            self.at, self.fresh = mark, fresh
            return None

    def _list(self):
        mark = self.at
        self.expect("[")
        if self.tok.kind == "name" and self.word("in", n=1):
            var = self.name()
            self.take()
            source = self.expr()
            where = self.expr() if self.accept_words("where") else None
            out = self.expr() if self.accept("|") else None
            self.expect("]")
            return ("comp", var, source, where, out)
        if self.sign("(") or (self.tok.kind == "name" and self.sign("=", n=1) and self.sign("(", n=2)):
            try:
                path = self.path()
                if len(path.elements) >= 3:
                    where = self.expr() if self.accept_words("where") else None
                    self.expect("|")
                    e = self.expr()
                    self.expect("]")
                    return ("patcomp", path, where, e)
            except ParseError:
                pass
            self.at = mark + 1
        items = []
        while not self.accept("]"):
            items.append(self.expr())
            if not self.sign("]"):
                self.expect(",")
        return ("list", items)

    def _case(self):
        self.take()
        operand = None if self.word("when") else self.expr()
        whens = []
        while self.accept_words("when"):
            cond = self.expr()
            self.expect_word("then")
            whens.append((cond, self.expr()))
        default = self.expr() if self.accept_words("else") else None
        self.expect_word("end")
        return ("case", operand, whens, default)


def _dotted_name(e) -> str | None:
    if e[0] == "var":
        return e[1]
    if e[0] == "prop" and (head := _dotted_name(e[1])):
        return f"{head}.{e[2]}"
    return None


def parse(text: str):
    """Syntax tree of a statement."""
    return Parser(text).statement()
