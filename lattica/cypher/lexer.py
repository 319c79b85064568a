"""Tokens of query and rule texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import ParseError

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|//[^\n]*|/\*.*?\*/)
  | (?P<number>0x[0-9a-fA-F]+|0o[0-7]+|(?:\d+\.(?!\.)\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
  | (?P<quoted>`(?:[^`]|``)*`)
  | (?P<param>\$[A-Za-z_0-9][A-Za-z_0-9.]*)
  | (?P<name>[^\W\d]\w*)
  | (?P<sign><>|<=|>=|=~|~=|!=|\+=|\.\.|->|<-|[-+*/%^=<>()\[\]{},.:;|!&~])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


@dataclass(frozen=True)
class Token:
    kind: str  # number, string, quoted, param, name, sign, end
    text: str
    start: int
    value: object = None


def _unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        if m[2]:
            return chr(int(m[2], 16))
        return _ESCAPES.get(m[3], m[3])

    return re.sub(r"\\(?:u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.))", one, body, flags=re.DOTALL)


def tokens_of(text: str) -> list[Token]:
    """All tokens, with an end token; comments and white space are dropped."""
    found, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected character {text[at]!r} at {at}")
        kind, raw = m.lastgroup, m[0]
        if kind == "number":
            low = raw.lower()
            value: object = int(raw, 16) if low.startswith("0x") else int(raw, 8) if low.startswith("0o") else float(raw) if re.search(r"[.eE]", raw) else int(raw)
            found.append(Token("number", raw, at, value))
        elif kind == "string":
            found.append(Token("string", raw, at, _unescape(raw[1:-1])))
        elif kind == "quoted":
            found.append(Token("name", raw[1:-1].replace("``", "`"), at, "quoted"))
        elif kind == "param":
            found.append(Token("param", raw[1:], at))
        elif kind != "space":
            found.append(Token(kind, raw, at))
        at = m.end()
    return [*found, Token("end", "", len(text))]
