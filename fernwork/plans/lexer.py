"""Tokens of the query languages. No word is reserved: the parsers look at words where they expect them."""

from __future__ import annotations

import re
from dataclasses import dataclass

_PATTERN = re.compile(
    r"""(?P<space>\s+)|(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>\d+)|(?P<name>[^\W\d]\w*)|(?P<quoted>`[^`]*`)
    |(?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<op>\.\.|<=|>=|<>|!=|==|[-+*/%=<>()\[\]{}:,.;|])""",
    re.X | re.S,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class QuerySyntaxError(ValueError):
    pass


@dataclass(frozen=True)
class Token:
    kind: str  # name, int, float, str, op, end
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def _plain(s: str) -> str:
    body = s[1:-1].replace("''", "'") if s[0] == "'" else s[1:-1]
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _PATTERN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup == "str":
            out.append(Token("str", _plain(m[0]), at))
        elif m.lastgroup == "quoted":
            out.append(Token("name", m[0][1:-1], at))
        elif m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]
