"""A quote- and comment-aware tokenizer and the bracket tree of a statement."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tidewater.errors import UnsupportedSql

_SCAN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
      | (?P<string>'(?:[^']|'')*')
      | (?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`)
      | (?P<number>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<word>[A-Za-z_][A-Za-z_0-9$]*)
      | (?P<mark>::|<=>|<>|!=|<=|>=|\|\||!~\*|!~|~\*|[-+*/%=<>~(),.;\[\]{}?:|&^@])""",
    re.X | re.S,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text

    def render(self) -> str:
        return "`" + self.text[1:-1].replace('""', '"').replace("`", "``") + "`" if self.text[:1] == '"' else self.text


@dataclass
class Group:
    """What stands between a pair of round brackets."""

    items: list = field(default_factory=list)
    kind = "group"
    upper = "("

    def render(self) -> str:
        return "(" + text_of(self.items) + ")"


def scan(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _SCAN.match(sql, at)
        if not m:
            raise UnsupportedSql(f"unexpected character {sql[at]!r} at position {at}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0]))
        at = m.end()
    return out


def tree(sql: str) -> list:
    """Tokens with bracket groups; a final semicolon goes."""
    stack: list[list] = [[]]
    tokens = scan(sql)
    while tokens and tokens[-1].text == ";":
        tokens.pop()
    for t in tokens:
        if t.text == "(" and t.kind == "mark":
            stack.append([])
        elif t.text == ")" and t.kind == "mark":
            if len(stack) == 1:
                raise UnsupportedSql("unbalanced brackets")
            done = Group(stack.pop())
            stack[-1].append(done)
        elif t.text == ";" and t.kind == "mark":
            raise UnsupportedSql("one statement at a time")
        else:
            stack[-1].append(t)
    if len(stack) != 1:
        raise UnsupportedSql("unbalanced brackets")
    return stack[0]


def text_of(items: list) -> str:
    out = ""
    for x in items:
        piece = x.render()
        glue = out and piece and not (piece in (",", ".", "::") or out[-1] == "." or out.endswith("::"))
        if x.kind == "group" and out and (out[-1].isalnum() or out[-1] in "_`"):
            glue = _KEEP_BLANK.search(out) is not None
        out += (" " if glue else "") + piece
    return out


#: Words before which a bracket is no argument list.
_KEEP_BLANK = re.compile(r"(?i)\b(?:in|as|and|or|not|on|from|join|where|select|over|by|when|then|else|exists|union|all|except|intersect|values|using|lateral|set|with|having|limit|case|between|like|distinct|any|some|group|filter|sets)$")


def words(items: list, *expected: str) -> bool:
    """Whether ``items`` starts with these keywords."""
    return len(items) >= len(expected) and all(x.kind == "word" and x.upper == w for x, w in zip(items, expected))


def split_on(items: list, mark: str) -> list[list]:
    out: list[list] = [[]]
    for x in items:
        if x.kind != "group" and x.text == mark:
            out.append([])
        else:
            out[-1].append(x)
    return out
