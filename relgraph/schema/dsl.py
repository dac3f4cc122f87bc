"""Parser of the schema language: a scanner made of one pattern, and a descent over its tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import SchemaError
from ..model import valid_name, valid_type_name
from .build import Allowed, Arrow, Expr, Nil, Permission, Ref, Relation, Schema, SetOp, build

_SCAN = re.compile(r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<open>/\*)|(?P<word>\w+(?:/\w+)*)|(?P<mark>->|[{}():|#*=+&\-])", re.S | re.ASCII)
_OPS = {"+": "union", "&": "intersection", "-": "exclusion"}


@dataclass
class Token:
    kind: str  # word, mark or end
    text: str
    line: int
    col: int


def scan(text: str) -> list[Token]:
    out, at = [], 0

    def place(i: int) -> tuple[int, int]:
        return text.count("\n", 0, i) + 1, i - text.rfind("\n", 0, i)

    while at < len(text):
        m = _SCAN.match(text, at)
        if m is None:
            raise SchemaError(f"unexpected character {text[at]!r}", *place(at))
        if m["open"]:
            raise SchemaError("unterminated comment", *place(at))
        if not m["skip"]:
            out.append(Token("word" if m["word"] else "mark", m[0], *place(at)))
        at = m.end()
    return [*out, Token("end", "end of schema", *place(len(text)))]


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = scan(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def take(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def fail(self, expected: str):
        t = self.now
        raise SchemaError(f"expected {expected}, found {t.text if t.kind == 'end' else repr(t.text)}", t.line, t.col)

    def mark(self, text: str) -> bool:
        if self.now.kind == "mark" and self.now.text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.mark(text):
            self.fail(repr(text))

    def name(self) -> Token:
        if self.now.kind != "word" or not valid_name(self.now.text):
            self.fail("a name")
        return self.take()

    def type_name(self) -> str:
        if self.now.kind != "word" or not valid_type_name(self.now.text):
            self.fail("a type name")
        return self.take().text

    def schema(self) -> Schema:
        out, seen = [], set()
        while self.now.kind != "end":
            if self.now.text != "definition":
                self.fail("'definition'")
            self.take()
            start = self.now
            type_ = self.type_name()
            if type_ in seen:
                raise SchemaError(f"type {type_!r} is defined twice", start.line, start.col)
            seen.add(type_)
            out.append((type_, self.members(type_)))
        return build(*out)

    def members(self, type_: str) -> tuple:
        self.need("{")
        out: dict[str, Relation | Permission] = {}
        while not self.mark("}"):
            keyword = self.now.text
            if self.now.kind != "word" or keyword not in ("relation", "permission"):
                self.fail("'relation', 'permission' or '}'")
            self.take()
            name = self.name()
            if name.text in out:
                raise SchemaError(f"{type_}#{name.text} is defined twice", name.line, name.col)
            if keyword == "relation":
                self.need(":")
                subjects = [self.allowed()]
                while self.mark("|"):
                    subjects.append(self.allowed())
                out[name.text] = Relation(name.text, tuple(subjects))
            else:
                self.need("=")
                out[name.text] = Permission(name.text, self.expr())
        return tuple(out.values())

    def allowed(self) -> Allowed:
        type_ = self.type_name()
        if self.mark("#"):
            return Allowed(type_, self.name().text)
        if self.mark(":"):
            self.need("*")
            return Allowed(type_, "", True)
        return Allowed(type_)

    def expr(self) -> Expr:
        terms, op = [self.term()], None
        while self.now.kind == "mark" and self.now.text in _OPS:
            t = self.take()
            if op is not None and op != t.text:
                raise SchemaError(f"{op!r} and {t.text!r} are mixed; use parentheses", t.line, t.col)
            op = t.text
            terms.append(self.term())
        if op is None:
            return terms[0]
        if op == "-":
            out = terms[0]
            for t in terms[1:]:
                out = SetOp("exclusion", (out, t))
            return out
        return SetOp(_OPS[op], tuple(terms))

    def term(self) -> Expr:
        if self.mark("("):
            out = self.expr()
            self.need(")")
            return out
        name = self.name()
        if name.text == "nil":
            return Nil()
        return Arrow(name.text, self.name().text) if self.mark("->") else Ref(name.text)


def parse(text: str) -> Schema:
    """Parse and validate schema text; errors of syntax carry line and column."""
    return _Parser(text).schema()
