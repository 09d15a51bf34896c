"""A small closed expression language, compiled to Spark columns.

    [price] * (1 - [discount]) > 10 and [status] in ["a", "b"]

Text becomes a tree or is refused with a position; the tree is typed against a relation's columns before anything runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulens.functions.shape import as_moment, read
from tabulens.types import ColumnSpec, Logical, TabulensError

MAX_LENGTH, MAX_DEPTH = 4000, 40


class ExpressionError(TabulensError):
    def __init__(self, message: str, at: int | None = None):
        super().__init__(message if at is None else f"{message} (at character {at + 1})")
        self.at = at


@dataclass(frozen=True)
class Node:
    """op: literal, column, call, unary, binary, in, between or is_null."""

    op: str
    args: tuple = ()
    name: str = ""
    value: object = None
    at: int = 0
    negated: bool = False


_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<text>\"[^\"]*\"|'[^']*')|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<sign><=|>=|<>|!=|[-+*/%(),=<>\[\]]))")
WORDS = {"and", "or", "not", "in", "between", "is", "null", "true", "false"}
COMPARISONS = ("=", "!=", "<>", "<", "<=", ">", ">=")


class Parser:
    """Recursive descent; every rule that recurs counts its depth."""

    def __init__(self, text: str):
        if len(text) > MAX_LENGTH:
            raise ExpressionError(f"the expression is longer than {MAX_LENGTH} characters")
        self.text, self.at, self.depth = text, 0, 0

    def parse(self) -> Node:
        tree = self.either()
        kind, value, at = self.peek()
        if kind:
            raise ExpressionError(f"unexpected {value!r}", at)
        return tree

    def peek(self) -> tuple[str, str, int]:
        rest = len(self.text) - len(self.text[self.at :].lstrip())
        if rest >= len(self.text):
            return "", "", rest
        m = _TOKEN.match(self.text, self.at)
        if not m:
            raise ExpressionError(f"can't read {self.text[rest]!r}", rest)
        kind = m.lastgroup
        value = m[kind]
        if kind == "name" and value.lower() in WORDS:
            return "word", value.lower(), m.start(kind)
        return kind, value, m.start(kind)

    def take(self) -> tuple[str, str, int]:
        found = self.peek()
        m = _TOKEN.match(self.text, self.at)
        if m:
            self.at = m.end()
        return found

    def accept(self, *values: str) -> str | None:
        kind, value, _ = self.peek()
        if kind in ("sign", "word") and value in values:
            self.take()
            return value
        return None

    def expect(self, value: str) -> None:
        if not self.accept(value):
            _, found, at = self.peek()
            raise ExpressionError(f"expected {value!r}" + (f" instead of {found!r}" if found else " before the end"), at)

    def deeper(self, rule: Callable[[], Node]) -> Node:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise ExpressionError(f"the expression is nested more than {MAX_DEPTH} levels deep", self.at)
        try:
            return rule()
        finally:
            self.depth -= 1

    def chain(self, rule: Callable[[], Node], *signs: str) -> Node:
        left = rule()
        while sign := self.accept(*signs):
            left = Node("binary", (left, rule()), sign, at=left.at)
        return left

    def either(self) -> Node:
        return self.chain(self.both, "or")

    def both(self) -> Node:
        return self.chain(self.negation, "and")

    def negation(self) -> Node:
        _, _, at = self.peek()
        if self.accept("not"):
            return Node("unary", (self.deeper(self.negation),), "not", at=at)
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        if sign := self.accept(*COMPARISONS):
            return Node("binary", (left, self.sum()), "!=" if sign == "<>" else sign, at=left.at)
        if self.accept("is"):
            negated = bool(self.accept("not"))
            self.expect("null")
            return Node("is_null", (left,), at=left.at, negated=negated)
        kind, value, _ = self.peek()
        negated = kind == "word" and value == "not"
        if negated:
            self.take()
        if self.accept("in"):
            return Node("in", (left, *self.options()), at=left.at, negated=negated)
        if self.accept("between"):
            low = self.sum()
            self.expect("and")
            return Node("between", (left, low, self.sum()), at=left.at, negated=negated)
        if negated:
            _, found, at = self.peek()
            raise ExpressionError(f"expected 'in' or 'between' after 'not', not {found!r}", at)
        return left

    def options(self) -> list[Node]:
        self.expect("[")
        out = [self.deeper(self.sum)]
        while self.accept(","):
            out.append(self.deeper(self.sum))
        self.expect("]")
        return out

    def sum(self) -> Node:
        return self.chain(self.product, "+", "-")

    def product(self) -> Node:
        return self.chain(self.signed, "*", "/", "%")

    def signed(self) -> Node:
        _, _, at = self.peek()
        if self.accept("-"):
            return Node("unary", (self.deeper(self.signed),), "-", at=at)
        return self.atom()

    def atom(self) -> Node:
        kind, value, at = self.peek()
        if kind == "number":
            self.take()
            return Node("literal", value=float(value), name="number", at=at)
        if kind == "text":
            self.take()
            return Node("literal", value=value[1:-1], name="text", at=at)
        if kind == "word" and value in ("true", "false", "null"):
            self.take()
            return Node("literal", value={"true": True, "false": False, "null": None}[value], name="null" if value == "null" else "boolean", at=at)
        if kind == "sign" and value == "[":
            return self.column(at)
        if kind == "sign" and value == "(":
            self.take()
            inner = self.deeper(self.either)
            self.expect(")")
            return inner
        if kind == "name":
            self.take()
            if value.lower() not in FUNCTIONS:
                raise ExpressionError(f"there is no function {value!r}; there are {', '.join(sorted(FUNCTIONS))}", at)
            self.expect("(")
            args = [self.deeper(self.either)]
            while self.accept(","):
                args.append(self.deeper(self.either))
            self.expect(")")
            return Node("call", tuple(args), value.lower(), at=at)
        raise ExpressionError("the expression ends too early" if not kind else f"unexpected {value!r}", at)

    def column(self, at: int) -> Node:
        """A name in brackets; brackets in it must balance."""
        level, i = 0, at
        while i < len(self.text):
            level += {"[": 1, "]": -1}.get(self.text[i], 0)
            i += 1
            if not level:
                self.at = i
                return Node("column", name=self.text[at + 1 : i - 1], at=at)
        raise ExpressionError("a column's bracket is not closed", at)


def parse(text: str) -> Node:
    return Parser(text).parse()


def canonical(n: Node) -> str:
    """One spelling of a tree, for fingerprints; it is never parsed again."""
    if n.op == "literal":
        if n.name == "number":
            return f"{n.value:.17g}"
        return {None: "null", True: "true", False: "false"}[n.value] if n.name in ("null", "boolean") else '"' + n.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if n.op == "column":
        return f"[{n.name}]"
    args = [canonical(a) for a in n.args]
    no = "not " if n.negated else ""
    if n.op == "call":
        return f"{n.name}({', '.join(args)})"
    if n.op == "unary":
        return f"(not {args[0]})" if n.name == "not" else f"(-{args[0]})"
    if n.op == "binary":
        return f"({args[0]} {n.name} {args[1]})"
    if n.op == "in":
        return f"({args[0]} {no}in [{', '.join(args[1:])}])"
    return f"({args[0]} {no}between {args[1]} and {args[2]})" if n.op == "between" else f"({args[0]} is {no}null)"


@dataclass(frozen=True)
class Function:
    """Parameter types (``?`` after those that may be missing, ``any`` for one type shared), result, and builder."""

    takes: tuple[str, ...]
    gives: str
    build: Callable[..., Column]


def _long(x: Column) -> Column:
    return x.cast("bigint").cast("double")


def _ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(F.ln(x))


FUNCTIONS: dict[str, Function] = {
    "abs": Function(("number",), "number", F.abs),
    "round": Function(("number", "digits?"), "number", lambda x, k=0: F.round(x, k)),
    "floor": Function(("number",), "number", lambda x: F.floor(x).cast("double")),
    "ceil": Function(("number",), "number", lambda x: F.ceil(x).cast("double")),
    "log": Function(("number",), "number", _ln),
    "sqrt": Function(("number",), "number", F.sqrt),
    "lower": Function(("text",), "text", F.lower),
    "upper": Function(("text",), "text", F.upper),
    "trim": Function(("text",), "text", F.trim),
    "length": Function(("text",), "number", lambda x: _long(F.length(x))),
    "contains": Function(("text", "text"), "boolean", F.contains),
    "starts_with": Function(("text", "text"), "boolean", F.startswith),
    "year": Function(("date",), "number", lambda x: _long(F.year(x))),
    "month": Function(("date",), "number", lambda x: _long(F.month(x))),
    "day": Function(("date",), "number", lambda x: _long(F.dayofmonth(x))),
    "weekday": Function(("date",), "number", lambda x: _long(F.weekday(x) + 1)),
    "date_diff": Function(("date", "date"), "number", lambda a, b: _long(F.datediff(b, a))),
    "date": Function(("text",), "date", lambda x: as_moment(F.trim(x))),
    "coalesce": Function(("any*",), "any", F.coalesce),
    "if": Function(("boolean", "any", "any"), "any", lambda c, a, b: F.when(c, a).otherwise(b)),
}

_TYPE_OF = {Logical.NUMERICAL: "number", Logical.TEXT: "text", Logical.CATEGORICAL: "text", Logical.BOOLEAN: "boolean", Logical.DATE: "date"}
LOGICAL_OF = {"number": Logical.NUMERICAL, "text": Logical.TEXT, "boolean": Logical.BOOLEAN, "date": Logical.DATE, "null": Logical.TEXT}
_SPARK = {"number": "double", "text": "string", "boolean": "boolean", "date": "timestamp_ntz", "null": "string"}


class Compiler:
    """Types a tree and builds its column; refuses what doesn't fit before anything runs."""

    def __init__(self, columns: tuple[ColumnSpec, ...]):
        self.columns = {c.name: c for c in columns}

    def build(self, n: Node) -> tuple[str, Column]:
        return getattr(self, n.op)(n)

    def of(self, n: Node, want: str) -> Column:
        kind, c = self.build(n)
        if kind == "null":
            return F.lit(None).cast(_SPARK[want])
        if kind != want:
            raise ExpressionError(f"{canonical(n)} is {kind}, not {want}", n.at)
        return c

    def alike(self, nodes: tuple[Node, ...]) -> tuple[str, list[Column]]:
        found = [self.build(n) for n in nodes]
        kinds = {k for k, _ in found if k != "null"}
        if len(kinds) > 1:
            raise ExpressionError(f"{' and '.join(sorted(kinds))} don't go together", nodes[0].at)
        kind = kinds.pop() if kinds else "null"
        return kind, [F.lit(None).cast(_SPARK[kind]) if k == "null" else c for k, c in found]

    def literal(self, n: Node) -> tuple[str, Column]:
        return n.name, F.lit(n.value)

    def column(self, n: Node) -> tuple[str, Column]:
        spec = self.columns.get(n.name)
        if spec is None:
            raise ExpressionError(f"there is no column {n.name!r}", n.at)
        if spec.logical not in _TYPE_OF:
            raise ExpressionError(f"column {n.name!r} has a type that expressions can't use", n.at)
        return _TYPE_OF[spec.logical], read(spec)

    def unary(self, n: Node) -> tuple[str, Column]:
        return ("boolean", ~self.of(n.args[0], "boolean")) if n.name == "not" else ("number", -self.of(n.args[0], "number"))

    def binary(self, n: Node) -> tuple[str, Column]:
        if n.name in ("and", "or"):
            a, b = (self.of(x, "boolean") for x in n.args)
            return "boolean", a & b if n.name == "and" else a | b
        if n.name in COMPARISONS:
            _, (a, b) = self.alike(n.args)
            return "boolean", {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[n.name]
        a, b = (self.of(x, "number") for x in n.args)
        if n.name in "/%":
            b = F.nullif(b, F.lit(0.0))
        return "number", {"+": a + b, "-": a - b, "*": a * b, "/": a / b, "%": a % b}[n.name]

    def is_null(self, n: Node) -> tuple[str, Column]:
        c = self.build(n.args[0])[1]
        return "boolean", c.isNotNull() if n.negated else c.isNull()

    def between(self, n: Node) -> tuple[str, Column]:
        _, (x, low, high) = self.alike(n.args)
        inside = (x >= low) & (x <= high)
        return "boolean", ~inside if n.negated else inside

    def call(self, n: Node) -> tuple[str, Column]:
        f = FUNCTIONS[n.name]
        if f.takes == ("any*",):
            kind, args = self.alike(n.args)
            return kind, f.build(*args)
        least = sum(not t.endswith("?") for t in f.takes)
        if not least <= len(n.args) <= len(f.takes):
            raise ExpressionError(f"{n.name} takes {least if least == len(f.takes) else f'{least} to {len(f.takes)}'} values", n.at)
        shared = tuple(a for a, t in zip(n.args, f.takes, strict=False) if t == "any")
        kind, same = self.alike(shared) if shared else (f.gives, [])
        args = []
        for a, t in zip(n.args, f.takes, strict=False):
            if t == "any":
                args.append(same.pop(0))
            elif t == "digits?":
                sign, lit = (-1, a.args[0]) if a.op == "unary" and a.name == "-" else (1, a)
                if lit.op != "literal" or lit.name != "number" or lit.value != int(lit.value):
                    raise ExpressionError("the digits of round must be a whole number", a.at)
                args.append(sign * int(lit.value))
            else:
                args.append(self.of(a, t))
        return kind, f.build(*args)


def _member(self: Compiler, n: Node) -> tuple[str, Column]:
    _, (x, *options) = self.alike(n.args)
    hit = x == options[0]
    for o in options[1:]:
        hit = hit | (x == o)
    return "boolean", ~hit if n.negated else hit


setattr(Compiler, "in", _member)


def compile_expression(text: str, columns: tuple[ColumnSpec, ...]) -> tuple[Logical, Column]:
    """(logical type of the result, column)."""
    kind, c = Compiler(columns).build(parse(text))
    return LOGICAL_OF[kind], c
