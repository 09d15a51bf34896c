"""Tools and their parameters: validation, normalisation, and JSON schemas for a planner."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from tabulens.functions.expressions import canonical, compile_expression, parse
from tabulens.types import Relation, Result, TabulensError

#: Kinds of parameters: a column, a set of columns, an ordered list of texts, a table, an expression, and plain values.
KINDS = ("column", "column_list", "text_list", "table", "expression", "integer", "number", "boolean", "enum", "text")


@dataclass(frozen=True)
class Parameter:
    """tier: 1 required, 2 with a default, 3 with a default that a planner is not told of."""

    name: str
    kind: str
    tier: int = 1
    default: object = None
    least: float | None = None
    most: float | None = None
    options: tuple[str, ...] = ()
    help: str = ""

    def normalise(self, value: object, relation: Relation | None = None) -> object:
        def refuse(why: str) -> TabulensError:
            return TabulensError(f"{self.name}: {why}")

        def column(x: object) -> str:
            if not isinstance(x, str):
                raise refuse("a column name is expected")
            if relation is not None:
                relation[x]
            return x

        if self.kind in ("integer", "number"):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or (self.kind == "integer" and value != int(value)):
                raise refuse(f"{'a whole' if self.kind == 'integer' else 'a'} number is expected")
            value = int(value) if self.kind == "integer" else float(value)
            if (self.least is not None and value < self.least) or (self.most is not None and value > self.most):
                raise refuse(f"{value} is not between {self.least} and {self.most}")
            return value
        if self.kind == "boolean":
            if not isinstance(value, bool):
                raise refuse("true or false is expected")
            return value
        if self.kind == "enum":
            if value not in self.options:
                raise refuse(f"one of {', '.join(self.options)} is expected")
            return value
        if self.kind == "column":
            return column(value)
        if self.kind in ("column_list", "text_list"):
            if not isinstance(value, (list, tuple)):
                raise refuse("a list is expected")
            if self.kind == "column_list":
                return sorted({column(x) for x in value})
            if not all(isinstance(x, str) for x in value):
                raise refuse("a list of texts is expected")
            return list(value)
        if not isinstance(value, str):
            raise refuse("a text is expected")
        if self.kind == "expression":
            canonical(parse(value))
            if relation is not None:
                compile_expression(value, relation.columns)
        return value

    def identity(self, value: object) -> object:
        """What a fingerprint sees: expressions by their one spelling."""
        return canonical(parse(value)) if self.kind == "expression" and isinstance(value, str) else value

    def schema(self) -> dict:
        kinds = {"integer": "integer", "number": "number", "boolean": "boolean", "column_list": "array", "text_list": "array"}
        out: dict = {"type": kinds.get(self.kind, "string")}
        if out["type"] == "array":
            out["items"] = {"type": "string"}
        if self.options:
            out["enum"] = list(self.options)
        for key, v in (("minimum", self.least), ("maximum", self.most), ("default", self.default if self.tier > 1 else None), ("description", self.help or None)):
            if v is not None:
                out[key] = v
        return out


@dataclass(frozen=True)
class Tool:
    """``version`` rises whenever the output for some input could change."""

    name: str
    version: int
    category: str
    output: str
    summary: str
    parameters: tuple[Parameter, ...]
    run: Callable[..., Result] = field(compare=False)
    applies_to: Callable[[Relation], bool] = field(compare=False, default=lambda r: True)

    def arguments(self, given: dict, relation: Relation | None = None) -> dict:
        known = {p.name: p for p in self.parameters}
        if extra := sorted(set(given) - set(known) - {"table"}):
            raise TabulensError(f"{self.name} has no parameter {extra[0]!r}; it has {', '.join(known) or 'none'}")
        out = {}
        for p in self.parameters:
            if p.name in given and given[p.name] is not None:
                out[p.name] = p.normalise(given[p.name], relation)
            elif p.tier == 1:
                raise TabulensError(f"{self.name} needs {p.name}")
            else:
                out[p.name] = p.default
        return out

    def schema(self) -> dict:
        told = [p for p in self.parameters if p.tier < 3]
        properties = {"table": {"type": "string", "default": "dataset"}} | {p.name: p.schema() for p in told}
        return {"type": "object", "properties": properties, "required": [p.name for p in told if p.tier == 1], "additionalProperties": False}

    def __call__(self, relation: Relation, **given) -> Result:
        return self.run(relation, **self.arguments(given, relation))


TOOLS: dict[str, Tool] = {}


def tool(name: str, version: int, category: str, output: str, *parameters: Parameter, applies_to: Callable[[Relation], bool] = lambda r: True):
    """Registers a function (relation, **arguments) -> Result; its docstring's first line is the summary."""

    def add(f: Callable[..., Result]) -> Tool:
        if name in TOOLS:
            raise ValueError(f"there are two tools named {name}")
        TOOLS[name] = made = Tool(name, version, category, output, (f.__doc__ or "").strip().splitlines()[0], parameters, f, applies_to)
        return made

    return add
