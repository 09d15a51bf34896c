"""A planner that lets a model propose tool calls, and holds its answer against the computations."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from tabulens.operators.registry import TOOLS
from tabulens.plans.privacy import Gate
from tabulens.plans.runner import Computation, Runner
from tabulens.types import TabulensError

#: Steps and rejected proposals of a turn at most; how far a cited number may lie from a figure.
MOST_STEPS, MOST_REJECTED, TOLERANCE = 6, 2, 0.005


@dataclass(frozen=True)
class Proposal:
    """A tool call (its arguments as JSON text), or an answer."""

    tool: str | None = None
    arguments: str = "{}"
    text: str | None = None
    tokens: int = 0


class Client(Protocol):
    def propose(self, messages: list[dict], tools: list[dict]) -> Proposal: ...


class ClientError(Exception):
    """A provider that gives no answer; ``wait``: seconds after which it says that it would."""

    def __init__(self, message: str, wait: float | None = None):
        super().__init__(message)
        self.wait = wait


@dataclass
class Cascade:
    """Clients in order: the next one answers where one fails. One short wait is honoured; who answered first goes on."""

    clients: list[Client]
    sleep: Callable[[float], None] = lambda s: None
    longest: float = 20.0
    pinned: int | None = None

    def propose(self, messages: list[dict], tools: list[dict]) -> Proposal:
        order = range(len(self.clients)) if self.pinned is None else [self.pinned]
        waited, last = False, None
        for i in order:
            for _ in range(2):
                try:
                    found = self.clients[i].propose(messages, tools)
                    self.pinned = i
                    return found
                except ClientError as e:
                    last = e
                    if waited or e.wait is None or e.wait > self.longest:
                        break
                    waited = True
                    self.sleep(e.wait)
        raise last or ClientError("there is no client")


def probe(client: Client) -> bool:
    """Whether a client makes one exact tool call when asked to."""
    tool = {"name": "add", "description": "Adds two whole numbers.", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "integer"}}, "required": ["a", "b"]}}
    try:
        p = client.propose([{"role": "user", "content": "Call add with a = 2 and b = 3."}], [tool])
        return p.tool == "add" and json.loads(p.arguments) == {"a": 2, "b": 3}
    except (ClientError, ValueError):
        return False


def eligible(runner: Runner) -> list[dict]:
    """The tools that apply to the dataset, as a model is told of them."""
    return [{"name": t.name, "description": t.summary, "parameters": t.schema()} for t in TOOLS.values() if t.applies_to(runner.relation)]


def categories(tools: list[dict]) -> dict[str, list[str]]:
    """The names of tools by their category."""
    out: dict[str, list[str]] = {}
    for t in tools:
        out.setdefault(TOOLS[t["name"]].category, []).append(t["name"])
    return out


def routed(question: str, tools: list[dict], client: Client) -> list[dict]:
    """The tools of the categories that a model picks for a question in a first, short call; all where it picks none that exist."""
    known = categories(tools)
    choose = {"name": "choose", "description": "Pick the categories of tools that the question needs", "parameters": {"type": "object", "properties": {"categories": {"type": "array", "items": {"enum": sorted(known)}}}, "required": ["categories"], "additionalProperties": False}}
    told = "; ".join(f"{k}: {', '.join(sorted(v))}" for k, v in sorted(known.items()))
    try:
        p = client.propose([{"role": "system", "content": f"Categories and their tools: {told}"}, {"role": "user", "content": question}], [choose])
        picked = json.loads(p.arguments)["categories"] if p.tool == "choose" else []
    except (ClientError, ValueError, KeyError, TypeError):
        picked = []
    names = {n for k in picked if isinstance(k, str) for n in known.get(k, [])}
    return [t for t in tools if t["name"] in names] or tools


def summarise(c: Computation, gate: Gate) -> dict:
    """What a model is told of a result: only shapes that are known, and only what the gate lets through."""
    body = json.loads(c.result)
    out: dict = {"id": c.id, "kind": c.kind}
    if c.kind == "table":
        names = [x["name"] for x in body["columns"]]
        if gate.allows("schema"):
            out["columns"] = body["columns"]
        if gate.allows("aggregates"):
            out["row_count"] = body["row_count"]
        size = body.get("size_column")
        if size:
            rows = [dict(zip(names, r, strict=True)) | {size: int(float(r[names.index(size)]))} for r in body["preview"]]
            out["rows"], out["held_back"] = gate.groups(rows, size)
        elif gate.allows("values"):
            out["rows"] = [dict(zip(names, r, strict=True)) for r in body["preview"]]
    elif c.kind == "report" and gate.allows("aggregates"):
        out["findings"] = body["findings"]
    elif c.kind == "matrix" and gate.allows("groups"):
        out["cells"], out["held_back"] = gate.groups(body["cells"], "count")
    elif c.kind in ("stat_panel", "column_cards") and gate.allows("aggregates"):
        out["figures"] = _scalars(body)
    return out


_GROUPED = {"top", "samples", "cloud", "top_words", "top_pairs", "top_triples", "extremes", "rug", "minimum", "maximum", "earliest", "latest", "note"}


def _scalars(x: object) -> object:
    """Numbers by name; whatever shows single values is left out."""
    if isinstance(x, dict):
        return {k: v for k, y in x.items() if k not in _GROUPED and (v := _scalars(y)) not in ({}, [], None)}
    if isinstance(x, list):
        return [v for y in x if isinstance(y, dict) and "name" in y and (v := _scalars(y) | {"name": y["name"]})]
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) else None


_CITED = re.compile(r"\[([0-9a-f]{32})\]")
_NUMBER = re.compile(r"(?<![\w.])-?\d[\d,]*(?:\.\d+)?%?")


def figures(x: object) -> list[float]:
    if isinstance(x, dict):
        return [f for y in x.values() for f in figures(y)]
    if isinstance(x, list):
        return [f for y in x for f in figures(y)]
    if isinstance(x, bool) or x is None:
        return []
    try:
        return [float(x)]
    except (TypeError, ValueError):
        return []


def complaints(text: str, computations: dict[str, Computation]) -> list[tuple[str, str]]:
    """(kind, detail) for citations of nothing, numbers that no cited result holds, and numbers without a citation."""
    out = [("unknown", c) for c in _CITED.findall(text) if c not in computations]
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        cited = [computations[c] for c in _CITED.findall(sentence) if c in computations]
        known = [f for c in cited for f in figures(json.loads(c.result))]
        for m in _NUMBER.findall(_CITED.sub("", sentence)):
            value = float(m.rstrip("%").replace(",", ""))
            meant = [value, value / 100] if m.endswith("%") else [value]
            if not cited:
                out.append(("uncited", m))
            elif not any(abs(f - v) <= TOLERANCE * max(abs(f), 1e-12) for f in known for v in meant):
                out.append(("unsupported", m))
    return out


def without_citations(text: str) -> str:
    return re.sub(r"\s*" + _CITED.pattern, "", text)


@dataclass
class Turn:
    question: str
    narrative: str | None = None
    stopped: str | None = None
    steps: list[dict] = field(default_factory=list)
    complaints: list[tuple[str, str]] = field(default_factory=list)
    tokens: int = 0

    @property
    def grounded(self) -> bool:
        return self.narrative is not None and not self.complaints


def ask(question: str, runner: Runner, client: Client, mode: str = "balanced", token_budget: int | None = None, route: bool = False) -> Turn:
    """One question: tool calls until the model answers, or a limit stops the turn; the turn is kept in the runner's store.

    ``route``: a first call narrows the tools to some categories.
    """
    turn = Turn(question)
    answered(turn, runner, client, Gate(mode), routed(question, eligible(runner), client) if route else eligible(runner), token_budget)
    runner.store.add_turn(runner.dataset, question, turn.narrative, [s["ref"] for s in turn.steps])
    return turn


def answered(turn: Turn, runner: Runner, client: Client, gate: Gate, tools: list[dict], token_budget: int | None) -> Turn:
    question = turn.question
    schema = gate.schema([(c.name, str(c.logical)) for c in runner.relation.columns])
    messages = [{"role": "system", "content": "Answer from tool results alone, and cite each number's result as [id]. Columns: " + json.dumps(schema)}, {"role": "user", "content": question}]
    made: dict[str, Computation] = {}
    seen: set[str] = set()
    rejected = 0
    while True:
        if token_budget is not None and turn.tokens >= token_budget:
            turn.stopped = "token budget"
            return turn
        try:
            p = client.propose(messages, tools)
        except ClientError as e:
            turn.stopped = str(e)
            return turn
        turn.tokens += p.tokens
        if p.tool is None:
            turn.narrative = without_citations(p.text or "")
            turn.complaints = complaints(p.text or "", made)
            return turn
        if len(turn.steps) >= MOST_STEPS:
            turn.stopped = "too many steps"
            return turn
        try:
            arguments = json.loads(p.arguments)
            if not isinstance(arguments, dict):
                raise TabulensError("arguments must be an object")
            if p.tool not in {t["name"] for t in tools}:
                raise TabulensError(f"there is no tool {p.tool!r} here")
            if (call := json.dumps([p.tool, arguments], sort_keys=True)) in seen:
                raise TabulensError("this call was made already")
            c = runner.run(p.tool, **arguments)
            seen.add(call)
        except (TabulensError, ValueError) as e:
            rejected += 1
            if rejected > MOST_REJECTED:
                turn.stopped = "too many rejected proposals"
                return turn
            messages.append({"role": "tool", "content": json.dumps({"error": str(e)})})
            continue
        made[c.id] = c
        turn.steps.append({"ref": c.id, "tool": c.tool, "table": arguments.get("table", "dataset"), "kind": c.kind})
        messages.append({"role": "tool", "content": json.dumps(summarise(c, gate), default=str)})
