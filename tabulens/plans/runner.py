"""Recorded computations: fingerprints, an append-only store, and chains of tools."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass, field
from types import MappingProxyType

import tabulens.operators.profile
import tabulens.operators.reports
import tabulens.operators.transforms  # noqa: F401  the tools register themselves
from tabulens.operators.registry import TOOLS
from tabulens.types import ColumnSpec, Logical, Relation, Result, SchemaContract, TabulensError

PREVIEW_ROWS = 10


def fingerprint(tool: str, version: int, arguments: dict, dataset: str, contract: int, parents: list[str]) -> str:
    """The identity of a computation: what runs, on what; equal fingerprints mean equal results."""
    parts = [tool, str(version), json.dumps(arguments, sort_keys=True, separators=(",", ":"), default=str), dataset, str(contract), *sorted(parents)]
    return hashlib.sha256("\x1f".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class Computation:
    id: str
    fingerprint: str
    tool: str
    version: int
    arguments: dict
    dataset: str
    contract: int
    parent: str | None
    kind: str
    result: str
    seconds: float


#: Turns of a dataset that a history shows.
MOST_TURNS = 100


class Store:
    """Computations by fingerprint, contracts by version and turns; what is in it is only added to, never changed.

    The first of equal computations stays. Everything can be kept as JSON lines.
    """

    def __init__(self) -> None:
        self._by_print: dict[str, Computation] = {}
        self._by_id: dict[str, Computation] = {}
        self._tools: dict[tuple[str, int], float] = {}
        self._contracts: dict[str, list[SchemaContract]] = {}
        self._turns: list[dict] = []
        #: Views that can't be written through.
        self.by_print, self.by_id, self.tools = map(MappingProxyType, (self._by_print, self._by_id, self._tools))

    def add(self, c: Computation) -> Computation:
        held = self._by_print.setdefault(c.fingerprint, c)
        self._by_id.setdefault(held.id, held)
        self._tools.setdefault((c.tool, c.version), time.time())
        return held

    def add_contract(self, dataset: str, contract: SchemaContract) -> SchemaContract:
        """Keeps the next version of a dataset's contract; a version that is there already is not replaced."""
        held = self._contracts.setdefault(dataset, [])
        if contract.version != len(held) + 1:
            raise TabulensError(f"version {len(held) + 1} is next, not {contract.version}")
        held.append(contract)
        return contract

    def contract(self, dataset: str, version: int | None = None) -> SchemaContract:
        """A dataset's newest contract, or one of its versions."""
        held = self._contracts.get(dataset, [])
        if not held or not 1 <= (version or len(held)) <= len(held):
            raise TabulensError(f"there is no such contract of {dataset!r}")
        return held[(version or len(held)) - 1]

    def add_turn(self, dataset: str, question: str, narrative: str | None, computations: list[str]) -> str:
        turn = {"id": uuid.uuid4().hex, "dataset": dataset, "asked": time.time(), "question": question, "narrative": narrative, "computations": list(computations)}
        self._turns.append(turn)
        return turn["id"]

    def history(self, dataset: str, most: int = MOST_TURNS) -> list[dict]:
        """A dataset's turns, the newest first."""
        return [dict(t) for t in reversed(self._turns) if t["dataset"] == dataset][: min(most, MOST_TURNS)]

    def forget(self, turn: str, dataset: str) -> bool:
        """Removes a turn of a dataset, whether there was one; its computations stay."""
        kept = [t for t in self._turns if (t["id"], t["dataset"]) != (turn, dataset)]
        gone, self._turns = len(kept) < len(self._turns), kept
        return gone

    def dump(self) -> str:
        lines = [("computation", c.__dict__) for c in self._by_id.values()]
        lines += [("contract", {"dataset": d, "version": c.version, "derived_from": c.derived_from, "columns": [x.__dict__ for x in c.columns]}) for d, held in self._contracts.items() for c in held]
        lines += [("turn", t) for t in self._turns]
        return "".join(json.dumps({kind: x}, sort_keys=True) + "\n" for kind, x in lines)

    @classmethod
    def load(cls, text: str) -> Store:
        out = cls()
        for line in text.splitlines():
            ((kind, x),) = json.loads(line).items()
            if kind == "computation":
                out.add(Computation(**x))
            elif kind == "contract":
                specs = tuple(ColumnSpec(**c | {"logical": Logical(c["logical"]), "null_markers": tuple(c["null_markers"])}) for c in x["columns"])
                out.add_contract(x["dataset"], SchemaContract(specs, x["version"], x["derived_from"]))
            else:
                out._turns.append(x)
        return out


@dataclass
class Runner:
    """Runs tools on one dataset. ``table`` names the dataset or a computation whose recorded steps are composed again."""

    dataset: str
    contract: int
    relation: Relation
    store: Store = field(default_factory=Store)
    _lazy: dict[str, Relation] = field(default_factory=dict)

    def resolve(self, table: str) -> Relation:
        if table == "dataset":
            return self.relation
        c = self.store.by_id.get(table)
        if c is None or c.dataset != self.dataset:
            raise TabulensError(f"there is no table {table!r} of this dataset")
        if c.kind != "table":
            raise TabulensError(f"{table!r} is a {c.kind}, not a table")
        if table not in self._lazy:
            self._lazy[table] = TOOLS[c.tool](self.resolve(c.parent or "dataset"), **c.arguments).relation
        return self._lazy[table]

    def run(self, name: str, /, **given) -> Computation:
        if name not in TOOLS:
            raise TabulensError(f"there is no tool {name!r}; there are {', '.join(sorted(TOOLS))}")
        tool, table = TOOLS[name], given.pop("table", "dataset")
        relation = self.resolve(table)
        if not tool.applies_to(relation):
            raise TabulensError(f"{name} can't be used on this table")
        arguments = tool.arguments(given, relation)
        kinds = {p.name: p for p in tool.parameters}
        identity = {k: kinds[k].identity(v) for k, v in arguments.items()}
        parents = [] if table == "dataset" else [self.store.by_id[table].fingerprint]
        key = fingerprint(name, tool.version, identity, self.dataset, self.contract, parents)
        if key in self.store.by_print:
            return self.store.by_print[key]
        began = time.monotonic()
        result = tool.run(relation, **arguments)
        body = self.body(result)
        made = Computation(uuid.uuid4().hex, key, name, tool.version, arguments, self.dataset, self.contract, None if table == "dataset" else table, result.kind, json.dumps(body, default=str), time.monotonic() - began)
        if result.relation is not None:
            self._lazy[made.id] = result.relation
        return self.store.add(made)

    def body(self, result: Result) -> dict:
        if result.relation is None:
            return {**result.values, "note": result.note}
        r = result.relation
        rows = [[None if v is None else str(v) for v in row] for row in r.rows(PREVIEW_ROWS).collect()]
        return {"columns": [{"name": c.name, "logical": str(c.logical)} for c in r.columns], "row_count": r.df.count(), "preview": rows, "size_column": r.size_column, "ordered": r.ordered, "note": result.note}


def open_results(steps: list[dict]) -> list[str]:
    """The steps (ref, table) whose results no later step takes up."""
    used = {s.get("table") for s in steps}
    return [s["ref"] for s in steps if s["ref"] not in used]
