"""Column types, schema contracts and relations."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import StrEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TabulensError(ValueError):
    """A request that can't be carried out, with a reason for its author."""


class Logical(StrEnum):
    NUMERICAL = "numerical"
    CATEGORICAL = "categorical"
    TEXT = "text"
    DATE = "date"
    BOOLEAN = "boolean"
    UNSUPPORTED = "unsupported"


@dataclass(frozen=True)
class ColumnSpec:
    """How a column is to be read. ``computed`` strings were made by an expression and are read as they are."""

    name: str
    ordinal: int
    physical: str
    logical: Logical
    confidence: float = 1.0
    reason: str = ""
    null_markers: tuple[str, ...] = ()
    format_hint: str | None = None
    overridden_by: str | None = None
    computed: bool = False

    @property
    def is_text(self) -> bool:
        return self.physical == "string"


@dataclass(frozen=True)
class SchemaContract:
    """A version of the interpretation of a dataset's columns; never changed, only followed by another version."""

    columns: tuple[ColumnSpec, ...]
    version: int = 1
    derived_from: int | None = None

    def __post_init__(self) -> None:
        names = [c.name for c in self.columns]
        if len(set(names)) < len(names):
            raise TabulensError("column names must be unique")
        if [c.ordinal for c in self.columns] != list(range(len(names))):
            raise TabulensError("ordinals must be dense from 0")

    def __getitem__(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise TabulensError(f"there is no column {name!r}")


def logical_of(kind: T.DataType) -> Logical:
    """The type that a typed column has by itself; strings are categorical or text only after inference."""
    if isinstance(kind, T.BooleanType):
        return Logical.BOOLEAN
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return Logical.DATE
    if isinstance(kind, T.NumericType):
        return Logical.NUMERICAL
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType)):
        return Logical.TEXT
    return Logical.UNSUPPORTED


#: The column of file order that ingest writes.
ROW_ID = "__rid"


@dataclass(frozen=True)
class Relation:
    """A lazy table with the interpretation of its columns.

    ``row_key`` makes orders total, ``order`` is the order that a sort has set and later steps keep; ``size_column``
    names the group size in an aggregated table.
    """

    df: DataFrame
    columns: tuple[ColumnSpec, ...]
    row_key: tuple[str, ...] = ()
    order: tuple[Column, ...] = ()
    derived: bool = False
    size_column: str | None = None

    @classmethod
    def of(cls, df: DataFrame, row_key: list[str] | None = None, logical: dict[str, Logical] | None = None) -> Relation:
        """A typed table: text columns count as text unless ``logical`` says otherwise."""
        logical = logical or {}
        specs = tuple(ColumnSpec(f.name, i, f.dataType.simpleString(), logical.get(f.name, logical_of(f.dataType))) for i, f in enumerate(f for f in df.schema.fields if f.name != ROW_ID))
        key = row_key if row_key is not None else [ROW_ID] if ROW_ID in df.columns else [c.name for c in specs if c.logical != Logical.UNSUPPORTED]
        return cls(df, specs, tuple(key))

    def __getitem__(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise TabulensError(f"there is no column {name!r}; there are {', '.join(c.name for c in self.columns)}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def ordered(self) -> bool:
        return bool(self.order)

    def step(self, df: DataFrame, **changes) -> Relation:
        return replace(self, df=df, derived=True, **changes)

    def total_order(self) -> list[Column]:
        return [*self.order, *(col(k).asc_nulls_last() for k in self.row_key)]

    def rows(self, limit: int, offset: int = 0) -> DataFrame:
        """The first rows in the relation's order, which earlier steps may have set."""
        df = self.df.orderBy(*self.total_order())
        df = df.offset(offset) if offset else df
        return df.limit(limit).select(*[col(n) for n in self.names])


def col(name: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class Result:
    """What a tool gives: a relation, or a table of findings with a note, or values."""

    kind: str
    relation: Relation | None = None
    table: DataFrame | None = None
    values: dict = field(default_factory=dict)
    note: str = ""
