r"""How values of a column are read. Text columns follow shape rules; typed columns are taken as they are.

``\z`` stands where a pattern ends: Java's ``$`` also matches before a final line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulens.types import ColumnSpec, Logical, col

#: What a number, a date and a moment look like, and the words of a boolean.
INTEGER = r"^[+-]?(0|[1-9][0-9]{0,17})\z"
DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)\z"
DATE = r"^\d{4}-\d{2}-\d{2}\z"
MOMENT = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?"
TRUE_WORDS, FALSE_WORDS = ("true", "t", "yes", "y"), ("false", "f", "no", "n")

#: The part of a moment that is cast; what follows it is ignored.
_READ = r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)"


def present(spec: ColumnSpec) -> Column:
    """Not null, for text not blank, and none of the contract's null markers."""
    c = col(spec.name)
    ok = c.isNotNull() & (F.trim(c) != "") if spec.is_text else c.isNotNull()
    return ok & ~F.trim(c.cast("string")).isin(*spec.null_markers) if spec.null_markers else ok


def looks_numeric(t: Column) -> Column:
    return t.rlike(INTEGER) | t.rlike(DECIMAL)


def as_number(t: Column) -> Column:
    """A trimmed text as double, null where it has no number's shape."""
    return F.when(looks_numeric(t), t.try_cast("double"))


def as_moment(t: Column, hint: str | None = None) -> Column:
    """A trimmed text as a timestamp without zone, null where it has no date's shape or no such day exists.

    ``hint``: a date pattern by which a text is read that has not the usual shape.
    """
    stamped = F.regexp_replace(F.regexp_extract(t, _READ, 1), "T", " ").try_cast("timestamp_ntz")
    usual = F.when(t.rlike(DATE), t.try_cast("timestamp_ntz")).when(t.rlike(MOMENT), stamped)
    return F.coalesce(usual, F.try_to_timestamp(t, F.lit(hint)).cast("timestamp_ntz")) if hint else usual


def as_boolean(t: Column, digits: bool = True) -> Column:
    """A trimmed text as boolean; ``digits``: whether 1 and 0 count, as they do where the type was declared."""
    word = F.lower(t)
    yes, no = (*TRUE_WORDS, *(["1"] * digits)), (*FALSE_WORDS, *(["0"] * digits))
    return F.when(word.isin(*yes), True).when(word.isin(*no), False)


def read(spec: ColumnSpec) -> Column:
    """The value of a column in its logical type: double, text, boolean or timestamp without zone."""
    c = col(spec.name)
    if not spec.is_text:
        c = F.when(present(spec), c) if spec.null_markers else c
        if spec.logical == Logical.NUMERICAL:
            return c.cast("double")
        return c.cast("timestamp_ntz") if spec.logical == Logical.DATE else c
    if spec.computed:
        return c
    t = F.when(present(spec), F.trim(c))
    if spec.logical == Logical.NUMERICAL:
        return as_number(t)
    if spec.logical == Logical.DATE:
        return as_moment(t, spec.format_hint)
    return as_boolean(t) if spec.logical == Logical.BOOLEAN else t


def conforms(spec: ColumnSpec, logical: Logical) -> Column:
    """Whether a present value could be read as ``logical``."""
    if logical in (Logical.TEXT, Logical.CATEGORICAL):
        return present(spec)
    if not spec.is_text:
        return present(spec) & F.lit(spec.logical == logical)
    t = F.trim(col(spec.name))
    value = {Logical.NUMERICAL: as_number, Logical.DATE: lambda x: as_moment(x, spec.format_hint), Logical.BOOLEAN: lambda x: as_boolean(x, False)}[logical](t)
    return present(spec) & value.isNotNull()
