"""Column statistics and type inference."""

from __future__ import annotations

from dataclasses import replace
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.shape import conforms, present
from tabulens.types import ColumnSpec, Logical, Relation, SchemaContract, TabulensError, col

#: The limits of the category rule, and the share at which a rejected type is worth telling.
MOST_CATEGORIES, MOST_RATIO, NEAR_MISS = 50, 0.5, 0.9
STATISTICS = ("total", "present", "distinct", "numeric", "dates", "moments", "booleans")


def _counts(spec: ColumnSpec) -> list[Column]:
    ok = present(spec)
    if not spec.is_text:
        zero = F.lit(0)
        own = {k: ok if spec.logical == k else F.lit(False) for k in Logical}
        return [F.count_if(ok), F.count_if(own[Logical.NUMERICAL]), F.count_if(own[Logical.DATE]), F.sum(zero), F.count_if(own[Logical.BOOLEAN])]
    t = F.trim(col(spec.name))
    dates = conforms(spec, Logical.DATE)
    plain = t.rlike(r"^\d{4}-\d{2}-\d{2}\z")
    return [F.count_if(ok), F.count_if(conforms(spec, Logical.NUMERICAL)), F.count_if(dates & plain), F.count_if(dates & ~plain), F.count_if(conforms(spec, Logical.BOOLEAN))]


def column_statistics(r: Relation) -> DataFrame:
    """(ordinal, name, total, present, distinct, numeric, dates, moments, booleans) for each column.

    Counts come from one pass. Distinct values, whose pass would multiply every row by the number of columns, are
    counted on (column, value) rows that are distinct before they are counted.
    """
    specs = [c for c in r.columns if c.logical != Logical.UNSUPPORTED]
    if not specs:
        raise TabulensError("no column can be measured")
    wide = r.df.agg(F.count(F.lit(1)).alias("t"), *[c.alias(f"c{s.ordinal}_{i}") for s in specs for i, c in enumerate(_counts(s))])
    names = [*STATISTICS[:2], *STATISTICS[3:]]
    cells = [F.struct(F.lit(s.ordinal).alias("ordinal"), F.lit(s.name).alias("name"), *[F.coalesce(x, F.lit(0)).cast("bigint").alias(n) for n, x in zip(names, [F.col("t"), *[F.col(f"c{s.ordinal}_{i}") for i in range(5)]], strict=True)]) for s in specs]
    long = wide.select(F.explode(F.array(*cells)).alias("s")).select("s.*")
    def short(s: ColumnSpec) -> Column:
        v = col(s.name).cast("string")
        return F.when(F.length(v) > 24, F.md5(v)).otherwise(v) if s.is_text else v  # a digest is longer than what stands for itself

    values = r.df.select(F.explode(F.array(*[F.struct(F.lit(s.ordinal).alias("ordinal"), F.when(present(s), short(s)).alias("v")) for s in specs])).alias("e")).select("e.*").filter("v is not null")
    distinct = values.distinct().groupBy("ordinal").agg(F.count(F.lit(1)).alias("distinct"))
    out = long.join(distinct, "ordinal", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0)).cast("bigint"))
    return out.select("ordinal", "name", *STATISTICS)


def infer(spec: ColumnSpec, s: dict) -> ColumnSpec:
    """The logical type of a column from its statistics; every present value must conform."""
    if not spec.is_text:
        return replace(spec, confidence=1.0, reason="the file's own type")
    n, distinct = s["present"], s["distinct"]

    def made(kind: Logical, confidence: float, reason: str) -> ColumnSpec:
        return replace(spec, logical=kind, confidence=confidence, reason=reason)

    if not n:
        return made(Logical.TEXT, 0.0, "no values")
    for kind, count, reason in ((Logical.BOOLEAN, s["booleans"], "all values are words for true or false"), (Logical.DATE, s["moments"], "all values are moments"), (Logical.DATE, s["dates"], "all values are dates"), (Logical.NUMERICAL, s["numeric"], "all values are numbers")):
        if count == n:
            return made(kind, 0.8 if kind == Logical.NUMERICAL and distinct <= 2 else 1.0, reason)
    nearest = max(s["numeric"], s["dates"], s["moments"], s["booleans"]) / n
    doubt = 0.5 if nearest >= NEAR_MISS else 0.9
    if distinct <= MOST_CATEGORIES and distinct <= MOST_RATIO * n:
        return made(Logical.CATEGORICAL, doubt, f"{distinct} different values")
    return made(Logical.TEXT, doubt, f"{distinct} different values of {n}")


def infer_schema(r: Relation) -> SchemaContract:
    rows = {x["name"]: x.asDict() for x in column_statistics(r).collect()}
    return SchemaContract(tuple(infer(c, rows[c.name]) if c.name in rows else c for c in r.columns))


def conforming(spec: ColumnSpec, s: dict) -> int:
    """How many present values can be read as the column's type, by its statistics."""
    counts = {Logical.NUMERICAL: s["numeric"], Logical.DATE: s["dates"] + s["moments"], Logical.BOOLEAN: s["booleans"]}
    return counts.get(spec.logical, s["present"])


def override(contract: SchemaContract, name: str, logical: Logical | None = None, by: str = "", null_markers: tuple[str, ...] | None = None, format_hint: str | None = None, relation: Relation | None = None) -> SchemaContract:
    """The next version of a contract, with another reading of one column; the data stay as they are.

    With ``relation`` the reason tells how many values don't conform to the new reading.
    """
    old = contract[name]
    logical = old.logical if logical is None else logical
    if Logical.UNSUPPORTED in (logical, old.logical):
        raise TabulensError("the type 'unsupported' is neither given nor taken by hand")
    new = replace(old, logical=logical, overridden_by=by, confidence=1.0, reason=f"set by {by}", null_markers=old.null_markers if null_markers is None else tuple(null_markers), format_hint=old.format_hint if format_hint is None else format_hint)
    if relation is not None:
        one = replace(relation, columns=(replace(new, physical=relation[name].physical, ordinal=0),))
        s = column_statistics(one).first().asDict()
        new = replace(new, reason=f"set by {by}; {s['present'] - conforming(new, s)} of {s['present']} values don't conform")
    return SchemaContract(tuple(new if c.name == name else c for c in contract.columns), contract.version + 1, contract.version)
