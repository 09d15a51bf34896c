"""Transforms of a relation; each stays lazy and composes with the others."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulens.functions.expressions import compile_expression
from tabulens.functions.shape import read
from tabulens.operators.quantiles import BUCKETS, at_ranks
from tabulens.operators.registry import Parameter, tool
from tabulens.types import ColumnSpec, Logical, Relation, Result, TabulensError, col

#: Groups that an aggregate may have.
MOST_GROUPS = 10_000


def spec_of(df, name: str, ordinal: int, logical: Logical) -> ColumnSpec:
    return ColumnSpec(name, ordinal, df.schema[name].dataType.simpleString(), logical, reason="computed", computed=True)


@tool("select_columns", 2, "shape", "table", Parameter("columns", "column_list"))
def select_columns(r: Relation, columns: list[str]) -> Result:
    """Keep the named columns, in the table's order."""
    kept = [c for c in r.columns if c.name in columns]
    if not kept:
        raise TabulensError("no column is left")
    # keys and order columns that are no longer shown stay in the frame until the end
    out = r.step(r.df, columns=tuple(replace(c, ordinal=i) for i, c in enumerate(kept)))
    return Result("table", out, note=f"{len(r.columns) - len(kept)} columns dropped")


@tool("filter_rows", 2, "shape", "table", Parameter("expression", "expression"))
def filter_rows(r: Relation, expression: str) -> Result:
    """Keep the rows for which an expression is true."""
    logical, keep = compile_expression(expression, r.columns)
    if logical != Logical.BOOLEAN:
        raise TabulensError(f"the expression is {logical}, not true or false")
    return Result("table", r.step(r.df.filter(keep)))


@tool("derive_column", 2, "compute", "table", Parameter("name", "text"), Parameter("expression", "expression"))
def derive_column(r: Relation, name: str, expression: str) -> Result:
    """Add a column that an expression computes."""
    if name in r.df.columns:
        raise TabulensError(f"there is a column {name!r} already")
    if not name.strip():
        raise TabulensError("the name is blank")
    logical, value = compile_expression(expression, r.columns)
    df = r.df.withColumn(name, value)
    return Result("table", r.step(df, columns=(*r.columns, spec_of(df, name, len(r.columns), logical))))


@tool("sort_rows", 2, "shape", "table", Parameter("by", "text_list"), Parameter("direction", "enum", 2, "desc", options=("asc", "desc")), Parameter("nulls", "enum", 3, "last", options=("first", "last")))
def sort_rows(r: Relation, by: list[str], direction: str, nulls: str) -> Result:
    """Order rows by columns as they are read, then by their raw values."""
    if not by:
        raise TabulensError("at least one column is needed")
    order = []
    for name in by:
        for c in (read(r[name]), col(name)):
            order.append(getattr(c, f"{direction}_nulls_{nulls}")())
    return Result("table", r.step(r.df, order=tuple(order)))


@tool("limit_rows", 2, "shape", "table", Parameter("n", "integer", 2, 100, 1, 1_000_000), Parameter("offset", "integer", 3, 0, 0))
def limit_rows(r: Relation, n: int, offset: int) -> Result:
    """Keep the first rows of the table's order."""
    df = r.df.orderBy(*r.total_order())
    return Result("table", r.step((df.offset(offset) if offset else df).limit(n)))


@tool("sample_rows", 2, "shape", "table", Parameter("n", "integer", 1, None, 1, 1_000_000), Parameter("seed", "integer", 2, 20260728), applies_to=lambda r: not r.ordered)
def sample_rows(r: Relation, n: int, seed: int) -> Result:
    """Exactly n rows, the same ones for the same seed: those with the least MD5 digest of seed and key, in any engine."""
    if r.ordered:
        raise TabulensError("a sorted table can't be sampled; sample first")
    keys = [col(k) for k in r.row_key]
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return Result("table", r.step(r.df.orderBy(drawn, *keys).limit(n)))


_MEASURE = re.compile(r"^([A-Za-z_]+)\(\s*(.*?)\s*\)$")
_NUMERIC_ONLY = ("sum", "mean", "median")


def measure(r: Relation, text: str):
    """(label, aggregate, logical type) of count(), count(x), distinct_count(x), sum, mean, median, min or max."""
    m = _MEASURE.match(text.strip())
    if not m:
        raise TabulensError(f"{text!r} is no measure like mean(price)")
    f, name = m[1].lower(), m[2].removeprefix("[").removesuffix("]")
    if f == "count" and not name:
        return "count", F.count(F.lit(1)), Logical.NUMERICAL
    if f not in ("count", "distinct_count", "min", "max", *_NUMERIC_ONLY):
        raise TabulensError(f"there is no measure {f!r}")
    spec = r[name]
    if f in _NUMERIC_ONLY and spec.logical != Logical.NUMERICAL:
        raise TabulensError(f"{f} needs a numerical column; {name} is {spec.logical}")
    x = read(spec)
    made = {"count": F.count, "distinct_count": F.count_distinct, "sum": F.sum, "mean": F.avg, "median": F.median, "min": F.min, "max": F.max}[f](x)
    return f"{f}_{name}", made, spec.logical if f in ("min", "max") else Logical.NUMERICAL


@tool("aggregate", 2, "compute", "table", Parameter("group_by", "text_list", 2, ()), Parameter("measures", "text_list"))
def aggregate(r: Relation, group_by: list[str], measures: list[str]) -> Result:
    """Measures for each group of equal raw values, ordered by these; each group's size is always there.

    More than MOST_GROUPS groups are refused before anything is measured.
    """
    keys = [r[k] for k in group_by]
    made = [measure(r, m) for m in measures]
    labels = [label for label, _, _ in made]
    taken = {*group_by, *labels}
    size = next((x for x in ("count",) if x in labels), None) or next(x for x in ("n", "n_rows", "group_size", "rows_in_group") if x not in taken)
    if size not in labels:
        made.append((size, F.count(F.lit(1)), Logical.NUMERICAL))
    if len({*group_by, *[x for x, _, _ in made]}) < len(group_by) + len(made):
        raise TabulensError("two result columns would have the same name")
    if group_by and r.df.select(*[col(k) for k in group_by]).distinct().limit(MOST_GROUPS + 1).count() > MOST_GROUPS:
        raise TabulensError(f"there are more than {MOST_GROUPS} groups; group by fewer columns")
    apart = {x for x, _, _ in made if x.startswith("distinct_count_")}
    if apart and any(x.startswith("median_") for x, _, _ in made):
        # together they would expand every row; apart, two small results meet on their keys
        sides = [[(x, a) for x, a, _ in made if (x in apart) == own] for own in (False, True)]
        left, right = (r.df.groupBy(*[col(k) for k in group_by]).agg(*[a.alias(x) for x, a in side]) for side in sides)
        others = [f"k{i}_" for i in range(len(group_by))]
        right = right.toDF(*others, *[x for x, _ in sides[1]])
        same = reduce(lambda a, b: a & b, [left[f"`{k}`"].eqNullSafe(right[o]) for k, o in zip(group_by, others, strict=True)], F.lit(True))
        df = left.join(right, same).select(*[col(k) for k in group_by], *[col(x) for x, _, _ in made])
    else:
        df = r.df.groupBy(*[col(k) for k in group_by]).agg(*[a.alias(x) for x, a, _ in made])
    specs = [replace(c, ordinal=i) for i, c in enumerate(keys)]
    specs += [spec_of(df, x, len(keys) + i, logical) for i, (x, _, logical) in enumerate(made)]
    order = tuple(col(k).asc_nulls_last() for k in group_by)
    return Result("table", r.step(df, columns=tuple(specs), row_key=tuple(group_by), order=order, size_column=size))


def free_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def ranks(df, key, column: str = "rank_", *ties):
    """``df`` with a dense 1-based rank by a numeric key without nulls, whose values should mostly differ.

    Rows are counted in buckets of the key, which gives each bucket's first rank; windows see one bucket each.
    """
    bounds = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    if bounds["lo"] is None:
        return df.withColumn(column, F.lit(1).cast("long"))
    width = max(float(bounds["hi"]) - float(bounds["lo"]), 1e-300)
    bucket = F.least(F.floor((key.cast("double") - F.lit(float(bounds["lo"]))) / F.lit(width) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    before, seen = [0] * BUCKETS, 0
    for r in df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect():
        before[r["b"]], seen = seen, seen + r["n"]
    first = F.get(F.array(*[F.lit(x).cast("long") for x in before]), F.col("_b"))
    return df.withColumn("_b", bucket).withColumn(column, first + F.row_number().over(Window.partitionBy("_b").orderBy(key, *ties))).drop("_b")


@tool("bin_column", 2, "compute", "table", Parameter("column", "column"), Parameter("strategy", "enum", 2, "equal_width", options=("equal_width", "equal_count")), Parameter("n_bins", "integer", 2, 10, 2, 200), Parameter("include_nulls", "boolean", 3, False))
def bin_column(r: Relation, column: str, strategy: str, n_bins: int, include_nulls: bool) -> Result:
    """Counts of a number or date column in bins of equal width or equal count, with the values observed in each.

    With ``include_nulls`` missing values are a bin of their own, without number and bounds.
    """
    spec = r[column]
    if spec.logical not in (Logical.NUMERICAL, Logical.DATE):
        raise TabulensError(f"{column} is {spec.logical}; numbers and dates can be binned")
    value = read(spec)
    df = r.df.select(value.alias("v"))
    x = F.unix_micros(F.col("v").cast("timestamp")).cast("double") / 1e6 if spec.logical == Logical.DATE else F.col("v")
    bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("v").alias("n")).first()
    if not bounds["n"] or bounds["lo"] == bounds["hi"]:
        raise TabulensError(f"{column} has no two different values")
    if strategy == "equal_width":
        width = (bounds["hi"] - bounds["lo"]) / n_bins
        number = F.least(F.floor((x - F.lit(bounds["lo"])) / F.lit(width)), F.lit(n_bins - 1))
        made = df.withColumn("b", F.when(F.col("v").isNotNull(), number).cast("long"))
        made = (made if include_nulls else made.filter(F.col("b").isNotNull())).groupBy("b").agg(F.min("v").alias("from"), F.max("v").alias("to"), F.count(F.lit(1)).alias("n"))
    else:
        # the first n % k tiles have one row more; a tile is known by the values at its first and last rank
        n, k = bounds["n"], n_bins
        size, more = divmod(n, k)
        ends = [0]
        for i in range(min(k, n)):
            ends.append(ends[-1] + size + (i < more))
        at = F.unix_micros(F.col("v").cast("timestamp")) if spec.logical == Logical.DATE else F.col("v")
        found = at_ranks(df.filter(F.col("v").isNotNull()).select(at.alias("v")), [e for a, b in zip(ends, ends[1:], strict=False) for e in (a, b - 1)], None if spec.logical == Logical.DATE else (bounds["lo"], bounds["hi"]), size=n)
        tiles = [(i, found[a], found[b - 1], b - a) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
        missing = df.filter(F.col("v").isNull()).count() if include_nulls else 0
        tiles += [(None, None, None, missing)] if missing else []
        kind = "bigint" if spec.logical == Logical.DATE else df.schema["v"].dataType.simpleString()
        made = df.sparkSession.createDataFrame(tiles, f"b bigint, from {kind}, to {kind}, n bigint")
        if spec.logical == Logical.DATE:
            made = made.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("from", "to")})
    names = []
    for name in ("bin", f"{column}_from", f"{column}_to", "count"):
        names.append(free_name(name, [*r.names, *names]) if name in r.names else name)
    out = made.toDF(*names)
    kinds = (Logical.NUMERICAL, spec.logical, spec.logical, Logical.NUMERICAL)
    specs = tuple(spec_of(out, n, i, k) for i, (n, k) in enumerate(zip(names, kinds, strict=True)))
    return Result("table", r.step(out, columns=specs, row_key=(names[0],), order=(col(names[0]).asc_nulls_last(),), size_column=names[3]))


