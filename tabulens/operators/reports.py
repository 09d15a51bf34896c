"""Quality reports, crosstabs and charts."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulens.functions.shape import present, read
from tabulens.operators.profile import fence
from tabulens.operators.registry import Parameter, tool
from tabulens.operators.stats import column_statistics
from tabulens.types import Logical, Relation, Result, TabulensError, col

PAIR_COLUMNS, LEVELS, LEGEND, NUMERIC_LEVELS, CHART_ROWS, EXAMPLES = 12, 50, 12, 12, 5000, 10
FINDING = "subject string, reason string, measures map<string,double>"


def findings(r: Relation, rows: list[tuple[str, str, dict]], note: str = "") -> Result:
    made = [(s, why, {k: None if v is None else float(v) for k, v in m.items()}) for s, why, m in rows]
    return Result("report", table=r.df.sparkSession.createDataFrame(made, FINDING), values={"findings": made}, note=note)


def statistics(r: Relation) -> dict[str, dict]:
    return {x["name"]: x.asDict() for x in column_statistics(r).collect()}


def missing_counts(r: Relation) -> DataFrame:
    """(name, missing, total) in one pass."""
    specs = r.columns
    wide = r.df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~present(c)).alias(f"m{c.ordinal}") for c in specs])
    return wide.select("total", F.explode(F.array(*[F.struct(F.lit(c.name).alias("name"), F.col(f"m{c.ordinal}").alias("missing")) for c in specs])).alias("e")).select("e.name", "e.missing", "total")


def missing_together(r: Relation, names: list[str]) -> DataFrame:
    """(a, b, together) for each pair of the named columns, in one pass."""
    pairs = list(combinations(names, 2))
    if not pairs:
        raise TabulensError("two columns are needed")
    wide = r.df.agg(*[F.count_if(~present(r[a]) & ~present(r[b])).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("together")) for i, (a, b) in enumerate(pairs)])).alias("e")).select("e.*")


@tool("missingness_report", 1, "quality", "report", Parameter("min_share", "number", 2, 0.0, 0, 1), Parameter("co_missing", "boolean", 3, True))
def missingness_report(r: Relation, min_share: float, co_missing: bool) -> Result:
    """Missing values by column, and pairs of columns that miss them together."""
    rows = sorted(((x["name"], x["missing"], x["total"]) for x in missing_counts(r).collect() if x["missing"] and x["missing"] >= min_share * x["total"]), key=lambda x: (-x[1], x[0]))
    out = [(n, "values are missing", {"missing": m, "share": m / t}) for n, m, t in rows]
    if co_missing and len(rows) > 1:
        for x in missing_together(r, [n for n, _, _ in rows[:PAIR_COLUMNS]]).orderBy(F.desc("together"), "a", "b").collect():
            if x["together"]:
                out.append((f"{x['a']} and {x['b']}", "missing together", {"rows": x["together"]}))
    return findings(r, out)


def duplicate_groups(r: Relation, subset: list[str]) -> DataFrame:
    return r.df.groupBy(*[col(n) for n in subset or r.names]).agg(F.count(F.lit(1)).alias("copies_")).filter("copies_ > 1")


def duplicate_counts(r: Relation, subset: list[str]) -> DataFrame:
    made = duplicate_groups(r, subset).agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("copies_"), F.lit(0)).alias("affected"))
    return made.select("groups", "affected", (F.col("affected") - F.col("groups")).alias("redundant"))


def duplicate_examples(r: Relation, subset: list[str], k: int = EXAMPLES) -> DataFrame:
    key = F.concat_ws(" | ", *[F.coalesce(col(n).cast("string"), F.lit("")) for n in subset or r.names])
    return duplicate_groups(r, subset).select(key.alias("example"), F.col("copies_").alias("copies")).orderBy(F.desc("copies"), "example").limit(k)


@tool("duplicate_report", 1, "quality", "report", Parameter("subset", "column_list", 2, ()))
def duplicate_report(r: Relation, subset: list[str]) -> Result:
    """Rows that are equal in all or some columns; missing values count as equal."""
    found = duplicate_counts(r, list(subset)).first().asDict()
    total = r.df.count()
    out = findings(r, [(", ".join(subset) or "all columns", "equal rows", found | {"share": found["redundant"] / total if total else 0.0})] if found["groups"] else [])
    out.values["examples"] = [x["example"] for x in duplicate_examples(r, list(subset)).collect()]
    return out


@tool("cardinality_report", 2, "quality", "report", Parameter("max_dimension", "integer", 2, 50, 2, 10_000))
def cardinality_report(r: Relation, max_dimension: int) -> Result:
    """Columns without use as a dimension: empty, constant, all different, or with too many values."""
    out, fine = [], []
    for c in r.columns:
        s = statistics_of(r, c.name)
        if s is None:
            continue
        n, d = s["present"], s["distinct"]
        measures = {"distinct": d, "present": n}
        grouped = c.logical in (Logical.CATEGORICAL, Logical.BOOLEAN, Logical.TEXT)
        if not n:
            out.append((c.name, "no values", measures))
        elif d == 1:
            out.append((c.name, "one value", measures))
        elif grouped and d == n:
            out.append((c.name, "all values differ", measures))
        elif grouped and d > max_dimension:
            out.append((c.name, "too many values", measures))
        elif 2 <= d <= max_dimension:
            fine.append(c.name)
    return findings(r, out, f"usable as dimensions: {', '.join(fine) or 'none'}")


_held: dict[int, tuple[Relation, dict]] = {}


def statistics_of(r: Relation, name: str) -> dict | None:
    """The statistics of one column; all columns of a relation are measured once."""
    if id(r) not in _held:
        _held.clear()
        _held[id(r)] = r, statistics(r)
    return _held[id(r)][1].get(name)


@tool("type_consistency_report", 1, "quality", "report", Parameter("min_conformance", "number", 2, 0.95, 0, 1))
def type_consistency_report(r: Relation, min_conformance: float) -> Result:
    """Columns whose values don't fit their type well enough, or nearly all fit another one."""
    out = []
    for c in r.columns:
        s = statistics_of(r, c.name)
        if not s or not s["present"]:
            continue
        share = {Logical.NUMERICAL: s["numeric"], Logical.DATE: s["dates"] + s["moments"], Logical.BOOLEAN: s["booleans"]}
        if c.logical in share:
            if (own := share[c.logical] / s["present"]) < min_conformance:
                out.append((c.name, f"not all values are {c.logical}", {"share": own}))
        else:
            for kind, n in share.items():
                if min_conformance <= n / s["present"] < 1:
                    out.append((c.name, f"nearly all values are {kind}", {"share": n / s["present"]}))
    return findings(r, out)


@tool("outlier_scan", 1, "quality", "report", Parameter("column", "column"), Parameter("method", "enum", 2, "iqr", options=("iqr", "bounds")), Parameter("k", "number", 2, 1.5, 0, 10), Parameter("lower", "number", 2), Parameter("upper", "number", 2))
def outlier_scan(r: Relation, column: str, method: str, k: float, lower: float | None, upper: float | None) -> Result:
    """Numbers beyond fences: quartiles and their distance, or given bounds."""
    if r[column].logical != Logical.NUMERICAL:
        raise TabulensError(f"{column} is {r[column].logical}, not numerical")
    if method == "bounds" and lower is None and upper is None:
        raise TabulensError("bounds need lower or upper")
    if method == "bounds":
        lower, upper = (-1.7976931348623157e308 if lower is None else lower), (1.7976931348623157e308 if upper is None else upper)
    x = fence(r, column, k, lower, upper).first().asDict()
    x |= {"share": x["outliers"] / x["n"]}
    return findings(r, [(column, "values beyond the fences", {a: round(b, 4) if b is not None else None for a, b in x.items()})] if x["outliers"] else [])


def _axis(r: Relation, name: str):
    return F.trim(col(name).cast("string"))


def crosstab_counts(r: Relation, a: str, b: str, levels: int = LEVELS) -> DataFrame:
    """(row, column, count) for every pair of the most frequent levels of two columns, 0 where there is none."""
    pairs = r.df.filter(present(r[a]) & present(r[b])).groupBy(_axis(r, a).alias("row"), _axis(r, b).alias("column")).agg(F.count(F.lit(1)).alias("count"))
    kept = [pairs.groupBy(x).agg(F.sum("count").alias("n")).orderBy(F.desc("n"), x).limit(levels).select(x) for x in ("row", "column")]
    # at most ``levels`` rows on either side
    grid = kept[0].crossJoin(F.broadcast(kept[1]))
    return grid.join(F.broadcast(pairs.join(F.broadcast(kept[0]), "row").join(F.broadcast(kept[1]), "column")), ["row", "column"], "left").select("row", "column", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def crosstab_shares(r: Relation, a: str, b: str, levels: int = LEVELS) -> DataFrame:
    cells = crosstab_counts(r, a, b, levels)
    rows = cells.groupBy("row").agg(F.sum("count").alias("rs"))
    columns = cells.groupBy("column").agg(F.sum("count").alias("cs"))
    total = cells.agg(F.sum("count").alias("ts"))
    share = lambda n: F.round(F.col("count") / F.nullif(F.col(n), F.lit(0)), 4)
    return cells.join(F.broadcast(rows), "row").join(F.broadcast(columns), "column").crossJoin(F.broadcast(total)).select("row", "column", "count", share("rs").alias("row_share"), share("cs").alias("column_share"), share("ts").alias("total_share"))


@tool("crosstab", 1, "relationship", "matrix", Parameter("a", "column"), Parameter("b", "column"), Parameter("normalize", "enum", 2, "none", options=("none", "row", "column", "all")))
def crosstab(r: Relation, a: str, b: str, normalize: str) -> Result:
    """Counts and shares of pairs of values of two columns."""
    if a == b:
        raise TabulensError("two different columns are needed")
    for name in (a, b):
        if r[name].logical == Logical.NUMERICAL and r.df.select(col(name)).distinct().limit(NUMERIC_LEVELS + 1).count() > NUMERIC_LEVELS:
            raise TabulensError(f"{name} has too many different numbers; bin it first")
    made = crosstab_shares(r, a, b)
    value = {"none": F.col("count").cast("double"), "row": F.col("row_share"), "column": F.col("column_share"), "all": F.col("total_share")}[normalize]
    made = made.withColumn("value", value)
    n = r.df.agg(F.count_if(present(r[a]) & present(r[b])).alias("counted"), F.count_if(~(present(r[a]) & present(r[b]))).alias("incomplete")).first()
    levels = distinct_levels(r, a, b).first()
    return Result("matrix", table=made, values={"cells": [x.asDict() for x in made.orderBy("row", "column").collect()], **n.asDict(), **levels.asDict()})


def pivoted(r: Relation, a: str, b: str, levels: int = LEGEND) -> DataFrame:
    """A crosstab as a grid: a row for each level of ``a``, a column for each of the most frequent levels of ``b``."""
    cells = crosstab_counts(r, a, b, levels)
    heads = [x["column"] for x in cells.select("column").distinct().orderBy("column").collect()]
    return cells.groupBy("row").pivot("column", heads).agg(F.first("count"))


def distinct_levels(r: Relation, a: str, b: str) -> DataFrame:
    """(row_levels, column_levels) among complete pairs, before a crosstab cuts them."""
    both = r.df.filter(present(r[a]) & present(r[b]))
    return both.agg(F.count_distinct(_axis(r, a)).alias("row_levels"), F.count_distinct(_axis(r, b)).alias("column_levels"))


_VEGA = {Logical.NUMERICAL: "quantitative", Logical.DATE: "temporal"}


@tool("plot", 3, "visual", "chart_spec", Parameter("mark", "enum", 1, options=("point", "bar", "line", "rect")), Parameter("x", "column"), Parameter("y", "column", 2), Parameter("x_end", "column", 2), Parameter("color", "column", 2), Parameter("size", "column", 2), Parameter("facet", "column", 2), Parameter("transform", "enum", 3, "none", options=("none", "sort", "stack")))
def plot(r: Relation, mark: str, x: str, y: str | None, x_end: str | None, color: str | None, size: str | None, facet: str | None, transform: str) -> Result:
    """A Vega-Lite chart with its values, of at most 5,000 rows."""
    used = {"x": x, "y": y, "x2": x_end, "color": color, "size": size, "facet": facet}
    names = list(dict.fromkeys(n for n in used.values() if n))
    rows = [d.asDict() for d in r.df.orderBy(*r.total_order()).select(*[read(r[n]).alias(n) for n in names]).limit(CHART_ROWS + 1).collect()]
    if len(rows) > CHART_ROWS:
        raise TabulensError(f"there are more than {CHART_ROWS} rows; aggregate or bin them first")
    for n, most in [*((n, LEVELS) for n in (x, y) if n and r[n].logical not in _VEGA), *((n, LEGEND) for n in (color, facet) if n and r[n].logical not in _VEGA)]:
        if len({d[n] for d in rows}) > most:
            raise TabulensError(f"{n} has more than {most} values")
    channels = {c: {"field": n, "type": _VEGA.get(r[n].logical, "nominal")} for c, n in used.items() if n and c != "x2"}
    if x_end:
        channels["x"]["bin"], channels["x2"] = "binned", {"field": x_end}
    if mark == "bar" and y and not x_end and channels["x"]["type"] == "nominal" and channels["y"]["type"] == "quantitative":
        channels["x"], channels["y"] = channels["y"], channels["x"]
    # sorting concerns the categories, stacking the measure, wherever they stand
    for c in ("x", "y"):
        if c in channels and transform == "sort" and channels[c]["type"] == "nominal":
            channels[c]["sort"] = "-x" if c == "y" else "-y"
        if c in channels and transform == "stack" and channels[c]["type"] == "quantitative":
            channels[c]["stack"] = "zero"
    plain = [{k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in d.items()} for d in rows]
    return Result("chart_spec", values={"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "mark": mark, "encoding": channels, "data": {"values": plain}})
