"""Queries over small dirty tables and over the engine's own workings, each with its SQL.

The test tables hold no nulls and no blanks; these rows do. They are written once and given to Spark and to SQL alike.
"""

from __future__ import annotations

import io
import json
import tempfile
import uuid
import zipfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tabulens.operators.profile as P
import tabulens.operators.reports as R
import tabulens.operators.transforms as T
from tabulens.functions.shape import DATE, DECIMAL, INTEGER, MOMENT, as_boolean, as_moment, as_number, read
from tabulens.operators.stats import infer_schema, override
from tabulens.plans.planner import Proposal, ask
from tabulens.plans.runner import Runner, Store
from tabulens.queries import HIST_SQL, TOKENS, holes, query, rel, rounded
from tabulens.sources import sniff
from tabulens.sources.normalise import Catalog, content_hash, ingest, numbered, page, preview
from tabulens.sources.samples import ingest_sample
from tabulens.types import Logical, Relation, TabulensError

#: Rows of text columns with what real files hold.
SHAPES = ("v string", [(x,) for x in ("42", "007", "+5", "1.", ".5", "-2.50", "1e5", "0x1F", "1_000", "inf", "nan", "1d", " 7 ", "42\n", "1" * 18, "1" * 19, "", "  ", "\t", "-0", "+", "1.2.3", None)])
MOMENTS = ("v string", [(x,) for x in ("2024-03-01", "2024-13-45", "2024-02-30", "2024-03-01 10:00", "2024-03-01T10:00:05", "2024-03-01 10:00:05 junk", "2024-03-01 25:00", "inf", "01.03.2024", " 2024-03-02 ", "", None)])
FLAGS = ("v string", [(x,) for x in ("true", "T", "Yes", "y", "1", "0", "No", "f", "FALSE", "maybe", " yes ", "", None)])
REGIONS = ("id int, region string, amount string, day string", [
    (1, "Jakarta", "10", "01.02.2024"), (2, "jakarta", "2.5", "03.02.2024"), (3, "Jakarta ", "unknown", "n/a"), (4, "", "7", "2024-02-05"), (5, None, None, None),
    (6, "Bandung", "n/a", "31.12.2023"), (7, "Jakarta", "-3", "unknown"), (8, "Bandung", "0", "05.02.2024"), (9, " ", " 12 ", ""), (10, "Jakarta", "10", "01.02.2024"),
])
TIES = ("id int, k string, x double", [(1, "a", 2.0), (2, "b", 1.0), (3, None, 2.0), (4, "b", 1.0), (5, "a", 3.0), (6, "c", None), (7, None, 3.0), (8, "c", 5.0), (9, "d", 1.0), (10, "a", 2.0)])
CODES = ("code string, level string, part string", [(str(100 + i) if i % 33 else "x1", "7" if i % 9 else "?", "ab"[i % 2]) for i in range(1, 100)])


def _literal(x: object) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def sql_of(fixture: tuple[str, list[tuple]]) -> str:
    """The rows as an SQL table."""
    schema, rows = fixture
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": "VARCHAR", "int": "INTEGER", "double": "DOUBLE"}[x.split()[1]] for x in schema.split(", ")]
    cells = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"(SELECT {', '.join(f'{n}::{k} AS {n}' for n, k in zip(names, kinds, strict=True))} FROM (VALUES {cells}) AS f({', '.join(names)}))"


def fixture(spark: SparkSession, made: tuple[str, list[tuple]], key: list[str] | None = None, logical: dict[str, Logical] | None = None) -> Relation:
    return Relation.of(spark.createDataFrame(made[1], made[0]), key, logical)


def on(name: str, made: tuple[str, list[tuple]], sql: str, key: list[str] | None = None, logical: dict[str, Logical] | None = None):
    """A query over a fixture; ``{t}`` in its SQL is the fixture."""
    return lambda f: query(name, "region", sql.replace("{t}", sql_of(made)))(lambda r: f(fixture(r.df.sparkSession, made, key, logical)))


PRESENT = "(v IS NOT NULL AND trim(v) <> '')"
NUMBER = f"(regexp_matches(trim(v), '{INTEGER[:-2]}$') OR regexp_matches(trim(v), '{DECIMAL[:-2]}$'))"
STAMP = "try_cast(replace(regexp_extract(trim(v), '^(\\d{4}-\\d{2}-\\d{2}[ T]\\d{2}:\\d{2}(?::\\d{2}(?:\\.\\d+)?)?)', 1), 'T', ' ') AS TIMESTAMP)"
MOMENT_SQL = f"CASE WHEN regexp_matches(trim(v), '{DATE[:-2]}$') THEN try_cast(trim(v) AS TIMESTAMP) WHEN regexp_matches(trim(v), '{MOMENT}') THEN {STAMP} END"
BOOLEAN_SQL = "CASE WHEN lower(trim(v)) IN ('true','t','yes','y','1') THEN true WHEN lower(trim(v)) IN ('false','f','no','n','0') THEN false END"


@on("text_as_numbers", SHAPES, f"SELECT v, CASE WHEN {PRESENT} AND {NUMBER} THEN trim(v)::DOUBLE END AS x FROM {{t}}")
def _(r):
    return r.df.select("v", as_number(F.trim("v")).alias("x"))


@on("text_as_moments", MOMENTS, f"SELECT v, {MOMENT_SQL} AS x FROM {{t}}")
def _(r):
    return r.df.select("v", as_moment(F.trim("v")).alias("x"))


@on("text_as_flags", FLAGS, f"SELECT v, {BOOLEAN_SQL} AS x FROM {{t}}")
def _(r):
    return r.df.select("v", as_boolean(F.trim("v")).alias("x"))


@on("declared_flags", FLAGS, f"SELECT count(*) FILTER (WHERE x) AS true_count, count(*) FILTER (WHERE NOT x) AS false_count, count(*) FILTER (WHERE {PRESENT} AND x IS NULL) AS other_count FROM (SELECT v, {BOOLEAN_SQL} AS x FROM {{t}})", logical={"v": Logical.BOOLEAN})
def _(r):
    return P.boolean_counts(r, "v")


_DIRTY = "sum(x) AS sum, count(x) AS n, count(*) AS size FROM (SELECT region, CASE WHEN {n} THEN trim(amount)::DOUBLE END AS x FROM {t})".replace("{n}", NUMBER.replace("v", "amount").replace("amountalue", "value"))


@on("aggregate_dirty_text", REGIONS, f"SELECT region, round(avg(x), 4) AS mean_amount, count(x) AS count_amount, {_DIRTY.replace('sum(x) AS sum, count(x) AS n, count(*) AS size', 'count(*) AS n')} GROUP BY region", ["id"], {"amount": Logical.NUMERICAL})
def _(r):
    return rel(T.aggregate(r, group_by=["region"], measures=["mean(amount)", "count(amount)"]).relation)


@on("completeness_dirty", REGIONS, "SELECT count(*) AS total, count(*) FILTER (WHERE region IS NOT NULL AND trim(region)<>'') AS present, count(*) FILTER (WHERE region IS NULL) AS nulls, count(*) FILTER (WHERE trim(region)='') AS empty, NULL::BIGINT AS zeros, NULL::BIGINT AS negatives FROM {t}", ["id"])
def _(r):
    return P.completeness(r, "region")


@on("top_values_dirty", REGIONS, "SELECT trim(region) AS value, count(*) AS count FROM {t} WHERE trim(region)<>'' GROUP BY 1", ["id"])
def _(r):
    return P.top_values(r, "region")


MARKERS = ("n/a", "unknown")
_MARKED = "FROM {t} WHERE amount IS NOT NULL AND trim(amount) <> '' AND trim(amount) NOT IN ('n/a','unknown')"


@on("null_markers", REGIONS, f"SELECT 'plain' AS contract, count(*) FILTER (WHERE trim(amount) <> '') AS present, count(*) FILTER (WHERE amount IS NULL) AS nulls, count(*) FILTER (WHERE trim(amount) = '') AS empty FROM {{t}} UNION ALL SELECT 'marked', (SELECT count(*) {_MARKED}), (SELECT count(*) FROM {{t}} WHERE amount IS NULL), (SELECT count(*) FROM {{t}}) - (SELECT count(*) {_MARKED}) - (SELECT count(*) FROM {{t}} WHERE amount IS NULL)", ["id"])
def _(r):
    contract = infer_schema(r)
    marked = replace(r, columns=override(contract, "amount", Logical.NUMERICAL, "owner", MARKERS).columns)
    one = lambda name, x: P.completeness(x, "amount").select(F.lit(name).alias("contract"), "present", "nulls", "empty")
    return one("plain", r).union(one("marked", marked))


@on("format_hint", REGIONS, "SELECT id, coalesce(try_cast(CASE WHEN regexp_matches(trim(day), '^\\d{4}-\\d{2}-\\d{2}$') THEN trim(day) END AS TIMESTAMP), try_strptime(trim(day), '%d.%m.%Y')) AS day FROM {t}", ["id"])
def _(r):
    contract = override(infer_schema(r), "day", Logical.DATE, "owner", MARKERS, "dd.MM.yyyy")
    return r.df.select("id", read(contract["day"]).alias("day"))


@on("override_non_conforming", REGIONS, "SELECT 2 AS version, 1 AS derived_from, 'numerical' AS logical, 'set by owner; ' || count(*) FILTER (WHERE NOT " + NUMBER.replace("trim(v)", "trim(amount)") + ") || ' of ' || count(*) || ' values don''t conform' AS reason FROM {t} WHERE trim(amount) <> '' AND trim(amount) <> 'n/a'", ["id"])
def _(r):
    store = Store()
    store.add_contract("d", infer_schema(r))
    store.add_contract("d", override(store.contract("d"), "amount", Logical.NUMERICAL, "owner", ("n/a",), relation=r))
    c = Store.load(store.dump()).contract("d")
    return r.df.sparkSession.createDataFrame([(c.version, c.derived_from, str(c["amount"].logical), c["amount"].reason)], "version int, derived_from int, logical string, reason string")


def _infer_sql(t: str, columns: list[str]) -> str:
    """The rules of inference for text columns, from counts of present values."""
    parts = []
    for i, c in enumerate(columns):
        words = "lower(trim(v)) IN ('true','t','yes','y','false','f','no','n')"
        counts = f"SELECT count(*) n, count(DISTINCT v) d, count(*) FILTER (WHERE {words}) b, count(*) FILTER (WHERE {NUMBER}) x, count(*) FILTER (WHERE regexp_matches(trim(v), '{DATE[:-2]}$') AND ({MOMENT_SQL}) IS NOT NULL) y, count(*) FILTER (WHERE NOT regexp_matches(trim(v), '{DATE[:-2]}$') AND ({MOMENT_SQL}) IS NOT NULL) m FROM (SELECT {c} AS v FROM {t}) WHERE {PRESENT}"
        logical = "CASE WHEN n=0 THEN 'text' WHEN b=n THEN 'boolean' WHEN m=n OR y=n THEN 'date' WHEN x=n THEN 'numerical' WHEN d<=50 AND d<=0.5*n THEN 'categorical' ELSE 'text' END"
        sure = "CASE WHEN n=0 THEN 0.0 WHEN b=n OR m=n OR y=n THEN 1.0 WHEN x=n THEN CASE WHEN d<=2 THEN 0.8 ELSE 1.0 END WHEN greatest(b,x,y,m) >= 0.9*n THEN 0.5 ELSE 0.9 END"
        parts.append(f"SELECT '{c}' AS name, {i} AS ordinal, {logical} AS logical, ({sure})::DOUBLE AS confidence FROM ({counts})")
    return " UNION ALL ".join(parts)


def _contract(r: Relation, *names: str) -> DataFrame:
    rows = [(c.name, c.ordinal, str(c.logical), c.confidence) for c in infer_schema(r).columns if not names or c.name in names]
    return r.df.sparkSession.createDataFrame(rows, "name string, ordinal int, logical string, confidence double")


on("infer_near_miss", CODES, _infer_sql(sql_of(CODES), ["code", "level", "part"]))(_contract)
on("infer_dirty", REGIONS, _infer_sql(sql_of((REGIONS[0].partition(", ")[2], [r[1:] for r in REGIONS[1]])), ["region", "amount", "day"]))(lambda r: _contract(Relation.of(r.df.drop("id"))))
query("infer_schema", "orders", "SELECT name, ordinal, logical, confidence FROM (" + _infer_sql("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]).replace("AS v FROM orders", "::VARCHAR AS v FROM orders") + ") WHERE name IN ('o_orderstatus','o_orderpriority') UNION ALL VALUES ('o_orderkey', 0, 'numerical', 1.0), ('o_custkey', 1, 'numerical', 1.0), ('o_totalprice', 3, 'numerical', 1.0), ('o_orderdate', 4, 'date', 1.0)")(_contract)

on("ties_mode_and_bins", TIES, "SELECT 'mode' AS what, 0::BIGINT AS i, v AS lower, v AS upper, n AS count FROM (SELECT x v, count(*) n FROM {t} WHERE x IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1) UNION ALL SELECT 'bin', i - 1, min(x), max(x), count(*) FROM (SELECT x, ntile(4) OVER (ORDER BY x) i FROM {t} WHERE x IS NOT NULL) GROUP BY i", ["id"])(
    lambda r: P.values(r, "x").groupBy("v").agg(F.count(F.lit(1)).alias("n")).join(P.moments(r, "x").select(F.col("mode").alias("v")), "v").select(F.lit("mode").alias("what"), F.lit(0).cast("bigint").alias("i"), F.col("v").alias("lower"), F.col("v").alias("upper"), F.col("n").alias("count"))
    .union(T.bin_column(r, column="x", strategy="equal_count", n_bins=4).relation.df.select(F.lit("bin"), "bin", "x_from", "x_to", "count"))
)
on("ties_top_and_sort", TIES, "SELECT 1 AS part, value, count FROM (SELECT k AS value, count(*) AS count FROM {t} WHERE k IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL SELECT 2, k, id FROM (SELECT k, id FROM {t} ORDER BY x DESC NULLS LAST, id LIMIT 4)", ["id"])(
    lambda r: P.top_values(r, "k", 3).select(F.lit(1).alias("part"), "value", "count").union(T.limit_rows(T.sort_rows(r, by=["x"]).relation, n=4).relation.df.select(F.lit(2), "k", "id"))
)
on("expressions_with_nulls", TIES, "SELECT id, round(x / nullif(x - 2, 0), 4) AS ratio, CASE WHEN k IN ('a', 'b') THEN true WHEN k IS NULL THEN NULL ELSE false END AS known, coalesce(k, 'none') AS kind, x IS NULL AS gone, CASE WHEN x BETWEEN 1 AND 2 THEN 'low' ELSE 'other' END AS band FROM {t}", ["id"])(
    lambda r: rel(T.select_columns(T.derive_column(T.derive_column(T.derive_column(T.derive_column(T.derive_column(r, name="ratio", expression="[x] / ([x] - 2)").relation, name="known", expression='[k] in ["a", "b"]').relation, name="kind", expression='coalesce([k], "none")').relation, name="gone", expression="[x] is null").relation, name="band", expression='if([x] between 1 and 2, "low", "other")').relation, columns=["id", "ratio", "known", "kind", "gone", "band"]).relation)
)


@query("sample_rows", "orders", "SELECT * FROM orders ORDER BY md5('20260728|' || o_orderkey), o_orderkey LIMIT 100")
def _(r):
    return T.sample_rows(r, n=100).relation


def found(result, *measures: str) -> DataFrame:
    """A report's findings as rows, with the named measures as columns."""
    return result.table.select("subject", "reason", *[F.round(F.col("measures")[m], 6).alias(m) for m in measures])


_CONFORM = f"count(*) FILTER (WHERE {NUMBER}) / count(*)"


@on("type_consistency", CODES, f"SELECT 'code' AS subject, 'nearly all values are numerical' AS reason, round({_CONFORM}, 6) AS share FROM (SELECT code AS v FROM {{t}}) HAVING {_CONFORM} BETWEEN 0.95 AND 0.999999 UNION ALL SELECT 'level', 'not all values are numerical', round({_CONFORM}, 6) FROM (SELECT level AS v FROM {{t}}) HAVING {_CONFORM} < 0.95", logical={"level": Logical.NUMERICAL})
def _(r):
    return found(R.type_consistency_report(r), "share")


def _cardinality_sql(t: str, columns: list[tuple[str, bool]], most: int) -> str:
    parts = [f"SELECT '{c}' AS subject, CASE WHEN n=0 THEN 'no values' WHEN d=1 THEN 'one value' WHEN {str(g).lower()} AND d=n THEN 'all values differ' WHEN {str(g).lower()} AND d>{most} THEN 'too many values' END AS reason, d::DOUBLE AS \"distinct\", n::DOUBLE AS present FROM (SELECT count({c}) n, count(DISTINCT {c}) d FROM {t})" for c, g in columns]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE reason IS NOT NULL"


query("cardinality_report", "part", _cardinality_sql("part", [("p_partkey", False), ("p_name", True), ("p_brand", True), ("p_type", True), ("p_size", False), ("p_retailprice", False)], 4))(lambda r: found(R.cardinality_report(T.select_columns(r, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]).relation, max_dimension=4), "distinct", "present"))
query("outlier_scan_tool", "events", "WITH q AS (SELECT quantile_cont(value,0.25) q1, quantile_cont(value,0.75) q3 FROM events), f AS (SELECT q1-0.5*(q3-q1) lo, q3+0.5*(q3-q1) hi FROM q) SELECT 'value' AS subject, 'values beyond the fences' AS reason, count(*)::DOUBLE AS n, (count(*) FILTER (WHERE value<lo))::DOUBLE AS below, (count(*) FILTER (WHERE value>hi))::DOUBLE AS above, round(any_value(lo),4) AS lower, round(any_value(hi),4) AS upper, round((count(*) FILTER (WHERE value<lo OR value>hi))/count(*),4) AS share FROM events, f")(lambda r: found(R.outlier_scan(r, column="value", k=0.5), "n", "below", "above", "lower", "upper", "share"))
query("outlier_scan_bounds", "events", "SELECT 'value' AS subject, 'values beyond the fences' AS reason, (count(*) FILTER (WHERE value<10))::DOUBLE AS below, (count(*) FILTER (WHERE value>60))::DOUBLE AS above FROM events")(lambda r: found(R.outlier_scan(r, column="value", method="bounds", lower=10.0, upper=60.0), "below", "above"))
query("missingness_tool", "events", "WITH h AS (SELECT CASE WHEN event_id%5<>0 THEN value END AS a, nullif(event_type,'click') AS b, CASE WHEN event_id%3<>0 THEN props ELSE ' ' END AS c FROM events), m AS (SELECT a IS NULL AS a, (b IS NULL OR trim(b)='') AS b, (c IS NULL OR trim(c)='') AS c FROM h), n AS (SELECT count(*) FILTER (WHERE a) a, count(*) FILTER (WHERE b) b, count(*) FILTER (WHERE c) c, count(*) t FROM m), w AS (SELECT 'value' AS subject, a::DOUBLE AS missing, a/t AS share FROM n UNION ALL SELECT 'event_type', b, b/t FROM n UNION ALL SELECT 'props', c, c/t FROM n) SELECT subject, round(missing,6) AS missing, round(share,6) AS share FROM w WHERE missing>0")(lambda r: found(R.missingness_report(holes(r), co_missing=False), "missing", "share").drop("reason"))
query("duplicate_tool", "documents", "WITH g AS (SELECT count(*) n FROM documents GROUP BY lang, n_chars HAVING count(*)>1) SELECT 'lang, n_chars' AS subject, count(*)::DOUBLE AS groups, sum(n)::DOUBLE AS affected, (sum(n)-count(*))::DOUBLE AS redundant, round((sum(n)-count(*))/(SELECT count(*) FROM documents),6) AS share FROM g")(lambda r: found(R.duplicate_report(r, subset=["n_chars", "lang"]), "groups", "affected", "redundant", "share").drop("reason"))


def _crosstab(r: Relation) -> DataFrame:
    made = R.crosstab(r, a="o_orderstatus", b="o_orderpriority", normalize="column").values
    rows = [("cell", c["row"], c["column"], float(c["count"]), c["value"]) for c in made["cells"]]
    rows += [("total", k, "", float(made[k]), None) for k in ("counted", "incomplete", "row_levels", "column_levels")]
    return rounded(r.df.sparkSession.createDataFrame(rows, "part string, row string, column string, count double, value double"))


query("crosstab_tool", "orders", "WITH c AS (SELECT o_orderstatus AS r, o_orderpriority AS k, count(*)::DOUBLE AS n FROM orders GROUP BY 1,2), g AS (SELECT a.r, b.k, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT r FROM c) a CROSS JOIN (SELECT DISTINCT k FROM c) b LEFT JOIN c ON c.r=a.r AND c.k=b.k) SELECT 'cell' AS part, r AS row, k AS \"column\", n AS count, round(n/sum(n) OVER (PARTITION BY k),4) AS value FROM g UNION ALL SELECT 'total', unnest(['counted','incomplete','row_levels','column_levels']), '', unnest([count(*)::DOUBLE, 0, count(DISTINCT o_orderstatus)::DOUBLE, count(DISTINCT o_orderpriority)::DOUBLE]), NULL FROM orders")(_crosstab)
query("crosstab_grid", "lineitem", "SELECT l_returnflag AS row, count(*) FILTER (WHERE l_linestatus='F') AS F, count(*) FILTER (WHERE l_linestatus='O') AS O FROM lineitem GROUP BY 1")(lambda r: R.pivoted(r, "l_returnflag", "l_linestatus"))
query("ecdf_lookup", "lineitem", "SELECT x, (SELECT count(*) FROM lineitem WHERE l_extendedprice <= x) / (SELECT count(*) FROM lineitem) AS share FROM (SELECT unnest([0.0, 1000.0, 20000.0, 50000.0, 1e9])::DOUBLE AS x)")(lambda r: P.ecdf_at(r, "l_extendedprice", [0.0, 1000.0, 20000.0, 50000.0, 1e9]))
query("ecdf_inverse", "lineitem", "SELECT unnest([0.1, 0.9, 1.0])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [0.1, 0.9, 1.0])),4) AS value FROM lineitem")(lambda r: rounded(P.quantiles(r, "l_extendedprice", (0.1, 0.9, 1.0))))
query("heat_grid", "events", "WITH d AS (SELECT unnest(generate_series(date_trunc('day',min(ts)), max(ts), INTERVAL 1 day))::DATE AS d FROM events), c AS (SELECT ts::DATE AS d, count(*) n FROM events GROUP BY 1), j AS (SELECT d.d, coalesce(n,0) n, max(coalesce(n,0)) OVER () top, date_diff('day', min(d.d) OVER (), d.d) + isodow(min(d.d) OVER ()) - 1 AS p FROM d LEFT JOIN c USING (d)) SELECT strftime(d,'%Y-%m-%d') AS key, floor(p/7)::BIGINT AS week, (p%7)::INTEGER AS row, n::BIGINT AS count, least(ceil(n/greatest(top,1)*4),4)::BIGINT AS level FROM j")(lambda r: P.heat_grid(r, "ts"))
query("plot_values", "customer", "SELECT c_mktsegment, round(avg(c_acctbal),4) AS mean_c_acctbal FROM customer GROUP BY 1")(lambda r: rounded(r.df.sparkSession.createDataFrame(R.plot(T.aggregate(r, group_by=["c_mktsegment"], measures=["mean(c_acctbal)"]).relation, mark="bar", x="c_mktsegment", y="mean_c_acctbal").values["data"]["values"])))
query("rug_thinned", "lineitem", "WITH c AS (SELECT l_extendedprice AS value, count(*) AS count FROM lineitem GROUP BY 1), n AS (SELECT value, count, row_number() OVER (ORDER BY value) i, count(*) OVER () d FROM c) SELECT value, count FROM n WHERE (i-1) % greatest(1, ceil(d/400.0)::BIGINT) = 0 OR i = d")(lambda r: P.rug(r, "l_extendedprice"))
query("row_id_page", "orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER () AS i FROM orders) WHERE i > 2500 AND i <= 2600")(lambda r: page(numbered(r.df), 2500, 100).select("o_orderkey", "o_custkey", "o_totalprice"))
query("distinct_levels", "part", "SELECT count(DISTINCT p_brand) AS row_levels, count(DISTINCT p_type) AS column_levels FROM part")(lambda r: R.distinct_levels(r, "p_brand", "p_type"))

# whole panels and cards: every block of a tool's result as rows (block, key, value)


def flat(spark: SparkSession, blocks: dict, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """Blocks of one row by their fields, blocks of several by their key and value column; figures only."""
    rows = []
    for name, b in blocks.items():
        if isinstance(b, dict):
            rows += [(name, k, round(float(v), 6) if name == "fence" else float(v)) for k, v in b.items() if v is not None and not isinstance(v, str) and not hasattr(v, "year")]
        elif name in keys:
            k, v = keys[name]
            rows += [(name, str(x[k]) if not isinstance(x[k], float) else f"{x[k]:.4f}", float(x[v])) for x in b]
    df = spark.createDataFrame(rows, "block string, key string, value double")
    # fences lie between four digits, where rounding to them would be a toss
    return df.withColumn("value", F.when(F.col("block") == "fence", F.round("value", 6)).otherwise(F.round("value", 4)))


def _fields(block: str, names: str, sql: str) -> str:
    return " UNION ALL ".join(f"SELECT '{block}' AS block, '{n}' AS key, round(({n})::DOUBLE, {6 if block == 'fence' else 4}) AS value FROM ({sql}) WHERE ({n}) IS NOT NULL" for n in names.split())


def _listed(block: str, key: str, value: str, sql: str, number: bool = False) -> str:
    return f"SELECT '{block}' AS block, {f'printf(chr(37)||{chr(39)}.4f{chr(39)}, {key}::DOUBLE)' if number else f'{key}::VARCHAR'} AS key, round({value}::DOUBLE, 4) AS value FROM ({sql})"


_M = "SELECT count(v) n, avg(v) mean, median(v) median, (SELECT v FROM (SELECT v, count(*) k FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)) AS mode, stddev_samp(v) std, var_samp(v) variance, min(v) minimum, max(v) maximum, max(v)-min(v) value_range, skewness(v) skewness, kurtosis(v) kurtosis FROM x"
_F = "SELECT count(v) n, count(*) FILTER (WHERE v<lo) below, count(*) FILTER (WHERE v>hi) above, count(*) FILTER (WHERE v<lo OR v>hi) outliers, any_value(q1) q1, any_value(q3) q3, any_value(lo) lower, any_value(hi) upper, min(v) FILTER (WHERE v BETWEEN lo AND hi) whisker_low, max(v) FILTER (WHERE v BETWEEN lo AND hi) whisker_high, min(v) minimum, max(v) maximum FROM x, (SELECT q1, q3, q1-1.5*(q3-q1) lo, q3+1.5*(q3-q1) hi FROM (SELECT quantile_cont(v,0.25) q1, quantile_cont(v,0.75) q3 FROM x))"
_QS = ",".join(map(str, P.QUANTILES))
_PS = ",".join(f"{i / 100}" for i in range(101))
NUMERIC_PANEL = "WITH x AS (SELECT c_acctbal AS v FROM customer) " + " UNION ALL ".join([
    _fields("completeness", "total present nulls empty zeros negatives", "SELECT count(*) total, count(v) present, count(*)-count(v) nulls, 0 AS empty, count(*) FILTER (WHERE v=0) zeros, count(*) FILTER (WHERE v<0) negatives FROM x"),
    _fields("cardinality", "distinct_ is_unique", "SELECT count(DISTINCT v) distinct_, (count(DISTINCT v)=count(v))::INT is_unique FROM x").replace("'distinct_'", "'distinct'"),
    _fields("moments", "n mean median mode std variance minimum maximum value_range skewness kurtosis", _M), _fields("fence", "n below above outliers q1 q3 lower upper whisker_low whisker_high minimum maximum", _F),
    _listed("quantiles", "q", "value", f"SELECT unnest([{_QS}])::DOUBLE q, unnest(quantile_cont(v, [{_QS}])) AS value FROM x", True), _listed("ecdf", "p", "value", f"SELECT unnest([{_PS}])::DOUBLE p, unnest(quantile_cont(v, [{_PS}])) AS value FROM x", True),
    _listed("rug", "value", "count", "SELECT value, count FROM (SELECT v AS value, count(*) AS count, row_number() OVER (ORDER BY v) i, count(*) OVER () d FROM x GROUP BY v) WHERE (i-1) % greatest(1, ceil(d/400.0)::BIGINT) = 0 OR i = d", True),
    _listed("bins", "bin", "count", HIST_SQL.format(x="v", t="x", k=20)),
])
query("profile_numeric", "customer", NUMERIC_PANEL)(lambda r: flat(r.df.sparkSession, P.profile_column(r, column="c_acctbal").values, {"quantiles": ("q", "value"), "ecdf": ("p", "value"), "rug": ("value", "count"), "bins": ("bin", "count")}))

_TOP = "SELECT v AS value, count(*) AS count FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"
CATEGORY_PANEL = "WITH x AS (SELECT trim(p_type) AS v FROM part) " + " UNION ALL ".join([
    _fields("completeness", "total present nulls empty", "SELECT count(*) total, count(v) present, count(*)-count(v) nulls, 0 AS empty FROM x"),
    _fields("cardinality", "distinct_ is_unique", "SELECT count(DISTINCT v) distinct_, (count(DISTINCT v)=count(v))::INT is_unique FROM x").replace("'distinct_'", "'distinct'"),
    _listed("top", "value", "count", _TOP), _fields("others", "others_count others_distinct rare_categories", f"SELECT (SELECT count(*) FROM x) - (SELECT sum(count) FROM ({_TOP})) AS others_count, (SELECT count(DISTINCT v) FROM x) - (SELECT count(*) FROM ({_TOP})) AS others_distinct, (SELECT count(*) FROM (SELECT v FROM x GROUP BY 1 HAVING count(*)<5)) AS rare_categories"),
    _listed("concentration", "rank", "share", "SELECT rank, cum/t AS share FROM (SELECT row_number() OVER (ORDER BY n DESC, v) rank, sum(n) OVER (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) cum, sum(n) OVER () t FROM (SELECT v, count(*) n FROM x GROUP BY 1))"),
])
query("profile_categorical", "part", CATEGORY_PANEL)(lambda r: flat(r.df.sparkSession, P.profile_column(r, column="p_type").values, {"top": ("value", "count"), "concentration": ("rank", "share")}))

_GRAMS = " UNION ALL ".join(_listed(b, "term", "count", f"SELECT term, count(*) AS count FROM (SELECT unnest(list_transform(generate_series(1, len(t)-{w - 1}), lambda i: {g})) AS term FROM (SELECT {TOKENS.replace('text', 'v')} t FROM x) WHERE len(t) >= {w}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k}") for b, w, g, k in (("cloud", 1, "t[i]", 60), ("top_words", 1, "t[i]", 12), ("top_pairs", 2, "t[i]||' '||t[i+1]", 12), ("top_triples", 3, "t[i]||' '||t[i+1]||' '||t[i+2]", 12)))
TEXT_PANEL = "WITH x AS (SELECT trim(text) AS v FROM documents WHERE trim(text) <> '') " + " UNION ALL ".join([
    _fields("cardinality", "distinct_ is_unique", "SELECT count(DISTINCT v) distinct_, (count(DISTINCT v)=count(v))::INT is_unique FROM x").replace("'distinct_'", "'distinct'"),
    _fields("text", "n length_min length_median length_mean length_max words_min words_median words_mean words_max share_digits share_non_ascii share_multiline", f"SELECT count(*) n, min(length(v)) length_min, median(length(v)) length_median, avg(length(v)) length_mean, max(length(v)) length_max, min(w) words_min, median(w) words_median, avg(w) words_mean, max(w) words_max, avg(regexp_matches(v,'[0-9]')::INT) share_digits, avg((octet_length(encode(v))<>length(v))::INT) share_non_ascii, avg(contains(v, chr(10))::INT) share_multiline FROM (SELECT v, len({TOKENS.replace('text', 'v')}) w FROM x)"),
    _fields("others", "others_count others_distinct rare_categories", f"SELECT (SELECT count(*) FROM x) - (SELECT sum(count) FROM ({_TOP})) AS others_count, (SELECT count(DISTINCT v) FROM x) - (SELECT count(*) FROM ({_TOP})) AS others_distinct, (SELECT count(*) FROM (SELECT v FROM x GROUP BY 1 HAVING count(*)<5)) AS rare_categories"),
    _fields("tokens", "tokens_total tokens_distinct", f"SELECT count(*) tokens_total, count(DISTINCT k) tokens_distinct FROM (SELECT unnest({TOKENS.replace('text', 'v')}) k FROM x)"),
    _listed("length_bins", "bin", "count", HIST_SQL.format(x="length(v)", t="x", k=20)), _GRAMS,
])
_TEXT_KEYS = {"cloud": ("term", "count"), "top_words": ("term", "count"), "top_pairs": ("term", "count"), "top_triples": ("term", "count"), "length_bins": ("bin", "count")}
_SEEN = ("n", "distinct", "is_unique", "tokens_total", "tokens_distinct", "share_digits", "share_non_ascii", "share_multiline")
query("profile_text", "documents", TEXT_PANEL)(lambda r: flat(r.df.sparkSession, {k: v for k, v in P.profile_column(r, column="text").values.items() if k != "completeness"}, _TEXT_KEYS).filter((F.col("block") != "text") | F.col("key").isin(*_SEEN) | F.col("key").rlike("^(length|words)_")))

_SPAN = "SELECT count(v) conforming, date_diff('day', min(v)::DATE, max(v)::DATE) span_days, count(DISTINCT v::DATE) days_seen, date_diff('day', min(v)::DATE, max(v)::DATE)+1 days_in_span FROM x"
_CAL = "SELECT d.key, coalesce(c.n,0) AS count FROM (SELECT strftime(unnest(generate_series(date_trunc('{g}',min(v)), max(v), INTERVAL 1 {g})),'{f}') AS key FROM x) d LEFT JOIN (SELECT strftime(v,'{f}') AS key, count(*) n FROM x GROUP BY 1) c USING (key)"
_CYC = "SELECT d.key, coalesce(c.n,0) AS count FROM (SELECT unnest(range({a},{b})) AS key) d LEFT JOIN (SELECT {f}(v) AS key, count(*) n FROM x GROUP BY 1) c USING (key)"
DATE_PANEL = "WITH x AS (SELECT ts AS v FROM events) " + " UNION ALL ".join([
    _fields("dates", "conforming span_days days_seen days_in_span", _SPAN), *[_listed(f"by_{g}", "key", "count", _CAL.format(g=g, f=f)) for g, f in (("year", "%Y"), ("month", "%Y-%m"), ("day", "%Y-%m-%d"))],
    *[_listed(f"by_{n}", "key", "count", _CYC.format(a=a, b=b, f=f)) for n, f, a, b in (("weekday", "isodow", 1, 8), ("month_of_year", "month", 1, 13), ("hour", "hour", 0, 24))],
])
query("profile_date", "events", DATE_PANEL)(lambda r: flat(r.df.sparkSession, {k: v for k, v in P.profile_column(r, column="ts").values.items() if k == "dates" or k.startswith("by_")}, {k: ("key", "count") for k in ("by_year", "by_month", "by_day", "by_weekday", "by_month_of_year", "by_hour")}))


def _cards(r: Relation) -> DataFrame:
    rows = []
    for c in P.describe_dataset(r).values["columns"]:
        rows += [(c["name"], "kind", c["kind"], None), (c["name"], "present", "", float(c["present"])), (c["name"], "distinct", "", float(c["distinct"]))]
        rows += [(c["name"], "bin", str(b["bin"]), float(b["count"])) for b in c.get("bins", [])] + [(c["name"], "top", t["value"], float(t["count"])) for t in c.get("top", [])]
    return r.df.sparkSession.createDataFrame(rows, "name string, part string, key string, value double")


def _cards_sql(t: str, columns: list[tuple[str, str, str]]) -> str:
    parts = []
    for c, kind, number in columns:
        parts += [f"SELECT '{c}' AS name, 'kind' AS part, '{kind}' AS key, NULL::DOUBLE AS value", f"SELECT '{c}', 'present', '', count({c}) FROM {t}", f"SELECT '{c}', 'distinct', '', count(DISTINCT {c}) FROM {t}"]
        if number:
            parts.append(f"SELECT '{c}', 'bin', bin::VARCHAR, count FROM ({HIST_SQL.format(x=number, t=t, k=10)})")
        else:
            parts.append(f"SELECT '{c}', 'top', value, count FROM (SELECT {c} AS value, count(*) AS count FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
    return " UNION ALL ".join(parts)


query("describe_dataset", "orders", _cards_sql("orders", [("o_orderkey", "numerical", "o_orderkey"), ("o_custkey", "numerical", "o_custkey"), ("o_orderstatus", "categorical", ""), ("o_totalprice", "numerical", "o_totalprice"), ("o_orderdate", "date", "(epoch_us(o_orderdate)/1e6)"), ("o_orderpriority", "categorical", "")]))(_cards)
_NUM = "CASE WHEN {x} = floor({x}) THEN format('{{:,.0f}}', {x}::DOUBLE) ELSE rtrim(rtrim(format('{{:,.4f}}', {x}::DOUBLE), '0'), '.') END"
query("narrative", "customer", "SELECT 'c_acctbal has ' || " + _NUM.format(x="n") + " || ' values in ' || " + _NUM.format(x="n") + " || ' rows. They lie between ' || " + _NUM.format(x="lo") + " || ' and ' || " + _NUM.format(x="hi") + " || ', with a mean of ' || " + _NUM.format(x="mean") + " || ' and a median of ' || " + _NUM.format(x="med") + " || '. ' || o || ' lie beyond the fences.' AS text FROM (SELECT count(c_acctbal) n, min(c_acctbal) lo, max(c_acctbal) hi, avg(c_acctbal) mean, median(c_acctbal) med, (SELECT count(*) FROM customer, (SELECT quantile_cont(c_acctbal,0.25) a, quantile_cont(c_acctbal,0.75) b FROM customer) WHERE c_acctbal < a-1.5*(b-a) OR c_acctbal > b+1.5*(b-a)) o FROM customer)")(lambda r: r.df.sparkSession.createDataFrame([(P.profile_column(r, column="c_acctbal").note,)], "text string"))

# ingest: files made here, and the cells that they hold


def scratch(spark: SparkSession) -> str:
    """A folder for files that a query makes: below spark.checkpoint.dir, in a local session without that a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise TabulensError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='tabulens-')}"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def put(spark: SparkSession, name: str, data: bytes) -> str:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{name}")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return at.toString()


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", "<workbook/>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>a b</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row><row/><row><c r="A3" t="s"><v>1</v></c><c r="B3"><v>2.5</v></c><c r="C3" s="1"><v>45352</v></c></row><row><c r="A4" t="b"><v>1</v></c><c r="B4"><v>3</v></c></row></sheetData></worksheet>')
    return out.getvalue()


#: Files by name, and the rows of cells that reading them must give.
FILES: dict[str, tuple[bytes, list[str], list[tuple]]] = {
    "ragged.csv": (b'name;amount\n"a;b";1\nshort\n"say ""hi""";\n', ["name", "amount"], [("a;b", "1"), ("short", None), ('say "hi"', None)]),
    "lines.csv": (b'a,b\n"x\ny",1\nz,2\n', ["a", "b"], [("x\ny", "1"), ("z", "2")]),
    "old.csv": ("ville,prix\nOrléans,3€\n".encode("cp1252"), ["ville", "prix"], [("Orléans", "3€")]),
    "mark.csv": (b"\xef\xbb\xbfk,v\n1,\xc3\xa9\n", ["k", "v"], [("1", "é")]),
    "bare.csv": (b"1,2\n3,4\n5,6\n", ["column_1", "column_2"], [("1", "2"), ("3", "4"), ("5", "6")]),
    "tabs.tsv": (b"a\tb\n 1 \t2\n", ["a", "b"], [(" 1 ", "2")]),
    "pipes.csv": (b"a|b|c\n1|2|3\n4|5|6\n", ["a", "b", "c"], [("1", "2", "3"), ("4", "5", "6")]),
    "records.json": (json.dumps([{"a": 1, "b": True}, {"c": 2.0, "a": None}, {"b": "x"}]).encode(), ["a", "b", "c"], [("1", "true", None), (None, None, "2"), (None, "x", None)]),
    "book.xlsx": (workbook(), ["name", "column_2", "when"], [("a b", "2.5", "2024-03-01"), ("true", "3", None)]),
}


def cells(spark: SparkSession, name: str) -> list[tuple]:
    d = ingest(spark, put(spark, name, FILES[name][0]), scratch(spark))
    rows = page(spark.read.parquet(d.path), 0, 100).collect()
    return [(name, i, c, r[c]) for i, r in enumerate(rows) for c in r.asDict()]


for _name, (_, _columns, _rows) in FILES.items():
    _cells = ", ".join(f"({_literal(_name)}, {i}, {_literal(c)}, {_literal(v)})" for i, r in enumerate(_rows) for c, v in zip(_columns, r, strict=True))
    query(f"ingest_{_name.replace('.', '_')}", "region", f"SELECT file, row::INTEGER AS row, name, value FROM (VALUES {_cells}) AS f(file, row, name, value)")(lambda r, n=_name: r.df.sparkSession.createDataFrame(cells(r.df.sparkSession, n), "file string, row int, name string, value string"))

SNIFFED = {
    "a.csv": (b"a,b\n1,2\n", ("csv", "utf-8", ",", True)), "b.tsv": (b"a\tb\n1\t2\n", ("tsv", "utf-8", "\t", True)), "c.csv": (b"1;2\n3;4\n", ("csv", "utf-8", ";", False)),
    "d.csv": ("né,b\n".encode("cp1252") + b"x,1\n", ("csv", "cp1252", ",", True)), "e.csv": (b"\x81a,b\nc,1\n", ("csv", "latin-1", ",", True)), "f.csv": ("a,b\nc,1\n".encode("utf-16"), ("csv", "utf-16", ",", True)),
    "g.csv": (b"\xef\xbb\xbfa|b\n1|2\n", ("csv", "utf-8-sig", "|", True)), "h.json": (b' [ {"a": 1}]', ("json", "utf-8", ",", True)), "i.parquet": (b"PAR1....PAR1", ("parquet", "utf-8", ",", True)), "j.bin": (workbook(), ("xlsx", None, None, None)),
}


def _sniffed(r: Relation) -> DataFrame:
    rows = []
    for name, (data, want) in SNIFFED.items():
        kind, d = sniff.sniff_format(data, name, data), sniff.detect(data, True)
        rows.append((name, kind, *((d.encoding, d.delimiter, d.header) if want[1] else (None, None, None))))
    return r.df.sparkSession.createDataFrame(rows, "name string, format string, encoding string, delimiter string, header boolean")


query("sniffing", "region", "SELECT name, format, encoding::VARCHAR AS encoding, delimiter::VARCHAR AS delimiter, header::BOOLEAN AS header FROM (VALUES " + ", ".join(f"({_literal(n)}, {_literal(k)}, {_literal(e)}, {_literal(d)}, {str(h).lower() if h is not None else 'NULL'})" for n, (_, (k, e, d, h)) in SNIFFED.items()) + ") AS f(name, format, encoding, delimiter, header)")(_sniffed)

REFUSED = {
    "cut.parquet": (lambda: sniff.sniff_format(b"PAR1xx", "a", b"xx"), "cut off"), "other.zip": (lambda: sniff.sniff_format(b"PK\x03\x04xx", "a.xlsx", b"xx"), "no workbook"), "empty": (lambda: sniff.check_size(0), "empty"),
    "large": (lambda: sniff.check_size(501 << 20), "larger"), "twice": (lambda: sniff.check_names(["a", "b", "a"]), "more than once"), "delimiter": (lambda: sniff.check_delimiter(["a;b"], [["1;2"]], ","), "delimiter"),
}


def _refused(r: Relation) -> DataFrame:
    rows = []
    for name, (call, why) in REFUSED.items():
        try:
            call()
            rows.append((name, "accepted"))
        except TabulensError as e:
            rows.append((name, why if why in str(e) else str(e)))
    return r.df.sparkSession.createDataFrame(rows, "name string, reason string")


query("refused_files", "region", "SELECT name, reason FROM (VALUES " + ", ".join(f"({_literal(n)}, {_literal(w)})" for n, (_, w) in REFUSED.items()) + ") AS f(name, reason)")(_refused)


@query("preview_of_a_file", "region", "SELECT * FROM (VALUES (0, 'a;b', '1', NULL), (1, 'short', NULL, NULL), (2, 'long', '2', '1 rows have more cells than there are columns')) AS f(row, name, amount, warning)")
def _(r):
    spark = r.df.sparkSession
    names, rows, warnings = preview(spark, put(spark, "p.csv", b'name;amount\n"a;b";1\nshort\nlong;2;3\n'))
    return spark.createDataFrame([(i, *x, warnings[0] if i == 2 and warnings else None) for i, x in enumerate(rows)], f"row int, {', '.join(f'{n} string' for n in names)}, warning string")


@query("dataset_life", "region", "SELECT 6::BIGINT AS rows, 5::BIGINT AS columns, true AS same_hash, true AS listed, true AS gone, 'numerical' AS seats, 'boolean' AS electric, 'date' AS first_used")
def _(r):
    """A bundled table: ingested twice to the same hash, catalogued, and deleted with its bytes."""
    spark, store = r.df.sparkSession, scratch(r.df.sparkSession)
    a, b = (ingest_sample(spark, "fleet.csv", store, "owner") for _ in range(2))
    catalog = Catalog(spark)
    catalog.add(a)
    listed = [d.id for d in catalog.of("owner")] == [a.id] and not catalog.of("other")
    catalog.delete(a.id, "owner")
    try:
        catalog.get(a.id, "owner")
        gone = False
    except TabulensError:
        gone = not _exists(spark, a.path) and _exists(spark, b.path)
    shuffled = content_hash(spark.read.parquet(b.path).drop("__rid").repartition(3))
    kinds = [str(b.contract[c].logical) for c in ("seats", "electric", "first_used")]
    return spark.createDataFrame([(b.row_count, b.column_count, a.content_hash == b.content_hash == shuffled, listed, gone, *kinds)], "rows bigint, columns bigint, same_hash boolean, listed boolean, gone boolean, seats string, electric string, first_used string")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


# recorded computations, and a planner that may only propose them


def _runner(r: Relation, store: Store | None = None) -> Runner:
    return Runner("orders", 1, r, store or Store())


@query("chain_replayed", "orders", "SELECT o_orderstatus, count(*) AS count, round(avg(o_totalprice*2),2) AS mean_double, true AS cached, 3::BIGINT AS computations FROM orders WHERE o_totalprice > 1000 GROUP BY 1")
def _(r):
    """A chain run twice and then from the dumped store: the same computations, recorded once each."""
    run = _runner(r)

    def steps(x: Runner) -> str:
        a = x.run("filter_rows", expression="[o_totalprice]  > 1000.0")
        b = x.run("derive_column", table=a.id, name="double", expression="[o_totalprice] * 2")
        return x.run("aggregate", table=b.id, group_by=["o_orderstatus"], measures=["count()", "mean(double)"]).id

    last = steps(run)
    again = _runner(r, Store.load(run.store.dump()))
    cached = steps(run) == last == steps(again)
    df = again.resolve(last).df
    return df.select("o_orderstatus", "count", F.round("mean_double", 2).alias("mean_double"), F.lit(cached).alias("cached"), F.lit(len(again.store.by_id)).cast("bigint").alias("computations"))


class Script:
    """A client that proposes what it was told to; a callable answers from the messages."""

    def __init__(self, *answers):
        self.answers = list(answers)

    def propose(self, messages, tools):
        a = self.answers.pop(0)
        return a(messages, tools) if callable(a) else a


@query("planner_turn", "orders", "WITH c AS (SELECT o_orderstatus s, count(*) n FROM orders GROUP BY 1), f AS (SELECT s, n FROM c WHERE n >= 5 ORDER BY s LIMIT 1) SELECT 'how many orders?' AS question, 'There are ' || n || ' orders of ' || s || '.' AS narrative, true AS grounded, 1::BIGINT AS kept, 'aggregate,derive_column' AS tools FROM f")
def _(r):
    """A scripted model: categories first, then a call, then a sentence whose figure is checked against the result."""
    told = []

    def answer(messages, tools):
        told.extend(sorted(t["name"] for t in tools if t["name"] in ("aggregate", "derive_column", "crosstab", "plot")))
        made = json.loads(messages[-1]["content"])
        return Proposal(text=f"There are {made['rows'][0]['count']} orders of {made['rows'][0]['o_orderstatus']} [{made['id']}].")

    run = _runner(r)
    turn = ask("how many orders?", run, Script(Proposal("choose", json.dumps({"categories": ["compute"]})), Proposal("aggregate", json.dumps({"group_by": ["o_orderstatus"], "measures": ["count()"]})), answer), route=True)
    kept = run.store.history("orders")
    return r.df.sparkSession.createDataFrame([(kept[0]["question"], kept[0]["narrative"], turn.grounded, len(kept), ",".join(told))], "question string, narrative string, grounded boolean, kept bigint, tools string")


@query("turn_history", "region", "SELECT * FROM (VALUES (0::BIGINT, 'q104'), (1::BIGINT, 'q103'), (2::BIGINT, 'q101')) AS f(place, question)")
def _(r):
    """Turns of one dataset, the newest first; a forgotten one is gone, after a reload too, and another dataset's are not seen."""
    store = Store()
    ids = {q: store.add_turn("a" if q < 105 else "b", f"q{q}", None, []) for q in range(110)}
    store.forget(ids[102], "a"), store.forget(ids[101], "b")
    kept = Store.load(store.dump()).history("a")
    if len(kept) != 100:
        raise TabulensError(f"{len(kept)} turns")
    return r.df.sparkSession.createDataFrame([(i, t["question"]) for i, t in enumerate(kept[:3])], "place bigint, question string")


@query("group_limit", "lineitem", "SELECT 'there are more than 10000 groups; group by fewer columns' AS refusal")
def _(r):
    made = r.df.sparkSession.range(10_001).toDF("i")
    try:
        T.aggregate(Relation.of(made, ["i"]), group_by=["i"], measures=["count()"])
        said = ""
    except TabulensError as e:
        said = str(e)
    return r.df.sparkSession.createDataFrame([(said,)], "refusal string")
