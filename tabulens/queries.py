"""Queries over the test tables, each with its SQL; both round doubles alike and spell every tie-break."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tabulens.operators.profile as P
import tabulens.operators.reports as R
import tabulens.operators.transforms as T
from tabulens.operators.stats import column_statistics
from tabulens.plans.privacy import suppressed
from tabulens.types import Logical, Relation, col

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"]}
CATEGORICAL = ("l_returnflag", "l_linestatus", "o_orderstatus", "o_orderpriority", "c_mktsegment", "event_type", "lang", "source", "p_brand", "p_type")


def table(spark: SparkSession, sf_dir: str, name: str) -> Relation:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Relation.of(df, KEYS.get(name), {c: Logical.CATEGORICAL for c in CATEGORICAL if c in df.columns})


def query(name: str, source: str, sql: str | None = None):
    def add(f: Callable[[Relation], DataFrame | Relation]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(table(spark, sf_dir, source))
            return out.df.select(*[col(n) for n in out.names]) if isinstance(out, Relation) else out

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(col(c), digits).alias(c) if t == "double" else col(c) for c, t in df.dtypes])


def rel(r: Relation, digits: int = 4) -> DataFrame:
    return rounded(r.df.select(*[col(n) for n in r.names]), digits)


def chain(r: Relation, *steps) -> Relation:
    for tool, args in steps:
        r = tool(r, **args).relation
    return r


@query("select_columns", "lineitem", "SELECT l_orderkey, l_returnflag, l_quantity FROM lineitem")
def _(r):
    return T.select_columns(r, columns=["l_quantity", "l_orderkey", "l_returnflag"]).relation


@query("filter_rows", "lineitem", "SELECT l_orderkey, l_quantity, l_discount FROM lineitem WHERE l_discount > 0.05 AND NOT (l_quantity < 10) AND l_returnflag <> 'N'")
def _(r):
    return chain(r, (T.filter_rows, {"expression": '[l_discount] > 0.05 and not ([l_quantity] < 10) and [l_returnflag] != "N"'}), (T.select_columns, {"columns": ["l_orderkey", "l_quantity", "l_discount"]}))


@query("filter_in_between_null", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F','O') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IS NOT NULL AND o_custkey NOT IN (1,2,3)")
def _(r):
    return chain(r, (T.filter_rows, {"expression": '[o_orderstatus] in ["F", "O"] and [o_totalprice] between 1000 and 200000 and [o_orderpriority] is not null and [o_custkey] not in [1, 2, 3]'}), (T.select_columns, {"columns": ["o_orderkey"]}))


def derived(source: str, key: list[str], **columns: str):
    def run(r: Relation) -> DataFrame:
        out = chain(r, *[(T.derive_column, {"name": n, "expression": e}) for n, e in columns.items()])
        return rel(chain(out, (T.select_columns, {"columns": [*key, *columns]})))

    return run


query("derive_arith", "lineitem", "SELECT l_orderkey, round(l_extendedprice*(1-l_discount),4) AS revenue, round(-l_quantity,4) AS neg, round(l_quantity/NULLIF(l_discount,0),4) AS ratio, round(l_quantity % NULLIF(7.0,0),4) AS rest FROM lineitem")(derived("lineitem", ["l_orderkey"], revenue="[l_extendedprice] * (1 - [l_discount])", neg="-[l_quantity]", ratio="[l_quantity] / [l_discount]", rest="[l_quantity] % 7"))
query("derive_if_coalesce", "events", "SELECT event_id, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS level, coalesce(event_type, 'none') AS kind FROM events")(derived("events", ["event_id"], level='if([value] > 50, "high", "low")', kind='coalesce([event_type], "none")'))
query("derive_text_fns", "customer", "SELECT c_custkey, lower(trim(c_name)) AS low, upper(trim(c_mktsegment)) AS up, length(trim(c_name))::DOUBLE AS len, contains(trim(c_mktsegment),'U') AS has_u, starts_with(trim(c_mktsegment),'A') AS starts_a FROM customer")(derived("customer", ["c_custkey"], low="lower([c_name])", up="upper(trim([c_mktsegment]))", len="length([c_name])", has_u='contains([c_mktsegment], "U")', starts_a='starts_with([c_mktsegment], "A")'))
query("derive_date_fns", "orders", "SELECT o_orderkey, year(o_orderdate)::DOUBLE AS y, month(o_orderdate)::DOUBLE AS m, day(o_orderdate)::DOUBLE AS d, isodow(o_orderdate)::DOUBLE AS w, date_diff('day', o_orderdate::DATE, DATE '2000-01-01')::DOUBLE AS until FROM orders")(derived("orders", ["o_orderkey"], y="year([o_orderdate])", m="month([o_orderdate])", d="day([o_orderdate])", w="weekday([o_orderdate])", until='date_diff([o_orderdate], date("2000-01-01"))'))
query("derive_math_fns", "customer", "SELECT c_custkey, round(abs(c_acctbal),4) AS a, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, round(sqrt(abs(c_acctbal)),4) AS s, round(ln(abs(c_acctbal)+1),4) AS l, round(c_acctbal,1) AS r FROM customer")(derived("customer", ["c_custkey"], a="abs([c_acctbal])", f="floor([c_acctbal])", c="ceil([c_acctbal])", s="sqrt(abs([c_acctbal]))", l="log(abs([c_acctbal]) + 1)", r="round([c_acctbal], 1)"))


@query("sort_limit_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(r):
    return chain(r, (T.sort_rows, {"by": ["o_totalprice"]}), (T.limit_rows, {"n": 25}), (T.select_columns, {"columns": ["o_orderkey", "o_totalprice"]}))


@query("limit_offset", "customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def _(r):
    return chain(r, (T.limit_rows, {"n": 50, "offset": 100}), (T.select_columns, {"columns": ["c_custkey", "c_name"]}))


@query("agg_group_all_measures", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS count, count(l_quantity) AS count_l_quantity, count(DISTINCT l_suppkey) AS distinct_count_l_suppkey, round(sum(l_quantity),2) AS sum_l_quantity, round(avg(l_discount),2) AS mean_l_discount, round(median(l_quantity),2) AS median_l_quantity, min(l_shipdate) AS min_l_shipdate, round(max(l_tax),2) AS max_l_tax FROM lineitem GROUP BY ALL")
def _(r):
    return rel(T.aggregate(r, group_by=["l_returnflag", "l_linestatus"], measures=["count()", "count(l_quantity)", "distinct_count(l_suppkey)", "sum(l_quantity)", "mean(l_discount)", "median(l_quantity)", "min(l_shipdate)", "max(l_tax)"]).relation, 2)


@query("agg_global", "customer", "SELECT round(avg(c_acctbal),4) AS mean_c_acctbal, count(*) AS n FROM customer")
def _(r):
    return rel(T.aggregate(r, measures=["mean(c_acctbal)"]).relation)


@query("agg_raw_vs_trimmed_groups", "customer", "SELECT x.seg AS seg, count(*) AS raw_n, min(t.n) AS trimmed_n FROM (SELECT CASE WHEN c_custkey%2=0 THEN c_mktsegment ELSE c_mktsegment||' ' END AS seg FROM customer) x JOIN (SELECT c_mktsegment s, count(*) n FROM customer GROUP BY 1) t ON trim(x.seg)=t.s GROUP BY 1")
def _(r):
    spaced = Relation.of(r.df.withColumn("seg", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" ")))), ["c_custkey"])
    raw = T.aggregate(spaced, group_by=["seg"], measures=["count()"]).relation.df.select("seg", F.col("count").alias("raw_n"))
    return raw.join(P.top_values(spaced, "seg", 50).select(F.col("value"), F.col("count").alias("trimmed_n")), F.trim("seg") == F.col("value")).select("seg", "raw_n", "trimmed_n")


CHAIN_SQL = "SELECT l_returnflag, round(avg(l_extendedprice*(1-l_discount)),2) AS mean_revenue, count(*) AS count FROM lineitem WHERE l_discount > 0.02 GROUP BY 1 ORDER BY 2 DESC"


@query("chain_filter_derive_agg_sort", "lineitem", CHAIN_SQL)
def flagship(r):
    return rel(chain(r, (T.filter_rows, {"expression": "[l_discount] > 0.02"}), (T.derive_column, {"name": "revenue", "expression": "[l_extendedprice] * (1 - [l_discount])"}), (T.aggregate, {"group_by": ["l_returnflag"], "measures": ["mean(revenue)", "count()"]}), (T.sort_rows, {"by": ["mean_revenue"]})), 2)


WIDTH_SQL = "WITH b AS (SELECT min({x}) lo, max({x}) hi FROM {t}), g AS (SELECT {c} v, CASE WHEN {c} IS NULL THEN NULL ELSE least(floor(({x}-lo)/((hi-lo)/{k})), {k}-1)::BIGINT END AS bin FROM {t}, b) SELECT bin, min(v) AS {n}_from, max(v) AS {n}_to, count(*) AS count FROM g WHERE {w} GROUP BY 1"
query("bin_equal_width", "lineitem", WIDTH_SQL.format(x="l_extendedprice", c="l_extendedprice", n="l_extendedprice", t="lineitem", k=12, w="v IS NOT NULL"))(lambda r: T.bin_column(r, column="l_extendedprice", n_bins=12).relation)
query("bin_dates", "orders", WIDTH_SQL.format(x="(epoch_us(o_orderdate)/1e6)", c="o_orderdate", n="o_orderdate", t="orders", k=10, w="v IS NOT NULL"))(lambda r: T.bin_column(r, column="o_orderdate").relation)
query("bin_include_nulls", "events", WIDTH_SQL.format(x="value", c="value", n="value", t="(SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)", k=8, w="true"))(lambda r: T.bin_column(Relation.of(r.df.withColumn("value", F.when(F.col("event_id") % 7 != 0, F.col("value"))), ["event_id"]), column="value", n_bins=8, include_nulls=True).relation)
query("bin_equal_count", "orders", "WITH g AS (SELECT o_totalprice v, ntile(8) OVER (ORDER BY o_totalprice) - 1 AS bin FROM orders) SELECT bin::BIGINT AS bin, min(v) AS o_totalprice_from, max(v) AS o_totalprice_to, count(*) AS count FROM g GROUP BY 1")(lambda r: T.bin_column(r, column="o_totalprice", strategy="equal_count", n_bins=8).relation)


def _stat_sql(t: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns):
        n = {k: "count(c)" if k == kind else "0" for k in ("numeric", "dates", "booleans")}
        text = kind == "text"
        if text:
            n["booleans"] = "count(*) FILTER (WHERE lower(trim(c::VARCHAR)) IN ('true','t','yes','y','false','f','no','n'))"
        p = "count(*) FILTER (WHERE c IS NOT NULL AND trim(c::VARCHAR) <> '')" if text else "count(c)"
        parts.append(f"SELECT {i} AS ordinal, '{c}' AS name, count(*) AS total, {p} AS present, count(DISTINCT c) AS distinct, {n['numeric']}::BIGINT AS numeric, {n['dates']}::BIGINT AS dates, 0::BIGINT AS moments, {n['booleans']}::BIGINT AS booleans FROM (SELECT {c} c FROM {t})")
    return " UNION ALL ".join(parts)


ORDERS = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "text"), ("o_totalprice", "numeric"), ("o_orderdate", "dates"), ("o_orderpriority", "text")]
query("column_statistics", "orders", _stat_sql("orders", ORDERS))(column_statistics)


def _describe_sql(t: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        num, date, text = (f"{c}" if kind == k else None for k in ("numeric", "dates", "text"))
        size = f"length(trim({c}))"
        parts.append(f"SELECT '{c}' AS name, {f'round(min({num})::DOUBLE,4)' if num else 'NULL::DOUBLE'} AS minimum, {f'round(median({num})::DOUBLE,4)' if num else 'NULL::DOUBLE'} AS median, {f'round(max({num})::DOUBLE,4)' if num else 'NULL::DOUBLE'} AS maximum, {f'min({date})' if date else 'NULL::TIMESTAMP'} AS earliest, {f'max({date})' if date else 'NULL::TIMESTAMP'} AS latest, {f'min({size})' if text else 'NULL::BIGINT'} AS length_min, {f'median({size})::DOUBLE' if text else 'NULL::DOUBLE'} AS length_median, {f'max({size})' if text else 'NULL::BIGINT'} AS length_max FROM {t}")
    return " UNION ALL ".join(parts)


query("describe_scalars", "orders", _describe_sql("orders", ORDERS))(lambda r: rounded(P.describe(r)).select("name", "minimum", "median", "maximum", "earliest", "latest", "length_min", "length_median", "length_max"))
query("completeness", "customer", "SELECT count(*) AS total, count(c_acctbal) AS present, count(*)-count(c_acctbal) AS nulls, 0::BIGINT AS empty, count(*) FILTER (WHERE c_acctbal=0) AS zeros, count(*) FILTER (WHERE c_acctbal<0) AS negatives FROM customer")(lambda r: P.completeness(r, "c_acctbal"))
query("cardinality", "documents", "SELECT count(DISTINCT trim(text)) AS distinct, count(DISTINCT trim(text)) = count(*) AS is_unique FROM documents WHERE trim(text) <> ''")(lambda r: P.cardinality(r, "text"))
query("numeric_moments", "customer", "WITH m AS (SELECT c_acctbal v, count(*) k FROM customer GROUP BY 1 ORDER BY k DESC, v LIMIT 1) SELECT count(c_acctbal) AS n, round(avg(c_acctbal),4) AS mean, round(median(c_acctbal),4) AS median, (SELECT round(v,4) FROM m) AS mode, round(stddev_samp(c_acctbal),4) AS std, round(var_samp(c_acctbal),2) AS variance, round(min(c_acctbal),4) AS minimum, round(max(c_acctbal),4) AS maximum, round(max(c_acctbal)-min(c_acctbal),4) AS value_range, round(skewness(c_acctbal),4) AS skewness, round(kurtosis(c_acctbal),4) AS kurtosis FROM customer")(lambda r: rounded(P.moments(r, "c_acctbal").withColumn("variance", F.round("variance", 2))))
_Q = ",".join(map(str, P.QUANTILES))
query("quantiles", "lineitem", f"SELECT unnest([{_Q}])::DOUBLE AS q, round(unnest(quantile_cont(l_extendedprice, [{_Q}])),4) AS value FROM lineitem")(lambda r: P.quantiles(r, "l_extendedprice").withColumn("value", F.round("value", 4)))
_P = ",".join(f"{i / 100}" for i in range(101))
query("ecdf_grid", "orders", f"SELECT unnest([{_P}])::DOUBLE AS p, round(unnest(quantile_cont(o_totalprice, [{_P}])),4) AS value FROM orders")(lambda r: P.ecdf(r, "o_totalprice").withColumn("value", F.round("value", 4)))
FENCE_SQL = "WITH q AS (SELECT quantile_cont({c},0.25) q1, quantile_cont({c},0.75) q3 FROM {t}), f AS (SELECT q1,q3,q1-1.5*(q3-q1) lo,q3+1.5*(q3-q1) hi FROM q) SELECT count({c}) AS n, count(*) FILTER (WHERE {c}<lo) AS below, count(*) FILTER (WHERE {c}>hi) AS above, count(*) FILTER (WHERE {c}<lo OR {c}>hi) AS outliers, round(any_value(q1),4) AS q1, round(any_value(q3),4) AS q3, round(any_value(lo),4) AS lower, round(any_value(hi),4) AS upper, round(min({c}) FILTER (WHERE {c} BETWEEN lo AND hi),4) AS whisker_low, round(max({c}) FILTER (WHERE {c} BETWEEN lo AND hi),4) AS whisker_high, round(min({c}),4) AS minimum, round(max({c}),4) AS maximum FROM {t}, f"
query("iqr_fence", "lineitem", FENCE_SQL.format(c="l_extendedprice", t="lineitem"))(lambda r: rounded(P.fence(r, "l_extendedprice")))
query("outlier_scan", "events", FENCE_SQL.format(c="value", t="events"))(lambda r: rounded(P.fence(r, "value")))
HIST_SQL = "WITH v AS (SELECT {x}::DOUBLE v FROM {t}), b AS (SELECT min(v) lo, max(v) hi, {k} n FROM v), c AS (SELECT least(floor((v-lo)/((hi-lo)/n)), n-1)::BIGINT bin, count(*) count FROM v, b GROUP BY 1) SELECT d.bin, round(lo+d.bin*((hi-lo)/n),4) AS lower, round(lo+(d.bin+1)*((hi-lo)/n),4) AS upper, coalesce(c.count,0)::BIGINT AS count FROM b, (SELECT unnest(range(1000))::BIGINT bin) d LEFT JOIN c ON c.bin=d.bin WHERE d.bin < n"
query("histogram", "lineitem", HIST_SQL.format(x="l_extendedprice", t="lineitem", k=20))(lambda r: rounded(P.numeric_histogram(r, "l_extendedprice")))
query("date_histogram", "orders", HIST_SQL.format(x="(epoch_us(o_orderdate)/1e6)", t="orders", k=10))(lambda r: rounded(P.date_histogram(r, "o_orderdate")))
query("length_histogram", "documents", HIST_SQL.format(x="length(trim(text))", t="documents", k=20))(lambda r: rounded(P.length_histogram(r, "text")))
RUG_SQL = "WITH c AS (SELECT l_quantity AS value, count(*) AS count FROM lineitem GROUP BY 1), n AS (SELECT value, count, row_number() OVER (ORDER BY value) i, count(*) OVER () d FROM c) SELECT value, count FROM n WHERE (i-1) % greatest(1, ceil(d/400.0)::BIGINT) = 0 OR i = d"
query("rug", "lineitem", RUG_SQL)(lambda r: P.rug(r, "l_quantity"))
query("top_values", "part", "SELECT trim(p_brand) AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda r: P.top_values(r, "p_brand"))
query("rare_categories", "part", "WITH c AS (SELECT trim(p_name) v, count(*) n FROM part GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, v LIMIT 10) SELECT (SELECT sum(n) FROM c)::BIGINT - (SELECT sum(n) FROM t)::BIGINT AS others_count, (SELECT count(*) FROM c)-(SELECT count(*) FROM t) AS others_distinct, (SELECT count(*) FROM c WHERE n<5) AS rare_categories")(lambda r: P.remainder(r, "p_name"))
SHARES_SQL = "WITH c AS ({c}), k AS (SELECT row_number() OVER (ORDER BY n DESC, v) rank, sum(n) OVER (ORDER BY n DESC, v ROWS UNBOUNDED PRECEDING) cum, count(*) OVER () d, sum(n) OVER () t FROM c) SELECT rank, round(cum/t,6) AS share FROM k WHERE rank<=50 OR rank % greatest(1, ceil(greatest(0,d-50)/70.0)::BIGINT) = 0 OR rank=d"
query("concentration", "part", SHARES_SQL.format(c="SELECT trim(p_type) v, count(*) n FROM part GROUP BY 1"))(lambda r: rounded(P.concentration(r, "p_type"), 6))
TOKENS = "list_filter(regexp_split_to_array(lower(trim(text)), '[^a-z0-9]+'), lambda x: length(x)>0)"
query("vocabulary", "documents", SHARES_SQL.format(c=f"SELECT unnest({TOKENS}) v, count(*) n FROM documents GROUP BY 1"))(lambda r: rounded(P.vocabulary(r, "text"), 6))
query("token_totals", "documents", f"SELECT count(*) AS tokens_total, count(DISTINCT v) AS tokens_distinct FROM (SELECT unnest({TOKENS}) v FROM documents)")(lambda r: P.token_totals(r, "text"))
for _w in (1, 2, 3):
    _gram = "||' '||".join(f"t[i+{k}]" if k else "t[i]" for k in range(_w))
    query(f"top_terms_{_w}", "documents", f"SELECT term, count(*) AS count FROM (SELECT unnest(list_transform(generate_series(1, len(t)-{_w - 1}), lambda i: {_gram})) AS term FROM (SELECT {TOKENS} t FROM documents) WHERE len(t) >= {_w}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12")(lambda r, w=_w: P.top_terms(r, "text", w))
query("extremes", "orders", "(SELECT 'smallest' AS side, o_totalprice AS value FROM orders ORDER BY 2 LIMIT 5) UNION ALL (SELECT 'largest', o_totalprice FROM orders ORDER BY 2 DESC LIMIT 5)")(lambda r: P.extremes(r, "o_totalprice"))
query("distinct_samples", "part", "SELECT DISTINCT trim(p_type) AS value FROM part ORDER BY 1 LIMIT 10")(lambda r: P.samples(r, "p_type"))


@query("presence_strip", "events", "WITH n AS (SELECT row_number() OVER (ORDER BY event_id)-1 i, nullif(event_type,'click') x FROM events), s AS (SELECT greatest(1,ceil(count(*)/240.0)::BIGINT) w FROM n) SELECT floor(i/w)::BIGINT AS slot, count(*) AS rows, count(x) AS present FROM n, s GROUP BY 1")
def _(r):
    numbered = T.ranks(r.df.withColumn("event_type", F.nullif("event_type", F.lit("click"))), F.col("event_id")).withColumn("i", F.col("rank_") - 1)
    return P.presence_strip(Relation.of(numbered, ["event_id"]), "event_type", row="i")


_N, _W = "length(x)", f"len({TOKENS.replace('trim(text)', 'x')})"
query("text_composition", "documents", "SELECT count(*) AS n, " + ", ".join(f"round({f}({e})::DOUBLE,4) AS {p}_{q}" for p, e in (("length", _N), ("words", _W)) for f, q in (("min", "min"), ("median", "median"), ("avg", "mean"), ("max", "max"))) + ", round(avg(regexp_matches(x,'[0-9]')::INT),4) AS share_digits, round(avg(regexp_matches(x,'[!-/:-@\\[-`{-~]')::INT),4) AS share_punctuation, round(avg(regexp_matches(x,'https?://|www\\.')::INT),4) AS share_url, round(avg((upper(x)=x AND regexp_matches(x,'[A-Za-z]'))::INT),4) AS share_upper, round(avg((strlen(x)<>length(x))::INT),4) AS share_non_ascii, round(avg(contains(x, chr(10))::INT),4) AS share_multiline, round(avg((" + _W + ">1)::INT),4) AS share_multiword, round(avg(regexp_full_match(x,'[0-9]+')::INT),4) AS share_numeric FROM (SELECT trim(text) x FROM documents WHERE trim(text) <> '')")(lambda r: rounded(P.text_composition(r, "text")))
query("date_summary", "orders", "SELECT count(o_orderdate) AS conforming, min(o_orderdate) AS earliest, max(o_orderdate) AS latest, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS span_days, CASE WHEN count(*) FILTER (WHERE o_orderdate<>date_trunc('day',o_orderdate))>0 THEN 'hourly' WHEN count(DISTINCT o_orderdate::DATE)<=count(DISTINCT strftime(o_orderdate,'%Y-%m')) THEN 'monthly' ELSE 'daily' END AS granularity, count(DISTINCT o_orderdate::DATE) AS days_seen, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)+1 AS days_in_span FROM orders")(lambda r: P.date_summary(r, "o_orderdate"))
for _g, _f, _t, _c in (("year", "%Y", "orders", "o_orderdate"), ("month", "%Y-%m", "orders", "o_orderdate"), ("day", "%Y-%m-%d", "events", "ts")):
    query(f"calendar_{_g}", _t, f"WITH d AS (SELECT strftime(unnest(generate_series(date_trunc('{_g}',min({_c})), max({_c}), INTERVAL 1 {_g})),'{_f}') AS key FROM {_t}), c AS (SELECT strftime({_c},'{_f}') AS key, count(*) n FROM {_t} GROUP BY 1) SELECT d.key, coalesce(c.n,0)::BIGINT AS count FROM d LEFT JOIN c USING(key)")(lambda r, g=_g, c=_c: P.calendar(r, c, g))
for _g, _f, _d in (("weekday", "isodow", "1,8"), ("month", "month", "1,13"), ("hour", "hour", "0,24")):
    query(f"cycle_{_g}", "events", f"WITH d AS (SELECT unnest(range({_d}))::BIGINT AS key), c AS (SELECT {_f}(ts)::BIGINT AS key, count(*) n FROM events GROUP BY 1) SELECT d.key, coalesce(c.n,0)::BIGINT AS count FROM d LEFT JOIN c USING(key)")(lambda r, g=_g: P.cycle(r, "ts", g))
query("boolean_counts", "labels", "SELECT count(*) FILTER (WHERE toxic=1) AS true_count, count(*) FILTER (WHERE toxic=0) AS false_count, 0::BIGINT AS other_count FROM labels")(lambda r: P.boolean_counts(Relation.of(r.df.withColumn("toxic", F.col("toxic") == 1), ["doc_id"]), "toxic"))

HOLES = ("value", "event_type", "props")
HOLES_SQL = "(SELECT CASE WHEN event_id%5<>0 THEN value END AS value, nullif(event_type,'click') AS event_type, CASE WHEN event_id%3<>0 THEN props ELSE ' ' END AS props FROM events)"


def holes(r: Relation) -> Relation:
    """The events with values made missing, in the way of HOLES_SQL."""
    key = F.col("event_id")
    made = (F.when(key % 5 != 0, F.col("value")), F.nullif("event_type", F.lit("click")), F.when(key % 3 != 0, F.col("props")).otherwise(F.lit(" ")))
    return Relation.of(r.df.select("event_id", *[c.alias(n) for n, c in zip(HOLES, made, strict=True)]), ["event_id"])


_MISS = {"value": "value IS NULL", "event_type": "(event_type IS NULL OR trim(event_type)='')", "props": "(props IS NULL OR trim(props)='')"}
query("missingness", "events", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) FILTER (WHERE {m}) AS missing, count(*) AS total FROM {HOLES_SQL}" for n, m in _MISS.items()))(lambda r: R.missing_counts(holes(r)).filter("name <> 'event_id'"))
query("co_missing", "events", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {_MISS[a]} AND {_MISS[b]}) AS together FROM {HOLES_SQL}" for a, b in (("value", "event_type"), ("value", "props"), ("event_type", "props"))))(lambda r: R.missing_together(holes(r), list(HOLES)))
query("duplicates", "documents", "SELECT count(*) AS groups, coalesce(sum(n),0)::BIGINT AS affected, (coalesce(sum(n),0)-count(*))::BIGINT AS redundant FROM (SELECT count(*) n FROM documents GROUP BY text HAVING count(*)>1)")(lambda r: R.duplicate_counts(r, ["text"]))
query("duplicate_examples", "lineitem", "SELECT l_orderkey::VARCHAR||' | '||l_linenumber::VARCHAR AS example, count(*) AS copies FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1 ORDER BY 2 DESC, 1 LIMIT 10")(lambda r: R.duplicate_examples(r, ["l_orderkey", "l_linenumber"]))
query("crosstab_counts", "orders", "SELECT a.v AS row, b.v AS column, count(o.o_orderkey) AS count FROM (SELECT DISTINCT o_orderstatus v FROM orders) a CROSS JOIN (SELECT DISTINCT o_orderpriority v FROM orders) b LEFT JOIN orders o ON o.o_orderstatus=a.v AND o.o_orderpriority=b.v GROUP BY 1,2")(lambda r: R.crosstab_counts(r, "o_orderstatus", "o_orderpriority"))
query("crosstab_row_share", "lineitem", "WITH c AS (SELECT a.v AS row, b.v AS column, count(l.l_orderkey) AS count FROM (SELECT DISTINCT l_returnflag v FROM lineitem) a CROSS JOIN (SELECT DISTINCT l_linestatus v FROM lineitem) b LEFT JOIN lineitem l ON l.l_returnflag=a.v AND l.l_linestatus=b.v GROUP BY 1,2) SELECT row, \"column\", count, round(count/sum(count) OVER (PARTITION BY row),4) AS row_share, round(count/sum(count) OVER (PARTITION BY \"column\"),4) AS column_share, round(count/sum(count) OVER (),4) AS total_share FROM c")(lambda r: R.crosstab_shares(r, "l_returnflag", "l_linestatus"))
query("crosstab_top_levels", "part", "WITH a AS (SELECT p_brand v FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), b AS (SELECT p_type v FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) SELECT a.v AS row, b.v AS column, count(p.p_partkey) AS count FROM a CROSS JOIN b LEFT JOIN part p ON p.p_brand=a.v AND p.p_type=b.v GROUP BY 1,2")(lambda r: R.crosstab_counts(r, "p_brand", "p_type", 5))
query("k_anonymity_suppression", "customer", "SELECT c_nationkey::VARCHAR||'/'||c_mktsegment AS \"group\", count(*) AS n FROM customer GROUP BY ALL HAVING count(*) >= 5 ORDER BY 1 LIMIT 20")(lambda r: suppressed(r.df.groupBy(F.concat_ws("/", F.col("c_nationkey").cast("string"), "c_mktsegment").alias("group")).agg(F.count(F.lit(1)).alias("n")), "n", ["group"]))
query("grid_page", "orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 300")(lambda r: r.rows(100, 300).select("o_orderkey", "o_custkey", "o_totalprice"))


def flagship_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(table(spark, sf_dir, "lineitem"))
