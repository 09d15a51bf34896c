"""Profiles: measures of one column, each a small table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulens.functions.shape import present, read
from tabulens.operators.quantiles import at_ranks, quantile_values, ranked_curve
from tabulens.operators.registry import Parameter, tool
from tabulens.operators.stats import column_statistics
from tabulens.types import ROW_ID, ColumnSpec, Logical, Relation, Result, TabulensError, col

QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
FENCE, RARE, SLOTS, RUG, TERMS, CLOUD, DAYS = 1.5, 5, 240, 400, 12, 60, 1200


def values(r: Relation, name: str) -> DataFrame:
    """The present values of a column as ``v``."""
    return r.df.select(read(r[name]).alias("v")).filter(F.col("v").isNotNull())


def texts(r: Relation, name: str) -> DataFrame:
    """The present values as trimmed text."""
    return r.df.filter(present(r[name])).select(F.trim(col(name).cast("string")).alias("v"))


def completeness(r: Relation, name: str) -> DataFrame:
    spec = r[name]
    x = read(spec)
    zero, less = (F.count_if(x == 0), F.count_if(x < 0)) if spec.logical == Logical.NUMERICAL else (F.lit(None).cast("bigint"),) * 2
    c = col(name)
    return r.df.agg(F.count(F.lit(1)).alias("total"), F.count_if(present(spec)).alias("present"), F.count_if(c.isNull()).alias("nulls"), F.count_if(c.isNotNull() & ~present(spec)).alias("empty"), zero.alias("zeros"), less.alias("negatives"))


def cardinality(r: Relation, name: str) -> DataFrame:
    made = texts(r, name).agg(F.count("v").alias("n"), F.count_distinct("v").alias("distinct"))
    return made.select("distinct", ((F.col("distinct") == F.col("n")) & (F.col("n") > 0)).alias("is_unique"))


def moments(r: Relation, name: str) -> DataFrame:
    """Mean, median, mode (the most frequent, then the smallest), deviation, variance, and bias-corrected skewness and excess kurtosis."""
    v = values(r, name)
    x, n = F.col("v"), F.col("n").cast("double")
    median = quantile_values(v, [0.5])[1][0]
    made = v.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_samp(x).alias("std"), F.var_samp(x).alias("variance"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    mode = v.groupBy("v").agg(F.count(F.lit(1)).alias("k")).agg(F.max_by("v", F.struct(F.col("k"), -F.col("v"))).alias("mode"))
    varied = F.col("variance") > 0
    skew = F.when((n > 2) & varied, F.col("g1") * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))
    kurt = F.when((n > 3) & varied, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * F.col("g2") + 6))
    # both sides have one row
    return made.crossJoin(F.broadcast(mode)).select("n", "mean", "median", "mode", "std", "variance", "minimum", "maximum", (F.col("maximum") - F.col("minimum")).alias("value_range"), skew.alias("skewness"), kurt.alias("kurtosis"))


def quantiles(r: Relation, name: str, at: tuple[float, ...] = QUANTILES) -> DataFrame:
    """(q, value): exact quantiles; none of a column without numbers."""
    n, found = quantile_values(values(r, name), at)
    return r.df.sparkSession.createDataFrame(list(zip(at, found, strict=True)) if n else [], "q double, value double")


def ecdf(r: Relation, name: str) -> DataFrame:
    return quantiles(r, name, tuple(i / 100 for i in range(101))).toDF("p", "value")


def ecdf_at(r: Relation, name: str, points: list[float]) -> DataFrame:
    """(x, share): for each point the share of values that are not above it, in one pass."""
    x = F.col("v")
    made = values(r, name).agg(F.count(x).alias("n"), *[F.count_if(x <= p).alias(f"c{i}") for i, p in enumerate(points)])
    cells = F.array(*[F.struct(F.lit(float(p)).alias("x"), (F.col(f"c{i}") / F.nullif(F.col("n"), F.lit(0))).alias("share")) for i, p in enumerate(points)])
    return made.select(F.explode(cells).alias("e")).select("e.*")


def fence(r: Relation, name: str, k: float = FENCE, lower: float | None = None, upper: float | None = None) -> DataFrame:
    """Quartiles, fences, counts beyond them, and whiskers: the extreme values inside."""
    v = values(r, name)
    q1, q3 = quantile_values(v, [0.25, 0.75])[1]
    if q1 is None:
        raise TabulensError(f"{name} has no numbers")
    low = q1 - k * (q3 - q1) if lower is None else lower
    high = q3 + k * (q3 - q1) if upper is None else upper
    x, inside = F.col("v"), F.col("v").between(low, high)
    made = v.agg(F.count(x).alias("n"), F.count_if(x < low).alias("below"), F.count_if(x > high).alias("above"), F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    return made.select("n", "below", "above", (F.col("below") + F.col("above")).alias("outliers"), *[F.lit(float(a)).alias(b) for a, b in ((q1, "q1"), (q3, "q3"), (low, "lower"), (high, "upper"))], "whisker_low", "whisker_high", "minimum", "maximum")


def filled(df: DataFrame, key: str, domain: DataFrame, value: str = "count") -> DataFrame:
    """Counts for every key of a bounded domain, 0 where there is none."""
    return domain.join(df, key, "left").withColumn(value, F.coalesce(value, F.lit(0)).cast("bigint"))


def histogram(df: DataFrame, n_bins: int, integer: bool = False) -> DataFrame:
    """(bin, lower, upper, count) of column ``v`` of doubles in bins of equal width; empty bins are there."""
    b = df.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if b["lo"] is None:
        raise TabulensError("there are no values")
    lo, hi = float(b["lo"]), float(b["hi"])
    n = min(n_bins, int(hi - lo) + 1) if integer else n_bins
    n, width = (1, 1.0) if lo == hi else (n, (hi - lo) / n)
    counts = df.groupBy(F.least(F.floor((F.col("v") - lo) / width), F.lit(n - 1)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = filled(counts, "bin", df.sparkSession.range(n).toDF("bin"))
    return out.select("bin", (F.lit(lo) + F.col("bin") * width).alias("lower"), (F.lit(lo) + (F.col("bin") + 1) * width).alias("upper"), "count")


def numeric_histogram(r: Relation, name: str, n_bins: int = 20) -> DataFrame:
    return histogram(values(r, name).select(F.col("v").cast("double").alias("v")), n_bins)


def date_histogram(r: Relation, name: str, n_bins: int = 10) -> DataFrame:
    return histogram(values(r, name).select((F.unix_micros(F.col("v").cast("timestamp")) / 1e6).alias("v")), n_bins)


def length_histogram(r: Relation, name: str, n_bins: int = 20) -> DataFrame:
    return histogram(texts(r, name).select(F.length("v").cast("double").alias("v")), n_bins, True)


def top_values(r: Relation, name: str, k: int = 10) -> DataFrame:
    return texts(r, name).groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(k)


def remainder(r: Relation, name: str, k: int = 10) -> DataFrame:
    """What the k most frequent values leave: how many rows, of how many values; and rare values."""
    counted = texts(r, name).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    top = counted.orderBy(F.desc("n"), "v").limit(k).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("d"))
    every = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("distinct"), F.count_if(F.col("n") < RARE).alias("rare_categories"))
    return every.crossJoin(F.broadcast(top)).select((F.col("all") - F.col("t")).alias("others_count"), (F.col("distinct") - F.col("d")).alias("others_distinct"), "rare_categories")


def thinned(last: int, most: int = 120, head: int = 50) -> list[int]:
    """The first ranks, then every so many, and the last."""
    step = max(1, math.ceil(max(0, last - head) / (most - head)))
    return sorted({*range(1, min(head, last) + 1), *range(step, last + 1, step), *([last] if last else [])})


def concentration(r: Relation, name: str) -> DataFrame:
    return _shares(texts(r, name).groupBy("v").agg(F.count(F.lit(1)).alias("n")))


def _shares(counted: DataFrame) -> DataFrame:
    """(rank, share): how much of all rows the most frequent values have, up to some ranks."""
    total, curve = ranked_curve(counted, thinned)
    return counted.sparkSession.createDataFrame([(k, n / total) for k, n in curve], "rank bigint, share double")


def rug(r: Relation, name: str, most: int = RUG) -> DataFrame:
    """Distinct numbers with counts, at most about ``most`` of them by a fixed stride, the last one always."""
    counted = values(r, name).groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    b = counted.agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    stride = max(1, math.ceil(b["n"] / most))
    if stride == 1:
        return counted
    kept = at_ranks(counted, [*range(0, b["n"], stride), b["n"] - 1], (b["lo"], b["hi"]), "value")
    # about ``most`` values, whose rows are counted again
    return counted.filter(F.col("value").isin(sorted(set(kept.values()))))


def extremes(r: Relation, name: str, k: int = 5) -> DataFrame:
    v = values(r, name)
    low = v.orderBy("v").limit(k).select(F.lit("smallest").alias("side"), F.col("v").alias("value"))
    return low.union(v.orderBy(F.desc("v")).limit(k).select(F.lit("largest"), F.col("v")))


def samples(r: Relation, name: str, k: int = 10) -> DataFrame:
    return texts(r, name).distinct().orderBy("v").limit(k).select(F.col("v").alias("value"))


def presence_strip(r: Relation, name: str, slots: int = SLOTS, row: str = ROW_ID) -> DataFrame:
    """(slot, rows, present) along the file; ``row`` numbers rows densely from 0."""
    total = r.df.count()
    size = max(1, math.ceil(total / slots))
    slot = F.floor(col(row) / size).cast("bigint").alias("slot")
    return r.df.groupBy(slot).agg(F.count(F.lit(1)).alias("rows"), F.count_if(present(r[name])).alias("present"))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in small letters."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), 0)


def terms(r: Relation, name: str, width: int = 1) -> DataFrame:
    """(v, n): word n-grams of a text column."""
    t = texts(r, name).select(tokens(F.col("v")).alias("t")).filter(F.size("t") >= width)
    grams, n = F.col("t"), F.size("t")
    for i in range(1, width):
        # each gram that has a word after it, and that word
        grams = F.zip_with(F.slice(grams, F.lit(1), n - i), F.slice(F.col("t"), F.lit(i + 1), n - i), lambda a, b: F.concat(a, F.lit(" "), b))
    # outer, as a filter that Spark infers for the plain one would make all grams twice
    return t.select(F.explode_outer(grams).alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))


def top_terms(r: Relation, name: str, width: int = 1, k: int = TERMS) -> DataFrame:
    return terms(r, name, width).orderBy(F.desc("n"), "v").limit(k).select(F.col("v").alias("term"), F.col("n").alias("count"))


def token_totals(r: Relation, name: str) -> DataFrame:
    return terms(r, name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens_total"), F.count(F.lit(1)).alias("tokens_distinct"))


def vocabulary(r: Relation, name: str) -> DataFrame:
    return _shares(terms(r, name))


def text_composition(r: Relation, name: str) -> DataFrame:
    """Lengths, words, and the shares of texts with digits, punctuation, links, line feeds, and so on."""
    v = F.col("v")
    n, w = F.col("n_"), F.col("w_")
    tests = {"share_digits": v.rlike("[0-9]"), "share_punctuation": v.rlike(r"[!-/:-@\[-`{-~]"), "share_url": v.rlike(r"https?://|www\."), "share_upper": (F.upper(v) == v) & v.rlike("[A-Za-z]"), "share_non_ascii": F.octet_length(v) != n, "share_multiline": v.contains("\n"), "share_multiword": w > 1, "share_numeric": v.rlike(r"^[0-9]+\z")}
    numbers = [f(x).cast("double").alias(f"{p}_{q}") for p, x in (("length", n), ("words", w)) for f, q in ((F.min, "min"), (F.median, "median"), (F.avg, "mean"), (F.max, "max"))]
    # lengths and words are found once for each text
    rows = texts(r, name).select("v", F.length("v").alias("n_"), F.size(tokens(v)).alias("w_"))
    return rows.agg(F.count(v).alias("n"), *numbers, *[F.avg(F.when(t, 1.0).otherwise(0.0)).alias(k) for k, t in tests.items()])


def date_summary(r: Relation, name: str) -> DataFrame:
    """First and last moment, span, granularity (hourly, daily, monthly), and the days that occur."""
    v = F.col("v")
    day = F.to_date(v)
    made = values(r, name).agg(F.count(v).alias("conforming"), F.min(v).alias("earliest"), F.max(v).alias("latest"), F.count_if(v != F.date_trunc("day", v).cast("timestamp_ntz")).alias("timed"), F.count_distinct(day).alias("days_seen"), F.count_distinct(F.date_format(v, "yyyy-MM")).alias("months"))
    span = F.datediff("latest", "earliest")
    kind = F.when(F.col("timed") > 0, "hourly").when(F.col("days_seen") <= F.col("months"), "monthly").otherwise("daily")
    return made.select("conforming", "earliest", "latest", span.cast("bigint").alias("span_days"), kind.alias("granularity"), "days_seen", (span + 1).cast("bigint").alias("days_in_span"))


def calendar(r: Relation, name: str, grain: str) -> DataFrame:
    """(key, count) for each year, month or day between the first and the last, empty ones included."""
    form, unit = {"year": ("yyyy", "year"), "month": ("yyyy-MM", "month"), "day": ("yyyy-MM-dd", "day")}[grain]
    v = values(r, name)
    counts = v.groupBy(F.date_format("v", form).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    b = v.agg(F.to_date(F.min("v")).alias("lo"), F.to_date(F.max("v")).alias("hi"))
    span = b.first()
    if grain == "day" and span["lo"] is not None and (span["hi"] - span["lo"]).days > DAYS:
        raise TabulensError(f"days are counted over {DAYS} days at most")
    step = F.expr(f"interval 1 {unit}")
    domain = b.filter("lo is not null").select(F.explode(F.sequence(F.trunc("lo", unit) if unit != "day" else F.col("lo"), F.col("hi"), step)).alias("d")).select(F.date_format("d", form).alias("key"))
    return filled(counts, "key", domain)


def cycle(r: Relation, name: str, part: str) -> DataFrame:
    """(key, count) over weekdays (1 to 7, from Monday), months (1 to 12) or hours (0 to 23), all of them."""
    v = F.col("v")
    key, domain = {"weekday": (F.weekday(v) + 1, range(1, 8)), "month": (F.month(v), range(1, 13)), "hour": (F.hour(v), range(24))}[part]
    counts = values(r, name).groupBy(key.cast("bigint").alias("key")).agg(F.count(F.lit(1)).alias("count"))
    return filled(counts, "key", r.df.sparkSession.range(domain.start, domain.stop).toDF("key"))


def heat_grid(r: Relation, name: str) -> DataFrame:
    """(key, week, row, count, level): days in columns of weeks, Monday first; levels 1 to 4 by quarters of the largest count, 0 for none."""
    days = calendar(r, name, "day").withColumn("d", F.to_date("key"))
    b = days.agg(F.min("d").alias("first"), F.greatest(F.max("count"), F.lit(1)).alias("top")).first()
    if b["first"] is None:
        return days.select("key", F.lit(0).cast("bigint").alias("week"), F.lit(0).alias("row"), "count", F.lit(0).cast("bigint").alias("level"))
    place = F.datediff("d", F.lit(b["first"])) + b["first"].weekday()
    level = F.least(F.ceil(F.col("count") / F.lit(b["top"]) * 4), F.lit(4))
    return days.select("key", F.floor(place / 7).alias("week"), (place % 7).alias("row"), "count", level.alias("level"))


def boolean_counts(r: Relation, name: str) -> DataFrame:
    x = read(r[name])
    return r.df.agg(F.count_if(x).alias("true_count"), F.count_if(~x).alias("false_count"), F.count_if(present(r[name]) & x.isNull()).alias("other_count"))


def describe(r: Relation) -> DataFrame:
    """A row of scalars for each column: counts, numbers' and dates' bounds, text lengths."""
    stats = column_statistics(r)
    rows = []
    for c in r.columns:
        if c.logical == Logical.UNSUPPORTED:
            continue
        x = read(c)
        number = x if c.logical == Logical.NUMERICAL else F.lit(None).cast("double")
        moment = x if c.logical == Logical.DATE else F.lit(None).cast("timestamp_ntz")
        size = F.length(F.when(present(c), F.trim(col(c.name)))) if c.is_text else F.lit(None).cast("int")
        rows.append((c, [("minimum", F.min(number)), ("median", F.median(number)), ("maximum", F.max(number)), ("earliest", F.min(moment)), ("latest", F.max(moment)), ("length_min", F.min(size).cast("bigint")), ("length_median", F.median(size)), ("length_max", F.max(size).cast("bigint"))]))
    wide = r.df.agg(*[a.alias(f"c{c.ordinal}_{n}") for c, aggs in rows for n, a in aggs])
    cells = F.array(*[F.struct(F.lit(c.name).alias("name"), F.lit(str(c.logical)).alias("logical"), *[F.col(f"c{c.ordinal}_{n}").alias(n) for n, _ in aggs]) for c, aggs in rows])
    return stats.join(wide.select(F.explode(cells).alias("e")).select("e.*"), "name")


def kind_of(spec: ColumnSpec, n: int, distinct: int) -> str:
    return "empty" if not n else "unsupported" if spec.logical == Logical.UNSUPPORTED else "constant" if distinct == 1 else str(spec.logical)


@tool("describe_dataset", 4, "profiling", "column_cards", Parameter("top_n", "integer", 2, 3, 1, 20), Parameter("n_bins", "integer", 2, 10, 2, 50), Parameter("samples", "integer", 2, 3, 1, 10))
def describe_dataset(r: Relation, top_n: int, n_bins: int, samples: int) -> Result:
    """A card for each column: scalars, a histogram or the top values, and samples."""
    cards = []
    found = {x["name"]: x.asDict() for x in describe(r).collect()}
    for c in r.columns:
        card = found.get(c.name, {"name": c.name, "present": r.df.count(), "distinct": 0})
        card["kind"] = kind_of(c, card["present"], card["distinct"])
        if card["kind"] == Logical.NUMERICAL:
            card["bins"] = [x.asDict() for x in numeric_histogram(r, c.name, n_bins).orderBy("bin").collect()]
        elif card["kind"] == Logical.DATE:
            card["bins"] = [x.asDict() for x in date_histogram(r, c.name, n_bins).orderBy("bin").collect()]
        elif card["kind"] in (Logical.CATEGORICAL, Logical.BOOLEAN, Logical.TEXT):
            card["top"] = [x.asDict() for x in top_values(r, c.name, top_n).collect()]
            card |= remainder(r, c.name, top_n).first().asDict()
        if card["kind"] not in ("empty", "unsupported"):
            card["samples"] = [x["value"] for x in globals()["samples"](r, c.name, samples).collect()]
        cards.append(card)
    return Result("column_cards", values={"columns": cards})


def number(x: float | None) -> str:
    """A figure for a sentence: whole numbers without a point, others with up to four digits after it."""
    if x is None:
        return "unknown"
    return f"{x:,.0f}" if x == int(x) else f"{x:,.4f}".rstrip("0")


def narrative(name: str, logical: Logical, blocks: dict) -> str:
    c = blocks["completeness"]
    out = [f"{name} has {number(c['present'])} values in {number(c['total'])} rows."]
    if c["present"] < c["total"]:
        out.append(f"{number(100 * (1 - c['present'] / c['total']))}% are missing.")
    if logical == Logical.NUMERICAL and "moments" in blocks and blocks["moments"]["n"]:
        m = blocks["moments"]
        out.append(f"They lie between {number(m['minimum'])} and {number(m['maximum'])}, with a mean of {number(m['mean'])} and a median of {number(m['median'])}.")
        out.append(f"{number(blocks['fence']['outliers'])} lie beyond the fences.")
    elif logical == Logical.DATE and blocks["dates"]["conforming"]:
        out.append(f"They run over {number(blocks['dates']['span_days'])} days.")
    elif "top" in blocks and blocks["top"]:
        out.append(f"The most frequent is {blocks['top'][0]['value']!r}, {number(blocks['top'][0]['count'])} times.")
    return " ".join(out)


@tool("profile_column", 16, "profiling", "stat_panel", Parameter("column", "column"), Parameter("top_n", "integer", 2, 10, 1, 50), Parameter("n_bins", "integer", 2, 20, 2, 100), Parameter("samples", "integer", 2, 10, 1, 20))
def profile_column(r: Relation, column: str, top_n: int, n_bins: int, samples: int) -> Result:
    """Everything about one column, by its type, and a few sentences."""
    spec = r[column]
    if spec.logical == Logical.UNSUPPORTED:
        raise TabulensError(f"{column} has a type that can't be profiled")
    one = lambda df: df.first().asDict()
    many = lambda df, *by: [x.asDict() for x in (df.orderBy(*by) if by else df).collect()]
    out = {"completeness": one(completeness(r, column)), "cardinality": one(cardinality(r, column))}
    if ROW_ID in r.df.columns:
        out["presence"] = many(presence_strip(r, column), "slot")
    if not out["completeness"]["present"]:
        pass
    elif spec.logical == Logical.NUMERICAL:
        out["moments"] = one(moments(r, column))
        if out["moments"]["n"]:
            out |= {"quantiles": many(quantiles(r, column), "q"), "fence": one(fence(r, column)), "ecdf": many(ecdf(r, column), "p"), "rug": many(rug(r, column), "value"), "bins": many(numeric_histogram(r, column, n_bins), "bin"), "extremes": many(extremes(r, column))}
    elif spec.logical == Logical.DATE:
        out["dates"] = one(date_summary(r, column))
        if out["dates"]["conforming"]:
            out |= {f"by_{g}": many(calendar(r, column, g), "key") for g in ("year", "month", "day") if g != "day" or out["dates"]["span_days"] <= DAYS}
            out |= {f"by_{g}": many(cycle(r, column, g), "key") for g in ("weekday", "month_of_year", "hour") if g != "month_of_year"} | {"by_month_of_year": many(cycle(r, column, "month"), "key")}
    elif spec.logical == Logical.BOOLEAN:
        out["booleans"] = one(boolean_counts(r, column))
    else:
        out |= {"top": many(top_values(r, column, top_n)), "others": one(remainder(r, column, top_n))}
        if spec.logical == Logical.CATEGORICAL:
            out["concentration"] = many(concentration(r, column), "rank")
        else:
            cloud = many(top_terms(r, column, 1, CLOUD))
            out |= {"text": one(text_composition(r, column)), "tokens": one(token_totals(r, column)), "cloud": cloud, "top_words": cloud[:TERMS], "top_pairs": many(top_terms(r, column, 2)), "top_triples": many(top_terms(r, column, 3)), "vocabulary": many(vocabulary(r, column), "rank"), "length_bins": many(length_histogram(r, column, n_bins), "bin"), "samples": many(globals()["samples"](r, column, samples))}
    return Result("stat_panel", values=out, note=narrative(column, spec.logical, out))
