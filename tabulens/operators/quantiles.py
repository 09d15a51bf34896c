"""Exact order statistics by refined histograms: a few passes with small results, and no exchange that grows with the data."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of a histogram that come to the driver at once, and distinct values that do in the last pass.
BUCKETS, VALUES = 4096, 100_000


def _bucket(x: Column, low: Column, high: Column, n: int, fine: bool) -> Column:
    """0 .. n - 1 for x between two bounds, which themselves get the first and the last; bounds alike give 0.

    Buckets are of equal width, or ``fine`` near the lower bound, where values of very different size crowd.
    """
    x, low, high = (c.cast("double") / 2 for c in (x, low, high))  # halves, as a difference may be too large
    share = F.coalesce((x - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    share = F.log2(share * float(1 << 52) + 1) / F.log2(F.lit(float(1 << 52) + 1)) if fine else share
    return F.least(F.floor(share * n), F.lit(n - 1)).cast("int")


def _take(found: dict[int, object], wanted: list[int], rank: int, values: list) -> None:
    """Notes the values at those of the sorted ``wanted`` ranks that lie among (value, count), of which the first has ``rank``."""
    at = bisect_left(wanted, rank)
    for x, n in values:
        rank += n
        while at < len(wanted) and wanted[at] < rank:
            found[wanted[at]] = x
            at += 1


def at_ranks(df: DataFrame, wanted: list[int], bounds: tuple | None = None, name: str = "v", size: int | None = None) -> dict[int, object]:
    """The values at the given ranks, from 0, of a column of numbers in ascending order, nulls left out.

    ``bounds`` and ``size``: the least and the greatest value and the number of rows, where they are known already.

    The column is counted in buckets; buckets that hold a wanted rank are divided again until their values are few.
    What reaches the driver is bounded by BUCKETS and VALUES; the data themselves are never moved.
    """
    todo = sorted(set(wanted))
    if not todo:
        return {}
    found: dict[int, object] = {}
    if size is not None and size <= VALUES:
        rows = df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n")).orderBy("v").collect()
        _take(found, todo, 0, rows)
        return found
    low, high = bounds or df.agg(F.min(name), F.max(name)).first()
    rows, v = df.select(F.col(name).alias("v")).filter("v is not null"), F.col("v")
    live = [(low, high, 0)]  # least value, greatest value, rank of the first
    index, level = F.lit(0), 0
    while todo:
        n = max(2, BUCKETS // len(live))
        ends = [F.get(F.array(*[F.lit(x[k]) for x in live]), index) if len(live) > 1 else F.lit(live[0][k]) for k in (0, 1)]
        place = index * n + _bucket(v, *ends, n, level % 2 == 1)
        inside = rows.filter(index.isNotNull()) if level else rows
        counts = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        kept, numbers, size, rank, at = [], [], 0, 0, -1
        for r in counts:
            if r["b"] // n != at:
                at = r["b"] // n
                rank = live[at][2]
            own = [k for k in todo if rank <= k < rank + r["n"]]
            if r["lo"] == r["hi"]:
                found.update(dict.fromkeys(own, r["lo"]))
            elif own:
                kept.append((r["lo"], r["hi"], rank))
                numbers.append(r["b"])
                size += r["n"]
            rank += r["n"]
        todo = [k for k in todo if k not in found]
        if not todo:
            break
        # the place of a value among the buckets that are left: by the first histogram's numbers, later by their bounds
        if level == 0:
            index = F.element_at(F.create_map(*[F.lit(x) for i, b in enumerate(numbers) for x in (b, i)]), place)
        else:
            index = reduce(lambda c, x: c.when(v.between(x[1][0], x[1][1]), x[0]), enumerate(kept), F.when(F.lit(False), 0))
        live, level = kept, level + 1
        if size <= VALUES:
            values: list[list] = [[] for _ in live]
            for r in rows.withColumn("i", index).filter("i is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n")).orderBy("i", "v").collect():
                values[r["i"]].append((r["v"], r["n"]))
            for (_, _, rank), own in zip(live, values, strict=True):
                _take(found, todo, rank, own)
            break
    return found


def quantile_values(df: DataFrame, at: tuple[float, ...] | list[float], name: str = "v") -> tuple[int, list[float | None]]:
    """(rows, the quantiles): between two values the position decides, as usual for a continuous quantile."""
    b = df.agg(F.count(name).alias("n"), F.min(name).alias("lo"), F.max(name).alias("hi")).first()
    if not b["n"]:
        return 0, [None] * len(at)
    places = [q * (b["n"] - 1) for q in at]
    found = at_ranks(df, [k for p in places for k in (math.floor(p), math.ceil(p))], (b["lo"], b["hi"]), name, b["n"])
    return b["n"], [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def ranked_curve(counted: DataFrame, wanted) -> tuple[int, list[tuple[int, int]]]:
    """(all, [(rank, cumulative count)]) of values with counts ``n``, the most frequent first, at the ranks that ``wanted`` gives.

    ``wanted`` maps the number of values to ranks from 1. Only counts of counts are read, of which N rows have at most
    the square root of 2 N.
    """
    rows = counted.groupBy("n").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    ranks, totals = [0], [0]
    for r in rows:
        ranks.append(ranks[-1] + r["m"])
        totals.append(totals[-1] + r["m"] * r["n"])
    out = []
    for k in wanted(ranks[-1]):
        i = bisect_right(ranks, k - 1) - 1
        out.append((k, totals[i] + (k - ranks[i]) * rows[i]["n"]))
    return totals[-1], out
