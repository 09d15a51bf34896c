"""Exact order statistics against sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabulens.operators import quantiles as Q
from tabulens.operators.transforms import ranks


@pytest.mark.parametrize("few", [True, False])
def test_ranks_are_those_of_sorting(spark, monkeypatch, few):
    if few:  # so that buckets are divided many times
        monkeypatch.setattr(Q, "BUCKETS", 4)
        monkeypatch.setattr(Q, "VALUES", 3)
    rng = random.Random(1)
    for made in (
        [rng.gauss(0, 1) for _ in range(300)],
        [float(rng.randint(0, 3)) for _ in range(300)],
        [10.0 ** rng.randint(-300, 300) for _ in range(100)] + [0.0] * 50 + [-1e-9],
        [5.0],
        [1.0, math.nextafter(1.0, 2.0), 1e18],
    ):
        df = spark.createDataFrame([(x,) for x in made], "v double").repartition(3)
        wanted = sorted({0, len(made) - 1, *(rng.randrange(len(made)) for _ in range(6))})
        assert Q.at_ranks(df, wanted) == {k: sorted(made)[k] for k in wanted}
    assert Q.at_ranks(spark.createDataFrame([], "v double"), []) == {}
    assert Q.quantile_values(spark.createDataFrame([], "v double"), [0.5]) == (0, [None])


def test_quantiles_of_whole_numbers(spark):
    df = spark.range(101).select(F.col("id").alias("v"))
    assert Q.quantile_values(df, [0, 0.25, 0.505, 1]) == (101, [0, 25, 50.5, 100])


def test_curve_by_counts_of_counts(spark):
    rng = random.Random(2)
    counts = [rng.choice([1, 1, 1, 2, 5, 9]) for _ in range(60)]
    df = spark.createDataFrame([(f"v{i}", n) for i, n in enumerate(counts)], "v string, n long")
    total, curve = Q.ranked_curve(df, lambda last: range(1, last + 1))
    ordered = sorted(counts, reverse=True)
    assert total == sum(counts) and curve == [(k, sum(ordered[:k])) for k in range(1, 61)]
    assert Q.ranked_curve(df.limit(0), lambda last: []) == (0, [])


def test_dense_ranks(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(3).sample(range(10_000), 500)], "v int")
    assert [r["rank_"] for r in ranks(df, F.col("v")).orderBy("v").collect()] == list(range(1, 501))
