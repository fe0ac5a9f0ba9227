"""Percentiles by slices against the built-in ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates, order_statistics

PROBS = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]


@pytest.fixture(scope="module")
def table(spark):
    """Ties, zeros of both signs, infinities, values a last bit apart, ten orders of magnitude, nulls and a null group."""
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), rng.lognormal(0, 4, 300), np.zeros(40), -np.zeros(3), np.full(50, 7.25), [np.inf, -np.inf, 1e-310, -1e308, 1e308], 1 + np.arange(200) * 2.3e-16])
    rows = [(int(i % 3) if i % 50 else None, float(v) if i % 41 else None) for i, v in enumerate(rng.permutation(values))] + [(9, None), (10, 1.5)]
    return spark.createDataFrame(rows, "k int, v double").cache()


@pytest.mark.parametrize("by", [[], ["k"]])
def test_slices_give_the_same_percentiles(table, by):
    built_in = {tuple(r)[:-1]: r.p for r in order_statistics.percentiles(table, by, F.col("v"), PROBS).collect()}
    sliced = {tuple(r)[:-1]: r.p for r in order_statistics.percentiles(table, by, F.col("v"), PROBS, buffered=0).collect()}
    assert sliced == built_in and len(sliced) == (5 if by else 1)


def test_not_a_number_is_the_largest_value(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    p = order_statistics.percentiles(df, [], F.col("v"), [0.0, 0.5, 1.0], buffered=0).first().p
    assert p[:2] == [1.0, float("inf")] and np.isnan(p[2])


def test_groups_without_values_stay_and_empty_tables_give_null(spark, table):
    grouped = table.groupBy("k").agg(F.count("*").alias("n"))
    for buffered in (0, 10**6):
        rows = {r.k: r.p for r in order_statistics.with_percentiles(grouped, table, ["k"], F.col("v"), [0.5], buffered=buffered).collect()}
        assert len(rows) == 6 and rows[9] is None and rows[10] == [1.5]
    one = spark.range(1)
    assert order_statistics.with_percentiles(one, table.where("k = 9"), [], F.col("v"), [0.5]).first().p is None


def test_a_group_of_millions_is_not_one_buffer(spark):
    """Five million distinct values of one group: no percentile buffer in the plan, and the right values."""
    big = spark.range(5_000_000).select((F.col("id") * 7 % 5_000_000 / 8.0).alias("v"))
    found = order_statistics.percentiles(big, [], F.col("v"), [0.25, 0.5, 1.0])
    assert "percentile(" not in found._jdf.queryExecution().optimizedPlan().toString()
    n = 4_999_999
    assert found.first().p == pytest.approx([n / 4 / 8, n / 2 / 8, n / 8], rel=1e-12)


def test_profile_uses_either(table, monkeypatch):
    import functools

    want = aggregates.profile(table, {"v": F.col("v")}, ["k"]).orderBy("k").collect()
    monkeypatch.setattr(aggregates, "with_percentiles", functools.partial(order_statistics.with_percentiles, buffered=0))
    got = aggregates.profile(table, {"v": F.col("v")}, ["k"]).orderBy("k").collect()
    assert got == want
