"""Exact quantiles against pandas, with hot values, NULLs, NaN, infinities and narrow ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.functions import quantiles as q


def _frame(spark, n, seed=7):
    rng = np.random.default_rng(seed)
    a = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.lognormal(3, 2, n), 2))
    pdf = pd.DataFrame({"a": a, "b": rng.integers(-300_000, 300_000, n), "k": np.arange(n)})
    df = spark.createDataFrame(pdf).withColumn("a", F.when(F.col("k") % 11 != 3, F.col("a")))
    pdf.loc[pdf.k % 11 == 3, "a"] = np.nan
    return df.repartition(8), pdf


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 120_000])
def test_quantiles_equal_pandas(spark, n):
    df, pdf = _frame(spark, n)
    row = spark.range(1).select(
        q.quantiles(df, {"a": [0.25, 0.5, 0.75], "b": [0.75]}).alias("q"),
        q.integer_quantiles(df, "b", [0.25, 0.5, 0.75]).alias("i"),
    ).first()
    assert row.q["a"] == pytest.approx(list(pdf.a.quantile([0.25, 0.5, 0.75])), nan_ok=True)
    assert row.q["b"] == pytest.approx([pdf.b.quantile(0.75)])
    assert row.i == pytest.approx(list(pdf.b.quantile([0.25, 0.5, 0.75])))


@pytest.mark.parametrize("n", [1, 9, 10, 1000, 120_000])
def test_top_share_equals_pandas(spark, n):
    df, pdf = _frame(spark, n)
    got = q.top_share(df, "b", 0.10).first()
    k = max(1, int(n * 0.10))
    assert got.top_count == k
    assert got.top_sum == pdf.b.sort_values(ascending=False).head(k).sum()
    assert got.total_sum == pdf.b.sum()


def _selected(df, column, probs):
    return df.sparkSession.range(1).select(q.quantiles(df, {column: probs}).alias("q")).first().q[column]


def _interpolated(values, p):
    at = (len(values) - 1) * p
    low, high = values[int(np.floor(at))], values[int(np.ceil(at))]
    return low if low == high or at == np.floor(at) else low + (high - low) * (at - np.floor(at))


def test_heavy_tails_hot_values_and_infinities(spark):
    rng = np.random.default_rng(1)
    n = 400_000
    v = 10 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n)
    v[rng.random(n) < 0.3] = 2.5
    v[:1000], v[1000:1500], v[1500:1700] = np.inf, -np.inf, np.nan
    v[1700:2000] = rng.choice([0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308], 300)
    df = spark.createDataFrame(pd.DataFrame({"v": v})).repartition(16)
    probs = [0.0, 0.0001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99995, 1.0]
    values = np.sort(v[~np.isnan(v)])
    for p, value in zip(probs, _selected(df, "v", probs)):
        assert value == pytest.approx(_interpolated(values, p), rel=1e-12)


def test_images_keep_the_order_and_the_value(spark):
    rng = np.random.default_rng(2)
    v = rng.integers(-(1 << 63), (1 << 63) - 1, 50_000).view(np.float64)
    powers = 2.0 ** np.arange(-1074, 1024)
    v = np.concatenate([v[np.isfinite(v)], powers, -powers, np.nextafter(powers, 0), np.nextafter(powers, np.inf), [0.0, np.inf, -np.inf]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = q.images(df, ["v"]).withColumn("back", F.expr(q.value_sql("x0"))).toPandas()
    bits = np.abs(v).view(np.int64) * np.where(np.signbit(v), -1, 1)
    assert (got.x0.to_numpy() == bits).all() and (got.back.to_numpy() == v).all()


def test_bigints_are_not_rounded(spark):
    base = 1 << 60
    df = spark.range(100_001).select((F.col("id") + base).alias("v"), F.lit(base).alias("same"))
    found = q._at_ranks(df, [("v", "floor(({total} - 1) * 0.5D)"), ("same", "0")])
    one = spark.range(1).select(found.alias("f")).first().f
    assert (one[0].low, one[0].high, one[0].total) == (base + 50_000, base + 50_001, 100_001)
    assert (one[1].low, one[1].high) == (base, base)
    base = (1 << 53) + 1
    share = q.top_share(spark.range(101).select((F.col("id") + base).alias("v")), "v", 0.1).first()
    assert (share.top_count, share.top_sum) == (10, sum(range(base + 91, base + 101)))


@pytest.mark.parametrize("spread", ["10 ** (rand(3) * 600 - 300)", "rand(3)", "1 + id * 1e-12D", "id * 1e300D"])
def test_no_step_has_more_rows_than_digits(spark, spread):
    """Whatever the spread, 65,536 rows at most leave a step for each rank."""
    spread = spread.replace("10 ** (rand(3) * 600 - 300)", "pow(10D, rand(3) * 600 - 300)")
    values = q.images(spark.range(300_000).select(F.expr(spread).alias("v")), ["v"]).persist()
    assert q._first_counts(values).count() <= 65_536
    prefix = values.select(F.percentile_approx("x0", 0.5, 1_000_000).alias("x")).first().x
    for place in q.PLACES[1:]:
        state = F.expr(f"array(named_struct('prefix', shiftright({prefix}L, {place + q.DIGIT}), 'rank', 0L, 'total', 1L))")
        counts = q._next_counts(values, state, [0], place)
        assert 0 < counts.count() <= 65_536
    values.unpersist()


def test_infinite_neighbours(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("inf"),), (float("inf"),)], "v double")
    assert spark.range(1).select(q.quantiles(df, {"v": [0.5, 0.0]})).first()[0]["v"] == [float("inf"), 1.0]


def test_no_values(spark):
    df = spark.range(5).select(F.lit(None).cast("double").alias("a"), F.lit(None).cast("int").alias("b"))
    row = spark.range(1).select(
        q.quantiles(df, {"a": [0.5]}).alias("q"), q.integer_quantiles(df, "b", [0.5]).alias("i")
    ).first()
    assert row.q["a"] == [None] and row.i == [None]
