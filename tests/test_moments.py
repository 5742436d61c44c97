"""Exact deviations: large means with small spreads, one value, no value, negative values."""

from __future__ import annotations

from fractions import Fraction
from math import sqrt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiny import charger, rows, session, station, tables
from voltlake.functions import measures as m
from voltlake.operators import noc


def exact(values):
    values = [Fraction(int(v)) for v in values]
    mean = sum(values) / len(values)
    spread = sum((v - mean) ** 2 for v in values)
    return float(mean), sqrt(spread / (len(values) - 1)) if len(values) > 1 else None


@pytest.mark.parametrize("values", [
    [10**13 + k % 3 for k in range(1000)], [-(10**13) - k % 7 for k in range(1000)], [10**15] * 500, [10**15] * 500 + [10**15 + 1],
    [0], [7, -7], [-1, -2, -2], list(range(-50, 60)), [10**9, -(10**9), 3],
])
def test_moments_are_exact(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"v": np.array(values, np.int64)})).repartition(4)
    row = noc._moments(df.agg(*noc._exact_sums("v", F.col("v"))), {"v": 1.0}).first()
    mean, deviation = exact(values)
    assert row.mean_v == pytest.approx(mean, rel=1e-15) and row.sd_v == (None if deviation is None else pytest.approx(deviation, rel=1e-13))


def test_z_scores_of_a_small_spread_on_a_large_mean(spark):
    energy = [1_000_000 + 0.01 * (k % 5 - 2) for k in range(200)]
    t = tables(spark, [station(1)], [charger(1, "S1")], [session(k, energy=e) for k, e in enumerate(energy)])
    mean, deviation = exact([round(e * m.SCALE) for e in energy])
    got = {r["session_id"]: r["energy_z"] for r in rows(noc.noc_zscore_behavior(t))}
    for k, e in enumerate(energy):
        assert got[f"X{k}"] == pytest.approx((round(e * m.SCALE) - mean) / deviation, abs=2e-6)


def test_no_session_has_no_score(spark):
    assert rows(noc.noc_zscore_behavior(tables(spark, [station(1)], [charger(1, "S1")], []))) == []
