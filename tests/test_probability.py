"""Probability plots against order statistics computed by hand."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.functions.numbers import normal_quantile
from clinfeat.operators import profile


def test_normal_quantile(spark):
    ps = [1e-300, 1e-30, 1e-12, 1e-5, 0.01, 0.074, 0.076, 0.3, 0.5, 0.7, 0.925, 0.9251, 0.99, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double")
    found = [r[0] for r in df.select(normal_quantile(F.col("p"))).collect()]
    assert found[:len(ps)] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-12, abs=1e-12)
    assert found[len(ps):] == [None] * 3


def by_hand(values):
    values = np.sort(values)
    n = len(values)
    p = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    p[-1] = 0.5 ** (1 / n)
    p[0] = 1 - p[-1] if n > 1 else p[0]
    return values, np.array([NormalDist().inv_cdf(x) for x in p])


@pytest.mark.parametrize("places", [3, 10_000])
def test_points_and_line(spark, monkeypatch, places):
    monkeypatch.setattr(profile, "PLACES", places)
    chance = np.random.default_rng(3)
    groups = {"a": chance.normal(5, 2, 60).round(1), "b": np.full(40, 7.0), "c": np.array([1.5]), None: chance.exponential(1, 25)}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("a", float("nan")), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    points = profile.probability_plot(df, "v", ["g"]).collect()
    lines = {r.g: r for r in profile.probability_line(df, "v", ["g"]).collect()}
    assert set(lines) == set(groups)
    for k, own in groups.items():
        mine = sorted((r.position, r.v, r.normal) for r in points if r.g == k)
        x, z = by_hand(own)
        assert [m[0] for m in mine] == list(range(1, len(x) + 1))
        assert [m[1] for m in mine] == pytest.approx(x) and [m[2] for m in mine] == pytest.approx(z, abs=1e-12)
        if k in ("a", None):
            slope, intercept = np.polyfit(z, x, 1)
            assert (lines[k].slope, lines[k].intercept) == pytest.approx((slope, intercept))
            assert lines[k].r == pytest.approx(np.corrcoef(z, x)[0, 1])
    assert lines["b"].slope == pytest.approx(0) and lines["b"].r is None and lines["c"].slope is None
    one = profile.probability_line(df.where("g = 'a'"), "v").first()
    assert one.n == 60 and one.r == pytest.approx(lines["a"].r)
    assert profile.probability_line(df.limit(0), "v", ["g"]).count() == 0
