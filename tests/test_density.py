"""Binned kernel density against the direct sum."""

import numpy as np
import pytest

from clinfeat.operators import profile


def direct(values, x):
    h = values.std(ddof=1) * len(values) ** -0.2
    return np.exp(-0.5 * ((x[:, None] - values[None]) / h) ** 2).sum(1) / (len(values) * h * np.sqrt(2 * np.pi)), h


def test_density_equals_the_direct_sum(spark):
    chance = np.random.default_rng(2)
    groups = {"a": chance.normal(50, 3, 400), "b": np.concatenate([chance.normal(0, 1, 200), [500.0]]), None: np.array([1.0, 2.0, 2.0]), "same": np.full(9, 4.0), "single": np.array([3.0])}
    rows = [(k, float(v)) for k, own in groups.items() for v in own] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    found = profile.kernel_density(df, "v", ["g"], points=60).collect()
    assert {r.g for r in found} == {"a", "b", None}
    for k in ("a", "b", None):
        mine = sorted((r.x, r.density) for r in found if r.g == k)
        x, density = np.array(mine).T
        want, h = direct(groups[k], x)
        assert len(x) == 60 and x[0] == pytest.approx(groups[k].min() - 3 * h) and x[-1] == pytest.approx(groups[k].max() + 3 * h)
        assert np.abs(density - want).max() < 1e-6 / h
    whole = profile.kernel_density(df.where("g = 'a'"), "v", points=60).collect()
    pairs = [np.array(sorted((r.x, r.density) for r in own)) for own in (whole, [r for r in found if r.g == "a"])]
    assert np.allclose(*pairs)
    assert profile.kernel_density(df.limit(0), "v", ["g"]).count() == 0
