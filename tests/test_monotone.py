"""Pooling of adjacent violators against the largest-smallest rate of all ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.learning import evaluate, monotone


def by_hand(scores, labels, bins):
    """{bin: rate}: over all ranges around the bin, the largest (by start) of the smallest (by end) rates."""
    at = np.minimum(np.floor(np.array(scores) * bins) + 1, bins).astype(int)
    own = sorted(set(at.tolist()))
    n = np.array([(at == b).sum() for b in own])
    e = np.array([np.array(labels)[at == b].sum() for b in own])
    return {
        b: max(min(e[i:j + 1].sum() / n[i:j + 1].sum() for j in range(k, len(own))) for i in range(k + 1)) for k, b in enumerate(own)
    }


@pytest.mark.parametrize("case", ["noise", "ties", "constant", "falling", "one"])
def test_steps(spark, case):
    chance = np.random.default_rng(5)
    scores = {
        "noise": chance.random(300), "ties": chance.integers(0, 6, 300) / 5, "constant": np.full(50, 0.3), "falling": np.linspace(0, 1, 40), "one": np.array([1.0]),
    }[case]
    labels = (chance.random(len(scores)) < scores).astype(int) if case != "falling" else (scores < 0.5).astype(int)
    rows = [(float(s), int(y)) for s, y in zip(scores, labels)] + [(0.5, None), (None, 1), (1.5, 1)]
    df = spark.createDataFrame(rows, "score double, outcome int").repartition(3)
    want = by_hand(scores, labels, 50)
    found = monotone.monotone_steps(df, bins=50).orderBy("low").collect()
    assert [r.rate for r in found] == sorted(r.rate for r in found) and len({r.rate for r in found}) == len(found)
    for b, rate in want.items():
        assert [r.rate for r in found if r.low <= b <= r.high] == [pytest.approx(rate)]
    assert sum(r.n for r in found) == len(scores)
    out = monotone.monotone(monotone.monotone_steps(df, bins=50), df, bins=50).collect()
    for r in out:
        if r.score is None or r.score > 1:
            assert r.calibrated is None
        elif r.outcome is not None:
            assert r.calibrated == pytest.approx(want[int(min(np.floor(r.score * 50) + 1, 50))])


def test_empty_and_lookup_between_steps(spark):
    df = spark.createDataFrame([(0.1, 0), (0.9, 1), (0.95, 1)], "score double, outcome int")
    steps = monotone.monotone_steps(df, bins=100)
    assert [r.rate for r in steps.orderBy("low").collect()] == [0.0, 1.0]
    asked = spark.createDataFrame([(0.0,), (0.5,), (0.99,)], "score double")
    low, middle, high = sorted(r.calibrated for r in monotone.monotone(steps, asked, bins=100).collect())
    assert (low, high) == (0.0, 1.0) and middle == pytest.approx((51 - 11) / (91 - 11))
    nothing = monotone.monotone_steps(df.limit(0))
    assert nothing.count() == 0 and monotone.monotone(nothing, asked).where("calibrated IS NOT NULL").count() == 0


def test_smoothed_sigmoid(spark):
    """The slope of the weighted loss with smoothed targets vanishes, also where the classes do not overlap."""
    data = [(0.1 * i, int(i > 6)) for i in range(12)]
    df = spark.createDataFrame(data, "score double, outcome int")
    model = evaluate.recalibrate(df).stages[-1]
    s, y = np.array(data).T
    p, q = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (p + 1) / (p + 2), 1 / (q + 2))
    fitted = 1 / (1 + np.exp(-(model.coefficients[0] * s + model.intercept)))
    assert abs((fitted - target).sum()) < 1e-2 and abs(((fitted - target) * s).sum()) < 1e-2
    assert monotone.smoothed_targets(df.withColumn("outcome", F.lit(None).cast("int"))).count() == 0
