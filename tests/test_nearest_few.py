"""Nearest rows over few columns: trees for each set of shared columns, shards of donors, and how little is looked at and moved."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.operators import nearest, nearest_few, prep
from test_nearest import brute, check, made


def listed(columns):
    out = {}
    for i, c, d, donor, _ in zip(*columns):
        out.setdefault((int(i), int(c)), []).append((float(d), int(donor)))
    return {key: sorted(v) for key, v in out.items()}


@pytest.mark.parametrize("kind", ["spread", "ties", "copies", "narrow"])
def test_like_comparing_all(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 4)) * (1e-7 if kind == "narrow" else 1)
    if kind == "ties":
        x = np.round(x)
    if kind == "copies":
        x[100:] = x[0]
    x[rng.random(x.shape) < 0.35] = np.nan
    x = x[~np.isnan(x).all(1)]
    ids = rng.permutation(1000)[:len(x)]
    rows = {int(i): [None if np.isnan(v) else float(v) for v in r] for i, r in zip(ids, x)}
    assert listed(nearest_few.Shard(ids, x).found(ids, x, 3)) == {k: sorted(v) for k, v in brute(rows, rows).items()}


def test_rows_of_one_id_are_no_donors_of_each_other():
    x = np.array([[1.0, np.nan], *[[1.0, 5.0]] * 6, [2.0, 7.0], [3.0, 8.0], [9.0, 9.0]])
    ids = np.array([4] * 7 + [1, 2, 3])
    assert listed(nearest_few.Shard(ids, x).found(ids[:1], x[:1], 3)) == {(4, 1): [(1.0, 1), (4.0, 2), (64.0, 3)]}


def test_shards_of_donors(spark, monkeypatch):
    """Many small shards, over few columns and by blocks, tell the same as one."""
    monkeypatch.setattr(nearest, "SHARD_BYTES", 2000)
    rows = made(8, 160, 4, 0.3) | {1000 + i: [1.0, None, 2.0, 2.0] for i in range(12)}
    check(spark, rows, rows, 4, 16)
    check(spark, rows, rows, 4, 16, {})


def test_most_places_are_not_looked_at(monkeypatch):
    """Of 20,000 rows that are all apart, a row meets few; all with all are 10,000 times 10,000 pairs."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(20_000, 3))
    x[:10_000, 2] = np.nan
    met, plain = [], nearest_few.Space.distances
    monkeypatch.setattr(nearest_few.Space, "distances", lambda self, x, at: met.append(len(at)) or plain(self, x, at))
    found = nearest_few.Shard(np.arange(20_000), x).found(np.arange(10_000), x[:10_000], 3)
    assert len(found[0]) == 30_000 and sum(met) < 10_000 * 200


def test_blocks_are_not_moved_for_every_pair(spark):
    """By blocks: what is shuffled and written does not grow with the number of pairs."""
    rows, audit = made(10, 600, 3, 0.2), {}
    df = spark.createDataFrame([(i, *x) for i, x in rows.items()], "enc_id long, a double, b double, c double")
    out = prep.impute_nearest(df, ["a", "b", "c"], block_rows=8, audit=audit)
    plans = out._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plans and "Join Inner" not in plans and audit["first"] + audit["second"] > 600
    few = prep.impute_nearest(df, ["a", "b", "c"])
    columns = ["enc_id", *[F.round(c, 9).alias(c) for c in "abc"]]
    assert sorted(map(tuple, out.select(*columns).collect()), key=str) == sorted(map(tuple, few.select(*columns).collect()), key=str)
