"""Nearest-row imputation by blocks: brute force, skipped blocks, bounds."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clinfeat.operators import nearest, prep


def brute(rows, donors, k=3):
    """{(id, column): [(distance, donor), ...]} by comparing all."""
    out = {}
    for i, x in rows.items():
        for j in [j for j, v in enumerate(x) if v is None]:
            found = []
            for other, y in donors.items():
                both = [(a - b) ** 2 for a, b in zip(x, y) if a is not None and b is not None]
                if other != i and y[j] is not None and both:
                    found.append((round(sum(both) / len(both), 9), other))
            out[i, j] = sorted(found)[:k]
    return {key: v for key, v in out.items() if v}


def made(seed, n, width, missing, clusters=1, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 8) for _ in range(width)] for _ in range(clusters)]
    out = {}
    for i in range(n):
        c = centres[rng.randrange(clusters)]
        out[i] = [None if rng.random() < missing else round(rng.gauss(m, spread), 2) for m in c]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in rows.items()], "id long, x array<double>").repartition(3)


def check(spark, rows, donors, width, block_rows, audit=None):
    want = brute(rows, donors)
    found = {}
    for r in nearest.nearest_values(frame(spark, rows), frame(spark, donors), width, 3, block_rows, audit).collect():
        assert r.value == donors[r.donor][r.feature]
        found.setdefault((r.id, r.feature), []).append((r.distance, r.donor))
    assert {k: sorted(v) for k, v in found.items()} == want


@pytest.mark.parametrize("missing, block_rows", [(0.2, 8), (0.6, 8), (0.2, 5000)])
def test_equal_to_comparing_all(spark, missing, block_rows):
    """Common and rare patterns, blocks of a few rows and one block for all; repeated rows and many ties."""
    rows = made(1, 150, 4, missing)
    rows |= {1000 + i: [1.0, None, 2.0, 2.0] for i in range(20)} | {2000 + i: [1.0, 3.0, None, 2.0] for i in range(20)} | {3000: [None] * 4}
    check(spark, rows, rows, 4, block_rows)


def test_other_donors(spark):
    check(spark, made(2, 60, 3, 0.4), {500 + i: x for i, x in made(3, 80, 3, 0.3).items()}, 3, 10)


def test_far_blocks_are_skipped(spark):
    """Of rows in clusters, most pairs of blocks are never read."""
    rows, audit = made(4, 3000, 3, 0.08, clusters=6, spread=0.3), {}
    check(spark, rows, rows, 3, 16, audit)
    assert 0 < audit["first"] + audit["second"] < 0.5 * audit["pairs"], audit


def test_lower_bound_holds_for_every_pair():
    """Of any two rows of two blocks, whatever columns they lack, no distance is below the bound of their boxes."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        blocks = []
        for _ in range(2):
            x = rng.normal(rng.normal(0, 3, 4), 1, (6, 4))
            x[rng.random((6, 4)) < rng.random(4)] = np.nan
            blocks.append(x)

        def box(x):
            value = lambda a: [None if np.isnan(v) else float(v) for v in a]
            low, high = np.where(np.isnan(x), np.inf, x).min(0), np.where(np.isnan(x), -np.inf, x).max(0)
            clean = lambda a: value(np.where(np.isinf(a), np.nan, a))
            return nearest.Boxes([{"block": "b", "n": 6, "lo": clean(low), "hi": clean(high), "known": (~np.isnan(x)).sum(0).tolist()}], 4)

        bound = box(blocks[1]).lower_bounds(box(blocks[0]), 0)[0]
        gap = (blocks[0][:, None] - blocks[1][None]) ** 2
        shared = (~np.isnan(gap)).sum(2)
        with np.errstate(invalid="ignore"):
            distance = np.where(shared > 0, np.nansum(gap, 2) / shared, np.inf)
        assert distance.min() >= bound - 1e-9


def test_trees_place_every_row():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1000, 3))
    x[rng.random((1000, 3)) < 0.2] = np.nan
    tree = nearest.grown(x[::3], 20)
    leaves = tree.leaves(x)
    assert leaves.min() >= 0 and leaves.max() < 32 and np.bincount(leaves).max() < 200
    assert (nearest.grown(x[:2], 50).leaves(x) == 0).all()


def test_empty_and_complete_tables_nan_and_copies(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.5, None), (2, 1.5, None), (3, float("nan"), 4.0)], "enc_id long, a double, b double")
    found = sorted((r.enc_id, r.a, r.b) for r in prep.impute_nearest(df, ["a", "b"]).collect())
    assert [f[0] for f in found] == [1, 2, 2, 3] and found[1] == found[2]
    assert found[3][1] == pytest.approx(1.0) and found[1][2] == pytest.approx(2.0)
    assert prep.impute_nearest(df.limit(0), ["a", "b"]).count() == 0
    full = df.where("enc_id = 1")
    assert [tuple(r) for r in prep.impute_nearest(full, ["a", "b"]).collect()] == [(1, 1.0, 2.0)]
    assert nearest._matrix(pa.array([[1.0, None], [None, 3.0]], pa.list_(pa.float64())), 2).shape == (2, 2)
    alone = spark.createDataFrame([(1, None, 2.0)], "enc_id long, a double, b double").withColumn("b", F.col("b"))
    assert prep.impute_nearest(alone, ["a", "b"]).first()["a"] is None
