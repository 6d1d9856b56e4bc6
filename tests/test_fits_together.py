"""Fits of several folds or shares in the same passes, with the results of separate fits."""

import random

import pytest
from pyspark.sql import functions as F

from clinfeat.learning import evaluate, models

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, y := int(rng.random() < 0.4), rng.gauss(y, 1), rng.gauss(0, 1)) for i in range(300)]
    return spark.createDataFrame(data, "enc_id long, outcome int, a double, b double").repartition(2).cache()


def separate_fit(*args, **params):
    raise AssertionError("a fit of its own")


def test_out_of_fold_like_separate_fits(rows, monkeypatch):
    parts = []
    for k in range(2):
        folded = rows.withColumn("_fold", models.fold("enc_id", 2))
        parts.append(models.score(models.fit(folded.where(F.col("_fold") != k), FEATURES), folded.where(F.col("_fold") == k)))
    want = {r["enc_id"]: r for r in parts[0].unionByName(parts[1]).collect()}
    monkeypatch.setattr(evaluate, "fit", separate_fit)
    found = evaluate.out_of_fold(rows, FEATURES, folds=2)
    assert found.columns == parts[0].columns
    got = found.collect()
    assert len(got) == 300
    for r in got:
        assert r["score"] == pytest.approx(want[r["enc_id"]]["score"], abs=1e-5)
        assert r["prediction"] == want[r["enc_id"]]["prediction"] or abs(r["score"] - 0.5) < 1e-5


def test_learning_curve_like_separate_fits(rows, monkeypatch):
    want = {(r["share"], r["part"]): r for r in evaluate.learning_curve(rows, FEATURES, shares=(0.5, 1.0), folds=2, maxIter=200).collect()}
    monkeypatch.setattr(evaluate, "fit", separate_fit)
    got = evaluate.learning_curve(rows, FEATURES, shares=(0.5, 1.0), folds=2).collect()
    assert len(got) == len(want) == 4
    for r in got:
        assert r["mean_accuracy"] == pytest.approx(want[r["share"], r["part"]]["mean_accuracy"], abs=1e-9)
        assert r["std_accuracy"] == pytest.approx(want[r["share"], r["part"]]["std_accuracy"], abs=1e-9)


def test_missing_feature_fails(rows):
    gap = rows.withColumn("a", F.when(F.col("enc_id") != 7, F.col("a")))
    with pytest.raises(Exception, match="a has missing values"):
        evaluate.out_of_fold(gap, FEATURES, folds=2).collect()
