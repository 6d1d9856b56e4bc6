"""Folds of a grid search over boosted trees."""

import random
import threading

import pytest
from pyspark.ml.classification import GBTClassifier

from clinfeat.learning import models

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = [(i, y := int(rng.random() < 0.4), rng.gauss(y, 1), rng.gauss(0, 1)) for i in range(300)]
    return spark.createDataFrame(data, "enc_id long, outcome int, a double, b double").repartition(2).cache()


def test_folds_of_boosting_are_fitted_side_by_side(rows, monkeypatch):
    together, plain = threading.Barrier(3), GBTClassifier.fit

    def fit(self, *args):
        together.wait(60)  # two folds and the fit on all rows
        return plain(self, *args)

    monkeypatch.setattr(GBTClassifier, "fit", fit)
    best, table = models.cross_validate(rows, FEATURES, "boosted", {"maxDepth": [1]}, folds=2, parallelism=1, fixed={"maxIter": 2})
    assert best.getNumTrees == 2 and 0.5 < table.first()["mean_score"] <= 1
