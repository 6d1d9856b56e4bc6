"""Trees of all folds grown together, against MLlib's fit of each fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.learning import evaluate, grown, models, trees

FEATURES = ["a", "b", "c d", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = []
    for i in range(600):
        x = [rng.gauss(0, 1), float(rng.randrange(200)), rng.random() ** 3, float(rng.randrange(2))]
        data.append((i, int(x[0] + 0.01 * x[1] * x[3] + rng.gauss(0, 0.8) > 0.4), *x))
    return spark.createDataFrame(data, "enc_id long, outcome int, a double, b double, `c d` double, e double").repartition(3).cache()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_trees_of_the_folds_equal_separate_fits(spark, rows):
    folded = rows.withColumn("_fold", models.fold("enc_id", 10))
    want = {}
    for k in range(10):
        model = models.fit(folded.where(F.col("_fold") != k), FEATURES, "tree")
        want |= {r["enc_id"]: r["score"] for r in models.score(model, folded.where(F.col("_fold") == k)).collect()}
    out, used = jobs(spark, "oof-trees", lambda: evaluate.out_of_fold(rows, FEATURES, "tree", folds=10).collect())
    assert {r["enc_id"]: r["prediction"] for r in out} == pytest.approx(want) and all(r["score"] == r["prediction"] for r in out)
    assert used < 25  # a fit a fold takes more than fifty


def test_error_of_the_folds(rows):
    found = evaluate.fold_rmse(rows, FEATURES, "tree", folds=10).first()
    per_fold = evaluate.out_of_fold(rows, FEATURES, "tree", 10).toPandas()
    per_fold = ((per_fold["prediction"] - per_fold["outcome"]) ** 2).groupby(per_fold["_fold"]).mean() ** 0.5
    assert found["folds"] == 10 and found["mean_rmse"] == pytest.approx(per_fold.mean()) and found["std_rmse"] == pytest.approx(per_fold.std(ddof=0))


def test_sums_merged_by_a_shuffle_and_more_rows_than_the_sample(rows, monkeypatch):
    one = evaluate.out_of_fold(rows, FEATURES, "tree", folds=3).toPandas().set_index("enc_id")["prediction"].sort_index()
    monkeypatch.setattr(grown, "FEW_BYTES", 0)
    two = evaluate.out_of_fold(rows, FEATURES, "tree", folds=3).toPandas().set_index("enc_id")["prediction"].sort_index()
    assert np.allclose(one, two)
    monkeypatch.setattr(grown, "SAMPLE", 200)
    three = evaluate.out_of_fold(rows, FEATURES, "tree", folds=3).toPandas()
    assert ((three["prediction"] > 0.5) == (three["outcome"] == 1)).mean() > 0.6


def test_a_missing_feature_or_label_fails_as_before(rows):
    with pytest.raises(Exception):
        evaluate.out_of_fold(rows.withColumn("a", F.lit(None).cast("double")), FEATURES, "tree", folds=3).collect()
    with pytest.raises(Exception):
        evaluate.out_of_fold(rows.withColumn("outcome", F.when(F.col("enc_id") > 9, F.col("outcome"))), FEATURES, "tree", folds=3).collect()


def test_thresholds():
    assert grown.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 32).tolist() == [1.5, 2.5] and grown.thresholds(np.zeros(5), 32).tolist() == []
    assert grown.thresholds(np.arange(100.0), 4).tolist() == [24.5, 49.5, 74.5]


def test_boosting_goes_on_from_its_trees(rows, monkeypatch):
    """The rounds of separate models, without a fit being started anew; the margins are also computed from all trees in between."""
    settings = {"stepSize": 0.3, "maxDepth": 3, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 2}
    with monkeypatch.context() as m:
        m.setattr(trees, "without_chance", lambda *_: False)
        want = trees.boosting_rounds(rows, FEATURES, folds=3, most=7, patience=4, **settings).orderBy("round").collect()
    monkeypatch.setattr(models, "fit", lambda *_, **__: pytest.fail("a model is fitted anew"))
    monkeypatch.setattr(grown, "FROM_START", 3)
    found = trees.boosting_rounds(rows, FEATURES, folds=3, most=7, patience=4, **settings).orderBy("round").collect()
    assert [(r["round"], r["chosen"]) for r in found] == [(r["round"], r["chosen"]) for r in want]
    for c in ("mean_error", "std_error"):
        assert [r[c] for r in found] == pytest.approx([r[c] for r in want])
