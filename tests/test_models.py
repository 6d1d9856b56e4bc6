"""Fits, scores and evaluation on a small separable sample."""

import random
from types import SimpleNamespace
from unittest.mock import MagicMock

import pytest
from pyspark.sql import functions as F

from clinfeat.learning import evaluate, models
from clinfeat.plans import model_queries
from clinfeat.plans.catalogue import QUERIES
from clinfeat.plans.dataset import prepare
from clinfeat.sources import stages

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for i in range(240):
        y = int(i % 4 == 0)
        data.append((i, y, rng.gauss(2 * y, 1), rng.gauss(0, 1), float(rng.randrange(2))))
    return spark.createDataFrame(data, "enc_id long, outcome int, a double, b double, c double").cache()


def auc(df):
    return evaluate.roc_auc(df).first()["auc"]


def test_class_weights_are_balanced(rows):
    sums = models.with_class_weights(rows).groupBy("outcome").agg(F.sum("_weight").alias("w")).collect()
    assert {r["outcome"]: round(r["w"], 6) for r in sums} == {0: 120.0, 1: 120.0}


@pytest.mark.parametrize("model,params", [
    ("logistic", {}), ("forest", {"numTrees": 10}), ("svm", {"maxIter": 20}), ("tree", {"maxDepth": 3}),
    ("boosted", {"maxIter": 5, "maxDepth": 2}),
])
def test_fit_save_load_score(spark, rows, model, params):
    path = stages.new_path(spark, model)
    stages.save_model(models.fit(rows, FEATURES, model, **params), path)
    scored = models.score(stages.load_model(path), rows)
    assert scored.count() == 240
    assert auc(scored) > 0.8


def test_folds_cover_all_rows(rows):
    sizes = rows.groupBy(models.fold("enc_id", 5).alias("f")).count().collect()
    assert {r["f"] for r in sizes} == {0, 1, 2, 3, 4} and sum(r["count"] for r in sizes) == 240


def test_out_of_fold_scores_each_row_once(rows):
    scored = evaluate.out_of_fold(rows, FEATURES, folds=3)
    assert scored.select("enc_id").distinct().count() == scored.count() == 240
    report = {r["class"]: r for r in evaluate.classification_report(scored).collect()}
    assert report[0]["support"] == 180 and report[1]["support"] == 60
    cells = {(r["outcome"], r["predicted"]): r["n"] for r in evaluate.confusion(scored).collect()}
    assert report[1]["misses"] == cells.get((1, 0), 0) and report[0]["misses"] == cells.get((0, 1), 0)
    shares = evaluate.confusion(scored).groupBy("outcome").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-9 for r in shares)


def test_auc_counts_ties_half(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4), (1, 0.05)]
    df = spark.createDataFrame(data, "outcome int, score double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / 9
    assert auc(df) == pytest.approx(want)
    last = evaluate.roc_curve(df).orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)


def test_grid_search_ranks_settings(rows):
    best, table = models.cross_validate(rows, FEATURES, "logistic", {"regParam": [0.01, 100.0]}, folds=3)
    scores = [r["mean_score"] for r in table.collect()]
    assert scores == sorted(scores, reverse=True) and len(scores) == 2
    assert best.coefficients.size == 3


def test_elimination_keeps_the_strong_feature_longest(rows):
    steps = models.eliminate_features(rows, FEATURES, folds=3)
    assert [r["n_features"] for r in steps.orderBy(F.desc("n_features")).collect()] == [3, 2, 1]
    assert steps.filter("n_features = 1").first()["features"] == ["a"]
    ranks = {r["feature"]: r["rank"] for r in models.feature_ranking(steps).collect()}
    assert ranks["a"] == 1 and set(ranks) == set(FEATURES)


def test_importance_ranks_the_strong_feature_first(spark, rows):
    logistic = models.fit(rows, FEATURES)
    assert models.coefficient_importance(logistic, rows, FEATURES).first()["feature"] == "a"
    forest = models.fit(rows, FEATURES, "forest", numTrees=10)
    table = models.tree_importance(forest, spark, FEATURES).collect()
    assert table[0]["feature"] == "a" and table[0]["std"] >= 0
    assert sum(r["importance"] for r in table) == pytest.approx(1)


def test_early_stopping_and_curves(rows):
    assert auc(models.score(models.fit_boosted(rows, FEATURES, maxIter=5, maxDepth=2), rows)) > 0.8
    curve = evaluate.learning_curve(rows, FEATURES, shares=(0.5, 1.0), folds=2).collect()
    assert len(curve) == 4 and all(0 <= r["mean_accuracy"] <= 1 for r in curve)
    summary = evaluate.fold_rmse(rows, FEATURES, "tree", folds=3, maxDepth=2).first()
    assert summary["folds"] == 3 and summary["mean_rmse"] < 0.6


def test_recalibration_is_monotone(rows):
    scored = models.score(models.fit(rows, FEATURES, "forest", numTrees=10), rows)
    out = evaluate.calibrated(evaluate.recalibrate(scored), scored).orderBy("score").collect()
    values = [r["calibrated"] for r in out]
    assert values == sorted(values)


def test_what_if_scores_each_drug_once(rows):
    drugs = ["x y", "z"]
    flagged = rows.withColumns({"x y": (F.col("enc_id") % 2).cast("int"), "z": F.lit(0)})
    trained = flagged.withColumn("z", (F.col("a") > 1).cast("int"))
    model = models.fit(trained, [*FEATURES, *drugs])
    out = evaluate.evaluate_risk(model, flagged, drugs)
    assert out.count() == 480
    one = out.filter("enc_id = 3").orderBy("position").collect()
    assert [r["position"] for r in one] == [1, 2] and one[0]["probability"] >= one[1]["probability"]
    band = evaluate.risk_band(F.col("p"))
    df = rows.sparkSession.createDataFrame([(0.40,), (0.41,), (0.60,)], "p double")
    assert [r[0] for r in df.select(band).collect()] == ["low", "moderate", "high"]


@pytest.fixture(scope="module")
def dataset(rows):
    gap = F.pmod(F.xxhash64("enc_id"), F.lit(10)) == 0
    return rows.withColumns({
        "expire": (F.col("enc_id") % 3 == 0).cast("int"), "b": F.when(~gap, F.col("b")),
    })


@pytest.mark.parametrize("strategy", ["nearest", "median"])
@pytest.mark.parametrize("under,total", [(True, 120), (False, 360)])
def test_prepare_balances_splits_scales_and_fills(dataset, strategy, under, total):
    p = prepare(dataset, FEATURES, under=under, strategy=strategy)
    train, test = p.train.count(), p.test.count()
    assert train + test == total and test == total // 5
    for df in (p.train, p.test):
        assert df.filter(F.col("a").isNull() | F.col("b").isNull()).count() == 0
        sizes = {r["count"] for r in df.groupBy("outcome").count().collect()}
        assert len(sizes) == 1
    assert p.scaler.binary == ["c"]
    mean = p.train.agg(F.avg("a")).first()[0]
    assert abs(mean) < 1e-9


def test_prepare_four_classes(dataset):
    p = prepare(dataset, FEATURES, four_classes=True, strategy="median")
    labels = {r["outcome"] for r in p.train.select("outcome").distinct().collect()}
    assert labels == {0, 1, 2, 3}


def test_boosted_grid_by_recall(rows):
    _, table = models.cross_validate(rows, FEATURES, "boosted", {"maxDepth": [2], "minInstancesPerNode": [1, 5]},
                                     metric="recallByLabel", folds=2, fixed={"maxIter": 3})
    assert table.count() == 2 and 0 <= table.first()["mean_score"] <= 1


class Called(Exception):
    pass


@pytest.mark.parametrize("name,owner,function,expected", [
    ("grid_search", models, "cross_validate", {"folds": 5, "fixed": {"numTrees": 250}}),
    ("learning_curve", evaluate, "learning_curve", {}),
    ("fold_rmse", evaluate, "fold_rmse", {"folds": 10}),
    ("fit_gbt", models, "fit_boosted", {}),
    ("fit_forest", models, "fit", {}),
    ("fit_svm", models, "fit", {}),
    ("importance", models, "fit", {}),
    ("recalibration", models, "fit", {}),
])
def test_queries_fit_all_features_with_the_scripts_settings(spark, monkeypatch, name, owner, function, expected):
    features = [f"f{i}" for i in range(20)]
    train = MagicMock()
    train.count.return_value = 240

    def called(df, columns, *args, **params):
        if "logistic" not in args or function != "fit":
            raise Called(columns, args, params)

    monkeypatch.setattr(model_queries, "prepared", lambda r: SimpleNamespace(train=train, test=train, features=features))
    monkeypatch.setattr(owner, function, called)
    with pytest.raises(Called) as error:
        QUERIES[name](spark, "/root/testdata/sf0.001")
    columns, args, params = error.value.args
    assert columns == features and params == expected
    if function == "cross_validate":
        assert [len(x) for x in args[1].values()] == [3, 3]
