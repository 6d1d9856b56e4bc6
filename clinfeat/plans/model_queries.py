"""Named queries that fit or evaluate models over the test tables.

Queries over a fixed score column have an oracle; those that fit a model do not.
"""

from pyspark.sql import DataFrame, functions as F

from clinfeat.codes.values import DRUG_FEATURES
from clinfeat.functions.numbers import combined_label
from clinfeat.learning import evaluate, models, monotone, trees
from clinfeat.operators import meds
from clinfeat.plans import dataset as plans
from clinfeat.plans.catalogue import (
    TEST_FEATURES, classified, codes, query, rounded, sources, staged_info,
)
from clinfeat.sources import stages
from clinfeat.sources.retail import Retail


def scored_stays(r: Retail) -> DataFrame:
    """Every stay with a fixed score; equal scores occur often."""
    score = F.pmod(F.col("enc_id") * 7919, F.lit(1009)) / F.lit(1009.0) * 0.7 + F.col("expire") * 0.3
    return r.enc.select("enc_id", F.col("expire").alias("outcome"), F.round(score, 4).alias("score")).withColumn(
        "prediction", (F.col("score") >= 0.5).cast("int")
    )


@query
def confusion_shares(r):
    return rounded(evaluate.confusion(scored_stays(r)), ["share"])


@query
def oof_report(r):
    report = evaluate.classification_report(scored_stays(r))
    return rounded(report, ["precision", "recall", "f1", "accuracy"])


@query
def roc_points(r):
    points = evaluate.roc_curve(scored_stays(r))
    return rounded(points.select("threshold", "fpr", "tpr", "cum_pos", "cum_neg"), ["threshold", "fpr", "tpr"])


@query
def roc_auc(r):
    return rounded(evaluate.roc_auc(scored_stays(r)), ["auc"])


@query
def score_quadrants(r):
    return evaluate.score_quadrants(scored_stays(r))


@query
def calibration(r):
    return rounded(evaluate.calibration_curve(scored_stays(r)), ["mean_score", "event_rate"])


CLASS_SCORES = [f"score{k}" for k in range(4)]


def class_scored_stays(r: Retail) -> DataFrame:
    """Every stay with one of four classes, a fixed score for each class, and the class of the highest one."""
    label = combined_label((F.col("enc_id") % 3 == 0).cast("int"), F.col("expire")).cast("int")
    rows = r.enc.select("enc_id", label.alias("outcome")).withColumns({
        c: F.round(F.pmod(F.col("enc_id") * (7919 + 101 * k), F.lit(211)) / F.lit(211.0) + F.when(F.col("outcome") == k, 0.4).otherwise(0.0), 4)
        for k, c in enumerate(CLASS_SCORES)
    })
    highest = F.array_max(F.array(*[F.struct(F.col(c).alias("s"), F.lit(-k).alias("k")) for k, c in enumerate(CLASS_SCORES)]))
    return rows.withColumn("prediction", -highest["k"])


@query
def class_report(r):
    report = evaluate.classification_report(class_scored_stays(r), classes=(0, 1, 2, 3))
    return rounded(report, ["precision", "recall", "f1", "accuracy"])


@query
def class_roc(r):
    points = evaluate.class_roc(class_scored_stays(r), CLASS_SCORES)
    return rounded(points.select("class", "threshold", "fpr", "tpr", "cum_pos", "cum_neg"), ["threshold", "fpr", "tpr"])


@query
def class_auc(r):
    return rounded(evaluate.class_auc(class_scored_stays(r), CLASS_SCORES), ["auc"])


@query
def fit_four_classes(r):
    """Four classes (outcome and death): prepared, fitted with balanced classes, the held-out rows scored."""
    p = plans.prepare(staged_dataset(r), TEST_FEATURES, four_classes=True)
    scored = models.score_classes(models.fit_classes(p.train, p.features), p.test)
    return scored.select("enc_id", "outcome", "prediction", *[F.round(c, 6).alias(c) for c in CLASS_SCORES])


@query
def monotone_steps(r):
    """Event rates of score ranges, pooled until they rise."""
    return rounded(monotone.monotone_steps(scored_stays(r), bins=100), ["rate"])


@query
def slice_rmse(r):
    scored = scored_stays(r).filter(F.col("score") < 0.25)
    return rounded(evaluate.rmse(scored, value="score"), ["rmse"])


@query
def what_if(r):
    """Ranked drugs of every stay under a fixed logistic formula over its drug flags."""
    profiles = r.enc.select("enc_id", (F.pmod(F.col("enc_id"), F.lit(17)) / 10.0).alias("base"))
    rows = evaluate.what_if_rows(profiles)
    z = F.col("base") - 1.0
    for i, drug in enumerate(DRUG_FEATURES):
        z = z + F.col(f"`{drug}`") * F.lit(round(0.07 * (i + 1) - 0.5, 2))
    scored = rows.withColumn("score", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6))
    return evaluate.what_if(scored)


# Fitted models

STAGED = {}


def prepared(r: Retail, strategy: str = "median") -> plans.Prepared:
    """Model input with drug flags. The written stages are shared by the queries of a session."""
    key = (r.spark.sparkContext.applicationId, r.folder, strategy)
    if key not in STAGED:
        dataset = staged_dataset(r)
        flags = plans.drug_features(sources(r), codes(r), dataset, shared_info(r))
        STAGED[key] = plans.prepare(dataset, TEST_FEATURES, flags, strategy=strategy)
    return STAGED[key]


def shared_info(r: Retail) -> DataFrame:
    """The stays, written once a session."""
    key = (r.spark.sparkContext.applicationId, r.folder, "info")
    if key not in STAGED:
        STAGED[key] = staged_info(r)
    return STAGED[key]


def staged_dataset(r: Retail) -> DataFrame:
    """The labelled dataset, written once a session."""
    key = (r.spark.sparkContext.applicationId, r.folder)
    if key not in STAGED:
        STAGED[key] = stages.materialize(plans.build_dataset(sources(r), codes(r), shared_info(r)), "dataset")
    return STAGED[key]


@query
def prepared_rows(r):
    p = prepared(r, "nearest")
    return p.train.withColumn("part", F.lit("train")).unionByName(p.test.withColumn("part", F.lit("test")))


@query
def prepared_drugs_only(r):
    dataset = r.enc.select("enc_id", F.col("expire").alias("outcome"))
    flags = meds.multi_hot_drugs(dataset, meds.early(classified(r)))
    p = plans.prepare(dataset, drugs=flags, only_drugs=True)
    return p.train.withColumn("part", F.lit("train")).unionByName(p.test.withColumn("part", F.lit("test")))


def fitted(r: Retail, model: str, **params) -> DataFrame:
    """Fit, save, load, and score the held-out rows with the loaded model."""
    p = prepared(r)
    path = stages.new_path(r.spark, f"model-{model}")
    stages.save_model(models.fit(p.train, p.features, model, **params), path)
    scored = models.score(stages.load_model(path), p.test)
    return scored.select("enc_id", "outcome", "prediction", F.round("score", 6).alias("score"))


@query
def fit_logistic(r):
    return fitted(r, "logistic")


@query
def fit_forest(r):
    return fitted(r, "forest")


@query
def fit_svm(r):
    return fitted(r, "svm")


@query
def fit_tree_regressor(r):
    return fitted(r, "tree")


@query
def fit_gbt(r):
    p = prepared(r)
    model = models.fit_boosted(p.train, p.features)
    return models.score(model, p.test).select("enc_id", "outcome", "prediction", "score")


@query
def boosting_rounds(r):
    """Rounds of boosting by five folds, stopped a hundred rounds after the smallest error."""
    p = prepared(r)
    settings = {"stepSize": 0.06, "maxDepth": 6, "subsamplingRate": 1.0, "featureSubsetStrategy": "all", "minInstancesPerNode": 1}
    return trees.boosting_rounds(p.train, p.features, folds=5, most=2000, patience=100, **settings)


@query
def boosted_recall_grid(r):
    p = prepared(r)
    fixed = {"maxIter": 100, "stepSize": 0.06, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
    grid = {"maxDepth": [6], "minInstancesPerNode": [1]}
    return models.cross_validate(p.train, p.features, "boosted", grid, metric="recallByLabel", folds=5, parallelism=1, fixed=fixed)[1]


@query
def split_counts(r):
    """How often the boosted trees split on each feature."""
    p = prepared(r)
    return trees.split_counts(trees.tree_table(models.fit(p.train, p.features, "boosted"), r.spark, p.features))


@query
def cv_regularisation(r):
    """Ten inverse strengths from 1e-4 to 1e4."""
    p = prepared(r)
    return models.regularisation_path(p.train, p.features, [10 ** (-4 + 8 * i / 9) for i in range(10)], folds=3)[0]


@query
def grid_search(r):
    p = prepared(r)
    grid = {"maxDepth": [4, 10, 20], "minInstancesPerNode": [1, 3, 10]}
    return models.cross_validate(p.train, p.features, "forest", grid, folds=5, fixed={"numTrees": 250})[1]


@query
def feature_elimination(r):
    p = prepared(r)
    eliminated = models.eliminate_features(p.train, p.features, folds=3)
    return models.feature_ranking(eliminated)


@query
def out_of_fold_fit(r):
    p = prepared(r)
    scored = evaluate.out_of_fold(p.train, p.features, "logistic", folds=5)
    return evaluate.classification_report(scored)


@query
def learning_curve(r):
    p = prepared(r)
    return evaluate.learning_curve(p.train, p.features, "logistic")


@query
def fold_rmse(r):
    p = prepared(r)
    return evaluate.fold_rmse(p.train, p.features, "tree", folds=10)


@query
def importance(r):
    p = prepared(r)
    logistic = models.fit(p.train, p.features, "logistic")
    forest = models.fit(p.train, p.features, "forest")
    by_coefficient = models.coefficient_importance(logistic, p.train, p.features).select(
        "feature", "importance", F.lit("coefficient").alias("kind"), F.lit(None).cast("double").alias("std")
    )
    by_tree = models.tree_importance(forest, r.spark, p.features).select(
        "feature", "importance", F.lit("tree").alias("kind"), "std"
    )
    return by_coefficient.unionByName(by_tree)


@query
def recalibration(r):
    p = prepared(r)
    held_out, rest = p.train.filter(models.fold("enc_id", 4) == 0), p.train.filter(models.fold("enc_id", 4) != 0)
    forest = models.fit(rest, p.features, "forest")
    sigmoid = evaluate.recalibrate(models.score(forest, held_out))
    scored = evaluate.calibrated(sigmoid, models.score(forest, p.test))
    return scored.select("enc_id", "outcome", "score", "calibrated")


@query
def what_if_fitted(r):
    p = prepared(r)
    model = models.fit(p.train, p.features, "logistic")
    return evaluate.evaluate_risk(model, p.test)
