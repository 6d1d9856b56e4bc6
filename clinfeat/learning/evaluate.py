"""Evaluation of scored rows, and what-if scoring. Scores and labels are plain columns."""

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clinfeat.codes.values import DRUG_FEATURES
from clinfeat.functions.numbers import histogram_bin, percent
from clinfeat.learning.grown import FoldRows, as_is
from clinfeat.learning.models import LABEL, fit, fold, score, together, without_gaps
from clinfeat.learning.monotone import smoothed_targets
from clinfeat.learning.newton import Fit, Rows, grouped_auc
from clinfeat.operators.ordered import running_totals

KINDS = {(1, 1): "true_pos", (0, 0): "true_neg", (0, 1): "false_pos", (1, 0): "false_neg"}


def out_of_fold(df: DataFrame, features: list[str], model: str = "logistic", folds: int = 5,
                **params) -> DataFrame:
    """Every row scored by a model that was fitted without its fold. Plain logistic models are fitted together (``newton``), plain trees
    are grown together (``grown``)."""
    folded = df.withColumn("_fold", fold("enc_id", folds))
    if together(df, model, params):
        rows = Rows(folded.withColumns(without_gaps(features)), features, LABEL, F.col("_fold"))
        fits = [Fit(tuple(range(len(features))), k) for k in range(folds)]
        rows.solve(fits)
        return with_scores(folded, features, fits)
    if model == "tree" and not params and plain_labels(folded):
        return with_tree_scores(folded, features, folds)
    parts = []
    for k in range(folds):
        fitted = fit(folded.filter(F.col("_fold") != k), features, model, **params)
        parts.append(score(fitted, folded.filter(F.col("_fold") == k)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def with_scores(folded: DataFrame, features: list[str], fits: list[Fit]) -> DataFrame:
    """Add ``prediction`` and ``score`` of the fit that leaves out the row's ``_fold``; ``fits``: one a fold, in order."""
    def own(i):
        return F.element_at(F.array(*[F.lit(float(f.beta[i])) for f in fits]), F.col("_fold") + 1)

    cells = without_gaps(features)
    products = [cells[c] * own(i) for i, c in enumerate(features)] + [own(len(features))]
    z = F.aggregate(F.array(*products), F.lit(0.0), lambda a, v: a + v)
    return folded.withColumn("_z", z).withColumns({
        "prediction": (F.col("_z") > 0).cast("double"), "score": F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z"))),
    }).drop("_z")


def plain_labels(folded: DataFrame) -> bool:
    """No label is missing, and every fold has rows outside it."""
    y = F.col(LABEL).cast("double")
    found = folded.agg(F.count_if(y.isNull() | F.isnan(y)).alias("gaps"), F.count_distinct("_fold").alias("folds")).first()
    return not found["gaps"] and found["folds"] > 1


def with_tree_scores(folded: DataFrame, features: list[str], folds: int, depth: int = 5, least: int = 1) -> DataFrame:
    """Add ``prediction`` and ``score`` of the regression tree that leaves out the row's ``_fold``."""
    cells = without_gaps(features)
    rows = FoldRows(folded, features, LABEL, F.col("_fold"), folds, cells)
    try:
        trees, _ = rows.grow(rows.blocks, depth, least, as_is)
    finally:
        rows.free()

    @F.pandas_udf("double")
    def predicted(fold: pd.Series, x: pd.Series) -> pd.Series:
        at, values = fold.to_numpy(), np.stack(x.to_numpy()) if len(x) else np.zeros((0, len(features)))
        out = np.zeros(len(at))
        for k in np.unique(at):
            own = at == k
            out[own] = trees[k].value[trees[k].places(values[own], trees[k].threshold)]
        return pd.Series(out)

    kept = folded.where(F.col("_fold").isNotNull())
    return kept.withColumn("prediction", predicted("_fold", F.array(*[cells[c] for c in features]))).withColumn("score", F.col("prediction"))


def confusion(scored: DataFrame, label: str = LABEL, predicted: str = "prediction") -> DataFrame:
    """Counts and row-normalised shares of (label, prediction)."""
    cells = scored.groupBy(label, F.col(predicted).cast("int").alias("predicted")).agg(
        F.count("*").alias("n")
    )
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(label)))


def classification_report(scored: DataFrame, label: str = LABEL, predicted: str = "prediction",
                          classes: tuple = (0, 1)) -> DataFrame:
    """Precision, recall, F1 and support per class, with the overall accuracy; one aggregation."""
    y, p = F.col(label), F.col(predicted)

    def total(condition):
        return F.sum(F.when(condition, 1).otherwise(0))

    one = scored.agg(
        F.avg(F.when(y == p, 1.0).otherwise(0.0)).alias("accuracy"),
        *[total((y == c) & (p == c)).alias(f"hit{c}") for c in classes],
        *[total(y == c).alias(f"true{c}") for c in classes],
        *[total(p == c).alias(f"said{c}") for c in classes],
    )
    rows = one.select("accuracy", F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(f"hit{c}").alias("hit"),
                 F.col(f"said{c}").alias("said"), F.col(f"true{c}").alias("support"))
        for c in classes
    ])))
    precision = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("said")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit").cast("double"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * precision * recall, precision + recall), F.lit(0.0))
    return rows.select(
        "class", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support",
        (F.col("said") - F.col("hit")).alias("false_alarms"),
        (F.col("support") - F.col("hit")).alias("misses"), "accuracy",
    )


def roc_curve(scored: DataFrame, label: str = LABEL, value: str = "score") -> DataFrame:
    """One point per distinct score, highest first: rates of rows at or above it."""
    y = F.col(label).cast("int")
    per_score = scored.groupBy((-F.col(value)).alias("_neg")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    total = scored.agg(F.sum(y).cast("double").alias("p"), F.sum(1 - y).cast("double").alias("n"))
    run = running_totals(per_score, [], "_neg", ["pos", "neg"])
    return run.select(
        (-F.col("_neg")).alias("threshold"),
        F.try_divide(F.col("cum_neg"), total.select("n").scalar()).alias("fpr"),
        F.try_divide(F.col("cum_pos"), total.select("p").scalar()).alias("tpr"),
        "pos", "neg", "cum_pos", "cum_neg",
    )


def roc_auc(scored: DataFrame, label: str = LABEL, value: str = "score") -> DataFrame:
    """Area under the curve: pairs ranked right, equal scores counting half."""
    curve = roc_curve(scored, label, value)
    right = F.col("neg") * (F.col("cum_pos") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0
    return curve.agg(
        F.try_divide(F.sum(right), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def one_against_rest(scored: DataFrame, scores: list[str], label: str = LABEL) -> DataFrame:
    """(class, label, score): a row for each class, whose label is 1 where the row is of the class; ``scores``: the column of each class."""
    cells = [
        F.struct(F.lit(k).alias("class"), (F.col(label) == k).cast("int").alias("label"), F.col(f"`{c}`").cast("double").alias("score"))
        for k, c in enumerate(scores)
    ]
    return scored.where(F.col(label).isNotNull()).select(F.inline(F.array(*cells))).where("score IS NOT NULL")


def class_roc(scored: DataFrame, scores: list[str], label: str = LABEL) -> DataFrame:
    """(class, threshold, fpr, tpr, pos, neg, cum_pos, cum_neg): the curve of each class against the rest, all in one pass over the rows."""
    counts = one_against_rest(scored, scores, label).groupBy("class", (-F.col("score")).alias("_neg")).agg(
        F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")
    )
    run = running_totals(counts, ["class"], "_neg", ["pos", "neg"])
    totals = counts.groupBy("class").agg(F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n"))
    return run.join(F.broadcast(totals), "class").select(  # a row a class
        "class", (-F.col("_neg")).alias("threshold"), F.try_divide(F.col("cum_neg"), F.col("n")).alias("fpr"),
        F.try_divide(F.col("cum_pos"), F.col("p")).alias("tpr"), "pos", "neg", "cum_pos", "cum_neg",
    )


def class_auc(scored: DataFrame, scores: list[str], label: str = LABEL) -> DataFrame:
    """(class, auc) of each class against the rest."""
    return grouped_auc(one_against_rest(scored, scores, label), ["class"])


def quadrant(label: Column, predicted: Column) -> Column:
    kind = F.lit(None).cast("string")
    for (y, p), name in KINDS.items():
        kind = F.when((label == y) & (predicted == p), name).otherwise(kind)
    return kind


def score_quadrants(scored: DataFrame, label: str = LABEL, predicted: str = "prediction",
                    value: str = "score", bins: int = 19) -> DataFrame:
    """Histogram of scores over [0, 1] by true / false positive / negative."""
    b = histogram_bin(F.col(value), F.lit(0.0), F.lit(1.0), bins)
    return (
        scored.withColumn("kind", quadrant(F.col(label), F.col(predicted)))
        .withColumn("bin", b)
        .filter(F.col("bin").isNotNull())
        .groupBy("kind", "bin")
        .agg(F.count("*").alias("n"))
    )


def calibration_curve(scored: DataFrame, label: str = LABEL, value: str = "score",
                      bins: int = 11) -> DataFrame:
    """Mean score and event rate per equal-width bin; empty bins have no row."""
    b = histogram_bin(F.col(value), F.lit(0.0), F.lit(1.0), bins)
    return scored.groupBy(b.alias("bin")).agg(
        F.avg(value).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("event_rate"),
        F.count("*").alias("n"),
    )


def recalibrate(held_out: DataFrame, label: str = LABEL, value: str = "score") -> PipelineModel:
    """A sigmoid over the score, fitted on held-out rows with smoothed targets, without penalty."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=[value], outputCol="_score_vector"),
        LogisticRegression(featuresCol="_score_vector", labelCol="target", weightCol="weight", probabilityCol="_p",
                           rawPredictionCol="_raw", predictionCol="_prediction"),
    ]).fit(smoothed_targets(held_out.select(label, value), label))


def calibrated(model: PipelineModel, scored: DataFrame) -> DataFrame:
    out = model.transform(scored).withColumn("calibrated", vector_to_array("_p")[1])
    return out.drop("_score_vector", "_p", "_raw", "_prediction")


def learning_curve(df: DataFrame, features: list[str], model: str = "logistic",
                   shares=(0.1, 0.325, 0.55, 0.775, 1.0), folds: int = 5, **params) -> DataFrame:
    """Accuracy on training and held-out rows for growing shares of the training rows.

    A share is a prefix of the hash order, so larger shares contain the smaller ones. Plain logistic models of all shares and folds
    are fitted together and scored in one pass (``newton``).
    """
    position = F.conv(F.substring(F.md5(F.col("enc_id").cast("string")), 1, 8), 16, 10).cast("double")
    folded = df.withColumn("_fold", fold("enc_id", folds)).withColumn("_at", position / F.lit(16.0 ** 8))
    if together(df, model, params):
        limits = [float(s) for s in shares]
        rows = Rows(folded.withColumns(without_gaps(features)), features, LABEL, F.col("_fold"), position=F.col("_at"), shares=limits)
        fits = [Fit(tuple(range(len(features))), k, share=s) for s in limits for k in range(folds)]
        rows.solve(fits)
        share_of = df.sparkSession.createDataFrame([(i, f.share) for i, f in enumerate(fits)], "fit int, share double")
        accuracy = F.try_divide(F.col("right").cast("double"), F.col("n"))
        return rows.hits(fits).join(F.broadcast(share_of), "fit").groupBy(  # two rows a fit
            "share", F.when(F.col("held_out"), "held_out").otherwise("train").alias("part")
        ).agg(F.avg(accuracy).alias("mean_accuracy"), F.stddev_pop(accuracy).alias("std_accuracy"))
    parts = []
    for share in shares:
        for k in range(folds):
            train = folded.filter((F.col("_fold") != k) & (F.col("_at") < share))
            fitted = fit(train, features, model, **params)
            for name, rows in (("train", train), ("held_out", folded.filter(F.col("_fold") == k))):
                hit = F.avg((F.col(LABEL) == F.col("prediction")).cast("double"))
                parts.append(score(fitted, rows).agg(
                    F.lit(float(share)).alias("share"), F.lit(name).alias("part"), hit.alias("accuracy")
                ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("share", "part").agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("std_accuracy")
    )


def rmse(scored: DataFrame, label: str = LABEL, value: str = "prediction") -> DataFrame:
    error = F.col(value).cast("double") - F.col(label).cast("double")
    return scored.agg(F.sqrt(F.avg(error * error)).alias("rmse"), F.count("*").alias("n"))


def fold_rmse(df: DataFrame, features: list[str], model: str = "tree", folds: int = 10,
              **params) -> DataFrame:
    """Mean and deviation of the error over the folds."""
    scored = out_of_fold(df, features, model, folds, **params)
    error = F.col("prediction").cast("double") - F.col(LABEL).cast("double")
    per_fold = scored.groupBy("_fold").agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    return per_fold.agg(
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
        F.count("*").alias("folds"),
    )


def what_if_rows(profiles: DataFrame, drugs=DRUG_FEATURES) -> DataFrame:
    """Each profile once per drug, with that drug's flag set and the others zero."""
    expanded = profiles.withColumn("drug", F.explode(F.array(*[F.lit(d) for d in drugs])))
    return expanded.withColumns({d: F.when(F.col("drug") == d, 1).otherwise(0) for d in drugs})


def risk_band(highest: Column) -> Column:
    return F.when(highest <= 0.40, "low").when(highest < 0.60, "moderate").otherwise("high")


def what_if(scored_rows: DataFrame, id_col: str = "enc_id", value: str = "score") -> DataFrame:
    """Ranked drugs per profile with the risk band of the highest score.

    The window holds one row per drug of the fixed list.
    """
    profile = W.partitionBy(id_col)
    ranked = profile.orderBy(F.desc(value), "drug")
    return scored_rows.select(
        id_col, "drug", F.col(value).alias("probability"),
        F.row_number().over(ranked).alias("position"),
        risk_band(F.max(value).over(profile)).alias("risk"),
    ).withColumn("shown", percent(F.col("probability")))


def evaluate_risk(model: PipelineModel, profiles: DataFrame, drugs=DRUG_FEATURES) -> DataFrame:
    return what_if(score(model, what_if_rows(profiles, drugs)))
