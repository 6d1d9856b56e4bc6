"""Model fitting: every fit aggregates on the executors, only the model comes back. Searches over logistic fits are in ``newton``."""

from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from clinfeat.codes.values import SEED
from clinfeat.learning import forest, newton
from clinfeat.operators.ordered import hash_order
from clinfeat.sources.stages import materialize

LABEL = "outcome"
FEW = 2_000  # rows up to which every setting of a grid of forests is a fit of its own
LARGE = 500_000  # rows from which a forest's trees are grown in tasks of their own

ESTIMATORS = {
    "logistic": lambda **p: LogisticRegression(
        labelCol=LABEL, weightCol="_weight", **{"standardization": False, "maxIter": 500, "tol": 1e-12, **p}
    ),
    "forest": lambda **p: RandomForestClassifier(
        labelCol=LABEL, seed=SEED, **{"numTrees": 250, "maxDepth": 10, "minInstancesPerNode": 10, **p}
    ),
    "svm": lambda **p: LinearSVC(labelCol=LABEL, **p),
    "tree": lambda **p: DecisionTreeRegressor(labelCol=LABEL, seed=SEED, **p),
    "boosted": lambda **p: GBTClassifier(
        labelCol=LABEL, seed=SEED,
        **{"maxDepth": 5, "stepSize": 0.1, "maxIter": 48, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 4, **p}
    ),
}


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features")


def with_class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """n / (number of classes x size of the class), in ``_weight``."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    share = sizes.agg(F.sum("_n") / F.count("*")).scalar()
    weights = sizes.select(label, (share / F.col("_n")).alias("_weight"))
    return df.join(F.broadcast(weights), label)


class LogisticModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """Scores ``features`` by given coefficients, with the columns of MLlib's binary logistic model; saved and loaded in pipelines."""

    values = Param(Params._dummy(), "values", "a coefficient for each feature, then the intercept", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, coefficients: list[float] | None = None, intercept: float = 0.0):
        super().__init__()
        if coefficients is not None:
            self._set(values=[*coefficients, intercept])

    @property
    def coefficients(self):
        return Vectors.dense(self.getOrDefault(self.values)[:-1])

    @property
    def intercept(self) -> float:
        return self.getOrDefault(self.values)[-1]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = F.array(*[F.lit(float(v)) for v in self.coefficients])
        products = F.zip_with(vector_to_array("features"), weights, lambda x, w: x * w)
        out = dataset.withColumn("_z", F.aggregate(products, F.lit(self.intercept), lambda a, v: a + v))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_z")))
        return out.withColumns({
            "rawPrediction": array_to_vector(F.array(-F.col("_z"), F.col("_z"))), "probability": array_to_vector(F.array(1 - p, p)),
            "prediction": (F.col("_z") > 0).cast("double"),
        }).drop("_z")


def together(df: DataFrame, model: str, params: dict) -> bool:
    """Can the fits be solved in one pass for each step: a plain logistic model of the labels 0 and 1?"""
    if model != "logistic" or params:
        return False
    labels = df.where(F.col(LABEL).isNotNull()).agg(F.count_distinct(LABEL).alias("n"), F.min(LABEL).alias("low"), F.max(LABEL).alias("high")).first()
    return (labels["n"], labels["low"], labels["high"]) == (2, 0, 1)


def without_gaps(features: list[str]) -> dict[str, Column]:
    """The features as doubles; a missing one fails, as it does in a fit."""
    def checked(c):
        v = F.col(f"`{c}`").cast("double")
        return F.when(v.isNull() | F.isnan(v), F.raise_error(f"{c} has missing values").cast("double")).otherwise(v)

    return {c: checked(c) for c in features}


def estimator(model: str, **params):
    if model not in ESTIMATORS:
        raise ValueError(f"unknown model {model!r}; one of {sorted(ESTIMATORS)}")
    return ESTIMATORS[model](**params)


def gathered(df: DataFrame, rows_each: int = 500_000, least: int = 4) -> DataFrame:
    """The rows in no more partitions than they need: every partition sends the sums of all nodes, features and bins through a shuffle
    (about a gigabyte for 250 full trees of depth 10), however few rows it has. Nothing is moved for it."""
    return df.coalesce(max(least, -(-df.count() // rows_each)))


def fit(df: DataFrame, features: list[str], model: str = "logistic", **params) -> PipelineModel:
    """Fit one of ``ESTIMATORS`` on the feature columns.

    The logistic model balances the classes and has an L2 penalty of 1 on the coefficients as they are, unless ``regParam`` says
    otherwise (MLlib's is per unit of weight, and the weights sum up to the number of rows). Without settings it is solved by Newton steps
    (``newton``): about ten passes over the rows, where L-BFGS on columns as they are takes up to its 500. Forests of many rows are
    grown a tree a task (``forest``).
    """
    if together(df, model, params):
        one = newton.fit(df.withColumns(without_gaps(features)), features, LABEL)
        return PipelineModel([assembler(features), LogisticModel(coefficients=one.beta[:-1].tolist(), intercept=float(one.beta[-1]))])
    if model == "logistic":
        df = with_class_weights(df)
        params = {"regParam": 1.0 / max(1, df.count()), **params}
    if model == "forest" and df.count() > LARGE and forest.can_grow(df, LABEL, len(features), params):
        rows = forest.Rows(df, LABEL, "enc_id", without_gaps(features))
        try:
            return PipelineModel([assembler(features), forest.model(rows, estimator(model, **params), len(features), df.sparkSession)])
        finally:
            rows.free()
    if model in ("forest", "boosted"):
        df = gathered(df)
    stage = estimator(model, **params)
    return Pipeline(stages=[assembler(features), stage]).fit(df)


def fit_boosted(df: DataFrame, features: list[str], validation_share: int = 5, **params) -> PipelineModel:
    """Boosted trees that stop early on a held-out share (one in ``validation_share`` rows)."""
    marked = df.withColumn("_validation", fold("enc_id", validation_share) == 0)
    return fit(marked, features, "boosted", validationIndicatorCol="_validation", **params)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``score`` (probability of the outcome) and ``prediction``."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    elif "rawPrediction" in out.columns:
        out = out.withColumn("score", vector_to_array("rawPrediction")[1])
    else:
        out = out.withColumn("score", F.col("prediction"))
    return out.drop("features", "rawPrediction", "probability", "_weight")


def fit_classes(df: DataFrame, features: list[str], **params) -> PipelineModel:
    """A multinomial logistic model of the classes 0, 1, ... with balanced classes and the penalty of ``fit``."""
    stage = LogisticRegression(labelCol=LABEL, weightCol="_weight", family="multinomial", **{
        "standardization": False, "maxIter": 500, "tol": 1e-9, "regParam": 1.0 / max(1, df.count()), **params,
    })
    return Pipeline(stages=[assembler(features), stage]).fit(with_class_weights(df))


def score_classes(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and the probability of each class as ``score0``, ``score1``, ..."""
    classes = model.stages[-1].numClasses
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    out = out.withColumns({f"score{k}": F.col("_p")[k] for k in range(classes)}).withColumn("prediction", F.col("prediction").cast("int"))
    return out.drop("features", "rawPrediction", "probability", "_p", "_weight")


def fold(id_col: str, folds: int, seed: int = SEED):
    """Repeatable fold number of a row."""
    h = F.conv(F.substring(hash_order(id_col, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(folds)).cast("int")


def _cells(features: list[str]) -> dict[str, Column]:
    """The features of assembled rows, which have no missing values."""
    x = vector_to_array("features")
    return {c: x[i] for i, c in enumerate(features)}


def _forest_scores(data: DataFrame, features: list[str], stage, settings: list[dict], evaluator, folds: int, pool) -> list[list[Future]]:
    """For each setting the score of each fold: one forest for each fold and least number of rows a leaf, cut at the depths asked for."""
    plans = [stage.copy(s) for s in settings]
    leasts = sorted({p.getMinInstancesPerNode() for p in plans})
    grown = [(sorted({p.getMaxDepth() for p in plans if p.getMinInstancesPerNode() == n}), n, forest.features_of_a_node(len(features))) for n in leasts]
    out = [[] for _ in settings]

    def judged(label, share):
        table = pa.table({LABEL: label.astype(float), "rawPrediction": share, "prediction": (share > 0.5).astype(float)})
        return evaluator.evaluate(data.sparkSession.createDataFrame(table))

    for k in range(folds):
        rows = forest.Rows(data, LABEL, "enc_id", _cells(features), F.col("_fold"), k)
        try:
            votes = forest.held_out_votes(rows, grown, stage.getSeed(), stage.getNumTrees())
        finally:
            rows.free()
        for own, p in zip(out, plans):
            own.append(pool.submit(judged, rows.held, votes[leasts.index(p.getMinInstancesPerNode()), p.getMaxDepth()]))
    return out


def _forest_model(data: DataFrame, features: list[str], stage) -> Model:
    rows = forest.Rows(data, LABEL, "enc_id", _cells(features))
    try:
        return forest.model(rows, stage, len(features), data.sparkSession)
    finally:
        rows.free()


def cross_validate(df: DataFrame, features: list[str], model: str, grid: dict[str, list],
                   metric: str = "areaUnderROC", folds: int = 5, parallelism: int = 4,
                   fixed: dict | None = None) -> tuple[Model, DataFrame]:
    """Grid search with hash folds. Returns the best model, fitted on all rows, and the ranked
    table of settings.

    ``parallelism`` fits run side by side, each fold and setting a fit of its own. Boosting has hundreds of short steps, one after the other,
    so there at least the folds do, and with a single setting the fit on all rows beside them. Forests of several depths and least rows
    a leaf share their trees (``forest``), unless there are few rows.
    """
    stage = estimator(model, **(fixed or {}))
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(stage.getParam(name), values)
    settings = builder.build()
    if metric in ("areaUnderROC", "areaUnderPR"):
        evaluator = BinaryClassificationEvaluator(labelCol=LABEL, metricName=metric)
    else:
        evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric, metricLabel=1.0)
    data = assembler(features).transform(
        with_class_weights(df).withColumn("_fold", fold("enc_id", folds))
    ).select("enc_id", LABEL, "features", "_weight", "_fold")
    data = data.persist()  # rows keep their partitions, which the trees' sampling goes by

    def judged(k: int, setting: dict) -> float:
        return evaluator.evaluate(stage.fit(data.where(F.col("_fold") != k), setting).transform(data.where(F.col("_fold") == k)))

    try:
        empty = set(range(folds)) - {r["_fold"] for r in data.select("_fold").distinct().collect()}
        if empty:
            raise ValueError(f"no rows in the folds {sorted(empty)}")
        with ThreadPoolExecutor(max(parallelism, folds + 1) if model == "boosted" else parallelism) as pool:
            shared = model == "forest" and set(grid) <= {"maxDepth", "minInstancesPerNode"} and data.count() > FEW
            shared = shared and forest.can_grow(data, LABEL, len(features), fixed or {})
            whole = pool.submit(stage.fit, data, settings[0]) if len(settings) == 1 and not shared else None  # the best one, whatever its score
            if shared:
                scores = _forest_scores(data, features, stage, settings, evaluator, folds, pool)
            else:
                scores = [[pool.submit(judged, k, s) for k in range(folds)] for s in settings]
            scores = np.array([[f.result() for f in own] for own in scores])
            means, spreads = scores.mean(1), scores.std(1)
            best = int(means.argmax() if evaluator.isLargerBetter() else means.argmin())
            if shared:
                best_model = _forest_model(data, features, stage.copy(settings[best]))
            else:
                best_model = whole.result() if whole else stage.fit(data, settings[best])
    finally:
        data.unpersist()
    rows = [
        (*[float(s[stage.getParam(n)]) for n in grid], float(mean), float(std))
        for s, mean, std in zip(settings, means, spreads)
    ]
    names = [*grid, "mean_score", "std_score"]
    table = df.sparkSession.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    return best_model, table.orderBy(F.desc("mean_score"), *names)


def eliminate_features(df: DataFrame, features: list[str], folds: int = 5, step: int = 1,
                       strength: float = 1.0) -> DataFrame:
    """Drop the weakest standardised coefficients, score the rest by cross-validation, repeat.

    Every fold drops its own features, judged by its training rows; its held-out rows give the accuracy of each size.
    One row per number of features: the mean accuracy, the features that all rows together keep, and those they drop next.
    ``strength`` is the inverse of the L2 penalty. All fits read the rows together (``newton``).
    """
    spread = df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(features)]).first()
    deviation = np.array([spread[f"s{i}"] or 0.0 for i in range(len(features))])
    rows = newton.Rows(df, features, LABEL, fold("enc_id", folds))
    paths = newton.elimination_path(rows, deviation, [-1, *rows.folds], step, strength)
    out = []
    for k, (kept, dropped) in enumerate(paths[-1]):
        scores = [paths[f][k][0].right / paths[f][k][0].held for f in rows.folds]
        names = [[features[c] for c in cells] for cells in (kept.columns, dropped)]
        out.append((len(kept.columns), float(np.mean(scores)) if scores else None, *names))
    return df.sparkSession.createDataFrame(
        out, "n_features int, mean_score double, features array<string>, dropped array<string>"
    )


def regularisation_path(df: DataFrame, features: list[str], strengths: list[float], folds: int = 3) -> tuple[DataFrame, newton.Fit]:
    """(inverse_strength, mean_score, std_score) of each inverse L2 penalty, best first, and the best one fitted on all rows.

    The score is the area under the curve of the held-out rows of each fold. All folds are solved together, and a strength starts from
    the sums of the one before. Equal scores: the smaller strength.
    """
    rows = newton.Rows(df, features, LABEL, fold("enc_id", folds))
    path = newton.penalty_path(rows, strengths, [-1, *rows.folds])
    fits = [f for own in path for f in own if f.held_out >= 0]
    number = df.sparkSession.createDataFrame([(i, f.strength) for i, f in enumerate(fits)], "fit int, inverse_strength double")
    aucs = newton.grouped_auc(rows.scored(fits), ["fit"]).join(F.broadcast(number), "fit")  # a row for each strength and fold
    table = aucs.groupBy("inverse_strength").agg(F.avg("auc").alias("mean_score"), F.stddev_pop("auc").alias("std_score"))
    table = materialize(table, "regularisation").orderBy(F.desc("mean_score"), "inverse_strength")
    best = table.first()["inverse_strength"]
    return table, next(own[0] for own in path if own[0].strength == best)


def feature_ranking(eliminated: DataFrame) -> DataFrame:
    """Rank 1 for the features of the best size; the others by how late they were dropped."""
    best = eliminated.orderBy(F.desc("mean_score"), "n_features").limit(1)
    size = best.select("n_features").scalar()
    return eliminated.select("n_features", F.explode("dropped").alias("feature")).select(
        "feature",
        F.greatest(F.lit(1), F.col("n_features") - size + 1).alias("rank"),
    )


def coefficient_importance(model: PipelineModel, df: DataFrame, features: list[str]) -> DataFrame:
    """Coefficient times column deviation, ranked by absolute value."""
    coefficients = model.stages[-1].coefficients.toArray()
    one = df.agg(*[F.stddev_samp(F.col(f"`{c}`")).alias(c) for c in features])
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(float(b)).alias("coefficient"),
                 (F.lit(float(b)) * F.col(f"`{c}`")).alias("importance"))
        for c, b in zip(features, coefficients)
    ]
    return _ranked(one.select(F.inline(F.array(*cells))), F.abs("importance"))


def tree_importance(model: PipelineModel, spark, features: list[str]) -> DataFrame:
    """Importance per feature, with its spread over the trees of a forest."""
    stage = model.stages[-1]
    trees = [t.featureImportances.toArray() for t in getattr(stage, "trees", [])]
    overall = stage.featureImportances.toArray()
    rows = []
    for i, c in enumerate(features):
        each = [t[i] for t in trees]
        mean = sum(each) / len(each) if each else 0.0
        std = (sum((e - mean) ** 2 for e in each) / len(each)) ** 0.5 if each else 0.0
        rows.append((c, float(overall[i]), float(std)))
    return _ranked(spark.createDataFrame(rows, "feature string, importance double, std double"), F.col("importance"))


def _ranked(df: DataFrame, strength) -> DataFrame:
    return df.withColumn("_s", strength).orderBy(F.desc("_s"), "feature").drop("_s")
