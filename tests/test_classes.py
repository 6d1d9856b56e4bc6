"""Several classes: fits with balanced classes, curves of each class against the rest."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.learning import evaluate, models
from clinfeat.plans import model_queries  # noqa: F401  (registers the queries)
from clinfeat.plans.catalogue import QUERIES


def test_fit_and_score_classes(spark):
    rng = random.Random(2)
    data = [(i, k, rng.gauss(3 * (k % 2), 1), rng.gauss(3 * (k // 2), 1)) for i in range(400) for k in [rng.choice([0, 0, 0, 1, 2, 2, 3])]]
    df = spark.createDataFrame(data, "enc_id long, outcome int, a double, b double")
    model = models.fit_classes(df, ["a", "b"])
    scored = models.score_classes(model, df).toPandas()
    p = scored[[f"score{k}" for k in range(4)]].to_numpy()
    assert np.allclose(p.sum(1), 1) and (p.argmax(1) == scored["prediction"]).all()
    assert (scored["prediction"] == scored["outcome"]).mean() > 0.8
    # the slope of the balanced, penalised loss vanishes
    y, x = scored["outcome"].to_numpy(), scored[["a", "b"]].to_numpy()
    weight = len(y) / (4 * np.bincount(y)[y])
    slope = ((p - np.eye(4)[y]) * weight[:, None]).T @ x + model.stages[-1].coefficientMatrix.toArray()
    assert np.abs(slope).max() < 1e-2


def test_curves_against_the_rest(spark):
    rng = random.Random(3)
    data = [(rng.choice([0, 1, 2, None]), *[rng.choice([0.1, 0.4, 0.4, 0.7, None]) for _ in range(4)]) for _ in range(120)]
    df = spark.createDataFrame(data, "outcome int, s0 double, s1 double, s2 double, s3 double")
    found = {r["class"]: r.auc for r in evaluate.class_auc(df, ["s0", "s1", "s2", "s3"]).collect()}
    for k in range(4):
        pos = [r[k + 1] for r in data if r[0] == k and r[k + 1] is not None]
        neg = [r[k + 1] for r in data if r[0] not in (k, None) and r[k + 1] is not None]
        want = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) if pos and neg else None
        assert found[k] == (None if want is None else pytest.approx(want))
    points = evaluate.class_roc(df, ["s0", "s1", "s2", "s3"]).where("class = 1").orderBy("threshold").collect()
    assert (points[0].fpr, points[0].tpr) == (1.0, 1.0) and [r.cum_pos for r in points] == sorted((r.cum_pos for r in points), reverse=True)
    assert evaluate.class_auc(df.limit(0), ["s0", "s1"]).count() == 0
    assert evaluate.one_against_rest(df.where(F.col("outcome").isNull()), ["s0"]).count() == 0


def test_query_of_four_classes(spark):
    rows = QUERIES["fit_four_classes"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(abs(sum(r[f"score{k}"] for k in range(4)) - 1) < 1e-4 for r in rows)
