"""Logistic fits by Newton steps: gradients, separate fits, elimination against one fit at a time, the queries themselves."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from clinfeat.learning import models, newton
from clinfeat.plans import model_queries
from clinfeat.plans.catalogue import QUERIES

FEATURES = [f"f{i}" for i in range(12)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for i in range(500):
        x = [rng.gauss(0, 1) for _ in range(9)]
        x += [x[0] + rng.gauss(0, 0.3), float(rng.randrange(2)), float(rng.random() < 0.05)]
        y = int(1.2 * x[0] - 0.8 * x[1] + 0.5 * x[2] + 0.9 * x[10] + rng.gauss(0, 1) > 0.6)
        data.append((i, y, *x))
    return spark.createDataFrame(data, "enc_id long, outcome int, " + ", ".join(f"{c} double" for c in FEATURES)).repartition(3).cache()


def arrays(rows, where="true"):
    found = rows.where(where).select("enc_id", "outcome", models.fold("enc_id", 3).alias("fold"), *FEATURES).toPandas()
    return found[FEATURES].to_numpy(), found["outcome"].to_numpy(), found["fold"].to_numpy()


def plain_fit(x, y, strength):
    """Newton on a table in memory; the balanced loss with an L2 penalty that spares the intercept."""
    x1, beta = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge = np.append(np.full(x.shape[1], 1 / strength), 0)
    for _ in range(100):
        p = 1 / (1 + np.exp(-x1 @ beta))
        slope = x1.T @ (weight * (p - y)) + ridge * beta
        beta = beta - np.linalg.solve((x1.T * (weight * p * (1 - p))) @ x1 + np.diag(ridge), slope)
    return beta


def gradient(x, y, beta, strength):
    x1 = np.c_[x, np.ones(len(x))]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    return x1.T @ (weight * (1 / (1 + np.exp(-x1 @ beta)) - y)) + np.append(beta[:-1] / strength, 0)


def test_gradient_of_the_penalised_loss_vanishes(rows):
    x, y, _ = arrays(rows)
    for strength in (1e-3, 1.0, 1e4):
        one = newton.fit(rows, FEATURES, strength=strength)
        assert np.abs(gradient(x, y, one.beta, strength)).max() < 1e-6
        assert one.beta == pytest.approx(plain_fit(x, y, strength), abs=1e-8)
    model = models.fit(rows, FEATURES).stages[-1]  # the default of the library's logistic model has the same penalty
    beta = np.append(model.coefficients.toArray(), model.intercept)
    assert np.abs(gradient(x, y, beta, 1.0)).max() / len(y) < 1e-6
    assert beta == pytest.approx(plain_fit(x, y, 1.0), abs=1e-4)


def test_path_equals_separate_fits(rows):
    strengths = [10 ** (-4 + 8 * i / 9) for i in range(10)]
    data = newton.Rows(rows, FEATURES, "outcome", models.fold("enc_id", 3))
    x, y, fold = arrays(rows)
    for own in newton.penalty_path(data, strengths, [-1, 0, 1, 2]):
        for one in own:
            keep = fold != one.held_out
            assert one.beta == pytest.approx(plain_fit(x[keep], y[keep], one.strength), abs=1e-6)
    table, best = models.regularisation_path(rows, FEATURES, strengths)
    found = table.collect()
    assert len(found) == 10 and found[0]["inverse_strength"] == best.strength
    assert [r["mean_score"] for r in found] == sorted((r["mean_score"] for r in found), reverse=True)
    strength, mean = found[0]["inverse_strength"], found[0]["mean_score"]
    aucs = []
    for k in range(3):
        beta = plain_fit(x[fold != k], y[fold != k], strength)
        z = x[fold == k] @ beta[:-1]
        pos, neg = z[y[fold == k] == 1], z[y[fold == k] == 0]
        aucs.append(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))
    assert mean == pytest.approx(np.mean(aucs), abs=1e-9)


def plain_elimination(x, y, spread, step):
    """[(columns, dropped next, coefficients)], one cold fit a size."""
    left, out = list(range(x.shape[1])), []
    while left:
        beta = plain_fit(x[:, left], y, 1.0)
        strength = np.abs(beta[:-1]) * spread[left]
        gone = [left[i] for i in np.lexsort((left, strength))[:step]]
        out.append((tuple(left), gone, beta))
        left = [c for c in left if c not in gone]
    return out


@pytest.mark.parametrize("step, ahead", [(1, 8), (1, 1), (3, 4), (5, 8)])
def test_elimination_equals_one_fit_at_a_time(rows, monkeypatch, step, ahead):
    monkeypatch.setattr(newton, "AHEAD", ahead)
    x, y, fold = arrays(rows)
    spread = x.std(0, ddof=1)
    found = models.eliminate_features(rows, FEATURES, folds=3, step=step).orderBy(F.desc("n_features")).collect()
    whole = plain_elimination(x, y, spread, step)
    assert [r["features"] for r in found] == [[FEATURES[c] for c in own] for own, _, _ in whole]
    assert [r["dropped"] for r in found] == [[FEATURES[c] for c in gone] for _, gone, _ in whole]
    means = np.zeros(len(whole))
    for k in range(3):
        keep = fold != k
        for i, (own, _, beta) in enumerate(plain_elimination(x[keep], y[keep], spread, step)):
            z = x[~keep][:, own] @ beta[:-1] + beta[-1]
            means[i] += ((z > 0) == (y[~keep] == 1)).mean() / 3
    assert [r["mean_score"] for r in found] == pytest.approx(means, abs=1e-9)


def test_elimination_ranks_as_separate_searches_do(rows):
    """The earlier form: one cross-validated search of the library's estimator for every size."""
    left, scores = FEATURES[:4], {}
    spread = {c: rows.agg(F.stddev_samp(c)).first()[0] for c in left}
    dropped = []
    while left:
        best, table = models.cross_validate(rows, left, "logistic", {"regParam": [1 / 500]}, "accuracy", 3)
        scores[len(left)] = table.first()["mean_score"]
        gone = min(left, key=lambda c: (abs(best.coefficients[left.index(c)]) * spread[c], c))
        dropped.append((len(left), gone))
        left = [c for c in left if c != gone]
    size = max(scores, key=lambda k: (scores[k], -k))
    eliminated = models.eliminate_features(rows, FEATURES[:4], folds=3)
    ranks = {r["feature"]: r["rank"] for r in models.feature_ranking(eliminated).collect()}
    assert ranks == {c: max(1, n - size + 1) for n, c in dropped}


def test_rows_without_values_one_class_and_collinear_columns(spark):
    data = [(i, i % 2, float(i % 2) + i % 5, 1.0, 2.0, None if i == 3 else float("nan") if i == 4 else 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(data, "enc_id long, outcome int, a double, b double, c double, d double")
    one = newton.fit(df.union(df.where("enc_id < 0")), ["a", "b", "c"])
    assert np.isfinite(one.beta).all() and one.beta[1] == pytest.approx(0, abs=1e-9)
    assert newton.Rows(df, ["d"], "outcome").rows.count() == 58
    path = models.eliminate_features(df, ["a", "b", "c", "d"], folds=3)
    assert path.count() == 4
    same = newton.fit(df.withColumn("outcome", F.lit(1)), ["a"])
    assert np.isfinite(same.beta).all()


def test_queries_with_all_features(spark):
    """The queries themselves, at the scripts' settings."""
    folder = "/root/testdata/sf0.001"
    began = time.time()
    ranks = QUERIES["feature_elimination"](spark, folder).collect()
    assert time.time() - began < 120
    features = model_queries.prepared(model_queries.Retail(spark, folder)).features
    assert sorted(r["feature"] for r in ranks) == sorted(features) and min(r["rank"] for r in ranks) == 1
    assert QUERIES["cv_regularisation"](spark, folder).count() == 10
