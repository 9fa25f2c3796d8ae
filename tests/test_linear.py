import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.config import SgdOptions
from factloom.operators import linear, models
from factloom.operators.linear import margins, train_folds


def data(spark, n=90, folds=3, loss="hinge", seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * (rng.random((n, 6)) < 0.7)
    score = x @ np.array([1, -1, 0.5, 0, 2, -0.3]) + 0.3 * rng.normal(size=n)
    y = score if loss in ("squared", "epsilon") else np.where(score > 0, 1.0, -1.0)
    names = [3, 70, 2**31 - 5, 11, 900, 12]
    cells = [(f"c{i:03d}", names[j], float(x[i, j])) for i in range(n) for j in range(6) if x[i, j]]
    features = spark.createDataFrame(cells, "case_id string, feature bigint, value double")
    cases = spark.createDataFrame([(f"c{i:03d}", float(y[i]), i % folds, False) for i in range(n)], "case_id string, label double, fold int, rejected boolean")
    return features, cases, x, y, names


def cost(loss, w, x, y, o):
    f = x @ w
    c = np.where(y < 0, o.lossratio, 1.0)
    return float((c * linear.losses(loss, f, y)).mean() + o.lambda_ / 2 * w @ w)


def table(weights, names):
    found = {}
    for r in weights.collect():
        found.setdefault(r.fold, np.zeros(len(names)))[names.index(r.feature)] = r.weight
    return found


@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("loss", ["hinge", "log", "exponential", "squared", "epsilon"])
def test_every_fold_reaches_its_optimum(spark, monkeypatch, loss, blocks):
    features, cases, x, y, names = data(spark, loss=loss)
    if blocks > 1:
        monkeypatch.setattr(linear, "CASES", 25)
    o = SgdOptions(loss=loss, lambda_=0.05, lossratio=0.5 if loss not in ("squared", "epsilon") else 1.0, tolerance=1e-3, epochs=5)
    weights, costs = train_folds(features, cases, o, [0, 1, 2])
    found = table(weights, names)
    for r in costs.collect():
        chosen = np.arange(len(y)) % 3 != r.fold
        own = cost(loss, found[r.fold], x[chosen], y[chosen], o)
        assert r.n == chosen.sum() and own == pytest.approx(r.primal, rel=1e-6) and 0 <= r.primal - r.dual <= 1.0001e-3 * r.primal
        # no point near it is better than the bound says
        rng = np.random.default_rng(r.fold)
        assert min(cost(loss, found[r.fold] + rng.normal(size=6) * s, x[chosen], y[chosen], o) for s in (0.3, 0.03, 0.003) for _ in range(40)) >= r.dual - 1e-9


def test_hinge_meets_the_dual_solver(spark):
    features, cases, x, y, names = data(spark, n=60, folds=2)
    o = SgdOptions(loss="hinge", lambda_=0.02, tolerance=0.005)
    found = table(train_folds(features, cases, o, [0, 1])[0], names)
    for fold, w in found.items():
        chosen = np.arange(60) % 2 != fold
        xs, ys = x[chosen], y[chosen]
        n = len(ys)
        # without an offset: coordinate by coordinate to the end
        a, best, g = np.zeros(n), np.zeros(6), 1 / (o.lambda_ * n)
        for _ in range(3000):
            for k in range(n):
                new = np.clip(a[k] + (1 - ys[k] * (xs[k] @ best)) / max(1e-12, g * (xs[k] @ xs[k])), 0, 1)
                best += g * (new - a[k]) * ys[k] * xs[k]
                a[k] = new
        assert cost("hinge", w, xs, ys, o) <= 1.03 * cost("hinge", best, xs, ys, o)


def test_a_fold_learns_nothing_of_its_own_cases(spark):
    features, cases, x, y, names = data(spark)
    o = SgdOptions(loss="squared", lambda_=0.05, tolerance=1e-6)
    before = table(train_folds(features, cases.withColumn("rejected", F.col("case_id") == "c001"), o, [0, 1, 2])[0], names)
    spoilt = cases.withColumn("label", F.when(F.col("fold") == 1, 99.0).otherwise(F.col("label"))).withColumn("rejected", F.col("case_id") == "c001")
    after = table(train_folds(features, spoilt, o, [0, 1, 2])[0], names)
    assert np.allclose(before[1], after[1], atol=1e-6) and not np.allclose(before[0], after[0], atol=1e-2)
    chosen = (np.arange(90) % 3 != 2) & (np.arange(90) != 1)  # the rejected case trains nothing
    ridge = np.linalg.solve(x[chosen].T @ x[chosen] + o.lambda_ * chosen.sum() * np.eye(6), x[chosen].T @ y[chosen])
    assert np.allclose(before[2], ridge, atol=2e-3)


def test_odd_folds(spark, monkeypatch):
    monkeypatch.setattr(linear, "WIDTH", 2)
    features, cases, *_ = data(spark, n=40, folds=5)
    cases = cases.union(spark.createDataFrame([("bare", 1.0, 4, False), ("left out", -1.0, 4, True)], cases.schema))
    weights, costs = train_folds(features, cases, SgdOptions(lambda_=0.1), [0, 1, 2, 3, 4])
    assert {r.fold for r in costs.collect()} == {0, 1, 2, 3, 4}
    found = {r.case_id: r.prediction for r in margins(features, cases, weights).collect()}
    assert len(found) == 42 and found["bare"] == found["left out"] == 0.0
    # one fold alone has nothing to learn from
    lonely = cases.withColumn("fold", F.lit(7))
    weights, costs = train_folds(features, lonely, SgdOptions(), [7])
    assert weights.count() == costs.count() == 0
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        train_folds(features, cases, SgdOptions(lambda_=1e-5, tolerance=1e-9), [0], rounds=1)


def test_cross_validation_takes_the_distributed_path(spark, monkeypatch):
    features, cases, *_ = data(spark)
    monkeypatch.setattr(models.Sgd, "fit", lambda *a: pytest.fail("one task trained a fold"))
    rows = cases.select("case_id", F.col("fold").cast("string").alias("ex"), "label")
    folds = spark.createDataFrame([("0", 0), ("1", 1), ("2", 2)], "ex string, fold int")
    found = models.cross_validate(features, rows, folds, "svm_sgd", task="binary", lambda_=0.05, max_cases=1).collect()
    assert len(found) == 90 and sum((r.prediction > 0) == (r.label > 0) for r in found) > 75
    with pytest.raises(ValueError):
        models.cross_validate(features, rows, folds, "svm_sgd", task="regression")


def test_few_features_need_no_rounds(spark, monkeypatch):
    def none(*_):
        raise AssertionError("a round")

    monkeypatch.setattr(linear, "_round", none)
    features, cases, x, y, names = data(spark, loss="squared")
    weights, costs = train_folds(features, cases, SgdOptions(loss="squared", lambda_=0.05, tolerance=1e-11), [0, 1, 2])
    for fold, w in table(weights, names).items():
        chosen = np.arange(len(y)) % 3 != fold
        xs, ys = x[chosen], y[chosen]
        assert w == pytest.approx(np.linalg.solve(xs.T @ xs / len(ys) + 0.05 * np.eye(6), xs.T @ ys / len(ys)))
    assert all(0 <= r.primal - r.dual <= 1e-11 * r.primal and r.n == 60 for r in costs.collect())


@pytest.mark.parametrize("loss", ["log", "exponential"])
def test_smooth_losses_over_few_features_need_no_rounds(spark, monkeypatch, loss):
    features, cases, x, y, names = data(spark, loss=loss)
    o = SgdOptions(loss=loss, lambda_=0.01, lossratio=0.5, tolerance=1e-3)
    found = table(train_folds(features, cases, o, [0, 1, 2], rounds=0)[0], names)
    monkeypatch.setattr(linear, "DIRECT", 5)
    rounds = table(train_folds(features, cases, o, [0, 1, 2])[0], names)
    for fold, w in found.items():
        chosen = np.arange(len(y)) % 3 != fold
        best, other = (cost(loss, v, x[chosen], y[chosen], o) for v in (w, rounds[fold]))
        assert best <= other + 1e-9 and other - best <= 1e-3 * other
