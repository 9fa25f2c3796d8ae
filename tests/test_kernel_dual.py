import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.config import SvmOptions
from factloom.operators import kernel_dual, models
from factloom.operators.kernel_dual import Against, Dual


def data(spark, n=60, folds=3, real=False, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)) * (rng.random((n, 5)) < 0.7)
    x[7] = 0  # a case without a feature
    x[8] = x[9]  # and a repeated one
    score = x[:, 0] ** 2 + x[:, 1] - x[:, 2] * x[:, 3] - 0.4 + 0.2 * rng.normal(size=n)
    y = score if real else np.where(score > 0, 1.0, -1.0)
    names = [3, 70, 2**62 - 5, 11, 900]
    features = spark.createDataFrame([(f"c{i:03d}", names[j], float(x[i, j])) for i in range(n) for j in range(5) if x[i, j]], "case_id string, feature bigint, value double")
    cases = spark.createDataFrame([(f"c{i:03d}", float(y[i]), i % folds, i % 11 == 5) for i in range(n)], "case_id string, label double, fold int, rejected boolean")
    return features, cases, [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in x], y


def alone(kind, options, rows, y, folds):
    """Predictions by the one-machine form."""
    out, where = {}, np.arange(len(y))
    for fold in range(folds):
        train, test = np.flatnonzero((where % folds != fold) & (where % 11 != 5)), np.flatnonzero(where % folds == fold)
        m = models.Svm(kind, **options)
        m.fit([rows[i] for i in train], y[train])
        out |= {f"c{i:03d}": p for i, p in zip(test, m.margin([rows[i] for i in test]), strict=True)}
    return out


KINDS = [("c_svc", {"c": 5.0, "wn": 0.5}), ("nu_svc", {"nu": 0.3}), ("eps_svr", {"c": 3.0, "epsilon_tube": 0.05}), ("nu_svr", {"c": 3.0, "nu": 0.4})]


@pytest.mark.parametrize("working", [500, 20])
@pytest.mark.parametrize(("kind", "options"), KINDS)
def test_decomposed_dual_meets_the_whole_one(spark, monkeypatch, kind, options, working):
    monkeypatch.setattr(kernel_dual, "WORKING", working)
    monkeypatch.setattr(kernel_dual, "CELLS", 40 if working == 20 else 4_000_000)
    options = options | {"kernel": "rbf", "gamma": 0.4, "tolerance": 1e-5}
    features, cases, rows, y = data(spark, real=kind.endswith("svr"))
    found = kernel_dual.cross_validated(features, cases, kind, SvmOptions(**options), [0, 1, 2]).collect()
    want = alone(kind, options, rows, y, 3)
    assert len(found) == len(y) and {r.case_id for r in found} == set(want)
    assert max(abs(r.prediction - want[r.case_id]) for r in found) < 2e-3
    assert all(r.fold == int(r.case_id[1:]) % 3 and r.label == y[int(r.case_id[1:])] for r in found)


@pytest.mark.parametrize("kind", ["c_svc", "nu_svc"])
def test_precomputed_kernel_equals_the_same_kernel(spark, monkeypatch, kind):
    monkeypatch.setattr(kernel_dual, "WORKING", 30)
    features, cases, rows, y = data(spark)
    o = {"c": 2.0, "nu": 0.3, "tolerance": 1e-5, "gamma": 0.4}
    gram = models.gram_matrix(rows, rows, SvmOptions(kernel="rbf", gamma=0.4))
    pairs = spark.createDataFrame([(f"c{i:03d}", f"c{j:03d}", float(gram[i, j])) for i in range(len(y)) for j in range(len(y))], "a string, b string, value double")
    given = kernel_dual.cross_validated(kernel_dual.gram_rows(pairs), cases, kind, SvmOptions(kernel="precomputed", **o), [0, 1, 2])
    want = alone(kind, o | {"kernel": "rbf"}, rows, y, 3)
    assert max(abs(r.prediction - want[r.case_id]) for r in given.collect()) < 2e-3
    with pytest.raises(ValueError, match="gram_rows"):
        models.Svm("c_svc", kernel="precomputed").fit(rows, y)


@pytest.mark.parametrize("kernel", ["linear", "poly", "rbf", "sigmoid"])
def test_pieces_of_the_gram_matrix(monkeypatch, kernel):
    rng = np.random.default_rng(2)
    pick = lambda: [(np.sort(rng.choice(40, m, replace=False)), rng.normal(size=m)) for m in rng.integers(0, 12, 25)]
    a, b, o = pick(), pick(), SvmOptions(kernel=kernel, gamma=0.3, coef0=0.2, degree=2)
    want = models.gram_matrix(a, b, o)
    assert Against(b, o).gram(a) == pytest.approx(want)
    monkeypatch.setattr(kernel_dual, "CELLS", 100)
    w = rng.normal(size=(25, 3))
    assert Against(b, o).expanded(a, w) == pytest.approx(want @ w)
    assert Against([], o).expanded(a, np.zeros((0, 3))) == pytest.approx(np.zeros((25, 3)))


def test_turns_that_do_not_suffice_and_infeasible_nu_are_errors(spark, monkeypatch):
    monkeypatch.setattr(kernel_dual, "WORKING", 2)
    features, cases, _, _ = data(spark)
    with pytest.raises(RuntimeError, match="after 2 turns"):
        kernel_dual.cross_validated(features, cases, "c_svc", SvmOptions(kernel="rbf"), [0, 1, 2], turns=2)
    lone = cases.withColumn("label", F.when(F.col("case_id") == "c001", 1.0).otherwise(-1.0))
    with pytest.raises(ValueError, match="infeasible"):
        kernel_dual.cross_validated(features, lone, "nu_svc", SvmOptions(nu=0.9), [0, 1, 2])


def test_no_case_one_class_and_more_cases_than_the_bound_of_one_task(spark):
    features, cases, rows, y = data(spark)
    assert kernel_dual.cross_validated(features, cases.limit(0), "c_svc", SvmOptions(), []).count() == 0
    same = kernel_dual.cross_validated(features, cases.withColumn("label", F.lit(2.5)), "eps_svr", SvmOptions(), [0, 1, 2])
    assert {round(r.prediction, 6) for r in same.collect()} == {2.5}
    folds = spark.createDataFrame([(i, i) for i in range(3)], "ex int, fold int")
    seen = models.cross_validate(features, cases.withColumnRenamed("fold", "ex"), folds, "dual_c_svc", task="binary", max_cases=1, kernel="rbf", gamma=0.4, c=5.0, tolerance=1e-5)
    want = alone("c_svc", {"kernel": "rbf", "gamma": 0.4, "c": 5.0, "tolerance": 1e-5}, rows, y, 3)
    assert max(abs(r.prediction - want[r.case_id]) for r in seen.collect()) < 2e-3


def test_a_dual_of_two_variables():
    d = Dual("c_svc", SvmOptions(c=10.0), np.array([1.0, -1.0]))
    a = d.solve(np.array([[1.0, -1.0], [-1.0, 1.0]]), np.zeros((2, 1)), np.zeros(2))
    assert a.ravel() == pytest.approx([0.5, 0.5], abs=1e-3)
