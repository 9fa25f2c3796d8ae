"""Linear kernels over few features: no turn of working sets is left to do, whatever the number of cases."""

import pytest
from pyspark.sql import functions as F

from factloom.config import SvmOptions
from factloom.operators import interior, kernel_dual

from .test_kernel_dual import alone, data

KINDS = [("c_svc", {"c": 5.0, "wn": 0.5}), ("nu_svc", {"nu": 0.7}), ("eps_svr", {"c": 3.0, "epsilon_tube": 0.05}), ("nu_svr", {"c": 3.0, "nu": 0.4})]


@pytest.mark.parametrize(("kind", "options"), KINDS)
def test_one_turn_confirms_the_optimum(spark, monkeypatch, kind, options):
    monkeypatch.setattr(kernel_dual, "WORKING", 10)
    options = options | {"kernel": "linear", "tolerance": 1e-5}
    features, cases, rows, y = data(spark, real=kind.endswith("svr"))
    found = {r.case_id: r.prediction for r in kernel_dual.cross_validated(features, cases, kind, SvmOptions(**options), [0, 1, 2], turns=1).collect()}
    want = alone(kind, options, rows, y, 3)
    assert set(found) == set(want) and max(abs(found[c] - want[c]) for c in want) < 2e-3


def test_constant_and_repeated_features(spark):
    features, cases, _, _ = data(spark, real=True)
    more = features.filter("feature = 3").withColumn("feature", F.lit(4).cast("bigint")).unionByName(cases.select("case_id", F.lit(5).cast("bigint").alias("feature"), F.lit(1.0).alias("value")))
    scaled = features.withColumn("value", F.col("value") * F.when(F.col("feature") == 3, 2**0.5).otherwise(1.0))
    a, b = ({r.case_id: r.prediction for r in kernel_dual.cross_validated(x, cases, "eps_svr", SvmOptions(tolerance=1e-5), [0, 1, 2], turns=1).collect()} for x in (features.unionByName(more), scaled))
    assert max(abs(a[c] - b[c]) for c in a) < 2e-3


def test_many_features_or_no_room_are_left_to_working_sets(spark, monkeypatch):
    features, cases, rows, y = data(spark)
    seen, real = [], interior.started
    monkeypatch.setattr(interior, "started", lambda *a: seen.append(real(*a)) or seen[-1])
    one = cases.withColumn("label", F.lit(1.0))
    assert kernel_dual.cross_validated(features, one, "c_svc", SvmOptions(), [0, 1, 2]).count() == len(y)
    monkeypatch.setattr(interior, "FEATURES", 4)
    options = {"kernel": "linear", "c": 1.0, "tolerance": 1e-4}
    found = kernel_dual.cross_validated(features, cases, "c_svc", SvmOptions(**options), [0, 1, 2]).collect()
    want = alone("c_svc", options, rows, y, 3)
    assert seen == [None, None] and max(abs(r.prediction - want[r.case_id]) for r in found) < 5e-3
