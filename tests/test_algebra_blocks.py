import math

import duckdb
import numpy as np
import pytest

from factloom.functions import algebra
from factloom.plans import queries


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CASES", 3), ("LEAST", 3), ("VALUES", 10), ("CELLS", 7)):
        monkeypatch.setattr(algebra, name, value)


def brute(rows, others=None):
    out = {}
    for a, f, x in rows:
        for b, g, y in others if others is not None else rows:
            if f is not None and f == g and (others is not None or a <= b):
                out.setdefault((a, b), []).append(None if x is None or y is None else x * y)
    return {k: sum(p for p in v if p is not None) if any(p is not None for p in v) else None for k, v in out.items()}


@pytest.mark.parametrize("dense", [0, 4_000_000])
def test_blocks_meet_without_a_join_of_pairs(spark, monkeypatch, small, dense):
    monkeypatch.setattr(algebra, "DENSE", dense)
    rng = np.random.default_rng(5)
    rows = [(f"c{rng.integers(14)}", int(rng.integers(9)), float(rng.normal())) for _ in range(60)]  # features repeat within a case
    rows += [("c1", None, 2.0), ("c2", 3, None), ("n", 20, None), ("m", 20, 1.0), ("é", 1, 0.5)]
    vectors = spark.createDataFrame(rows, "case_id string, feature bigint, value double")
    found = algebra.dot_products(vectors)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got, want = {(r.case_a, r.case_b): r.dot for r in found.collect()}, brute(rows)
    assert got.keys() == want.keys() and got["m", "n"] is None
    assert all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())
    two = [(k, f, v) for k, f, v in rows if k != "c3"]
    got = {(r.case_a, r.case_b): r.dot for r in algebra.dot_products(vectors, spark.createDataFrame(two, vectors.schema)).collect()}
    want = brute(rows, two)
    assert got.keys() == want.keys() and all(got[k] == (None if v is None else pytest.approx(v)) for k, v in want.items())


def test_given_pairs_meet_in_blocks_and_may_repeat(spark, small):
    rng = np.random.default_rng(6)
    cells = {(f"c{k}", int(f)): float(rng.normal()) for k in range(12) for f in rng.choice(9, 4, replace=False)}
    vectors = spark.createDataFrame([(c, f, v) for (c, f), v in cells.items()], "case_id string, feature bigint, value double")
    pairs = [(f"c{rng.integers(13)}", f"c{rng.integers(13)}") for _ in range(50)] + [("c1", "c2")] * 2
    dense = {f"c{k}": np.array([cells.get((f"c{k}", f), 0.0) for f in range(9)]) for k in range(13)}
    for kernel in ("linear", "rbf"):
        got = algebra.gram_of(spark.createDataFrame(pairs, "case_a string, case_b string"), vectors, kernel, gamma=0.3).collect()
        want = lambda a, b, kernel=kernel: dense[a] @ dense[b] if kernel == "linear" else np.exp(-0.3 * ((dense[a] - dense[b]) ** 2).sum())
        assert sorted((r.case_a, r.case_b) for r in got) == sorted(pairs)
        assert all(r.k == pytest.approx(want(r.case_a, r.case_b)) for r in got)


def test_pairs_are_rounded_as_sql_rounds(spark):
    """Halves too, without decimals; what is too large to have such digits, or no number, stays as it is."""
    rng = np.random.default_rng(7)
    given = [*(rng.normal(size=200) * 10.0 ** rng.integers(-6, 9, 200)).tolist(), *(k / 64 for k in range(-40, 40)), 1.000005, -2.000015, 0.0, 1e-9, -1e-9, 1e14, -1e300, math.inf, -math.inf]
    frame = spark.createDataFrame([(x,) for x in [*given, math.nan, None]], "x double").coalesce(1).select("x", queries._rounded("x", 5).alias("y"))
    assert "round(" not in frame._jdf.queryExecution().optimizedPlan().toString()
    rows = frame.collect()
    assert math.isnan(rows[-2].y) and rows[-1].y is None
    assert [r.y for r in rows[:-2]] == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [x]).fetchone()[0] for x in given]
