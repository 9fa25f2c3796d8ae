"""Distances between all vertices, in tiles of blocks, against a search from each vertex."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import paths
from factloom.operators.graph import Graph


def graph(spark, edges, alone=()):
    names = sorted({(x, n) for x, a, b in edges for n in (a, b)} | set(alone), key=str)
    half = [(x, *two, "r") for x, a, b in edges for two in ((a, b), (b, a))]
    return Graph(spark.createDataFrame([(x, n, True) for x, n in names], "ex string, vid string, alive boolean"), spark.createDataFrame(half, "ex string, src string, dst string, role string"))


def searched(edges, alone, bound):
    near, out = {v: set() for v in alone}, {}
    for x, a, b in edges:
        near.setdefault((x, a), set()).add((x, b))
        near.setdefault((x, b), set()).add((x, a))
    for v in near:
        seen, rim = {v: 0}, [v]
        for d in range(1, bound + 1):
            rim = [n for n in {n for m in rim for n in near[m]} if n not in seen]
            seen |= dict.fromkeys(rim, d)
        out |= {(v[0], v[1], n[1]): d for n, d in seen.items()}
    return out


@pytest.mark.parametrize("bound", [2, 3, 4, 5])
def test_tiles_hold_each_pair_once_at_its_distance(spark, monkeypatch, bound):
    for name, value in (("BLOCK", 6), ("LEAST", 6), ("CELLS", 5)):
        monkeypatch.setattr(paths, name, value)
    rng = random.Random(bound)
    edges = [(x, *(f"{n}" for n in rng.sample(range(12), 2))) for x in "ab" for _ in range(14)]  # names repeat in other interpretations
    edges += [("c", "hub", f"l{k}") for k in range(9)] + [("c", f"l{k}", f"i{k}") for k in range(9)] + [("a:", "1", "2"), ("a", "self", "self")]
    alone = [("a", "alone"), ("d", "alone")]
    rows = paths.distances(graph(spark, edges, alone), bound).collect()
    got = {(r.ex, r.src, r.dst): r.d for r in rows}
    assert len(rows) == len(got) and got == searched(edges, alone, bound)


def test_nameless_and_dead_vertices(spark):
    g = graph(spark, [("a", "x", "y"), ("a", "y", "z")], [("a", None), (None, "n")])
    rows = {tuple(r) for r in paths.distances(g, 2).collect()}
    assert {(None, "n", "n", 0), ("a", None, None, 0), ("a", "x", "z", 2)} <= rows and len(rows) == 11
    dead = Graph(g.vertices.withColumn("alive", F.coalesce(F.col("vid") != "y", F.lit(True))), g.edges)
    assert {r.d for r in paths.distances(dead, 2).collect()} == {0}


@pytest.mark.parametrize("bound", [2, 3])
def test_pairs_are_not_grouped(spark, bound):
    """The pairs of a hub go out as they are made: no aggregate or join after them."""
    g = graph(spark, [("c", "hub", f"l{k}") for k in range(5)])
    plan = paths.distances(g, bound)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[: plan.index("MapInArrow")]
    assert "Aggregate" not in top and "Join" not in top
