"""Components that are known are carried on; rounds end at stars."""

import random

import pytest

from factloom.llm import graph


def by_hand(edges):
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    return least


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


def labels(found):
    return {r.node: r.component for r in found.collect()}


@pytest.fixture
def written(monkeypatch):
    names, real = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, what: names.append(what) or real(df, what))
    return names


def test_stars_need_no_round(spark, written):
    edges = [(1, x) for x in range(2, 40)] + [(50, 51), (52, 50), (60, 60)]
    assert labels(graph.components(frame(spark, edges))) == by_hand([e for e in edges if e[0] != e[1]])
    assert written == ["edges", "components"]


def test_a_round_writes_two_tables(spark, written):
    assert labels(graph.components(frame(spark, [(1, 2), (2, 3)]))) == {1: 1, 2: 1, 3: 1}
    assert written == ["edges", "large", "edges", "components"]


@pytest.mark.parametrize("seed", range(4))
def test_merged_labels_equal_those_of_all_edges(spark, seed):
    rng = random.Random(seed)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    more = [(rng.randrange(90), rng.randrange(90)) for _ in range(20)] + [(95, 95)]
    known = graph.components(frame(spark, first))
    every = by_hand([e for e in first + more if e[0] != e[1]])
    assert labels(graph.merged(known, frame(spark, more))) == every


def test_edges_within_components_write_no_labels(spark, written):
    known = graph.components(frame(spark, [(1, 2), (2, 3), (7, 8)]))
    del written[:]
    assert labels(graph.merged(known, frame(spark, [(3, 1), (8, 7)]))) == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert written == ["between"]
    assert labels(graph.merged(known.filter("node < 0"), frame(spark, [(3, 1)]))) == {1: 1, 3: 1}
