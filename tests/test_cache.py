import pytest
from pyspark.sql import functions as F

from factloom.config import KernelOptions
from factloom.operators import cache
from factloom.operators.cache import VectorCache, case_fingerprints, graph_fingerprints, load_graph, save_graph
from factloom.operators.graph import Graph
from factloom.operators.kernels import Kernel
from factloom.operators.workspace import exists, workspace

OPTIONS = KernelOptions(match_type="hard", radius=1, distance=2)


def line(spark, n=14, cut=None, color=None):
    """Entities e0..., joined by relationships r0... in a row, in two interpretations."""
    rows, edges = [], []
    for ex in ("1", "2"):
        for k in range(n):
            tint = "green" if (ex, k) == color else "red" if k % 3 else "blue"
            rows += [(ex, f"{ex}/e{k}", "node", "i", f"e{k}", ["node", tint], [], True, True), (ex, f"{ex}/r{k}", "link", "r", f"r{k}", ["link"], [], False, True)]
            for end, role in ((k, "p1"), (k + 1, "p0")):
                if end < n and (ex, k, end) != cut:
                    edges += [(ex, f"{ex}/r{k}", f"{ex}/e{end}", role), (ex, f"{ex}/e{end}", f"{ex}/r{k}", role)]
    v = spark.createDataFrame(rows, "ex string, vid string, sig string, kind string, sym_id string, syms array<string>, nums array<double>, is_kp boolean, alive boolean")
    return Graph(v, spark.createDataFrame(edges, "ex string, src string, dst string, role string"))


def cases_of(g):
    return g.vertices.filter("kind = 'i'").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))


def rows(df):
    return sorted((r.case_id, r.feature, round(r.value, 9)) for r in df.collect())


def test_only_cases_near_a_change_are_computed(spark, tmp_path):
    store = VectorCache(spark, str(tmp_path / "store"))
    g = line(spark)
    cases = cases_of(g)
    assert rows(store.features(g, cases, OPTIONS)) == rows(Kernel(g, OPTIONS).features(cases))
    assert (store.computed, store.reused) == (28, 0)
    first = store._state()

    same = store.features(line(spark), cases, OPTIONS)
    assert (store.computed, store.reused) == (0, 28) and store._state() == first and same.count() > 0

    # the edge from r6 to e7 goes: e6 to e8 have both its ends within 3 steps
    changed = line(spark, cut=("1", 6, 7))
    assert rows(store.features(changed, cases, OPTIONS)) == rows(Kernel(changed, OPTIONS).features(cases))
    assert (store.computed, store.reused) == (3, 25)
    assert not any(exists(spark, f"{store.path}/{what}-{first}") for what in ("keys", "vectors"))
    assert len(list((tmp_path / "store").glob("vectors-*"))) == len(list((tmp_path / "store").glob("keys-*"))) == 1

    tinted = line(spark, cut=("1", 6, 7), color=("2", 0))
    assert rows(store.features(tinted, cases, OPTIONS)) == rows(Kernel(tinted, OPTIONS).features(cases))
    assert store.computed == 2  # e0 and e1

    fewer = cases.filter("case_id != '1/e3'")
    assert "1/e3" not in {r[0] for r in rows(store.features(tinted, fewer, OPTIONS))} and (store.computed, store.reused) == (0, 27)
    store.features(tinted, cases, KernelOptions(match_type="soft", radius=1, distance=2))
    assert store.computed == 28
    store.clear()
    assert not exists(spark, store.path)


def test_dead_vertices_and_whole_graphs(spark):
    g = line(spark)
    ex = spark.createDataFrame([("1", "one", None), ("2", "two", None), ("3", "three", None)], "ex string, case_id string, viewpoints array<string>")
    prints = lambda g: {r.case_id: r.fingerprint for r in case_fingerprints(g, ex, OPTIONS).collect()}
    before, after = prints(g), prints(line(spark, color=("2", 9)))
    assert before["one"] == after["one"] and before["two"] != after["two"] and len(before) == 3
    assert prints(g.kill(["link"]))["one"] != before["one"]
    assert {r.ex: r.n for r in graph_fingerprints(g).collect()} == {"1": 82, "2": 82}


@pytest.mark.parametrize("variant", ["nspdk", "anspdk", "rnspdk"])
def test_a_changed_vector_has_a_changed_fingerprint(spark, variant):
    options = KernelOptions(variant=variant, match_type="hard", radius=2, distance=1)
    a, b = line(spark, 9), line(spark, 9, cut=("1", 4, 4))
    cases = cases_of(a)
    vectors = [{} for _ in range(2)]
    for found, g in zip(vectors, (a, b), strict=True):
        for case_id, feature, value in rows(Kernel(g, options).features(cases)):
            found.setdefault(case_id, []).append((feature, value))
    prints = [{r.case_id: r.fingerprint for r in case_fingerprints(g, cases, options).collect()} for g in (a, b)]
    for c in prints[0]:
        assert vectors[0].get(c) == vectors[1].get(c) or prints[0][c] != prints[1][c]
    assert sum(prints[0][c] == prints[1][c] for c in prints[0]) >= 9


def test_graphs_as_files(spark, tmp_path):
    g, path = line(spark, 5), str(tmp_path / "g")
    save_graph(g, path)
    back = load_graph(spark, path)
    assert sorted(map(tuple, back.edges.collect())) == sorted(map(tuple, g.edges.collect())) and back.vertices.count() == g.vertices.count()
    assert cache.changed_interpretations(graph_fingerprints(g), graph_fingerprints(line(spark, 5, color=("2", 1)))).collect()[0][0] == "2"
    g.edges.limit(1).write.mode("append").parquet(f"{path}/edges")
    with pytest.raises(ValueError, match="not what was saved"):
        load_graph(spark, path)


def test_a_workspace_leaves_nothing(spark):
    with pytest.raises(RuntimeError), workspace(spark) as work:
        kept = work.put(spark.range(5).toDF("a"))
        assert kept.count() == 5 and exists(spark, work.path)
        raise RuntimeError
    assert not exists(spark, work.path)
