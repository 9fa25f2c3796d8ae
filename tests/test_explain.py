import pytest
from pyspark.sql import functions as F

from factloom.config import KernelOptions
from factloom.operators.graph import Graph
from factloom.operators.kernels import Kernel, collisions


@pytest.fixture(scope="module")
def small(spark):
    """A ring of entities and relationships with attributes, and a tail."""
    rows = [("1", f"e{k}", "node", "i", f"e{k}", ["node", "red" if k % 3 else "blue"], [float(k % 2)], True, True) for k in range(5)]
    rows += [("1", f"r{k}", "link", "r", f"r{k}", ["link"], [], False, True) for k in range(5)]
    v = spark.createDataFrame(rows, "ex string, vid string, sig string, kind string, sym_id string, syms array<string>, nums array<double>, is_kp boolean, alive boolean")
    half = [(f"r{k}", f"e{k}", "p1") for k in range(5)] + [(f"r{k}", f"e{(k + 1) % 5}", "p0") for k in range(4)]
    e = spark.createDataFrame([("1", *x) for a, b, r in half for x in ((a, b, r), (b, a, r))], "ex string, src string, dst string, role string")
    cases = v.filter("kind = 'i'").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))
    return Graph(v, e), cases


OPTIONS = [
    {"match_type": "hard", "radius": 1, "distance": 2}, {"match_type": "hard", "radius": 2, "distance": 2}, {"match_type": "soft", "radius": 2, "distance": 1}, {"match_type": "hard_soft", "radius": 1, "distance": 1},
    {"match_type": "mixed", "radius": 1, "distance": 1}, {"variant": "mnspdk", "radius": 1, "distance": 2}, {"variant": "alnspdk", "radius": 1, "distance": 2}, {"variant": "rnspdk", "match_type": "soft", "radius": 1, "distance": 2},
    {"variant": "gnspdk", "radius": 1, "distance": 2}, {"variant": "anspdk", "radius": 2, "distance": 2},
]


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: "-".join(map(str, o.values())))
def test_every_feature_has_a_text(spark, small, options):
    graph, cases = small
    kernel = Kernel(graph, KernelOptions(**options))
    texts = kernel.explain(cases).collect()
    seen = {r.feature for r in kernel.features(cases).select("feature").distinct().collect()}
    assert seen <= {r.feature for r in texts} and len({r.text for r in texts}) == len(texts)  # one hash a text
    assert collisions(spark.createDataFrame(texts)).count() == 0


def test_texts_say_what_was_hashed(small):
    graph, cases = small
    hard = {r.text for r in Kernel(graph, KernelOptions(match_type="hard", radius=1, distance=2)).explain(cases).collect()}
    assert "d0 r0 node.blue" in hard and "d2 r0 node.blue ~ node.red" in hard and "d0 r1 node.red:link-p0.link-p1" in hard
    soft = {r.text for r in Kernel(graph, KernelOptions(match_type="soft", radius=0, distance=0)).explain(cases).collect()}
    assert soft == {"d0 r0 node ; pred:node ; bin:0_v:node", "d0 r0 node ; pred:node ; bin:1_v:red", "d0 r0 node ; pred:node ; bin:1_v:blue", "d0 r0 node ; f:node ; bn:0"}
    with pytest.raises(ValueError):
        Kernel(graph, KernelOptions(min_kernel=True)).explain(cases)


def test_collisions_are_listed(small):
    graph, cases = small
    texts = Kernel(graph, KernelOptions(match_type="hard", radius=1, distance=2, hash_bit_mask=3)).explain(cases)
    found = {r.feature: (r.n, r.first, r.last) for r in collisions(texts).collect()}
    by_hand: dict[int, set[str]] = {}
    for r in texts.collect():
        by_hand.setdefault(r.feature, set()).add(r.text)
    assert found == {f: (len(t), min(t), max(t)) for f, t in by_hand.items() if len(t) > 1} and found
