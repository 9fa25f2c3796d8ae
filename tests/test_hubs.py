"""Kernels over hubs: work grows with the vertices, not with the pairs that meet at a hub."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.config import KernelOptions
from factloom.operators import kernels
from factloom.operators.graph import Graph
from factloom.operators.kernels import Kernel
from factloom.operators.paths import distances


def star(spark, n):
    """A hub whose n links each lead to an item."""
    v = [("1", "hub", "hub", True, ["hub"])] + [("1", f"item{k}", "item", True, ["item", "ab"[k % 2]]) for k in range(n)] + [("1", f"link{k}", "link", False, ["link"]) for k in range(n)]
    half = [("1", f"link{k}", end, role) for k in range(n) for end, role in ((f"item{k}", "p"), ("hub", "q"))]
    vertices = spark.createDataFrame(v, "ex string, vid string, sig string, is_kp boolean, syms array<string>").select("ex", "vid", "sig", F.lit("i").alias("kind"), "syms", F.array().cast("array<double>").alias("nums"), "is_kp", F.lit(True).alias("alive"))
    return Graph(vertices, spark.createDataFrame(half + [(x, b, a, r) for x, a, b, r in half], "ex string, src string, dst string, role string"))


def cases_of(graph):
    return graph.vertices.filter("sig = 'item'").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))


def all_points(graph):
    """The graph with its links as kernel points too."""
    return Graph(graph.vertices.withColumn("is_kp", F.lit(True)), graph.edges)


def largest_cut(spark, monkeypatch, n, **options):
    sizes, real = [], kernels.cut
    monkeypatch.setattr(kernels, "cut", lambda df: sizes.append((out := real(df)).count()) or out)
    g = star(spark, n)
    assert Kernel(g, KernelOptions(**options)).features(cases_of(g)).select("case_id").distinct().count() == n
    monkeypatch.setattr(kernels, "cut", real)
    return max(sizes)


@pytest.mark.parametrize("options", [{"match_type": "hard", "radius": 1, "distance": 2}, {"match_type": "soft", "radius": 2, "distance": 2}])
def test_tables_grow_with_the_vertices(spark, monkeypatch, options):
    assert largest_cut(spark, monkeypatch, 120, **options) <= 3.2 * largest_cut(spark, monkeypatch, 40, **options)


@pytest.mark.parametrize("match_type", ["hard", "soft"])
def test_viewpoints_are_marked_near_them_only(spark, monkeypatch, match_type):
    options = {"variant": "rnspdk", "match_type": match_type, "radius": 1, "distance": 2}
    assert largest_cut(spark, monkeypatch, 120, **options) <= 3.2 * largest_cut(spark, monkeypatch, 40, **options)


@pytest.mark.parametrize("variant", ["nspdk3d", "nspdk"])
def test_links_that_are_kernel_points_do_not_meet_at_their_hub(spark, monkeypatch, variant):
    """Cases look from items; the links of a hub, two steps from each other, begin no pair."""

    def most(n):
        sizes, real = [], kernels.cut
        monkeypatch.setattr(kernels, "cut", lambda df: sizes.append((out := real(df)).count()) or out)
        g = all_points(star(spark, n))
        Kernel(g, KernelOptions(variant=variant, match_type="hard_propertyless", radius=1, distance=2)).features(cases_of(g)).collect()
        monkeypatch.setattr(kernels, "cut", real)
        return max(sizes)

    assert most(120) <= 3.2 * most(40)


def test_cases_that_share_a_viewpoint_count_it_once_each(spark):
    """Without steps, too: a walk begins once at a vertex, however many cases look from it."""
    g = star(spark, 6)
    once = cases_of(g)
    twice = once.unionByName(once.withColumn("case_id", F.concat(F.lit("also "), "case_id")))
    found = Kernel(g, KernelOptions(distance=0, normalization=False)).features(twice).collect()
    assert {r.value for r in found} == {1.0} and len({r.case_id for r in found}) == 12


def test_fingerprints_read_a_ball_once(spark, monkeypatch):
    from factloom.operators import cache

    def most(n):
        sizes, real = [], kernels.cut
        monkeypatch.setattr(cache, "cut", lambda df: sizes.append((out := real(df)).count()) or out)
        g = star(spark, n)
        prints = cache.case_fingerprints(g, cases_of(g), KernelOptions(match_type="hard", radius=1, distance=2)).collect()
        assert len({r.fingerprint for r in prints}) == n
        monkeypatch.setattr(cache, "cut", real)
        return max(sizes)

    assert most(120) <= 3.2 * most(40)


def test_hard_balls_of_radius_two_are_counted(spark, monkeypatch):
    options = {"match_type": "hard", "radius": 2, "distance": 2}
    assert largest_cut(spark, monkeypatch, 120, **options) <= 3.2 * largest_cut(spark, monkeypatch, 40, **options)


def test_global_distances_in_balls_are_counted(spark, monkeypatch):
    options = {"variant": "anspdk", "match_type": "hard", "radius": 2, "distance": 2}
    assert largest_cut(spark, monkeypatch, 120, **options) <= 3.2 * largest_cut(spark, monkeypatch, 40, **options)


@pytest.mark.parametrize("distance", [1, 3, 4])
def test_paths_around_a_ball_count(spark, monkeypatch, distance):
    """Rings, whose balls are left and entered again, and random graphs, against all pairs of a ball with their global distances."""
    rng = random.Random(distance)
    ends = [(f"r{n}", a, (a + 1) % n) for n in range(5, 10) for a in range(n)] + [(f"x{k}", *rng.sample(range(14), 2)) for k in range(3) for _ in range(16 + 3 * k)]
    half = [(x, str(a), str(b), rng.choice("pq")) for x, a, b in ends]
    v = [(x, a, "item", rng.random() < 0.8, ["item", rng.choice("ab")]) for x, a in sorted({(x, a) for x, *two, _ in half for a in two})]
    vertices = spark.createDataFrame(v, "ex string, vid string, sig string, is_kp boolean, syms array<string>").select("ex", "vid", "sig", F.lit("i").alias("kind"), "syms", F.array().cast("array<double>").alias("nums"), "is_kp", F.lit(True).alias("alive"))
    g = Graph(vertices, spark.createDataFrame(half + [(x, b, a, r) for x, a, b, r in half], "ex string, src string, dst string, role string"))
    cases = g.vertices.filter("is_kp").select("ex", F.concat_ws("/", "ex", "vid").alias("case_id"), F.array("vid").alias("viewpoints"))
    options = KernelOptions(variant="anspdk", match_type="hard", radius=2, distance=distance)
    found = lambda: {(r.case_id, r.feature): r.value for r in Kernel(g, options).features(cases).collect()}
    got, walked = found(), []
    dist = distances(g, max(2, distance)).select(F.concat(F.lit("0"), "ex").alias("g"), F.col("src").alias("i"), F.col("dst").alias("j"), "d")

    def pairs(ball, inner, label, top, hops=None):
        walked.append(hops)
        both = ball.drop("d").join(ball.select("g", "root", F.col("i").alias("j")), ["g", "root"])
        return both.join(dist, ["g", "i", "j"], "left").withColumn("d", F.coalesce("d", F.lit(-1))).join(label, ["g", "j"]).withColumn("n", F.lit(1))

    monkeypatch.setattr(Kernel, "_seen", staticmethod(pairs))
    assert got == pytest.approx(found()) and walked[0] is not None


def test_pairs_do_not_carry_the_text_of_a_hub(spark):
    """The text of a hub is as long as its links, and each of them has a pair with it."""

    def length(n):
        g = star(spark, n)
        ends = Kernel(g, KernelOptions(match_type="hard", radius=1, distance=2), traced=True)._ends(cases_of(g))[0]
        return ends.agg(F.sum(F.length("near") + F.length("far"))).first()[0]

    assert length(80) <= 2.2 * length(40)
