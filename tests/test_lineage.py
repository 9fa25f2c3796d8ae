import pytest
from pyspark.sql import functions as F

from factloom.operators.deduce import deduce
from factloom.operators.lineage import Lineage
from factloom.operators.liveness import dependency_dot, dependents
from factloom.schema import Domain


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lineage") / "facts")
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "ex string, u int, s string").write.parquet(path)
    facts = spark.read.parquet(path)
    return {
        "node": facts.select("ex", F.col("u").alias("node")), "likes": facts.select("ex", "u", (F.col("u") + 1).alias("v")), "path": path,
        "alone": spark.createDataFrame([("a", 5)], "ex string, u int"),
    }


def test_subtrees_name_tables(spark, tables):
    known = {n: tables[n] for n in ("node", "likes", "alone")}
    found = Lineage(known)
    assert found.reads(known["node"].filter("node > 1")) == {"node"}
    assert found.reads(known["likes"].join(known["node"], "ex").groupBy("ex").count()) == {"likes", "node"}
    assert found.reads(known["likes"].alias("p").join(known["likes"].alias("q"), F.col("p.v") == F.col("q.u"))) == {"likes"}
    assert found.reads(known["alone"].unionByName(known["alone"])) == {"alone"}
    assert found.reads(spark.range(3)) == set()
    # the files themselves, read another way: both tables come from them
    assert found.reads(spark.read.parquet(tables["path"]).filter("u = 1")) == {"likes", "node"}


def test_subqueries_count(spark, tables):
    known = {"node": tables["node"], "alone": tables["alone"]}
    df = spark.sql("SELECT * FROM {node} WHERE node < (SELECT max(u) FROM {alone})", **known)
    assert Lineage(known).reads(df) == {"node", "alone"}


@pytest.mark.parametrize("keep", [False, True])
def test_a_closure_over_the_target_is_found_and_killed(spark, tables, keep):
    def domain(hidden=None):
        d = Domain().entity("node", "node:self").relationship("likes", "u:node", "v:node").relationship("alone", "u:node")
        d.intensional("popular", "v:node", rule=lambda t: t["likes"].groupBy("ex", "v").agg(F.count(F.lit(1)).alias("n")).select("ex", "v"))
        if hidden is not None:
            d.intensional("a_shadow", "v:node", rule=lambda _: hidden.select("ex", "v"))
        return d.close(["node"])

    given = {n: tables[n] for n in ("node", "likes", "alone")}
    held = deduce(domain(), given)["popular"]
    leaky, plain = domain(held), domain(given["alone"].select("ex", F.col("u").alias("v")))
    for d in (leaky, plain):
        deduce(d, given, keep=keep)
    assert leaky.captured["a_shadow"] >= {"popular"} and "a_shadow" in dependents(leaky, "popular") and "a_shadow" in dependents(leaky, "likes")
    assert plain.captured["a_shadow"] == {"alone"} and "a_shadow" not in dependents(plain, "popular")
    assert '"a_shadow" -> "popular";' in dependency_dot(leaky)
