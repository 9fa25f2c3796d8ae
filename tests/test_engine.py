import gzip
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import config
from factloom.functions import algebra, strings
from factloom.functions.hashing import hash_list, hash_string
from factloom.operators import cases as case_ops
from factloom.operators import deduce, integrity, liveness, metrics, models, paths, relational, splits
from factloom.operators import graph as graph_ops
from factloom.operators.graph import Graph
from factloom.operators.kernels import Kernel, feature_dictionary, remap
from factloom.plans.dataset import Dataset
from factloom.schema import Column, Domain, SchemaError, Signature, er_diagram, parse_declarations
from factloom.sources import facts, sinks


def values(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column):
    return spark.range(1).select(column).first()[0]


# -- schema ------------------------------------------------------------------------------------------------------


def people():
    d = Domain("people").entity("person", "person_id:self", "age:property").entity("town", "town_id:self")
    return d.relationship("lives", "person:person", "town:town").relationship("likes", "a:person@friend", "b:person@friend")


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda d: d.entity("person", "x:self"), "twice"), (lambda d: d.entity("x", "a:self", "b:self"), "self"), (lambda d: d.relationship("r", "a:nowhere").close(), "nowhere"),
        (lambda d: d.entity("x", "a:self", "b:person").close(), "refer"), (lambda d: d.add(Signature("x", (), "odd")), "level"),
        (lambda d: d.entity("x", "a:self", rule="select 1"), "extensional"), (lambda d: d.intensional("x", "a:person", rule=None), "no rule"), (lambda d: d.close(["zz"]), "zz"),
    ],
)
def test_schema_rules(change, message):
    with pytest.raises(SchemaError, match=message):
        change(people())


def test_schema_needs_living_entities_and_relationships():
    with pytest.raises(SchemaError, match="no relationship"):
        Domain().entity("a", "x:self").close()
    with pytest.raises(SchemaError, match="ghost"):
        Domain().entity("a", "x:self", ghost=True).relationship("r", "p:a").close()


def test_traits_and_roles():
    d = people().close(["person"])
    s = d.signatures["lives"]
    assert [s.role(c) for c in s.columns] == ["p1", "p0"] and s.references == ("person", "town") and s.kind == "relationship"
    assert [d.signatures["likes"].role(c) for c in d.signatures["likes"].columns] == ["friend", "friend"]
    assert d.entities == ["person", "town"] and d.is_kernel_point("person") and not d.is_kernel_point("town") and d.signatures["person"].id_position() == 1
    assert d.describe()["person"]["arity"] == 2 and "diamond" in er_diagram(d)


def test_declarations_from_text():
    d = parse_declarations("% a comment\nsignature person(person_id::self, age::property) :: extensional.\nsignature likes(a@friend::person, b@friend::person) :: extensional.").close()
    assert d.signatures["likes"].columns[0].role == "friend" and d.entities == ["person"]


def test_options():
    with pytest.raises(ValueError, match="radius"):
        config.KernelOptions(radius=-1)
    assert config.SessionOptions().with_flag("pthreshold", 0.5).pthreshold == 0.5 and len(config.SessionOptions.describe()) == 7
    with pytest.raises(KeyError):
        config.SessionOptions().with_flag("none", 1)


# -- hashing, strings ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "code"), [("student", 438017639), ("professor", 1247136946), ("viewpointstudent", 439649287), ("bin:0_v:student", 347481075), ("é", 1084794859)])
def test_string_hash(spark, text, code):
    assert one(spark, hash_string(F.lit(text))) == code


@pytest.mark.parametrize(("numbers", "code"), [([0, 0], 2013441960), ([2, 1], 111673430), ([1, 2, 3, 4, 0], 2075227726)])
def test_list_hash(spark, numbers, code):
    assert one(spark, hash_list(F.array(*map(F.lit, numbers)))) == code


def test_strings(spark):
    t = F.lit("a--b-")
    assert one(spark, strings.split_on(t, "-")) == ["a", "b"] and one(spark, strings.replace_all(t, "-", "+")) == "a++b+" and one(spark, strings.reverse_string(t)) == "-b--a"
    assert one(spark, strings.ascii_upper(F.lit("aé"))) == "Aé" and one(spark, strings.rest_after(F.lit("abc"), "ab")) == "c" and one(spark, strings.compare_strings(F.lit("a"), F.lit("b"))) == -1
    assert [one(spark, strings.six_digits(F.lit(x))) for x in (1.0, 0.5, 1234567.0, 0.333333333, -2.0)] == ["1", "0.5", "1.23457e+06", "0.333333", "-2"]
    assert one(spark, strings.member_ignoring_case(F.lit("Ab"), ["AB"])) and one(spark, strings.is_capitalised(F.lit("Ab")))


# -- facts ---------------------------------------------------------------------------------------------------------

FACTS = """% people
interpretation(x, person(ann,30)).
interpretation(x, person(bob,41)).
interpretation(x, town(rome)).
interpretation(x, lives(ann,rome)).
interpretation(x,lives(bob,oslo)).
interpretation(y(2), person(ann, 5)).
db:interpretation(x, sub(g,[link(a,b),c],'q, r')).
interpretation(x, flag).
:- directive(x).
"""


def test_fact_files(spark, tmp_path):
    (tmp_path / "a.pl").write_text(FACTS)
    with gzip.open(tmp_path / "b.pl.gz", "wt") as f:
        f.write("interpretation(z, town(bonn)).\n")
    rows = facts.read_facts(spark, [str(tmp_path / "a.pl"), str(tmp_path / "b.pl.gz")])
    assert rows.count() == 9
    assert rows.filter("sig = 'sub'").first().args == ["g", "[link(a,b),c]", "q, r"]
    assert rows.filter("slice is not null").first()[:2] == ("y", "2") and rows.filter("sig = 'flag'").first().args == []
    again = facts.parse_facts(facts.fact_lines(rows.filter("sig = 'lives'")))
    assert values(again.select("ex", "args")) == values(rows.filter("sig = 'lives'").select("ex", "args"))


def dataset(spark, **options):
    d = people().close(["person", "town"])
    rows = facts.inline_facts(spark, [("x", "person", "ann", 30), ("x", "person", "bob", 41), ("x", "town", "rome"), ("x", "lives", "ann", "rome"), ("x", "lives", "bob", "oslo"), ("x", "likes", "ann", "bob"), ("x", "likes", "ann", "bob")])
    return d, Dataset(d, facts.tables_of(d, rows), config.SessionOptions(**options))


def test_repairs(spark):
    d, data = dataset(spark)
    assert values(integrity.dangling(d, data.tables, "lives").select("column", "id", "n")) == [("town", "oslo", 1)]
    assert data.tables["likes"].count() == 1
    assert values(dataset(spark, referential_integrity_repair="delete")[1].tables["lives"].select("person")) == [("ann",)]
    added = dataset(spark, referential_integrity_repair="add")[1]
    assert values(added.tables["town"].select("town_id")) == [("oslo",), ("rome",)]
    g = data.graph
    assert values(graph_ops.degrees(g).filter("vid like '%lives%'").select("vid", "degree")) == [("x/lives/ann/rome", 2), ("x/lives/bob/oslo", 1)]
    assert values(data.counts().filter("sig = 'person'").select("n")) == [(2,)]


# -- rules ---------------------------------------------------------------------------------------------------------


def test_rules_in_order_and_fixpoint(spark):
    d = people()
    d.intensional("same_town", "a:person", "b:person", rule="select x.ex, x.person a, y.person b from {lives} x join {lives} y on x.ex = y.ex and x.town = y.town and x.person < y.person", depends_on=("lives",))
    d.intensional("friends_near", "a:person", "b:person", rule=lambda t: deduce.exists(t["same_town"], t["likes"], ["ex", "a", "b"]), depends_on=("same_town", "likes"))
    d.close(["person", "town"])
    assert deduce.evaluation_order(d) == ["same_town", "friends_near"]
    rows = facts.inline_facts(spark, [("x", "person", "a", 1), ("x", "person", "b", 1), ("x", "town", "r"), ("x", "lives", "a", "r"), ("x", "lives", "b", "r"), ("x", "likes", "a", "b")])
    assert values(deduce.deduce(d, facts.tables_of(d, rows))["friends_near"]) == [("x", "a", "b")]
    assert liveness.dependents(d, "same_town") == {"same_town", "lives", "friends_near", "likes"} and liveness.dependents(d, "likes") == {"likes", "friends_near", "same_town", "lives"}
    step = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    closure = deduce.fixpoint(step, lambda new: new.join(step.toDF("b", "c"), "b").select("a", F.col("c").alias("b")))
    assert closure.count() == 9


def test_recursive_rules_without_fixpoint_are_refused():
    d = people().intensional("p", "a:person", rule="x", depends_on=("q",)).intensional("q", "a:person", rule="x", depends_on=("p",)).close()
    with pytest.raises(SchemaError, match="depend on each other"):
        deduce.evaluation_order(d)


def test_lists(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("b", 2)], "k string, v int")
    assert values(relational.set_of(rows, "v", ["k"])) == [("a", [1, 3]), ("b", [2])] and values(relational.bag_of(rows, "v", ["k"])) == [("a", [1, 3, 3]), ("b", [2])]
    assert relational.find_all(rows.filter("k = 'z'"), "v").first()[0] == [] and values(relational.slice_rows(rows, 2, 3, ["v"]).select("v")) == [(2,), (3,)]
    assert [r.v for r in relational.shuffled(rows, 1, "k", "v").collect()] == [r.v for r in relational.shuffled(rows, 1, "k", "v").collect()]
    assert values(deduce.forall(rows, F.col("v") > 1, F.col("v") > 2, ["k"])) == [("a",)]


# -- graphs ---------------------------------------------------------------------------------------------------------


def path_graph(spark, n=4, labels=None):
    v = [("g", f"v{k}", (labels or {}).get(k, "n"), "i", f"v{k}", [(labels or {}).get(k, "n"), f"p{k % 2}"], [float(k)], True, True) for k in range(1, n + 1)]
    e = [("g", f"v{a}", f"v{b}", "r") for k in range(1, n) for a, b in ((k, k + 1), (k + 1, k))]
    return Graph(spark.createDataFrame(v, "ex string, vid string, sig string, kind string, sym_id string, syms array<string>, nums array<double>, is_kp boolean, alive boolean"), spark.createDataFrame(e, "ex string, src string, dst string, role string"))


def test_distances_on_a_path(spark):
    found = {(a, b): d for _, a, b, d in paths.distances(path_graph(spark), 2).collect()}
    assert found == {(f"v{a}", f"v{b}"): abs(a - b) for a in range(1, 5) for b in range(1, 5) if abs(a - b) <= 2}
    dead = path_graph(spark, labels={2: "dead"}).kill(["dead"])
    assert {(a, b) for _, a, b, d in paths.distances(dead, 3).collect() if d} == {("v3", "v4"), ("v4", "v3")}


def cases_of(graph):
    return graph.vertices.filter("alive").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))


@pytest.mark.parametrize("match", config.MATCH_TYPES)
@pytest.mark.parametrize("variant", ["nspdk", "rnspdk", "alnspdk"])
def test_vectors_have_norm_one(spark, match, variant):
    g = path_graph(spark)
    found = Kernel(g, config.KernelOptions(variant=variant, match_type=match, radius=1, distance=2)).features(cases_of(g))
    assert all(abs(r.norm2 - 1) < 1e-9 for r in algebra.squared_norms(found).collect()) and found.select("case_id").distinct().count() == 4


@pytest.mark.parametrize("variant", config.VARIANTS)
def test_kernel_ignores_names_and_order(spark, variant):
    g = path_graph(spark, labels={1: "a", 4: "a"})
    names = F.concat(F.lit("z"), F.reverse("vid"))
    h = Graph(g.vertices.withColumn("vid", names).orderBy(F.desc("vid")), g.edges.select("ex", F.concat(F.lit("z"), F.reverse("src")).alias("src"), F.concat(F.lit("z"), F.reverse("dst")).alias("dst"), "role"))
    o = config.KernelOptions(variant=variant, match_type="hard_propertyless", radius=2, distance=1)
    a = values(Kernel(g, o).features(cases_of(g)).select(F.col("case_id"), "feature", F.round("value", 9)))
    b = values(Kernel(h, o).features(cases_of(h)).select(F.reverse(F.expr("substring(case_id, 2)")), "feature", F.round("value", 9)))
    assert a == b and a


def test_min_kernel_and_remap(spark):
    g = path_graph(spark)
    found = Kernel(g, config.KernelOptions(match_type="soft", min_kernel=True)).features(cases_of(g))
    counts = {r.case_id: r.n for r in found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {f"v{k}": 2 + k for k in range(1, 5)}
    numbers = [r["index"] for r in feature_dictionary(found).orderBy("feature").collect()]
    assert numbers == list(range(1, len(numbers) + 1)) and remap(found).count() == found.count()


def test_dead_vertices_make_no_feature(spark):
    g = path_graph(spark, labels={4: "dead"}).kill(["dead"])
    o = config.KernelOptions(match_type="soft", radius=1, distance=2)
    whole, less = path_graph(spark, 3), g
    assert values(Kernel(less, o).features(cases_of(less))) == values(Kernel(whole, o).features(cases_of(whole)))


def test_exports(spark, tmp_path):
    g = path_graph(spark, 2)
    assert [r.value for r in sinks.graph_lines(g, "gspan").orderBy("part", "a", "b").collect()] == ["t # g", "v 0 n.p1", "v 1 n.p0", "e 0 1 r"]
    assert [r.value for r in sinks.graph_lines(g, "dot", True).orderBy("part", "a", "b").collect()] == ["graph g {", '0 [label="n", shape=box];', '1 [label="n", shape=box];', '0 -- 1 [label="r"];', "}"]
    sinks.export_graph(g, str(tmp_path / "out"), "csv")
    assert spark.read.text(str(tmp_path / "out")).count() == 3
    rows = spark.createDataFrame([("a", 2, 0.5), ("a", 1, 1.0)], "case_id string, feature long, value double")
    cases = spark.createDataFrame([("a", 1.0, "q"), ("b", -1.0, "q")], "case_id string, label double, q string")
    assert values(sinks.libsvm_lines(rows, cases).select("value")) == [("-1  # b",), ("1 1:1 2:0.5 # a",)]
    assert values(sinks.libsvm_subset(rows, cases, "q").select("qid")) == [(1,), (1,)]
    induced = spark.createDataFrame([("x/lives/ann/rome",)], "case_id string")
    assert sinks.induced_lines(induced).first().value == "interpretation(x,pred_lives(ann,rome))."
    assert sinks.save_results(rows, str(tmp_path / "r"), {"a": 1}).endswith(sinks.results_name({"a": 1}))
    with pytest.raises(Exception, match="exists"):
        sinks.save_results(rows, str(tmp_path / "r"), {"a": 1})


# -- cases, splits, metrics, models ---------------------------------------------------------------------


def test_cases(spark):
    d, data = dataset(spark)
    found = data.cases("lives", F.col("label") < 0)
    assert {r.case_id: (r.label, r.rejected) for r in found.collect()} == {"x/lives/ann/rome": (1.0, False), "x/lives/bob/rome": (-1.0, True)}
    with pytest.raises(SchemaError, match="kernel point"):
        data.features("person", found, config.KernelOptions())
    vectors = data.features("lives", found, config.KernelOptions(match_type="soft", radius=1, distance=2))
    assert vectors.select("case_id").distinct().count() == 2
    assert case_ops.task_type(spark.createDataFrame([("a",), ("b",), ("c",)], "value string")).first()[0] == "multiclass"
    assert [case_ops.task_type(spark.createDataFrame([(x,) for x in v], "value string")).first()[0] for v in (["true", "false"], ["-1", "1"], ["1", "2.5"], ["a", "1"], ["a"])] == ["binary", "binary", "regression", "error", "error"]


def test_data_set_from_end_to_end(spark, tmp_path):
    d = people()
    d.add(Signature("trait", (*d.signatures["lives"].columns, Column("weight", "property")), ghost=True))
    d.close(["person", "town"])
    rows = []
    for x in "abcd":
        rows += [(x, "person", f"p{k}", 20 + k) for k in range(4)] + [(x, "town", "t0"), (x, "town", "t1")]
        rows += [(x, "lives", f"p{k}", f"t{k % 2}") for k in range(4)] + [(x, "trait", f"p{k}", f"t{k % 2}", 3.5) for k in range(4)]
    data = Dataset(d, facts.tables_of(d, facts.inline_facts(spark, rows)))
    o = config.KernelOptions(match_type="soft", radius=1, distance=1)
    preds = data.kfold("lives", 2, o, "svm_sgd", epochs=20)
    assert preds.count() == 32 and metrics.binary_report(preds).first().error == 0
    ids = data.interpretations().withColumn("part", F.when(F.col("ex") == "a", "test").otherwise("train"))
    assert data.split("lives", ids, o, "lr_sgd").count() == 8
    data.generate_all("lives", o, str(tmp_path / "v"))
    assert spark.read.text(str(tmp_path / "v")).count() == 32
    data.induce(preds, str(tmp_path / "f"))
    assert facts.read_facts(spark, str(tmp_path / "f")).filter("sig = 'pred_lives'").count() == 16
    ball = sinks.viewpoint_ball(data.graph, data.graph.vertices.filter("vid = 'a/person/p0'"), 2)
    assert values(ball.vertices.select("sym_id")) == [("livesp0t0",), ("p0",), ("t0",)]
    assert sinks.fold_lists(splits.kfold(data.interpretations(), 2)).filter("part = 'test'").count() == 4


def test_partitions(spark):
    ids = spark.createDataFrame([(k, k % 2) for k in range(1, 9)], "ex int, s int")
    fold = splits.kfold(ids, 3, 5).collect()
    assert sorted(r.ex for r in fold) == list(range(1, 9)) and sorted([r.fold for r in fold].count(k) for k in range(3)) == [2, 3, 3]
    sums = splits.stratified(ids.filter("ex <= 4"), 2, "s", 1).groupBy("fold").agg(F.sum("ex").alias("t")).collect()
    assert all(r.t % 2 == 1 for r in sums) and len(sums) == 2
    assert splits.random_split(ids, 0.25).filter("part = 'train'").count() == 2 == splits.random_split(ids, 25).filter("part = 'train'").count()
    with pytest.raises(ValueError, match="both"):
        splits.fixed_split(ids, [1], [1])


def test_metrics(spark):
    p = spark.createDataFrame([("a/1", 2.0, 1.0), ("a/2", 1.0, -1.0), ("b/1", -1.0, 1.0), ("b/2", -2.0, -1.0)], "case_id string, prediction double, label double")
    r = metrics.binary_report(p).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.error, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 50.0, 0.5, 0.5, 0.5)
    assert metrics.auc_roc(p).first()[0] == 0.75 and abs(metrics.auc_pr(p).first()[0] - (1 + 2 / 3) / 2) < 1e-12
    ties = spark.createDataFrame([("a", 1.0, 1.0), ("b", 1.0, -1.0)], p.schema)
    assert metrics.auc_roc(ties).first()[0] == 0.5
    assert metrics.binary_report(p.filter("label < 0")).first().recall is None
    assert values(metrics.induced(p, 1.5)) == [("a/1",)]


SPARSE = [(np.array([0, 1]), np.array([x, y])) for x, y in ((1, 0.1), (0.9, -0.2), (1.1, 0.3), (-1, 0.2), (-0.8, -0.1), (-1.2, 0.1))]
SIGNS = np.array([1.0, 1, 1, -1, -1, -1])


@pytest.mark.parametrize("name", ["svm_sgd", "lr_sgd", "adaboost_sgd", "dual_c_svc", "dual_nu_svc"])
def test_classifiers_separate(name):
    m = models.MODELS.new(name)
    m.fit(SPARSE, SIGNS)
    assert (np.sign(m.margin(SPARSE)) == SIGNS).all()


@pytest.mark.parametrize(("name", "options"), [("dual_eps_svr", {"c": 100.0, "epsilon_tube": 0.01}), ("dual_nu_svr", {"c": 100.0, "nu": 0.9}), ("ols_sgd", {"epochs": 400, "lambda_": 1e-3}), ("svr_sgd", {"epochs": 400, "lambda_": 1e-3})])
def test_regressors_fit_a_line(name, options):
    y = np.array([2 * v[0] for _, v in SPARSE])
    m = models.MODELS.new(name, **options)
    m.fit(SPARSE, y)
    assert np.abs(m.margin(SPARSE) - y).max() < 0.3


def test_dual_solution_meets_its_conditions():
    rng = np.random.default_rng(0)
    x = [(np.arange(3), rng.normal(size=3)) for _ in range(40)]
    y = np.where(np.array([v.sum() for _, v in x]) + rng.normal(size=40) > 0, 1.0, -1.0)
    m = models.Svm("c_svc", c=2.0, kernel="rbf", gamma=0.5, tolerance=1e-6)
    m.fit(x, y)
    a, f = m.coefficients * y, y * m.margin(x)
    assert abs((a * y).sum()) < 1e-9 and a.min() >= -1e-12 and a.max() <= 2 + 1e-12
    assert (f[a < 1e-9] >= 1 - 1e-4).all() and (f[a > 2 - 1e-9] <= 1 + 1e-4).all() and (np.abs(f[(a > 1e-6) & (a < 2 - 1e-6)] - 1) < 1e-4).all()


def test_votes_and_saved_models():
    m = models.OneVsOne(kernel="rbf", gamma=2.0)
    x = [(np.array([0]), np.array([v])) for v in (0.0, 0.1, 1.0, 1.1, 2.0, 2.1)]
    y = np.array([3.0, 3, 1, 1, 2, 2])
    m.fit(x, y)
    assert m.margin(x).tolist() == y.tolist() and m.classes == [3.0, 1.0, 2.0]
    s = models.Sgd()
    s.fit(SPARSE, SIGNS)
    assert np.allclose(models.Sgd.load(s.dump()).margin(SPARSE), s.margin(SPARSE)) and s.cost(SPARSE, SIGNS) < 1
    e = models.MODELS.new("external", learn=lambda x, y, t: np.full(len(t), y.mean()))
    e.fit(SPARSE, SIGNS)
    assert e.margin(SPARSE[:2]).tolist() == [0.0, 0.0]
    with pytest.raises(ValueError, match="max_cases"):
        models.Svm("c_svc", max_cases=2).fit(SPARSE, SIGNS)


def test_gram_matches_numpy(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "case_id string, feature long, value double")
    assert values(algebra.gram(rows)) == [("a", "a", 5.0), ("a", "b", 3.0), ("b", "b", 9.0)]
    assert abs(algebra.gram(rows, "rbf", gamma=0.1).filter("case_a != case_b").first().k - np.exp(-0.1 * (5 + 9 - 6))) < 1e-12
    assert values(algebra.combine(rows, rows, 1, -1)) == []


# -- streams ---------------------------------------------------------------------------------------------------------


def test_kernels_of_pairs_without_a_common_feature(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 1.0), ("c", 9, 3.0)], "case_id string, feature long, value double")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "bare")], "case_a string, case_b string")
    for kernel, options in (("rbf", {"gamma": 0.1}), ("poly", {"coef0": -2.0, "degree": 3}), ("sigmoid", {"coef0": -0.5}), ("linear", {})):
        dot, xx, yy = np.array([2.0, 0.0, 0.0]), np.array([5.0, 5.0, 1.0]), np.array([1.0, 9.0, 0.0])
        by_hand = {"rbf": np.exp(-0.1 * (xx + yy - 2 * dot)), "poly": (dot - 2) ** 3, "sigmoid": np.tanh(dot - 0.5), "linear": dot}[kernel]
        got = {(r.case_a, r.case_b): r.k for r in algebra.gram_of(pairs, rows, kernel, **options).collect()}
        assert [got[p] for p in (("a", "b"), ("a", "c"), ("b", "bare"))] == pytest.approx(by_hand.tolist())
        factor = {r.case_id: r.factor for r in algebra.unshared(rows, kernel, **options).collect()}
        sign = algebra.unshared_sign(kernel, options.get("coef0", 0.0), options.get("degree", 3))
        assert sign * factor["a"] * factor["c"] == pytest.approx(by_hand[1])


def test_slices_are_appended_once(spark, tmp_path):
    from factloom.streaming.slices import append_slices, read_slices, windowed_counts

    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):
        spark.createDataFrame([(k, "a"), (k, "a"), (k, "b")], "slice int, id string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("slice int, id string").option("maxFilesPerTrigger", 100).parquet(source)
        q = append_slices(stream, out, str(tmp_path / "check"), lambda f: f.groupBy("id").agg(F.min("slice").alias("slice")), str(tmp_path / "derived"))
        q.processAllAvailable()
        q.stop()
    assert read_slices(spark, out).count() == 4
    assert values(spark.read.parquet(str(tmp_path / "derived")).filter("batch = 1").select("id", "slice")) == [("a", 0), ("b", 0)]
    rows = spark.createDataFrame([("2020-01-01 10:00:00", "x"), ("2020-01-01 11:00:00", "x")], "t string, k string").withColumn("t", F.col("t").cast("timestamp"))
    assert windowed_counts(rows, "t", "k").first().n == 2


def test_dual_solver_raises_when_it_stops_early():
    rng = np.random.default_rng(2)
    x, s = rng.normal(size=(40, 3)), np.where(np.arange(40) % 2, 1.0, -1.0)
    problem = ((x @ x.T) * np.outer(s, s), -np.ones(40), s, np.full(40, 5.0), np.zeros(40), 1e-3)
    with pytest.raises(RuntimeError, match="after 3 steps"):
        models.solve_dual(*problem, rounds=3)
    a, grad = models.solve_dual(*problem)
    score = -s * grad
    up, down = np.where(s > 0, a < 5, a > 0), np.where(s > 0, a > 0, a < 5)
    assert score[up].max() - score[down].min() < 1e-3


def sparse_cases(n=300, seed=4):
    rng = np.random.default_rng(seed)
    dense = rng.normal(size=(n, 6)) * (rng.random((n, 6)) < 0.7)
    truth = np.array([2.0, -1.0, 0.5, 0.0, 1.5, -0.7])
    return [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense], dense, dense @ truth


def test_gradients_reach_the_closed_form():
    x, dense, y = sparse_cases()
    y = y + np.random.default_rng(1).normal(size=len(y)) * 0.1
    model = models.MODELS.new("ols_sgd", lambda_=0.01, epochs=40)
    model.fit(x, y)
    exact = np.linalg.solve(dense.T @ dense / len(y) + 0.01 * np.eye(6), dense.T @ y / len(y))
    assert np.allclose([model.weights.get(k, 0.0) for k in range(6)], exact, atol=0.03)


def test_gradients_reach_the_dual_optimum():
    x, _, y = sparse_cases()
    y = np.where(y + np.random.default_rng(2).normal(size=len(y)) > 0, 1.0, -1.0)
    model = models.MODELS.new("svm_sgd", lambda_=0.01, epochs=60)
    model.fit(x, y)
    # the same problem as a dual: c = 1 / (n * lambda), without an offset
    k = models.gram_matrix(x, x, models.SvmOptions()) * np.outer(y, y)
    a = np.zeros(len(y))
    for _ in range(400):
        for i in range(len(y)):
            a[i] = min(100 / len(y), max(0.0, a[i] + (1 - k[i] @ a) / max(k[i, i], 1e-12)))
    best = np.mean(np.maximum(0, 1 - k @ a)) + 0.005 * a @ k @ a
    assert best - 1e-6 <= model.cost(x, y) < best * 1.03


def test_models_outlive_their_session():
    x, _, y = sparse_cases(60)
    signs, kinds = np.where(y > 0, 1.0, -1.0), np.digitize(y, [-1.0, 1.0]).astype(float)
    for name, labels in (("svm_sgd", signs), ("ols_sgd", y), ("dual_c_svc", signs), ("dual_nu_svc", signs), ("dual_eps_svr", y), ("dual_nu_svr", y), ("dual_c_svc_mc", kinds)):
        model = models.MODELS.new(name, **({"kernel": "rbf", "gamma": 0.3} if name.startswith("dual") else {}))
        model.fit(x, labels)
        assert np.allclose(models.load(models.dump(model)).margin(x), model.margin(x)), name


def test_a_model_must_be_able_to_do_the_task(spark):
    with pytest.raises(ValueError, match="regression"):
        models.check_ability("svm_sgd", "regression")
    models.check_ability("svm_sgd", "binary")
    nothing = spark.createDataFrame([], "case_id string, feature long, value double")
    with pytest.raises(ValueError, match="binary"):
        models.cross_validate(nothing, nothing, nothing, "ols_sgd", task="binary")


def test_an_outside_program(tmp_path):
    script = tmp_path / "learn.py"
    script.write_text("import sys\nn = sum(float(x.split()[0]) for x in open(sys.argv[1]))\nopen(sys.argv[3], 'w').writelines(f'{n + len(x.split())}\\n' for x in open(sys.argv[2]))\n")
    model = models.MODELS.new("external", command=[sys.executable, str(script)])
    x = [(np.array([1, 4]), np.array([0.5, 2.0])), (np.array([2]), np.array([1.0]))]
    model.fit(x, np.array([1.0, 2.0]))
    assert model.margin(x).tolist() == [6.0, 5.0]


def test_what_a_rule_reads_is_found_without_being_declared(spark):
    domain = Domain().entity("person", "id:self").relationship("knows", "a:person", "b:person@other")
    domain.intensional("friend", "a:person", "b:person@other", rule="SELECT ex, a, b FROM {knows}")
    domain.intensional("far", "a:person", "b:person@other", rule=lambda t: t["friend"].join(t["person"].select("ex", "id").withColumnRenamed("id", "a"), ["ex", "a"])).close()
    people = spark.createDataFrame([("x", 1), ("x", 2)], "ex string, id long")
    knows = spark.createDataFrame([("x", 1, 2)], "ex string, a long, b long")
    assert deduce.deduce(domain, {"person": people, "knows": knows})["far"].count() == 1
    assert liveness.calls(domain)["far"] == {"friend", "person"} and liveness.calls(domain)["friend"] == {"knows"}
    assert {"friend", "far", "knows"} <= liveness.dependents(domain, "knows")
    loop = Domain().entity("person", "id:self").relationship("knows", "a:person", "b:person@other")
    loop.intensional("p", "a:person", "b:person@other", rule="SELECT * FROM {q}").intensional("q", "a:person", "b:person@other", rule="SELECT * FROM {p}").close()
    with pytest.raises(Exception, match="depend on each other"):
        deduce.deduce(loop, {"person": people, "knows": knows})


def test_users_add_kernels():
    config.register_kernel("far_end", lambda a, b, d, r, hashed: hashed(b, d))
    try:
        assert config.KernelOptions(variant="far_end").variant == "far_end"
        with pytest.raises(ValueError):
            config.register_kernel("nspdk", None)
    finally:
        del config.PAIR_KEYS["far_end"]
    with pytest.raises(ValueError):
        config.KernelOptions(variant="far_end")


def test_curves_end_at_one(spark):
    rows = spark.createDataFrame([(0.1 * k, 1.0 if k % 3 else -1.0) for k in range(30)], "prediction double, label double")
    points = metrics.curves(rows).orderBy("prediction").collect()
    assert points[0].fpr == points[0].recall == 1.0 and len(points) == 30 and 0 < points[-1].precision <= 1
