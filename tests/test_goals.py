import pytest
from pyspark.sql import functions as F

from factloom.operators.deduce import deduce
from factloom.operators.goals import Rule, UnsafeRule, Var, absent, goal, holds, let, member, missing, occurs, solve, substitute, tables_in, unify
from factloom.operators.liveness import dependents
from factloom.schema import Domain, SchemaError

X, Y, Z, N = map(Var, "XYZN")


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "edge": spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("a", 3, 3), ("b", 1, 2), ("b", 2, 9), ("b", None, 5)], "ex string, u int, v int"),
        "mark": spark.createDataFrame([("a", 3, ["p", "q"]), ("b", 2, ["q"]), ("b", 7, None)], "ex string, node int, tags array<string>"),
        "weight": spark.createDataFrame([(1, 10.0), (2, 5.0), (3, 1.0), (9, 0.5)], "node int, w double"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_facts_meet_within_an_interpretation(tables):
    assert rows(solve((goal("edge", u=X, v=Y), goal("edge", u=Y, v=Z)), tables, {"x": X, "z": Z})) == [(1, 3), (1, 9), (2, 3), (3, 3)]
    assert rows(solve((goal("edge", u=X, v=Y), goal("edge", u=Y, v=Z)), tables, {"ex": Var("ex"), "x": X, "z": Z})) == [("a", 1, 3), ("a", 2, 3), ("a", 3, 3), ("b", 1, 9)]
    assert rows(solve((goal("edge", ex=N, u=X, v=X),), tables, {"n": N, "x": X})) == [("a", 3)]
    assert rows(solve((goal("edge", u=None, v=X),), tables, {"x": X})) == [(5,)]


def test_nulls_unify_with_nothing(tables):
    both = (goal("edge", u=X, v=Y), goal("edge", u=X, v=Z))
    assert 5 not in {r[0] for r in rows(solve(both, tables, {"y": Y}))}


def test_order_of_goals_does_not_matter(tables):
    body = [goal("edge", u=X, v=Y), goal("weight", node=Y, w=N), holds(lambda n: n < 6, N), let(Z, lambda n: n * 2, N), absent(goal("mark", node=Y))]
    found = [rows(solve([body[(k + j) % 5] for j in range(5)], tables, {"x": X, "y": Y, "z": Z})) for k in range(5)]
    assert found[0] == [(1, 2, 10.0), (2, 9, 1.0)] and all(f == found[0] for f in found)
    assert rows(solve(body[::-1], tables, {"x": X, "y": Y, "z": Z})) == found[0]


def test_a_fact_without_new_variables_only_filters(tables):
    df = solve((goal("edge", u=X, v=Y), goal("weight", node=Y, w=N), goal("mark", node=Y)), tables, {"x": X})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2 and "Inner" not in plan and "Cartesian" not in plan
    assert rows(df) == [(1,), (2,), (3,)]


def test_negation_of_a_conjunction_has_variables_of_its_own(tables):
    body = (goal("edge", u=X, v=Y), holds(lambda x: x.isNotNull(), X), absent(goal("edge", u=Y, v=Z), goal("weight", node=Z, w=N), holds(lambda n: n < 2, N)))
    assert rows(solve(body, tables, {"ex": Var("ex"), "x": X, "y": Y})) == [("b", 2, 9)]


def test_members_and_bound_values(tables):
    body = (goal("mark", node=X, tags=Y), member(Z, Y))
    assert rows(solve(body, tables, {"x": X, "z": Z})) == [(2, "q"), (3, "p"), (3, "q")]
    assert rows(solve((*body, let(Z, lambda y: F.element_at(y, 1), Y)), tables, {"x": X, "z": Z})) == [(2, "q"), (3, "p")]
    assert rows(solve((goal("weight", node=X, w=Y), let(X, lambda y: (y / 10).cast("int"), Y)), tables, {"x": X})) == [(1,)]


@pytest.mark.parametrize("body", [
    (goal("edge", u=X), goal("weight", node=Y)),  # a product
    (goal("edge", u=X), absent(goal("weight", node=Y)), holds(lambda y: y > 1, Y)),  # bound by a negation only
    (goal("edge", u=X), absent(goal("weight", node=Y))),  # a negation beside the point
    (holds(lambda x: x > 1, X),), (absent(goal("edge", u=X)),), (goal("edge", u=Z), let(X, lambda y: y, Y)),
])
def test_unsafe_rules_are_refused(tables, body):
    with pytest.raises(UnsafeRule):
        solve(body, tables | {"edge": tables["edge"].drop("ex")}, {"x": X})
    with pytest.raises(SchemaError):
        solve((goal("edge", nowhere=X),), tables, {"x": X})


def test_lists_of_goals():
    a, b, c = goal("p", x=X, y=1), goal("p", x=2, y=Y), goal("q", x=X)
    body = (a, c) + (b,)
    assert unify(a, b) == {"X": 2, "Y": 1} and unify(a, c) is None and unify(goal("p", x=X, y=X), goal("p", x=1, y=2)) is None
    assert unify(goal("p", x=X, y=X), goal("p", x=Y, y=3)) == {"X": Y, "Y": 3} and unify(goal("p", x=1), goal("p", x=True)) is None
    assert occurs(goal("p", x=2, y=Z), body) == [{"X": 2, "Z": 1}, {"Z": Y}]
    assert missing(goal("r"), body) and not missing(c, body) and missing(goal("p", y=5, x=7), body)
    assert substitute((a, absent(c)), {"X": Y, "Y": 4}) == (goal("p", x=4, y=1), absent(goal("q", x=4)))
    with pytest.raises(SchemaError):
        substitute((holds(lambda x: x > 1, X),), {"X": 3})
    assert tables_in((a, absent(c, absent(goal("r"))), holds(lambda x: x, X))) == {"p", "q", "r"}


def test_a_rule_of_a_domain(tables, spark):
    d = Domain().entity("node", "node:self").relationship("edge", "u:node", "v:node")
    rule = Rule({"u": X, "v": Y}, (goal("edge", u=X, v=Z), goal("edge", u=Z, v=Y), absent(goal("edge", u=X, v=Y))), (goal("edge", u=Y, v=X), holds(lambda x, y: x != y, X, Y)))
    d.intensional("two", "u:node", "v:node", rule=rule).close(["node"])
    found = deduce(d, {"edge": tables["edge"].filter("u is not null"), "node": spark.createDataFrame([("a", 1)], "ex string, node int")})
    assert rows(found["two"].select("ex", "u", "v")) == [("a", 1, 3), ("a", 2, 1), ("a", 3, 2), ("b", 1, 9), ("b", 2, 1), ("b", 9, 2)]
    assert d.captured["two"] == {"edge"} and dependents(d, "two") == {"two", "edge"}


def test_another_fact_is_never_paired(spark):
    from factloom.operators.goals import another

    rows = [(1, "x", "p q"), (2, "x", "q"), (2, "x", "r"), (3, "y", "q"), (4, "y", "r r"), (5, None, "p"), (6, None, "p")]
    tables = {"part": spark.createDataFrame(rows, "id int, brand string, name string")}
    a, b, d, n, p, w, l, q = map(Var, "abdnpwlq")
    split = lambda name: F.split(name, " ")
    first = (goal("part", id=a, brand=d, name=n), let(l, split, n), member(w, l))
    rest = (goal("part", id=b, brand=d, name=p), let(q, split, p))
    found = solve((*first, another(a, b, *rest, member(w, q))), tables, {"a": a, "w": w})
    paired = solve((*first, *rest, holds(lambda x, y: x != y, a, b), holds(F.array_contains, q, w)), tables, {"a": a, "w": w})
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, paired.collect())) == [(1, "q"), (2, "q")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and "Join Inner" not in plan
