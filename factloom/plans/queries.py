"""Registered queries over the star-schema tables, each with the DuckDB SQL of its result where SQL has one."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import KernelOptions, SgdOptions
from ..functions import algebra, strings
from ..functions.hashing import hash_list, hash_string, sql_hash_list, sql_hash_string
from ..operators import cases as case_ops
from ..operators import deduce, integrity, linear, liveness, metrics, models, paths, relational, splits
from ..operators import graph as graph_ops
from ..operators.cache import VectorCache, graph_fingerprints
from ..operators.goals import Rule, Var, absent, another, goal, holds, let, member, solve
from ..operators.graph import Graph, build_graph
from ..operators.kernels import Kernel, collisions, ghost_features, remap
from ..schema import Domain
from ..sources import facts as fact_ops
from ..sources import sinks
from ..sources.trade import base_tables, load, suppliers_domain, trade_domain
from .dataset import Dataset
from .sql import BASE, features_sql, graph_sql, hist_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# -- rules ----------------------------------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT ex, customer, supplier FROM sends_back")
def rule_join(spark, sf_dir):
    return deduce.deduce(trade_domain(), base_tables(spark, sf_dir))["sends_back"]


@query("""WITH big AS (SELECT DISTINCT l_partkey AS part, l_suppkey AS s FROM lineitem WHERE l_quantity = 50)
SELECT DISTINCT a.s AS supplier_a, b.s AS supplier_b FROM big a JOIN big b ON a.part = b.part AND a.s < b.s""")
def rule_selfjoin(spark, sf_dir):
    big = load(spark, sf_dir, "lineitem").filter("l_quantity = 50").select(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("s")).distinct()
    a, b = big.withColumnRenamed("s", "supplier_a"), big.withColumnRenamed("s", "supplier_b")
    return a.join(b, "part").filter("supplier_a < supplier_b").select("supplier_a", "supplier_b").distinct()


@query("SELECT c_custkey AS customer FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def rule_semijoin(spark, sf_dir):
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer"))
    return deduce.exists(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), urgent, ["customer"])


@query("SELECT c_custkey AS customer FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def rule_negation(spark, sf_dir):
    urgent = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("customer"))
    return deduce.absent(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")), urgent, ["customer"])


@query("""SELECT s_nationkey AS nation, 'supplier' AS kind FROM supplier WHERE s_acctbal < 0 UNION
SELECT c_nationkey, 'customer' FROM customer WHERE c_acctbal < 0""")
def rule_union(spark, sf_dir):
    a = load(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"))
    b = load(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return deduce.union_of(a, b)


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'other' END AS class FROM orders""")
def rule_ifelse(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.when(F.col("o_totalprice") > 200000, "large").when(F.col("o_orderstatus") == "F", "done").otherwise("other").alias("class"))


@query("SELECT DISTINCT p_partkey AS part, unnest(string_split(p_name, ' ')) AS word FROM part")
def rule_unnest(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.split("p_name", " ").alias("words"))
    return deduce.unnest(rows, "words", "word").distinct()


@query("SELECT o_custkey AS customer, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def rule_count(spark, sf_dir):
    return load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count_distinct("o_orderpriority").alias("n"))


@query("""WITH RECURSIVE up AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey // 3 > 0),
anc AS (SELECT a, b FROM up UNION SELECT x.a, u.b FROM anc x JOIN up u ON x.b = u.a) SELECT a, b FROM anc""")
def rule_recursive(spark, sf_dir):
    up = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("a"), F.expr("c_custkey div 3").alias("b")).filter("b > 0")
    parent = up.select(F.col("a").alias("b"), F.col("b").alias("next"))
    return deduce.fixpoint(up, lambda fresh: fresh.join(parent, "b").select("a", F.col("next").alias("b")))


@query("SELECT o_custkey AS customer FROM orders GROUP BY 1 HAVING bool_and(CASE WHEN o_orderstatus = 'F' THEN o_totalprice > 1000 ELSE true END)")
def rule_forall(spark, sf_dir):
    return deduce.forall(load(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", F.col("o_totalprice") > 1000, ["o_custkey"]).withColumnRenamed("o_custkey", "customer")


@query("SELECT c_custkey AS customer, o_orderkey AS order_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000")
def rule_leftjoin(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_totalprice > 250000").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"))
    return load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer")).join(o, "customer", "left")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name")
def rule_thetajoin(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    a, b = n.select("n_regionkey", F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select("n_regionkey", F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, "n_regionkey").filter("x < y").select("a", "b")


@query("SELECT n_regionkey AS region, list_sort(list(DISTINCT n_name)) AS names, count(*) AS n FROM nation GROUP BY 1")
def set_of(spark, sf_dir):
    n = load(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "region")
    return relational.set_of(n, "n_name", ["region"], "names").join(n.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region")


@query("SELECT o_custkey AS customer, list_sort(list(o_orderpriority)) AS bag FROM orders GROUP BY 1")
def bag_of(spark, sf_dir):
    return relational.bag_of(load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer"), "o_orderpriority", ["customer"], "bag")


@query("SELECT o_orderkey AS order_id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 11 OFFSET 9")
def slice_of_list(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), (-F.col("o_totalprice")).alias("p"))
    return relational.slice_rows(rows, 10, 20, ["p", "order_id"]).select("order_id")


@query("SELECT l_returnflag AS a, l_linestatus AS b, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2")
def histogram2(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"), "l_quantity")
    return relational.histogram(rows, ["a", "b"], F.col("l_quantity"))


# -- rules as lists of goals -----------------------------------------------------------------------------------

A, B, C, D, L, N, O, P, Q, S, W = map(Var, "ABCDLNOPQSW")


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem")}


@query(f"WITH {BASE} SELECT ex, customer, supplier FROM sends_back")
def goals_rule(spark, sf_dir):
    """The derived relation of the trade domain, its rule given as goals."""
    rule = Rule({"customer": C, "supplier": S}, (goal("returned", customer=C, supplier=S), goal("customer", customer_id=C), goal("supplier", supplier_id=S)))
    d = trade_domain(rule)
    return deduce.deduce(d, base_tables(spark, sf_dir))["sends_back"]


@query("""SELECT DISTINCT o_custkey AS customer, l_suppkey AS supplier FROM orders JOIN lineitem ON l_orderkey = o_orderkey
JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey AND o_orderstatus = 'F'""")
def goals_chain(spark, sf_dir):
    body = (goal("supplier", s_suppkey=S, s_nationkey=N), goal("lineitem", l_orderkey=O, l_suppkey=S), goal("customer", c_custkey=C, c_nationkey=N), goal("orders", o_orderkey=O, o_custkey=C, o_orderstatus="F"))
    return solve(body, star_tables(spark, sf_dir), {"customer": C, "supplier": S})


@query("""SELECT c_custkey AS customer, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_quantity > 25)""")
def goals_negation(spark, sf_dir):
    """A negated conjunction, with variables of its own and a comparison inside; it is written before the fact that binds its variable."""
    body = (absent(goal("orders", o_orderkey=O, o_custkey=C), goal("lineitem", l_orderkey=O, l_returnflag="R", l_quantity=Q), holds(lambda q: q > 25, Q)), goal("customer", c_custkey=C, c_mktsegment=S))
    return solve(body, star_tables(spark, sf_dir), {"customer": C, "segment": S})


@query("SELECT DISTINCT a.l_suppkey AS supplier_a, b.l_suppkey AS supplier_b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey")
def goals_selfjoin(spark, sf_dir):
    body = (holds(lambda a, b: a < b, A, B), goal("lineitem", l_orderkey=O, l_suppkey=A), goal("lineitem", l_orderkey=O, l_suppkey=B))
    return solve(body, star_tables(spark, sf_dir), {"supplier_a": A, "supplier_b": B})


@query("""SELECT DISTINCT s_suppkey AS supplier, 'late' AS kind FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_suppkey = s_suppkey AND o_orderpriority = '1-URGENT' AND date_diff('day', o_orderdate::DATE, l_shipdate::DATE) > 100)""")
def goals_computed(spark, sf_dir):
    """A computed value and a constant in the head."""
    body = (let(D, lambda a, b: F.datediff(b, a), A, B), holds(lambda d: d > 100, D), goal("orders", o_orderkey=O, o_orderpriority="1-URGENT", o_orderdate=A), goal("lineitem", l_orderkey=O, l_suppkey=S, l_shipdate=B), goal("supplier", s_suppkey=S))
    return solve(body, star_tables(spark, sf_dir), {"supplier": S, "kind": "late"})


@query("""WITH w AS (SELECT DISTINCT p_partkey AS part, p_brand AS brand, unnest(string_split(p_name, ' ')) AS word FROM part)
SELECT DISTINCT a.part, a.word FROM w a JOIN w b ON a.brand = b.brand AND a.word = b.word AND a.part <> b.part""")
def goals_member(spark, sf_dir):
    """Words that a part's name shares with another part of its brand: elements of computed lists."""
    words = lambda name: F.split(name, " ")
    body = (goal("part", p_partkey=A, p_brand=D, p_name=N), let(L, words, N), member(W, L), another(A, B, goal("part", p_partkey=B, p_brand=D, p_name=P), let(Q, words, P), member(W, Q)))
    return solve(body, star_tables(spark, sf_dir), {"part": A, "word": W})


@query("""SELECT 'supplier' AS kind, s_suppkey AS id FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal < 0 AND n_regionkey = 1
UNION SELECT 'customer', c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal < 0 AND n_regionkey = 1""")
def goals_clauses(spark, sf_dir):
    """Two clauses of one head."""
    home, debt = goal("nation", n_nationkey=N, n_regionkey=1), holds(lambda a: a < 0, A)
    tables = star_tables(spark, sf_dir)
    parts = [solve((goal(t, **{f"{t[0]}_{k}": S, f"{t[0]}_nationkey": N, f"{t[0]}_acctbal": A}), home, debt), tables, {"kind": t, "id": S}) for t, k in (("supplier", "suppkey"), ("customer", "custkey"))]
    return deduce.union_of(*parts)


# -- catalogue and integrity -------------------------------------------------------------------------------


@query(f"WITH {BASE} SELECT DISTINCT ex FROM n")
def list_interpretations(spark, sf_dir):
    return base_tables(spark, sf_dir)["nation"].select("ex").distinct()


@query(f"""WITH {BASE} SELECT ex, 'cust_in' AS sig, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT ex, 'customer', count(*) FROM c GROUP BY 1
UNION ALL SELECT ex, 'nation', count(*) FROM n GROUP BY 1 UNION ALL SELECT ex, 'supp_in', count(*) FROM s GROUP BY 1
UNION ALL SELECT ex, 'supplier', count(*) FROM s GROUP BY 1 UNION ALL SELECT ex, 'sends_back', count(*) FROM sends_back GROUP BY 1""")
def signature_counts(spark, sf_dir):
    d = trade_domain()
    found = deduce.deduce(d, base_tables(spark, sf_dir))
    return deduce.signature_counts({n: found[n] for n in d.signatures})


@query("SELECT 'k' AS sig, o_custkey::VARCHAR AS id, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 2 HAVING count(*) > 1")
def key_duplicates(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("id"), "o_orderstatus")
    return deduce.key_violations(rows, ["id"]).select(F.lit("k").alias("sig"), "id", "n")


@query("SELECT c_custkey AS customer, o_orderkey AS order_id FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 WHERE o_orderkey IS NULL")
def ground_violations(spark, sf_dir):
    return deduce.ground_violations(rule_leftjoin(spark, sf_dir))


def _broken(spark, sf_dir):
    """The supplier tables without the suppliers in debt: their relationships dangle."""
    t = base_tables(spark, sf_dir)
    return t | {"supplier": t["supplier"].filter("balance >= 0")}


@query(f"WITH {BASE} SELECT ex, 'supp_in' AS sig, 'supplier' AS \"column\", 'supplier' AS entity, id, count(*) AS n FROM s WHERE balance < 0 GROUP BY ex, id")
def fk_violations(spark, sf_dir):
    return integrity.dangling(suppliers_domain(), _broken(spark, sf_dir), "supp_in")


@query(f"WITH {BASE} SELECT ex, id AS supplier_id, CASE WHEN balance >= 0 THEN band ELSE '?' END AS band, CASE WHEN balance >= 0 THEN balance END AS balance FROM s")
def repair_add(spark, sf_dir):
    return integrity.check_and_repair(suppliers_domain(), _broken(spark, sf_dir), "add")["supplier"]


@query(f"WITH {BASE} SELECT ex, id AS supplier, nation FROM s WHERE balance >= 0")
def repair_delete(spark, sf_dir):
    return integrity.check_and_repair(suppliers_domain(), _broken(spark, sf_dir), "delete")["supp_in"].select("ex", "supplier", "nation")


@query(f"WITH {BASE} SELECT ex || '/supp_in/' || id || '/' || nation AS vid, CASE WHEN balance >= 0 THEN 2 ELSE 1 END::BIGINT AS degree FROM s")
def hanging_edges(spark, sf_dir):
    g = build_graph(suppliers_domain(), _broken(spark, sf_dir))
    return graph_ops.degrees(g).join(g.vertices.filter("sig = 'supp_in'").select("vid"), "vid", "left_semi").select("vid", "degree")


@query(f"WITH {BASE} SELECT ex, 'nation' AS sig, id, count(*) AS n FROM (SELECT n.ex, n.id FROM n JOIN s ON s.nation = n.id AND s.band = 'high') GROUP BY ex, id HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    t = base_tables(spark, sf_dir)
    high = t["supplier"].filter("band = 'high'").select(F.col("supplier_id").alias("supplier"))
    twice = t["nation"].join(t["supp_in"].join(high, "supplier").select(F.col("nation").alias("nation_id")), "nation_id").select("ex", "nation_id", "name")
    return integrity.duplicate_ids(suppliers_domain(), t | {"nation": twice}).filter("sig = 'nation'")


@query(f"WITH {BASE} SELECT ex, 'nation' AS sig, id FROM n UNION SELECT ex, 'supplier', id FROM s")
def identifiers(spark, sf_dir):
    return integrity.identifiers(suppliers_domain(), base_tables(spark, sf_dir))


# -- graphs -----------------------------------------------------------------------------------------------------------


def _trade(spark, sf_dir) -> Graph:
    d = trade_domain()
    return build_graph(d, deduce.deduce(d, base_tables(spark, sf_dir), keep=True))


def _suppliers(spark, sf_dir) -> Graph:
    return build_graph(suppliers_domain(), base_tables(spark, sf_dir))


@query(f"WITH {graph_sql(trade=True)} SELECT ex, sig, count(*) AS n FROM v WHERE sig NOT IN ('sends_back', 'customer', 'supplier') GROUP BY ALL")
def leak_killed(spark, sf_dir):
    """The living vertices when sends_back is the target, beside a rule whose function holds that relation and names no table.

    What it is derived from is dead (customers and suppliers that no declaration calls safe), and so is what the rule derives.
    """
    tables = base_tables(spark, sf_dir)
    held = deduce.deduce(trade_domain(), tables)["sends_back"]
    d = Domain("leaky")
    for s in trade_domain().signatures.values():
        d.add(s)
    d.intensional("partner", "customer:customer", "supplier:supplier", rule=lambda _: held.select("ex", "customer", "supplier"))
    d.helpers["returned"] = ()
    d.close(["nation", "supplier", "customer"])
    found = deduce.deduce(d, tables, keep=True)
    dead = liveness.dependents(d, "sends_back")
    return build_graph(d, found).kill(sorted(dead)).living().vertices.groupBy("ex", "sig").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {graph_sql(trade=True)} SELECT ex, vid, sig, kind, sym_id, syms, nums, is_kp, true AS alive FROM v")
def vertices(spark, sf_dir):
    return _trade(spark, sf_dir).vertices.drop("slice")


@query(f"WITH {graph_sql(trade=True)} SELECT ex, src, dst, role FROM e")
def edges(spark, sf_dir):
    return _trade(spark, sf_dir).edges


DEGREE_SQL = f"WITH {graph_sql(trade=True)} SELECT v.ex, v.sig, v.vid, count(*) AS degree FROM v JOIN e ON e.src = v.vid WHERE v.is_kp GROUP BY 1, 2, 3"


@query(DEGREE_SQL)
def degree(spark, sf_dir):
    """Flagship: the degree of each kernel point."""
    g = _trade(spark, sf_dir)
    return graph_ops.degrees(g).join(g.vertices.filter("is_kp").select("ex", "vid", "sig"), ["ex", "vid"]).select("ex", "sig", "vid", "degree")


@query(f"WITH {graph_sql()} SELECT e.ex, e.src AS vid, list_sort(list(DISTINCT e.dst)) AS neighbours FROM e WHERE e.src NOT LIKE '%/nation/%' AND e.dst NOT LIKE '%/nation/%' GROUP BY 1, 2")
def adjacency_alive(spark, sf_dir):
    return graph_ops.adjacency(_suppliers(spark, sf_dir).kill(["nation"]))


@query(f"WITH {graph_sql()} SELECT e.ex, src, dst, role FROM e JOIN v a ON a.vid = src JOIN v b ON b.vid = dst WHERE (a.sig <> 'supplier' OR a.syms[2] = 'high') AND (b.sig <> 'supplier' OR b.syms[2] = 'high')")
def induced_subgraph(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    return graph_ops.induced_subgraph(g, g.vertices.filter("sig != 'supplier' or syms[1] = 'high'")).edges


@query(f"WITH {graph_sql()} SELECT v.ex, count(*) AS n_vertices, (SELECT count(*) // 2 FROM e WHERE e.ex = v.ex)::BIGINT AS n_edges, true AS ok FROM v GROUP BY v.ex")
def graph_sanity(spark, sf_dir):
    return graph_ops.sanity(_suppliers(spark, sf_dir))


NUMBERED = f"""{graph_sql()}, num AS (SELECT ex, vid, row_number() OVER (PARTITION BY ex ORDER BY kind, vid) - 1 AS no, array_to_string(syms, '.') AS text, kind FROM v),
ends AS (SELECT e.ex, a.no AS a, b.no AS b, role FROM e JOIN num a ON a.vid = e.src JOIN num b ON b.vid = e.dst WHERE a.no < b.no)"""


@query(f"WITH {NUMBERED} SELECT ex, no || ';' || text || ';' || kind AS value FROM num UNION ALL SELECT ex, a || ';' || b || ';' || role FROM ends")
def export_csv_rows(spark, sf_dir):
    return sinks.graph_lines(_suppliers(spark, sf_dir), "csv").select("ex", "value")


@query(f"WITH {NUMBERED} SELECT ex, 'v ' || no || ' ' || text AS value FROM num UNION ALL SELECT ex, 'e ' || a || ' ' || b || ' ' || role FROM ends UNION ALL SELECT DISTINCT ex, 't # ' || ex FROM num")
def export_gspan_rows(spark, sf_dir):
    return sinks.graph_lines(_suppliers(spark, sf_dir), "gspan").select("ex", "value")


@query(f"""WITH {NUMBERED} SELECT ex, no || ' [label="' || text || '", shape=' || CASE kind WHEN 'i' THEN 'box' ELSE 'diamond' END || '];' AS value FROM num
UNION ALL SELECT ex, a || ' -- ' || b || ' [label="' || role || '"];' FROM ends UNION ALL SELECT DISTINCT ex, 'graph g {{' FROM num UNION ALL SELECT DISTINCT ex, '}}' FROM num""")
def export_dot_rows(spark, sf_dir):
    return sinks.graph_lines(_suppliers(spark, sf_dir), "dot").select("ex", "value")


@query(f"""WITH {NUMBERED} SELECT ex, 'node [ id ' || no || ' label "' || text || '" type "' || kind || '" ]' AS value FROM num
UNION ALL SELECT ex, 'edge [ source ' || a || ' target ' || b || ' label "' || role || '" ]' FROM ends UNION ALL SELECT DISTINCT ex, 'graph [' FROM num UNION ALL SELECT DISTINCT ex, ']' FROM num""")
def export_gml_rows(spark, sf_dir):
    return sinks.graph_lines(_suppliers(spark, sf_dir), "gml").select("ex", "value")


@query(f"""WITH {NUMBERED} SELECT ex, 'node: {{ title: "' || no || '" label: "' || text || '" shape: ' || CASE kind WHEN 'i' THEN 'box' ELSE 'diamond' END || ' }}' AS value FROM num
UNION ALL SELECT ex, 'edge: {{ source: "' || a || '" target: "' || b || '" label: "' || role || '" }}' FROM ends UNION ALL SELECT DISTINCT ex, 'graph: {{' FROM num UNION ALL SELECT DISTINCT ex, '}}' FROM num""")
def export_gdl_rows(spark, sf_dir):
    return sinks.graph_lines(_suppliers(spark, sf_dir), "gdl").select("ex", "value")


# -- paths ------------------------------------------------------------------------------------------------------------

REACH = f"""RECURSIVE {graph_sql()}, walk AS (SELECT ex, vid AS src, vid AS dst, 0 AS d FROM v UNION SELECT w.ex, w.src, e.dst, w.d + 1 FROM walk w JOIN e ON e.src = w.dst WHERE w.d < 3),
dist AS (SELECT ex, src, dst, min(d) AS d FROM walk GROUP BY 1, 2, 3)"""


@query(f"WITH {REACH} SELECT ex, src, dst, d FROM dist")
def bfs_dist(spark, sf_dir):
    return paths.distances(_suppliers(spark, sf_dir), 3)


@query(f"WITH {REACH} SELECT ex, src, dst, d FROM dist WHERE d <= 2 AND src LIKE '%/supplier/%'")
def ball(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    return paths.ball(paths.distances(g, 2, g.vertices.filter("sig = 'supplier'")), 2)


@query(f"WITH {REACH} SELECT ex, src, dst, d FROM dist WHERE d = 2")
def fixed_distance(spark, sf_dir):
    return paths.at_distance(paths.distances(_suppliers(spark, sf_dir), 2), 2)


@query(f"""WITH {REACH}, p AS (SELECT a.ex, a.vid AS src, b.vid AS dst FROM v a JOIN v b ON a.ex = b.ex WHERE a.sig = 'nation' AND b.sig = 'supplier')
SELECT p.ex, p.src, p.dst, coalesce(d.d, -1) AS d FROM p LEFT JOIN dist d ON d.src = p.src AND d.dst = p.dst""")
def pairwise_distance(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    a, b = g.vertices.filter("sig = 'nation'").select("ex", F.col("vid").alias("src")), g.vertices.filter("sig = 'supplier'").select("ex", F.col("vid").alias("dst"))
    return paths.pairwise(paths.distances(g, 3, g.vertices.filter("sig = 'nation'")), a.join(b, "ex"))


# -- slices and liveness ---------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS customer, l_suppkey AS supplier, min(greatest(year(o_orderdate), year(l_shipdate)))::INTEGER AS slice FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2""")
def cumulative_deduce(spark, sf_dir):
    o = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("s1"))
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("supplier"), F.year("l_shipdate").alias("s2"))
    return deduce.cumulative(o.join(li, F.col("o_orderkey") == F.col("l_orderkey")), ["s1", "s2"], ["customer", "supplier"])


@query("SELECT DISTINCT o_orderpriority AS ex, year(o_orderdate)::INTEGER AS slice FROM orders")
def list_slices(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ex"), F.year("o_orderdate").alias("slice")).distinct()


@query("SELECT o_orderpriority AS ex, max(year(o_orderdate))::INTEGER AS slice FROM orders GROUP BY 1")
def max_slice(spark, sf_dir):
    return liveness.extreme_slice(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ex"), F.year("o_orderdate").alias("slice")))


@query("SELECT o_orderpriority AS ex, count(DISTINCT year(o_orderdate)) > 1 AS sliced FROM orders GROUP BY 1")
def is_sliced(spark, sf_dir):
    return liveness.is_sliced(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("ex"), F.year("o_orderdate").alias("slice")))


@query(f"WITH {graph_sql(trade=True)} SELECT sig, count(*) AS n, count(*) FILTER (sig NOT IN ('sends_back')) AS alive FROM v GROUP BY 1")
def kill_signature(spark, sf_dir):
    dead = sorted(liveness.dependents(trade_domain(), "sends_back") - {"customer", "supplier", "nation"})
    return _trade(spark, sf_dir).kill(dead).vertices.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alive").cast("bigint")).alias("alive"))


@query("SELECT year(o_orderdate)::VARCHAR AS slice, count(*) AS n, count(*) FILTER (year(o_orderdate) <= 1995) AS alive FROM orders GROUP BY 1")
def kill_future(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.lit("x").alias("ex"), F.year("o_orderdate").cast("string").alias("slice"), F.lit(True).alias("alive"))
    return liveness.kill_future(rows, "1995").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("alive").cast("bigint")).alias("alive"))


# -- hashing and strings ---------------------------------------------------------------------------------------


@query(f"SELECT p_partkey AS part, {sql_hash_string('p_name')} AS h FROM part")
def ap_hash_string(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), hash_string(F.col("p_name")).alias("h"))


@query(f"SELECT l_orderkey AS order_id, l_linenumber AS line, {sql_hash_list('[l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT]')} AS h FROM lineitem")
def ap_hash_vector(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), hash_list(F.array("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint"))).alias("h"))


@query("SELECT p_partkey AS part, replace(p_type, 'e', 'EE') AS x FROM part")
def str_replace(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), strings.replace_all(F.col("p_type"), "e", "EE").alias("x"))


@query("SELECT p_partkey AS part, list_filter(string_split(p_name, ' '), lambda x: x <> '') AS x FROM part")
def str_split(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), strings.split_on(F.col("p_name"), " ").alias("x"))


@query("SELECT p_partkey AS part, upper(p_name) AS up, lower(p_brand) AS low, regexp_matches(p_name, '^[A-Z]') AS cap FROM part")
def str_case(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), strings.ascii_upper(F.col("p_name")).alias("up"), strings.ascii_lower(F.col("p_brand")).alias("low"), strings.is_capitalised(F.col("p_name")).alias("cap"))


@query("SELECT c_custkey AS customer, contains(c_mktsegment, 'O') AS has, CASE WHEN starts_with(c_name, 'Customer') THEN substr(c_name, 9) END AS rest, lower(c_mktsegment) IN ('building', 'machinery') AS member FROM customer")
def str_contains(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("customer"), strings.contains(F.col("c_mktsegment"), "O").alias("has"), strings.rest_after(F.col("c_name"), "Customer").alias("rest"), strings.member_ignoring_case(F.col("c_mktsegment"), ["Building", "MACHINERY"]).alias("member"))


@query("SELECT n_nationkey AS nation, reverse(n_name) AS x FROM nation")
def str_reverse(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), strings.reverse_string(F.col("n_name")).alias("x"))


@query("SELECT p_partkey AS part, CASE WHEN p_brand < p_type THEN -1 WHEN p_brand = p_type THEN 0 ELSE 1 END AS x, p_brand || p_type AS cat FROM part")
def str_compare(spark, sf_dir):
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), strings.compare_strings(F.col("p_brand"), F.col("p_type")).alias("x"), strings.concat_strings(F.col("p_brand"), F.col("p_type")).alias("cat"))


@query("SELECT n_nationkey AS nation, sha1(n_name) AS digest FROM nation")
def sha1_digest(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.sha1("n_name").alias("digest"))


# -- kernels ------------------------------------------------------------------------------------------------------------


def _supplier_cases(g: Graph) -> DataFrame:
    return g.vertices.filter("sig = 'supplier'").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))


def _kernel(spark, sf_dir, **options) -> DataFrame:
    g = _suppliers(spark, sf_dir)
    return Kernel(g, KernelOptions(**options)).features(_supplier_cases(g)).withColumn("value", F.round("value", 6))


def _kernel_query(name: str, sql: bool = True, **options) -> None:
    def run(spark, sf_dir):
        return _kernel(spark, sf_dir, **options)

    run.__name__ = name
    query(features_sql(**options) if sql else None)(run)


_kernel_query("nspdk_hard_r0", match_type="hard", radius=0, distance=2)
_kernel_query("nspdk_hard_r1", match_type="hard", radius=1, distance=2)
_kernel_query("nspdk_soft_r0", match_type="soft", radius=0, distance=2)
_kernel_query("nspdk_soft_r1", match_type="soft", radius=1, distance=2)
_kernel_query("nspdk_soft_r2", match_type="soft", radius=2, distance=2)
_kernel_query("nspdk_hard_propertyless", match_type="hard_propertyless", radius=1, distance=2)
_kernel_query("nspdk_hard_soft", match_type="hard_soft", radius=1, distance=1, sql=False)
_kernel_query("nspdk_mixed", match_type="mixed", radius=1, distance=2)
_kernel_query("nspdk_hard_r2", match_type="hard", radius=2, distance=2, sql=False)
_kernel_query("rnspdk_soft", variant="rnspdk", match_type="soft", radius=1, distance=2)
_kernel_query("rnspdk_hard", variant="rnspdk", match_type="hard", radius=1, distance=2)
_kernel_query("mnspdk", variant="mnspdk", match_type="hard", radius=1, distance=2)
_kernel_query("anspdk", variant="anspdk", match_type="hard", radius=2, distance=2, sql=False)
_kernel_query("alnspdk", variant="alnspdk", match_type="hard", radius=1, distance=2)
_kernel_query("gnspdk", variant="gnspdk", match_type="hard", radius=1, distance=2)
_kernel_query("min_kernel", match_type="hard", radius=1, distance=2, min_kernel=True)
_kernel_query("raw_vector", match_type="soft", radius=1, distance=2, normalization=False)


@query(None)
def nspdk3d(spark, sf_dir):
    """Embeddings as points in space: the first three entries are coordinates, points of one label share an item."""
    e = load(spark, sf_dir, "embeddings").filter("vec_id is not null")
    ex = (F.col("vec_id") % 20).cast("string").alias("ex")
    item = e.select(ex, F.col("vec_id").cast("string").alias("item_id"), F.col("label").cast("string").alias("kind"), *[F.element_at("embedding", k + 1).cast("double").alias(f"x{k}") for k in range(3)])
    group = item.select("ex", F.col("kind").alias("group_id")).distinct()
    d = Domain("points").entity("item", "item_id:self", "x0:property", "x1:property", "x2:property").entity("group", "group_id:self").relationship("of", "item:item", "group:group").close()
    g = build_graph(d, {"item": item.drop("kind"), "group": group, "of": item.select("ex", F.col("item_id").alias("item"), F.col("kind").alias("group"))})
    cases = g.vertices.filter("sig = 'item'").select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"))
    return Kernel(g, KernelOptions(variant="nspdk3d", match_type="hard_propertyless", radius=1, distance=2)).features(cases)


@query(f"WITH {features_sql(match_type='hard', radius=1, distance=2, cte=True)} SELECT case_id, round(sum(value * value), 6) AS norm2 FROM f GROUP BY 1")
def normalized_vector(spark, sf_dir):
    """Vectors without collisions have norm 1."""
    g = _suppliers(spark, sf_dir)
    return algebra.squared_norms(Kernel(g, KernelOptions(radius=1, distance=2)).features(_supplier_cases(g))).withColumn("norm2", F.round("norm2", 6))


@query(f"WITH {features_sql(match_type='hard', radius=0, distance=0, cte=True)} SELECT case_id, feature, round(value, 6) AS value FROM f UNION ALL SELECT vid, {sql_hash_string("'balance_1'")}, round(nums[1], 6) FROM v WHERE sig = 'supplier'")
def ghost_feature_query(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    ghosts = g.vertices.filter("sig = 'supplier'").select(F.col("vid").alias("case_id"), F.lit(1).alias("place"), F.get("nums", F.lit(0)).alias("value"))
    return ghost_features(Kernel(g, KernelOptions()).features(_supplier_cases(g)), ghosts, "balance").withColumn("value", F.round("value", 6))


@query(f"WITH {features_sql(match_type='hard', radius=1, distance=2, cte=True)} SELECT case_id, dense_rank() OVER (ORDER BY feature) AS feature, round(value, 6) AS value FROM f")
def remap_indices(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    return remap(Kernel(g, KernelOptions(radius=1, distance=2)).features(_supplier_cases(g))).withColumn("value", F.round("value", 6))


@query(f"""WITH {hist_sql(match_type='hard', radius=1, distance=2)}, child AS (SELECT le.g, le.src AS vid, list_sort(list(c.label || '-' || le.role)) AS k FROM le JOIN lv c ON c.g = le.g AND c.vid = le.dst GROUP BY 1, 2),
t AS (SELECT g, vid, 0 AS r, label AS text FROM lv UNION ALL SELECT lv.g, lv.vid, 1, label || ':' || array_to_string(coalesce(k, []), '.') FROM lv LEFT JOIN child ON child.g = lv.g AND child.vid = lv.vid)
SELECT DISTINCT {sql_hash_list('[rd, key, 1, 1, 0]')} AS feature, 'd' || d || ' r' || p.r || ' ' || CASE WHEN d = 0 THEN a.text ELSE least(a.text, b.text) || ' ~ ' || greatest(a.text, b.text) END AS text
FROM (SELECT DISTINCT g, s AS near, t AS far, d, r, rd, key FROM pairs) p JOIN t a ON a.g = p.g AND a.vid = p.near AND a.r = p.r JOIN t b ON b.g = p.g AND b.vid = p.far AND b.r = p.r""")
def feature_texts(spark, sf_dir):
    """What every feature of nspdk_hard_r1 stands for."""
    g = _suppliers(spark, sf_dir)
    return Kernel(g, KernelOptions(match_type="hard", radius=1, distance=2)).explain(_supplier_cases(g))


@query(f"""WITH {hist_sql(match_type='hard', radius=1, distance=2)}, child AS (SELECT le.g, le.src AS vid, list_sort(list(c.label || '-' || le.role)) AS k FROM le JOIN lv c ON c.g = le.g AND c.vid = le.dst GROUP BY 1, 2),
t AS (SELECT g, vid, 0 AS r, label AS text FROM lv UNION ALL SELECT lv.g, lv.vid, 1, label || ':' || array_to_string(coalesce(k, []), '.') FROM lv LEFT JOIN child ON child.g = lv.g AND child.vid = lv.vid),
m AS (SELECT *, {sql_hash_string("text", 63)} AS code FROM t), q AS (SELECT DISTINCT p.d, p.r, a.text AS x, b.text AS y, a.code AS u, b.code AS w FROM pairs p JOIN m a ON a.g = p.g AND a.vid = p.s AND a.r = p.r JOIN m b ON b.g = p.g AND b.vid = p.t AND b.r = p.r),
o AS (SELECT {sql_hash_list(f"[{sql_hash_list('[d, r]', 63)}, CASE WHEN d = 0 THEN {sql_hash_list('[u]', 63)} ELSE {sql_hash_list('[least(u, w), greatest(u, w)]', 63)} END, 1, 1, 0]", 63)} AS feature,
'd' || d || ' r' || r || ' ' || CASE WHEN d = 0 THEN x ELSE least(x, y) || ' ~ ' || greatest(x, y) END AS text FROM q)
SELECT feature, count(DISTINCT text) AS n, min(text) AS first, max(text) AS last FROM o GROUP BY 1 HAVING count(DISTINCT text) > 1""")
def feature_collisions(spark, sf_dir):
    """The features of a space of 64 that several neighbourhoods share."""
    g = _suppliers(spark, sf_dir)
    return collisions(Kernel(g, KernelOptions(match_type="hard", radius=1, distance=2, hash_bit_mask=63)).explain(_supplier_cases(g)))


@query(features_sql(match_type="hard", radius=1, distance=2))
def cached_vectors(spark, sf_dir):
    """Vectors stored for a graph without the edges of one region, then asked for of the whole one: only that region's cases are computed again."""
    g = _suppliers(spark, sf_dir)
    deduce.ensure_checkpoint_dir(spark)
    cache = VectorCache(spark, f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/vectors-{uuid.uuid4().hex}")
    options = KernelOptions(match_type="hard", radius=1, distance=2)
    cache.features(Graph(g.vertices, g.edges.filter("ex != '1'")), _supplier_cases(g), options)
    return cache.features(g, _supplier_cases(g), options).withColumn("value", F.round("value", 6))


@query(f"""WITH {graph_sql()}, texts AS (SELECT ex, concat_ws(chr(31), vid, sig, kind, is_kp, array_to_string(syms, ','), coalesce(array_to_string(list_transform(nums, lambda x: x::VARCHAR), ','), '')) AS text FROM v
UNION ALL SELECT ex, concat_ws(chr(31), src, dst, role) FROM e),
p AS (SELECT ex, count(*) AS n, sum(('0x' || substr(md5(text), 1, 13))::BIGINT) AS low, sum(('0x' || substr(md5(text), 14, 13))::BIGINT) AS high FROM texts GROUP BY ex)
SELECT ex, n, md5(n || chr(31) || low || chr(31) || high) AS fingerprint FROM p""")
def fingerprints(spark, sf_dir):
    return graph_fingerprints(_suppliers(spark, sf_dir))


@query(f"WITH {hist_sql(match_type='soft', radius=1, distance=1)} SELECT case_id, rd, key, pred, bin, round(w, 4) AS w FROM h")
def kernel_histogram(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    return Kernel(g, KernelOptions(match_type="soft", radius=1, distance=1)).histogram(_supplier_cases(g)).withColumn("w", F.round("w", 4))


@query(f"""WITH {features_sql(match_type='hard', radius=0, distance=2, min_kernel=True, cte=True)}, i AS (SELECT case_id, dense_rank() OVER (ORDER BY feature) AS k FROM f)
SELECT case_id, '1 ' || string_agg(k || ':1', ' ' ORDER BY k) || ' # ' || case_id AS value FROM i GROUP BY case_id""")
def libsvm_rows(spark, sf_dir):
    g = _suppliers(spark, sf_dir)
    cases = _supplier_cases(g)
    return sinks.libsvm_lines(remap(Kernel(g, KernelOptions(distance=2, min_kernel=True)).features(cases)), cases.withColumn("label", F.lit(1.0)))


# -- kernel algebra ----------------------------------------------------------------------------------------------

VECTORS = "q AS (SELECT l_suppkey::VARCHAR AS case_id, l_linenumber::BIGINT AS feature, sum(l_discount) AS value FROM lineitem GROUP BY 1, 2)"
DOTS = f"{VECTORS}, d AS (SELECT a.case_id AS case_a, b.case_id AS case_b, sum(a.value * b.value) AS dot FROM q a JOIN q b ON a.feature = b.feature AND a.case_id <= b.case_id GROUP BY 1, 2), n AS (SELECT case_id, sum(value * value) AS norm2 FROM q GROUP BY 1)"


def _vectors(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").cast("string").alias("case_id"), F.col("l_linenumber").cast("bigint").alias("feature")).agg(F.sum("l_discount").alias("value"))


def _rounded(name: str, digits: int) -> Column:
    """As the SQL rounds, the scaled value away from zero at a half; Spark's own way makes a decimal of each number, which costs more over many pairs."""
    x, scaled = F.col(name), F.col(name) * 10.0**digits
    return F.when(F.abs(scaled) < 2.0**52, F.signum(scaled) * F.floor(F.abs(scaled) + 0.5) / 10.0**digits).when(F.abs(scaled) < float("inf"), scaled / 10.0**digits).otherwise(x)


@query(f"WITH {DOTS} SELECT case_a, case_b, round(dot, 5) AS dot FROM d")
def dot_product(spark, sf_dir):
    return algebra.dot_products(_vectors(spark, sf_dir)).withColumn("dot", _rounded("dot", 5))


def _gram_query(kernel: str, sql: str, **options) -> None:
    def run(spark, sf_dir):
        return algebra.gram(_vectors(spark, sf_dir), kernel, **options).withColumn("k", _rounded("k", 5))

    run.__name__ = f"gram_{kernel}"
    query(f"WITH {DOTS} SELECT case_a, case_b, round({sql}, 5) AS k FROM d JOIN n x ON x.case_id = case_a JOIN n y ON y.case_id = case_b")(run)


@query("""WITH x AS (SELECT l_suppkey::VARCHAR AS case_id, l_quantity::BIGINT AS feature, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1, 2), w AS (SELECT case_id, sum(value * value) AS norm2 FROM x GROUP BY 1),
p AS (SELECT DISTINCT s.l_suppkey::VARCHAR AS a, t.l_suppkey::VARCHAR AS b FROM lineitem s JOIN lineitem t ON s.l_orderkey = t.l_orderkey AND t.l_linenumber = s.l_linenumber + 1 WHERE s.l_suppkey <> t.l_suppkey), d AS (SELECT a, b, sum(x.value * y.value) AS dot FROM p JOIN x ON x.case_id = a JOIN x y ON y.case_id = b AND y.feature = x.feature GROUP BY 1, 2)
SELECT p.a AS case_a, p.b AS case_b, round(exp(-0.0005 * (coalesce(v.norm2, 0) + coalesce(w.norm2, 0) - 2 * coalesce(dot, 0))), 5) AS k FROM p LEFT JOIN d ON d.a = p.a AND d.b = p.b LEFT JOIN w v ON v.case_id = p.a LEFT JOIN w ON w.case_id = p.b""")
def gram_of_pairs(spark, sf_dir):
    """The rbf kernel of suppliers of neighbouring lines of an order, by the quantities of all their lines, whether they share one or not."""
    lines = load(spark, sf_dir, "lineitem")
    rows = lines.groupBy(F.col("l_suppkey").cast("string").alias("case_id"), F.col("l_quantity").cast("bigint").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    next_one = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").cast("string").alias("case_b"))
    pairs = lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").cast("string").alias("case_a")).join(next_one, ["l_orderkey", "l_linenumber"]).filter("case_a != case_b").select("case_a", "case_b").distinct()
    return algebra.gram_of(pairs, rows, "rbf", gamma=0.0005).withColumn("k", F.round("k", 5))


_gram_query("linear", "dot")
_gram_query("poly", "pow(0.01 * dot + 1, 2)", gamma=0.01, coef0=1.0, degree=2)
_gram_query("rbf", "exp(-0.05 * (x.norm2 + y.norm2 - 2 * dot))", gamma=0.05)
_gram_query("sigmoid", "tanh(0.001 * dot - 0.5)", gamma=0.001, coef0=-0.5)


# -- cases ---------------------------------------------------------------------------------------------------------------

PAIRS = f"{BASE}, cand AS (SELECT n.ex, n.id AS nation, s.id AS supplier FROM n JOIN s ON n.ex = s.ex)"


@query(f"WITH {PAIRS} SELECT ex, [supplier, nation] AS ids, [ex || '/supplier/' || supplier, ex || '/nation/' || nation] AS viewpoints, ex || '/supp_in/' || supplier || '/' || nation AS case_id FROM cand")
def candidates(spark, sf_dir):
    return case_ops.candidates(suppliers_domain(), base_tables(spark, sf_dir), "supp_in")


@query(f"WITH {PAIRS} SELECT ex || '/supp_in/' || supplier || '/' || cand.nation AS case_id, CASE WHEN s.id IS NULL THEN -1.0 ELSE 1.0 END::DOUBLE AS label FROM cand LEFT JOIN s ON s.id = supplier AND s.nation = cand.nation".replace("SELECT ex ||", "SELECT cand.ex ||"))
def case_labels(spark, sf_dir):
    d, t = suppliers_domain(), base_tables(spark, sf_dir)
    return case_ops.existence_labels(d, t, "supp_in", case_ops.candidates(d, t, "supp_in")).select("case_id", "label")


@query(f"WITH {BASE} SELECT ex || '/customer/' || id AS case_id, segment AS value FROM c")
def property_labels(spark, sf_dir):
    d, t = trade_domain(), base_tables(spark, sf_dir)
    return case_ops.property_labels(d, t, "customer", case_ops.candidates(d, t, "customer"), "segment").select("case_id", "value")


@query("SELECT 'segment' AS what, 'multiclass' AS task UNION ALL SELECT 'price', 'regression' UNION ALL SELECT 'quality', 'regression' UNION ALL SELECT 'status', 'multiclass'")
def task_types(spark, sf_dir):
    sources = (("segment", "customer", "c_mktsegment"), ("price", "orders", "o_totalprice"), ("quality", "labels", "quality"), ("status", "orders", "o_orderstatus"))
    out = None
    for what, name, column in sources:
        row = case_ops.task_type(load(spark, sf_dir, name), column).select(F.lit(what).alias("what"), "task")
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT DISTINCT c_mktsegment AS value, dense_rank() OVER (ORDER BY c_mktsegment)::DOUBLE AS code FROM customer")
def label_codes(spark, sf_dir):
    return case_ops.label_codes(load(spark, sf_dir, "customer"), "c_mktsegment")


def _md5_share(expression: str) -> str:
    return f"(('0x' || substr(md5({expression}), 1, 8))::BIGINT / 4294967296.0)"


@query(f"SELECT o_orderkey::VARCHAR AS case_id, o_orderstatus = 'O' AND {_md5_share('o_orderkey::VARCHAR')} > 0.1 AS rejected FROM orders")
def reject_sample(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), "o_orderstatus")
    return case_ops.reject(rows, (F.col("o_orderstatus") == "O") & (case_ops.hash_share("case_id") > 0.1)).select("case_id", "rejected")


@query(f"SELECT o_orderkey::VARCHAR AS case_id, label FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END::DOUBLE AS label FROM orders) WHERE label > 0 OR {_md5_share('o_orderkey::VARCHAR')} < 0.25")
def negatives_sampled(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("label"))
    return sinks.negatives_sampled(rows, 0.25)


# -- splits --------------------------------------------------------------------------------------------------------------

ORDERED = "(ORDER BY md5(n_nationkey::VARCHAR || '/7'), n_nationkey)"


def _ids(spark, sf_dir):
    return load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ex"), F.col("n_regionkey").alias("stratum"))


@query(f"SELECT n_nationkey AS ex, (row_number() OVER {ORDERED} - 1) % 4 AS fold FROM nation")
def kfold_assign(spark, sf_dir):
    return splits.kfold(_ids(spark, sf_dir), 4, 7)


@query(f"SELECT n_nationkey AS ex, (row_number() OVER {ORDERED.replace('(', '(PARTITION BY n_regionkey ', 1)} - 1) % 3 AS fold FROM nation")
def stratified_assign(spark, sf_dir):
    return splits.stratified(_ids(spark, sf_dir), 3, "stratum", 7).select("ex", "fold")


@query("SELECT r_regionkey AS ex, row_number() OVER (ORDER BY r_regionkey) - 1 AS fold FROM region")
def leave_one_out(spark, sf_dir):
    return splits.leave_one_out(load(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ex")))


@query(f"SELECT n_nationkey AS ex, CASE WHEN row_number() OVER {ORDERED} <= round(count(*) OVER () * 0.7) THEN 'train' ELSE 'test' END AS part FROM nation")
def random_split(spark, sf_dir):
    return splits.random_split(_ids(spark, sf_dir), 70, 7)


@query("SELECT n_nationkey AS ex, CASE WHEN n_nationkey < 15 THEN 'train' ELSE 'test' END AS part FROM nation WHERE n_nationkey < 20")
def fixed_split(spark, sf_dir):
    return splits.fixed_split(_ids(spark, sf_dir), list(range(15)), list(range(15, 20)))


@query("SELECT n_nationkey AS ex, n_regionkey AS trial, n_nationkey % 2 AS fold FROM nation")
def prepartitioned(spark, sf_dir):
    ids = _ids(spark, sf_dir)
    return splits.prepartitioned(ids, ids.select("ex", F.col("stratum").alias("trial"), (F.col("ex") % 2).alias("fold")))


# -- metrics -----------------------------------------------------------------------------------------------------------

#: Deterministic predictions: orders above a price are said to be finished.
PREDS = "p AS (SELECT o_orderpriority || '/' || o_orderkey AS case_id, o_orderpriority AS fold, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE -1.0 END::DOUBLE AS label, (o_totalprice - 150000) / 1000 AS prediction FROM orders)"
CLASSES = "k AS (SELECT o_orderpriority || '/' || o_orderkey AS case_id, CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 2.0 ELSE 3.0 END::DOUBLE AS label, (1 + o_custkey % 3)::DOUBLE AS prediction FROM orders)"


def _preds(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("case_id"), F.col("o_orderpriority").alias("fold"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0).alias("label"), ((F.col("o_totalprice") - 150000) / 1000).alias("prediction"))


def _classes(spark, sf_dir):
    o = load(spark, sf_dir, "orders")
    return o.select(F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("case_id"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 2.0).otherwise(3.0).alias("label"), (1 + F.col("o_custkey") % 3).cast("double").alias("prediction"))


BINARY = """count(*) FILTER (prediction > 0 AND label > 0) AS tp, count(*) FILTER (prediction > 0 AND label <= 0) AS fp, count(*) FILTER (prediction <= 0 AND label <= 0) AS tn, count(*) FILTER (prediction <= 0 AND label > 0) AS fn"""
SHARES = "100.0 * (fp + fn) / (tp + fp + tn + fn) AS error, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1"


@query(f"WITH {PREDS}, x AS (SELECT {BINARY} FROM p) SELECT *, {SHARES} FROM x")
def binary_report(spark, sf_dir):
    return metrics.binary_report(_preds(spark, sf_dir))


@query(f"WITH {PREDS}, x AS (SELECT fold, {BINARY} FROM p GROUP BY fold) SELECT *, {SHARES} FROM x")
def binary_report_by_fold(spark, sf_dir):
    return metrics.binary_report(_preds(spark, sf_dir), ["fold"])


PER_CLASS = f"""{CLASSES}, l AS (SELECT DISTINCT label FROM k), r AS (SELECT l.label, (SELECT count(*) FROM k WHERE k.label = l.label) AS n, (SELECT count(*) FROM k WHERE k.label = l.label AND k.prediction = l.label) AS tp,
(SELECT count(*) FROM k WHERE k.prediction = l.label AND k.label <> l.label) AS fp, (SELECT count(*) FROM k) AS a FROM l),
c AS (SELECT label, n, tp, fp, n - tp AS fn, a - n - fp AS tn, (tp + a - n - fp) / a AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(n, 0) AS recall, 2.0 * tp / nullif(tp + fp + n, 0) AS f1 FROM r)"""


@query(f"WITH {PER_CLASS} SELECT label, n, tp, fp, fn, tn, accuracy, precision, recall, f1 FROM c")
def class_report(spark, sf_dir):
    return metrics.class_report(_classes(spark, sf_dir))


@query(f"""WITH {PER_CLASS} SELECT 100 * (1 - sum(tp) / sum(n)) AS error, avg(coalesce(precision, 0)) AS macro_precision, avg(coalesce(recall, 0)) AS macro_recall, avg(coalesce(f1, 0)) AS macro_f1,
sum(coalesce(precision, 0) * n) / sum(n) AS weighted_precision, sum(coalesce(recall, 0) * n) / sum(n) AS weighted_recall, sum(coalesce(f1, 0) * n) / sum(n) AS weighted_f1 FROM c""")
def multiclass_report(spark, sf_dir):
    return metrics.multiclass_report(_classes(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT label, prediction, count(*) AS n FROM k GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_classes(spark, sf_dir))


@query(f"WITH {CLASSES} SELECT regexp_extract(case_id, '^(.*)/[^/]*$', 1) AS interpretation, count(*) AS n, avg((prediction <> label)::INT) AS error FROM k GROUP BY 1")
def interp_error(spark, sf_dir):
    return metrics.interpretation_error(_classes(spark, sf_dir))


@query(f"""WITH {CLASSES} SELECT avg(pow(prediction - label, 2)) AS mse, sqrt(avg(pow(prediction - label, 2))) AS rmse, avg(abs(prediction - label)) AS mae,
avg(abs(prediction - label) / label) FILTER (label > 1e-10) AS mape, pow(corr(prediction, label), 2) AS r2 FROM k""")
def regression_report(spark, sf_dir):
    return metrics.regression_report(_classes(spark, sf_dir))


CUTS = f"""{PREDS}, t AS (SELECT prediction, count(*) FILTER (label > 0) AS pos, count(*) FILTER (label <= 0) AS neg FROM p GROUP BY 1),
u AS (SELECT *, sum(pos) OVER (ORDER BY prediction DESC) AS tp, sum(neg) OVER (ORDER BY prediction DESC) AS fp FROM t)"""


@query(f"WITH {CUTS} SELECT 1 - sum(pos * (fp - neg / 2)) / (sum(pos) * sum(neg)) AS auc_roc FROM u")
def auc_roc(spark, sf_dir):
    return metrics.auc_roc(_preds(spark, sf_dir))


@query(f"WITH {CUTS} SELECT sum(pos * tp / (tp + fp)) / sum(pos) AS auc_pr FROM u")
def auc_pr(spark, sf_dir):
    return metrics.auc_pr(_preds(spark, sf_dir))


@query("SELECT 'price' AS measure, avg(x) AS mean, stddev_pop(x) AS std FROM (SELECT o_orderpriority, avg(o_totalprice) AS x FROM orders GROUP BY 1)")
def fold_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("value")).withColumn("measure", F.lit("price"))
    return metrics.fold_summary(rows, ["measure"])


@query("SELECT o_orderpriority AS parameter, list_sort(list(DISTINCT o_orderstatus)) AS values FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def differing_parameters(spark, sf_dir):
    return metrics.differing_parameters(load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("parameter"), F.col("o_orderstatus").alias("value")))


@query(f"WITH {PREDS} SELECT case_id FROM p WHERE prediction > 50")
def induce_facts(spark, sf_dir):
    return metrics.induced(_preds(spark, sf_dir), 50)


@query("SELECT n_nationkey AS ex, 'interpretation(' || n_regionkey || ',nation(' || n_nationkey || ',' || lower(n_name) || ')).' AS line FROM nation")
def fact_round_trip(spark, sf_dir):
    """Facts written as text, read again, and written."""
    rows = load(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("ex"), F.lit(None).cast("string").alias("slice"), F.lit("nation").alias("sig"), F.array(F.col("n_nationkey").cast("string"), F.lower("n_name")).alias("args"))
    again = fact_ops.parse_facts(fact_ops.fact_lines(rows))
    return again.select(F.col("args")[0].cast("int").alias("ex"), F.format_string("interpretation(%s,%s(%s)).", "ex", "sig", F.concat_ws(",", "args")).alias("line"))


# -- models ------------------------------------------------------------------------------------------------------------


def _learn(spark, sf_dir, model: str, label=None, **options) -> DataFrame:
    """Bands of suppliers from their neighbourhoods, a fold a region."""
    g = _suppliers(spark, sf_dir)
    v = g.vertices.filter("sig = 'supplier'")
    cases = v.select("ex", F.col("vid").alias("case_id"), F.array("vid").alias("viewpoints"), (F.when(F.get("syms", F.lit(1)) == "high", 1.0).otherwise(-1.0) if label is None else label).alias("label"))
    found = remap(Kernel(g, KernelOptions(match_type="soft", radius=1, distance=2)).features(cases))
    folds = splits.leave_one_out(cases)
    return models.cross_validate(found, cases, folds, model, **options)


@query(None)
def sgd_svm_cv(spark, sf_dir):
    return _learn(spark, sf_dir, "svm_sgd", epochs=12, lambda_=1e-4, lossratio=0.2)


@query("""WITH x AS (SELECT o_orderkey % 5 AS fold, o_totalprice / 1e5 AS a, year(o_orderdate) - 1995.0 AS b, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END AS y FROM orders),
s AS (SELECT f.fold, count(*) AS n, sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb, sum(a * y) AS ay, sum(b * y) AS byy FROM x JOIN (SELECT DISTINCT fold FROM x) f ON f.fold <> x.fold GROUP BY 1),
r AS (SELECT fold, aa + 0.5 * n AS p, ab AS q, bb + 0.5 * n AS r, ay, byy FROM s)
SELECT fold::INTEGER AS fold, unnest([1, 2])::BIGINT AS feature, round(unnest([(r * ay - q * byy) / (p * r - q * q), (p * byy - q * ay) / (p * r - q * q)]), 4) AS weight FROM r""")
def ridge_folds(spark, sf_dir):
    """Least squares with a regulariser on every order, a model a fold, all folds trained together; SQL solves the normal equations."""
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("case_id"), (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_totalprice") / 1e5).alias("a"), (F.year("o_orderdate") - 1995).cast("double").alias("b"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("label"))
    cells = rows.select("case_id", F.posexplode(F.array("a", "b")).alias("k", "value")).select("case_id", (F.col("k") + 1).cast("bigint").alias("feature"), "value")
    cases = rows.select("case_id", "label", "fold", F.lit(False).alias("rejected"))
    weights, _ = linear.train_folds(cells, cases, SgdOptions(loss="squared", lambda_=0.5, tolerance=1e-11, epochs=2), list(range(5)))
    return weights.withColumn("weight", F.round("weight", 4))


@query(None)
def property_cv(spark, sf_dir):
    """Both properties of suppliers' homes, a three-class one and a number, cross-validated over regions on one table of features."""
    tables = base_tables(spark, sf_dir)
    suppliers = tables["supplier"].select("ex", "supplier_id", F.when(F.col("balance") < 2000, "low").when(F.col("balance") < 6000, "fair").otherwise("high").alias("band"), "balance")
    home = tables["supp_in"].join(suppliers.withColumnRenamed("supplier_id", "supplier"), ["ex", "supplier"]).select("ex", "supplier", "nation", F.col("band").alias("standing"), (F.col("balance") / 10000).alias("score"))
    d = Domain("homes").entity("nation", "nation_id:self").entity("supplier", "supplier_id:self", "band:property").relationship("home", "supplier:supplier", "nation:nation", "standing:property", "score:property")
    data = Dataset(d.close(["nation", "supplier"]), {"nation": tables["nation"].select("ex", "nation_id"), "supplier": suppliers.select("ex", "supplier_id", "band"), "home": home})
    found = data.kfold_tasks("home", 5, KernelOptions(match_type="soft", radius=1, distance=2), lambda_=0.01)
    return reduce(DataFrame.unionByName, [preds.withColumn("column", F.lit(c)) for c, preds in sorted(found.items())])


@query(None)
def lr_sgd_cv(spark, sf_dir):
    return _learn(spark, sf_dir, "lr_sgd")


@query(None)
def csvc_rbf(spark, sf_dir):
    return _learn(spark, sf_dir, "dual_c_svc", kernel="rbf", c=20.0, wn=0.2)


@query(None)
def nu_svc(spark, sf_dir):
    return _learn(spark, sf_dir, "dual_nu_svc", nu=0.2)


@query(None)
def eps_svr(spark, sf_dir):
    return _learn(spark, sf_dir, "dual_eps_svr", F.get("nums", F.lit(0)) / 10000, c=1.0)


@query(None)
def nu_svr(spark, sf_dir):
    return _learn(spark, sf_dir, "dual_nu_svr", F.get("nums", F.lit(0)) / 10000, c=1.0)


@query(None)
def ols_cv(spark, sf_dir):
    return _learn(spark, sf_dir, "ols_sgd", F.get("nums", F.lit(0)) / 10000)


@query(None)
def multiclass_ovo(spark, sf_dir):
    return _learn(spark, sf_dir, "dual_c_svc_mc", F.floor(F.get("nums", F.lit(0)) / 4000).cast("double"))


@query(None)
def logistic_distributed(spark, sf_dir):
    """The distributed linear model on orders: no row leaves the executors."""
    from pyspark.ml.feature import VectorAssembler

    rows = load(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("label"), (F.col("o_totalprice") / 1e5).alias("x0"), (F.year("o_orderdate") - 1995).cast("double").alias("x1"))
    data = VectorAssembler(inputCols=["x0", "x1"], outputCol="features").transform(rows)
    fitted = models.distributed("logistic", maxIter=10).fit(data)
    return fitted.transform(data).select("o_orderkey", "label", "prediction")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degree(spark, sf_dir)
