from pathlib import Path

import pytest

from factloom.plans.queries import QUERIES, SQL

from .oracle import SMALL, agree, connection

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no tables")
#: Kernel queries are slow on a small machine: each form of key and label once.
SLOW = {"nspdk_soft_r0", "nspdk_hard_r0", "nspdk_hard_propertyless", "nspdk_mixed", "rnspdk_soft", "mnspdk", "gnspdk", "raw_vector", "kernel_histogram", "normalized_vector", "remap_indices", "libsvm_rows"}


@pytest.fixture(scope="module")
def tables():
    return connection()


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_matches_its_sql(spark, tables, name):
    agree(QUERIES[name](spark, SMALL), SQL[name], tables)


def test_every_query_has_a_name_of_its_own():
    assert len(QUERIES) > 100 and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", ["dot_product", "gram_linear", "gram_poly", "gram_rbf", "gram_sigmoid"])
def test_gram_queries_hold_every_supplier(spark, tables, name):
    folder = SMALL.replace("sf0.001", "sf0.01")
    suppliers = {str(r.l_suppkey) for r in spark.read.parquet(f"{folder}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    assert max(map(int, suppliers)) > 60
    assert {r.case_a for r in QUERIES[name](spark, folder).filter("case_a = case_b").collect()} == suppliers


def test_hashes_and_bags_hold_every_row(spark, tables):
    lines, orders = (tables.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("lineitem", "orders"))
    assert QUERIES["ap_hash_vector"](spark, SMALL).count() == lines
    assert sum(len(r.bag) for r in QUERIES["bag_of"](spark, SMALL).collect()) == orders
