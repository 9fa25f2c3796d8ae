"""A domain over the star-schema tables: regions are interpretations, nations, suppliers and customers entities.

Every key is a small integer that other tables use too, so vertex keys carry their signature. Relations
across regions are dropped, as a fact never leaves its interpretation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Domain


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str, alias: str):
    return F.col(column).cast("string").alias(alias)


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    nation = load(spark, sf_dir, "nation").select(_text("n_regionkey", "ex"), _text("n_nationkey", "nation_id"), F.col("n_name").alias("name"))
    home = nation.select("ex", F.col("nation_id").alias("nation"))
    supplier = load(spark, sf_dir, "supplier").select(_text("s_suppkey", "supplier"), _text("s_nationkey", "nation"), F.col("s_acctbal").alias("balance")).join(home, "nation")
    customer = load(spark, sf_dir, "customer").select(_text("c_custkey", "customer"), _text("c_nationkey", "nation"), F.col("c_mktsegment").alias("segment")).join(home, "nation")
    band = F.when(F.col("balance") >= 5000, "high").otherwise("low").alias("band")
    return {
        "nation": nation,
        "supplier": supplier.select("ex", F.col("supplier").alias("supplier_id"), band, "balance"),
        "supp_in": supplier.select("ex", "supplier", "nation"),
        "customer": customer.select("ex", F.col("customer").alias("customer_id"), "segment"),
        "cust_in": customer.select("ex", "customer", "nation"),
        "returned": returned(spark, sf_dir),
    }


def returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(customer, supplier) of returned lines of urgent orders: background facts that only rules read."""
    orders = load(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_orderkey", _text("o_custkey", "customer"))
    lines = load(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", _text("l_suppkey", "supplier"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("customer", "supplier").distinct()


def sends_back(tables: dict[str, DataFrame]) -> DataFrame:
    """Customers and suppliers of one region with a returned line between them."""
    c = tables["customer"].select("ex", F.col("customer_id").alias("customer"))
    s = tables["supplier"].select(F.col("ex").alias("ex2"), F.col("supplier_id").alias("supplier"))
    return tables["returned"].join(c, "customer").join(s, "supplier").filter("ex = ex2").select("ex", "customer", "supplier")


def suppliers_domain() -> Domain:
    d = Domain("suppliers").entity("nation", "nation_id:self", "name:property").entity("supplier", "supplier_id:self", "band:property", "balance:property")
    d.relationship("supp_in", "supplier:supplier", "nation:nation")
    return d.close(["nation", "supplier"])


def trade_domain(rule=sends_back) -> Domain:
    d = Domain("trade").entity("nation", "nation_id:self", "name:property").entity("supplier", "supplier_id:self", "band:property", "balance:property").entity("customer", "customer_id:self", "segment:property")
    d.relationship("supp_in", "supplier:supplier", "nation:nation").relationship("cust_in", "customer:customer", "nation:nation")
    d.intensional("sends_back", "customer:customer@buyer", "supplier:supplier@seller", rule=rule, depends_on=("returned", "customer", "supplier"))
    d.helpers["returned"] = ()
    return d.close(["nation", "supplier", "customer"])
