"""Cases of a target signature: candidate tuples, labels, task types, and what is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import Domain, SchemaError
from .deduce import EX


def candidates(domain: Domain, tables: dict[str, DataFrame], target: str) -> DataFrame:
    """(ex, ids, viewpoints, case_id) of every tuple of identifiers that the target could hold in an interpretation.

    Identifier sets of the referenced entities meet by equality on the interpretation, never across it;
    a target without references has one case an interpretation.
    """
    s = domain.signatures[target]
    rows = None
    for k, entity in enumerate(s.references):
        own = domain.signatures[entity].id_columns[0].name
        ids = tables[entity].select(F.col(EX).cast("string").alias(EX), F.col(own).cast("string").alias(f"_{k}")).dropDuplicates()
        rows = ids if rows is None else rows.join(ids, EX)
    if rows is None:
        found = [t.select(F.col(EX).cast("string").alias(EX)) for t in tables.values()]
        rows = found[0]
        for t in found[1:]:
            rows = rows.union(t)
        rows = rows.distinct()
        ids, views = F.array().cast("array<string>"), F.lit(None).cast("array<string>")
    else:
        ids = F.array(*[f"_{k}" for k in range(s.relational_arity)])
        views = F.array(*[F.concat_ws("/", EX, F.lit(e), f"_{k}") for k, e in enumerate(s.references)])
    if s.candidate_filter is not None:
        rows = s.candidate_filter(rows)
    return rows.select(EX, ids.alias("ids"), views.alias("viewpoints"), F.concat_ws("/", EX, F.lit(target), ids).alias("case_id"))


def existence_labels(domain: Domain, tables: dict[str, DataFrame], target: str, cases: DataFrame) -> DataFrame:
    """Cases with label 1 where the target has the tuple and -1 elsewhere."""
    s = domain.signatures[target]
    ids = F.array(*[F.col(c.name).cast("string") for c in s.id_columns])
    true = tables[target].select(F.concat_ws("/", F.col(EX).cast("string"), F.lit(target), ids).alias("case_id")).distinct().withColumn("_true", F.lit(1.0))
    return cases.join(true, "case_id", "left").withColumn("label", F.coalesce("_true", F.lit(-1.0))).drop("_true")


def property_labels(domain: Domain, tables: dict[str, DataFrame], target: str, cases: DataFrame, column: str) -> DataFrame:
    """Cases that have a value of the property, with the smallest one as ``value``; the others are skipped."""
    s = domain.signatures[target]
    ids = F.array(*[F.col(c.name).cast("string") for c in s.id_columns])
    values = tables[target].select(F.concat_ws("/", F.col(EX).cast("string"), F.lit(target), ids).alias("case_id"), F.col(column).alias("value")).groupBy("case_id").agg(F.min("value").alias("value"))
    return cases.join(values, "case_id").filter("value is not null")


def label_codes(rows: DataFrame, column: str = "value") -> DataFrame:
    """(value, code): symbols numbered from 1 by their order; the table is as small as the classes are few."""
    return rows.select(F.col(column).alias("value")).distinct().withColumn("code", F.row_number().over(Window.orderBy("value")).cast("double"))


def declared_codes(rows: DataFrame, labels: list[str], column: str = "value") -> DataFrame:
    """Rows with the code of a declared list of labels."""
    code: Column = F.lit(None).cast("double")
    for k, label in enumerate(labels, 1):
        code = F.when(F.col(column) == label, F.lit(float(k))).otherwise(code)
    return rows.withColumn("code", code)


def task_type(values: DataFrame, column: str = "value") -> DataFrame:
    """One row (task): binary, multiclass, regression or error, from the values seen."""
    text = F.col(column).cast("string")
    is_number = text.rlike(r"^[-+]?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$")
    seen = values.filter(F.col(column).isNotNull()).agg(
        F.count_distinct(text).alias("n"), F.bool_and(is_number).alias("numbers"), F.bool_or(is_number).alias("some"),
        F.bool_and(text.isin("true", "false")).alias("truth"), F.bool_and(text.isin("-1", "1", "-1.0", "1.0")).alias("signs"),
    )
    task = (
        F.when(F.col("n") == 0, "error").when((F.col("truth") | F.col("signs")) & (F.col("n") == 2), "binary").when(F.col("numbers"), "regression")
        .when(F.col("some"), "error").when(F.col("n") == 2, "binary").when(F.col("n") > 2, "multiclass").otherwise("error")
    )
    return seen.select(task.alias("task"))


def task_of(domain: Domain, tables: dict[str, DataFrame], target: str) -> dict[str, str]:
    """The task of each property; without properties, whether the tuple exists."""
    s = domain.signatures[target]
    if not s.property_columns:
        return {"": "binary"}
    out = {}
    for c in s.property_columns:
        task = task_type(tables[target], c.name).first()[0]
        if task == "error":
            raise SchemaError(f"{target}.{c.name}: its values make no task")
        out[c.name] = task
    return out


def reject(cases: DataFrame, condition: Column | None) -> DataFrame:
    """Marks cases that training leaves out."""
    return cases.withColumn("rejected", F.lit(False) if condition is None else F.coalesce(condition, F.lit(False)))


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", *columns)), 1, 8), 16, 10).cast("double") / 4294967296.0
