"""List and set helpers of the rule language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_of(rows: DataFrame, column: str, by: list[str], alias: str = "values") -> DataFrame:
    """Sorted distinct values of each group; empty groups don't exist."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_set(column)).alias(alias))


def bag_of(rows: DataFrame, column: str, by: list[str], alias: str = "values") -> DataFrame:
    """All values of each group, sorted so that reruns agree."""
    return rows.groupBy(*by).agg(F.sort_array(F.collect_list(column)).alias(alias))


def find_all(rows: DataFrame, column: str, alias: str = "values") -> DataFrame:
    """All values in one row, an empty list if there are none."""
    return rows.agg(F.sort_array(F.coalesce(F.collect_list(column), F.array())).alias(alias))


def slice_rows(rows: DataFrame, first: int, last: int, order: list[str]) -> DataFrame:
    """Rows from the first to the last place, counted from 1: a top-k of the last place, then the cut."""
    top = rows.orderBy(*order).limit(last)
    return top.withColumn("_k", F.row_number().over(Window.orderBy(*order))).filter(F.col("_k") >= first).drop("_k")


def shuffled(rows: DataFrame, seed: int, *columns: str) -> DataFrame:
    """Rows in an order that looks random and that reruns repeat."""
    return rows.orderBy(F.xxhash64(*columns, F.lit(seed)))


def integer_range(spark, first: int, last: int) -> DataFrame:
    return spark.range(first, last + 1).toDF("value")


def histogram(rows: DataFrame, levels: list[str], weight: Column | None = None) -> DataFrame:
    """Sums of weights (or counts) by one, two or three levels."""
    return rows.groupBy(*levels).agg(F.sum(F.lit(1.0) if weight is None else weight).alias("w"))
