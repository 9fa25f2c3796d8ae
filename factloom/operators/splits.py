"""Partitions of interpretations (or any ids) into folds: deterministic, by a hash of the id and a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(seed: int, column: str):
    return F.md5(F.concat_ws("/", F.col(column).cast("string"), F.lit(str(seed))))


def kfold(ids: DataFrame, k: int, seed: int = 0, column: str = "ex") -> DataFrame:
    """(id, fold): folds of equal size, but for one. Ids are few (interpretations), so one ordering suffices."""
    if k < 2:
        raise ValueError("two folds at least")
    return ids.select(column).distinct().withColumn("fold", (F.row_number().over(Window.orderBy(_order(seed, column), F.col(column))) - 1) % k)


def stratified(ids: DataFrame, k: int, stratum: str, seed: int = 0, column: str = "ex") -> DataFrame:
    """(id, fold): the same within each stratum, so small strata may leave folds without them."""
    rows = ids.select(column, stratum).distinct()
    return rows.withColumn("fold", (F.row_number().over(Window.partitionBy(stratum).orderBy(_order(seed, column), F.col(column))) - 1) % k)


def leave_one_out(ids: DataFrame, column: str = "ex") -> DataFrame:
    """Each id is a fold of its own."""
    return ids.select(column).distinct().withColumn("fold", F.row_number().over(Window.orderBy(column)) - 1)


def tenfold(ids: DataFrame, seed: int = 0, column: str = "ex") -> DataFrame:
    return kfold(ids, 10, seed, column)


def random_split(ids: DataFrame, share: float, seed: int = 0, column: str = "ex") -> DataFrame:
    """(id, part): ``train`` for a share of the ids, given as 0 to 1 or in percent."""
    share = share / 100 if share > 1 else share
    rows = ids.select(column).distinct().withColumn("_k", F.row_number().over(Window.orderBy(_order(seed, column), F.col(column)))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return rows.select(column, F.when(F.col("_k") <= F.round(F.col("_n") * share), "train").otherwise("test").alias("part"))


def fixed_split(ids: DataFrame, train: list, test: list, column: str = "ex") -> DataFrame:
    """(id, part) of the ids in two lists; an id in both is an error."""
    if set(train) & set(test):
        raise ValueError("an id is in both parts")
    part = F.when(F.col(column).isin(train), "train").when(F.col(column).isin(test), "test")
    return ids.select(column).distinct().select(column, part.alias("part")).filter("part is not null")


def prepartitioned(ids: DataFrame, folds: DataFrame, column: str = "ex") -> DataFrame:
    """(id, trial, fold) from a table of test ids per trial and fold."""
    return ids.select(column).distinct().join(folds.select(column, "trial", "fold"), column)
