"""Tables of a computation in the shared folder, deleted when it ends."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .deduce import ensure_checkpoint_dir


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class Workspace:
    """Writes tables under one folder; what a lost executor held is read again from there."""

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/work-{uuid.uuid4().hex}"
        self.tables = 0

    def put(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._at = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete(self.spark, df._at)


@contextmanager
def workspace(spark: SparkSession):
    found = Workspace(spark)
    try:
        yield found
    finally:
        delete(spark, found.path)
