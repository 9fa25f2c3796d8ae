"""Facts as a stream: each micro-batch is a slice, appended once and deduced against all slices up to it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_slices(stream: DataFrame, path: str, checkpoint: str, derive: Callable[[DataFrame], DataFrame] | None = None, derived_path: str | None = None) -> StreamingQuery:
    """Appends batches under ``path/batch=<id>``; a replayed batch overwrites its own folder, so every fact is kept once.

    ``derive`` maps all facts so far to derived rows with a slice column; those of later slices are added.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates().write.mode("overwrite").parquet(f"{path}/batch={number}")
        if derive is not None:
            derive(batch.sparkSession.read.parquet(path).filter(F.col("batch") <= number)).write.mode("overwrite").parquet(f"{derived_path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(start, key, n): facts per window and key, with late ones up to ``delay``; runs on streams and tables alike."""
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
