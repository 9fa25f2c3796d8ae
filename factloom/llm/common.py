"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, MapType, NumericType, StructType, TimestampType

#: ASCII white space, the only characters that part words here.
SPACE = r"[\x20\x09-\x0D]+"

#: A table may be broadcast when its counted rows, at their widths in a hashed relation, stay below this bound.
BROADCAST_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local session, whose executors see the driver's disk, may go without: it gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.factloom.shared.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.factloom.shared.dir", found)
    return found.rstrip("/")


#: Rows of a batch between Spark and Python. Texts are long: at the usual 10,000 a batch takes tens of megabytes on both sides.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"

#: Folders that the innermost open scratch() block of this thread (or task of an event loop) has written.
_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage, survives lost executors, and gives the planner true sizes."""
    spark = df.sparkSession
    if spark.conf.get(BATCH) == "10000":  # the default; a setting of the user's own stays
        spark.conf.set(BATCH, BATCH_ROWS)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    if (open_block := _SCRATCH.get()) is not None:
        open_block.append(path)  # before the write: what a failed one leaves goes as well
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def scratch(spark: SparkSession):
    """Tables stored within are deleted at the end, but for those given to the function that this yields."""
    own: list[str] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._stored_at)
        return df

    outer = _SCRATCH.get()
    token = _SCRATCH.set(own)
    try:
        yield keep
    finally:
        _SCRATCH.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in own:
            if path not in kept:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
        if outer is not None:
            outer.extend(x for x in own if x in kept)


def _width(kind: DataType) -> int:
    """Bytes that a value is reckoned to take: numbers 8, strings and others 64 beside them."""
    return 8 if isinstance(kind, (NumericType, BooleanType, DateType, TimestampType)) else 72


def row_bytes(df: DataFrame) -> int:
    """Bytes that a row is reckoned to take in a hashed relation."""
    return 40 + sum(_width(f.dataType) for f in df.schema)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its rows (counted) take at most ``limit`` bytes; beyond that the planner joins by shuffle.

    A table whose files lie below the planner's own threshold needs neither count nor hint: the planner broadcasts it.
    """
    spark = df.sparkSession
    threshold = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= threshold:
        return df
    rows = limit // row_bytes(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def quoted(c: str) -> str:
    """A column's name as one identifier, whatever signs it has."""
    return "`" + c.replace("`", "``") + "`"


def col(df: DataFrame, c: str) -> Column:
    return df[quoted(c)]


def ddl(kind: DataType) -> str:
    """A type as schema text, with its field names quoted."""
    if isinstance(kind, StructType):
        return "struct<" + ",".join(f"{quoted(f.name)}:{ddl(f.dataType)}" for f in kind) + ">"
    if isinstance(kind, ArrayType):
        return f"array<{ddl(kind.elementType)}>"
    if isinstance(kind, MapType):
        return f"map<{ddl(kind.keyType)},{ddl(kind.valueType)}>"
    return kind.simpleString()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also where ``body`` uses it within lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def tidy(f):
    """A batch function whose worker gives free memory back when its task ends; workers live on between tasks, beside each other and a JVM."""

    @wraps(f)
    def run(arrow):
        try:
            yield from f(arrow)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(AttributeError, OSError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return run


def batches(arrow, columns: list[str], rows: int = 512):
    """Record batches as lists of Python values, at most ``rows`` rows at a time, so that long texts stay bounded in memory."""
    for batch in arrow:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, hash of the text) isn't in ``dropped`` (columns _id, _hash); texts move only if ``dropped`` is too large to broadcast."""
    dropped = small(dropped)
    same = col(docs, id_col).eqNullSafe(dropped._id) & F.xxhash64(col(docs, text_col)).eqNullSafe(dropped._hash)
    return docs.join(dropped, same, "left_anti")
