"""Intermediate tables and skew-safe lookups shared by the operators.

An intermediate result that is read more than once, or that ends a round of an
iteration, is written as Parquet below the folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read and nothing else. An
operator ends with ``settled``, which stages its result and deletes what it staged before.

Rows reach Python in batches of at most 64 MB (Spark's own bound on Arrow batches) and,
while a table is staged, of at most ``rows`` rows. The latter is a setting of the session:
operators that run at the same time in one session share it.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_staged: list[tuple[str, str | None]] = []  # (folder, table in the catalogue)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-mailloom-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Hand at most ``rows`` rows at a time to Python in the jobs run inside; texts can be long."""
    before = spark.conf.get(_ROWS)
    spark.conf.set(_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def trim() -> None:
    """Give memory that a Python worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def stage(df: DataFrame, label: str, rows: int = 1000, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once, handing ``rows`` rows at a time to Python, and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/mailloom-{label}-{uuid.uuid4().hex}"
    with arrow_rows(spark, rows):
        df.write.parquet(path, compression=codec)
    _staged.append((path, None))
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_bucketed(df: DataFrame, key: str, codec: str, rows: int = 1000) -> DataFrame:
    """``stage`` as a table bucketed by ``key``, which later joins on the key need not move again."""
    spark = df.sparkSession
    name = f"mailloom_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with arrow_rows(spark, rows):
        df.write.bucketBy(parts, key).option("path", path).option("compression", codec).format("parquet").saveAsTable(name)
    _staged.append((path, name))
    return spark.table(name)


def ranges(spark: SparkSession, size: int, per_range: int = 128 << 20) -> int:
    """Partitions for a range shuffle of ``size`` bytes: the session's number, or as many more as keep each near ``per_range``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // per_range))


def mark() -> int:
    """How many tables are staged; see ``settled``."""
    return len(_staged)


def settled(df: DataFrame, label: str, since: int) -> DataFrame:
    """``df`` staged, and what was staged after ``since`` deleted: an operator's last step."""
    out = stage(df, label)
    for path, name in _staged[since:-1]:
        _delete(df.sparkSession, path, name)
    del _staged[since:-1]
    return out


def drop_since(spark: SparkSession, since: int) -> None:
    """Delete what was staged after ``since``, once nothing reads it any more."""
    for path, name in _staged[since:]:
        _delete(spark, path, name)
    del _staged[since:]


def drop_staged(df: DataFrame) -> None:
    """Delete one staged table whose last reader has finished."""
    for entry in [e for e in _staged if e[0] == df.staged_at]:
        _delete(df.sparkSession, *entry)
        _staged.remove(entry)


def release(spark: SparkSession) -> None:
    """Delete every table staged by this process; results read from them are gone then."""
    while _staged:
        _delete(spark, *_staged.pop())


def _delete(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hot_lookup(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int, hot: int = 512) -> DataFrame:
    """Left join ``rows`` with ``table`` (unique ``key``, ``weight`` = its number of rows) without a hot partition.

    Keys that weigh over ``total / hot`` number fewer than ``hot``, so they are
    broadcast; the rest have few rows each and are joined by a shuffle.
    """
    at_least = total / hot
    common = table.columns
    renamed = [F.col(c).alias(f"__hot_{c}") for c in common if c != key]
    large = table.where(F.col(weight) > at_least).select(F.col(key), *renamed, F.lit(True).alias("__hot"))
    first = rows.join(F.broadcast(large), key, "left")
    done = first.where(F.col("__hot")).select(*rows.columns, *[F.col(f"__hot_{c}").alias(c) for c in common if c != key])
    rest = first.where(F.col("__hot").isNull()).select(*rows.columns)
    return done.unionByName(rest.join(table.where(F.col(weight) <= at_least), key, "left").select(*rows.columns, *[c for c in common if c != key]))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.crc32(F.col(id_col).cast("string")) % n
