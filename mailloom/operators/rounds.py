"""Tables between the rounds of an iteration, and results that a job writes for others to read.

They lie in the folder that the cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set, a temporary one in local mode only."""
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_KEY} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-mailloom-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/mailloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` as a table of its own, without lineage; the table ``replaces`` of an earlier round is deleted."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if replaces is not None:
        forget(replaces)
    return out


def forget(table: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = table.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
