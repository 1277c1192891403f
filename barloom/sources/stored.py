"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from types import TracebackType

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, that of the session.
    Without either, a session on this machine alone (tests) gets a temporary folder;
    on a cluster that is an error, as executors wouldn't share it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or own.isDefined():
        return (named or own.get()).rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what several
    results are made of is then computed once, lost executors cost no recomputation,
    and plans stay short. The table goes with the session."""
    return written(df, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as Parquet to ``path`` and read again; the table is removed when
    the session's driver ends, if it wasn't before."""
    spark = df.sparkSession
    df.write.parquet(path)
    file_system, there = _located(spark, path)
    file_system.deleteOnExit(there)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes the table or folder at ``path``, if it is there."""
    file_system, there = _located(spark, path)
    file_system.delete(there, True)
    file_system.cancelDeleteOnExit(there)


def _located(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


class Store:
    """A handle on intermediate tables, which go when its block ends:
    ``with Store(spark) as store: table = store(df, "name")``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        return written(df, f"{self.folder}/{name}")

    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        removed(self.spark, self.folder)
