"""Tables that a plan writes for itself in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session without one gets a temporary folder, a cluster must name it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


class Scratch:
    """Stored tables of one plan; they go when the plan is done, so what it returns must not read them.

    A stored table ends the lineage: a lost executor costs nothing, and what is read several
    times is made once.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            delete(self.spark, p)
        self.paths.clear()

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame) -> DataFrame:
    """A result of a few rows (patterns, intervals, folds), computed now and free of what it was made from."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


# -- files of the driver's: few and small ------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds, in order; nothing where there is no folder."""
    at, fs = _at(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written beside its place and renamed into it."""
    at, fs = _at(spark, path)
    own, _ = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    try:
        out = fs.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        fs.delete(at, False)
        if not fs.rename(own, at):
            raise OSError(f"{path} can't be put in place")
    finally:
        fs.delete(own, False)


def get_text(spark: SparkSession, path: str) -> str | None:
    """A file's text; None where it can't be read."""
    if not exists(spark, path):
        return None
    try:
        return bytes(spark.read.format("binaryFile").load(path).select("content").collect()[0]["content"]).decode()
    except (IndexError, UnicodeDecodeError, Py4JError, PySparkException):
        return None
