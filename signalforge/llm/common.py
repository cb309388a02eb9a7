"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: A row without an id is keyed by this, the least long.
NO_ID = -(2**63)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the maximal runs of characters other than ``SPACES``; empty for null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_OWNER: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextmanager
def owned() -> Iterator[list[str]]:
    """The paths of all tables stored within, unless something further in owns them; they stay until they are dropped."""
    paths: list[str] = []
    token = _OWNER.set(paths)
    try:
        yield paths
    finally:
        _OWNER.reset(token)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (owner := _OWNER.get()) is not None:
        owner.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return what a worker no longer holds to the system: NumPy and Arrow keep large blocks, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def thrifty(run: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for mapInArrow, that leaves no memory with the worker when its task ends."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()  # run's own arrays are gone by now

    return own


def thrifty_group(run: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``run``, for applyInArrow, that leaves no memory but its result with the worker."""

    def own(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    return own


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with as many underscores before it as keep it apart from the columns ``taken``; Spark's names ignore case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int) -> DataFrame:
    """Add ``name``: gapless numbers from 0 within ``keys``, dealing each group over ``parts`` slices.

    A group may hold most rows: rows are numbered within (keys, slice), and each slice starts
    where the counts of the group's earlier slices end. Ties are numbered in any order.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(*order))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = sliced.withColumn("_local", local - 1).join(starts, [*same, F.col("_slice") == F.col("_s")])
    return joined.withColumn(name, (F.col("_local") + F.col("_start")).cast("long")).drop(
        "_slice", "_local", "_start", "_s", *[f"_k{i}" for i in range(len(keys))]
    )
