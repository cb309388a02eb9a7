"""Quotes: which of them a session's spread is read from, and the table of spreads as a side table of its own."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.plans.store import exists, names

#: Minutes from the open at which each bucket is sampled, and seconds of quotes taken there (fixed values).
SAMPLE_MINUTES = {"open": (1, 10, 25), "midday": (60, 180, 300), "close": (361, 372, 385)}
SAMPLE_SECONDS = 2

TABLE = "symbol string, bucket string, half_spread_bps double"
#: Versions of the table that stay readable.
VERSIONS = 2


def sampled(quotes: DataFrame) -> DataFrame:
    """Quotes (symbol, day, minute, second, bp, ap) at the sample points; both conditions reach the scan of a stored table."""
    minutes = [m for held in SAMPLE_MINUTES.values() for m in held]
    return quotes.filter(F.col("minute").isin(minutes) & (F.col("second") < SAMPLE_SECONDS))


def write_quotes(quotes: DataFrame, path: str) -> None:
    """Quotes by day, sorted by minute within a file, so that sampling skips what it doesn't read."""
    quotes.repartition("day").sortWithinPartitions("minute", "second", "symbol").write.mode("errorifexists").partitionBy("day").parquet(path)


def write_table(table: DataFrame, path: str, now: dt.datetime) -> str:
    """Publish the table as a new version, whole or not at all; its name."""
    version = now.strftime("%Y%m%dT%H%M%S%f")
    table.select("symbol", "bucket", "half_spread_bps").write.mode("errorifexists").parquet(f"{path}/{version}")
    return version


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version; without one that can be read, a table without rows, so that every bar falls back."""
    for version in sorted(names(spark, path), reverse=True)[: VERSIONS + 1]:
        at = f"{path}/{version}"
        if not exists(spark, f"{at}/_SUCCESS"):
            continue
        try:
            found = spark.read.parquet(at).selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in TABLE.split(", ")])
            found.limit(1).collect()
            return found
        except (PySparkException, Py4JError):
            continue
    return spark.createDataFrame([], TABLE)


def source_shares(priced: DataFrame) -> DataFrame:
    """(interval, cost_source, bars, share) of bars that have a cost_source: how many spreads were observed, imputed or fixed."""
    rows = priced.groupBy("interval", "cost_source").agg(F.count("*").alias("bars"))
    total = rows.groupBy("interval").agg(F.sum("bars").alias("_all"))
    return rows.join(total, "interval").select("interval", "cost_source", "bars", (F.col("bars") / F.col("_all")).alias("share"))
