"""A cache of bars that a refresh can't spoil.

A refresh writes its bars as a new version beside the others and then publishes a list that says
which version of each symbol and interval holds. Spark's commit marker makes the list whole or
absent, and readers take the newest whole one: an interrupted refresh leaves everything as it
was. Versions that no list names are deleted by the next refresh.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalforge.plans.store import Scratch, delete, exists, names
from signalforge.sources.bars import is_sound, validate

#: Lists that stay readable: a reader that began with an older one can end.
LISTS = 2
LIST = "interval string, symbol string, version string, bars long"
REPORT = "interval string, symbol string, bars long, dropped long, published boolean, failure string"


def lists(spark: SparkSession, root: str) -> list[str]:
    """Whole lists, newest last."""
    return [v for v in names(spark, f"{root}/lists") if exists(spark, f"{root}/lists/{v}/_SUCCESS")]


def held(spark: SparkSession, root: str) -> DataFrame:
    """(interval, symbol, version, bars) of the newest list: one row for each series."""
    found = lists(spark, root)
    return spark.read.schema(LIST).parquet(f"{root}/lists/{found[-1]}") if found else spark.createDataFrame([], LIST)


def refresh(spark: SparkSession, root: str, fetched: DataFrame, now: dt.datetime) -> DataFrame:
    """Publish what ``fetched`` brings (bars, and rows with an error for windows that failed); one report row for each series.

    A series with a failed window isn't published where an older, whole one is held: it would be
    shorter. A series without sound bars never is.
    """
    key, version = ["interval", "symbol"], now.strftime("%Y%m%dT%H%M%S%f")
    if (newest := lists(spark, root)) and newest[-1] >= version:
        raise ValueError(f"the cache has a newer list, {newest[-1]}")
    with Scratch(spark) as scratch:
        rows = scratch.put(fetched)
        sound = F.coalesce(is_sound(), F.lit(False))
        bars = F.col("error").isNull() & F.col("ts").isNotNull()
        seen = rows.groupBy(*key).agg(
            F.count_if(bars & ~sound).alias("unsound"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(" ", F.col("window_start").cast("string"), "error"))).alias("error")
        )
        clean = validate(rows.filter(bars).drop("error", "window_start").withColumn("_arrival", F.monotonically_increasing_id()), "_arrival").drop("_arrival")
        clean.write.partitionBy(*key).parquet(f"{root}/data/version={version}")
        written = spark.read.schema(clean.schema).parquet(f"{root}/data/version={version}") if not clean.isEmpty() else clean
        old = held(spark, root).withColumnsRenamed({"version": "old", "bars": "old_bars"})
        kept = rows.filter(bars).groupBy(*key).agg(F.count("*").alias("got"))
        sizes = written.groupBy(*key).agg(F.count("*").alias("bars"))
        found = seen.join(kept, key, "left").join(sizes, key, "left").join(old, key, "full_outer")
        n = F.coalesce("bars", F.lit(0).cast("long"))
        publish = (n > 0) & (F.col("error").isNull() | F.col("old").isNull())
        failure = F.when(F.col("error").isNotNull() & (n > 0) & F.col("old").isNotNull(), F.concat_ws("; ", "error", F.lit("the older, whole series stays"))).otherwise(F.col("error"))
        failure = F.coalesce(failure, F.when((n == 0) & (F.coalesce("got", F.lit(0)) > 0), F.lit("no sound bars")))
        found = scratch.put(found.select(*key, "old", "old_bars", n.alias("n"), (F.coalesce("got", F.lit(0)) - n).alias("dropped"), publish.alias("publish"), failure.alias("failure")))
        new = found.filter("publish OR old IS NOT NULL").select(
            *key, F.when(F.col("publish"), F.lit(version)).otherwise(F.col("old")).alias("version"), F.when(F.col("publish"), F.col("n")).otherwise(F.col("old_bars")).alias("bars")
        )
        new.coalesce(1).write.parquet(f"{root}/lists/{version}")  # the commit: one row for each series
        asked = found.filter("n > 0 OR failure IS NOT NULL OR dropped > 0")
        report = spark.createDataFrame(asked.select(*key, F.col("n").alias("bars"), "dropped", F.col("publish").alias("published"), "failure").collect(), REPORT)
    _swept(spark, root)
    return report


def _swept(spark: SparkSession, root: str) -> None:
    """Delete all but the newest lists, and versions that none of them names."""
    found = lists(spark, root)
    for v in set(names(spark, f"{root}/lists")) - set(found[-LISTS:]):
        delete(spark, f"{root}/lists/{v}")
    named = {r[0] for v in found[-LISTS:] for r in spark.read.schema(LIST).parquet(f"{root}/lists/{v}").select("version").distinct().collect()}
    for v in names(spark, f"{root}/data"):
        if v.removeprefix("version=") not in named and v.removeprefix("version=") < found[-1]:
            delete(spark, f"{root}/data/{v}")


def load(spark: SparkSession, root: str, interval: str | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Validated bars of the newest list; a series that isn't held is an error, not a download."""
    found = held(spark, root)
    if interval:
        found = found.filter(F.col("interval") == interval)
    if symbols is not None:
        found = found.filter(F.col("symbol").isin(list(symbols)))
    rows = found.select("interval", "symbol", "version").collect()  # one row for each series
    missing = sorted(set(symbols or ()) - {r["symbol"] for r in rows})
    if missing or not rows:
        raise FileNotFoundError(f"no cached {interval or ''} bars of {', '.join(missing) or 'any symbol'} in {root}: refresh the cache first")
    versions = sorted({r["version"] for r in rows})
    wide = "interval string, symbol string, ts timestamp, open double, high double, low double, close double, volume double, version string"
    bars = spark.read.schema(wide).option("basePath", f"{root}/data").parquet(*[f"{root}/data/version={v}" for v in versions])
    chosen = spark.createDataFrame(rows, "interval string, symbol string, version string")
    return validate(bars.join(chosen, ["interval", "symbol", "version"], "left_semi").drop("version"))


def description(bars: DataFrame) -> DataFrame:
    """Symbols, sessions and bars of each interval, and the first and last session."""
    return bars.groupBy("interval").agg(
        F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("session").alias("dates"),
        F.count_distinct("symbol", "session").alias("sessions"),
        F.count("*").alias("bars"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
    )


def newest_sessions(bars: DataFrame, n: int) -> DataFrame:
    """The n newest sessions of each symbol, newest first."""
    days = bars.select("symbol", "session").distinct()
    newest = Window.partitionBy("symbol").orderBy(F.desc("session"))
    return days.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)
