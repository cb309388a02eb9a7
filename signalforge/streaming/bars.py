"""Bars from a stream of prints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalforge.sources.bars import INELIGIBLE


def stream_bars(ticks: DataFrame, interval: str, seconds: int, lateness: str = "1 minute") -> DataFrame:
    """Bars of a stream: a bar is final once prints are later than its end by the allowed lateness.

    Prints later still are dropped by the watermark; state is one row per symbol and open bar.
    """
    codes = F.coalesce("conditions", F.array().cast("array<string>"))
    ok = ~F.arrays_overlap(codes, F.array(*[F.lit(c) for c in INELIGIBLE]))
    rows = ticks.withWatermark("ts", lateness).withColumn("ok", ok)
    at, price = F.when(F.col("ok"), F.struct("ts", "price")), F.when(F.col("ok"), F.col("price"))
    found = rows.groupBy("symbol", F.window("ts", f"{seconds} seconds")).agg(
        F.min(at)["price"].alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max(at)["price"].alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )
    found = found.filter(F.col("open").isNotNull() & (F.col("volume") > 0))
    return found.select("symbol", F.lit(interval).alias("interval"), F.col("window.start").alias("ts"), "open", "high", "low", "close", "volume")
