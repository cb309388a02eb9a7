"""Synthetic bars: each (symbol, date) is a pure function of its name, so any partitioning gives the same market."""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.schema import BARS

MINUTES = 390


def _day(symbol: str, date: dt.date, clustered: bool) -> pd.DataFrame:
    """One session of minute bars: a random walk whose volatility is high at both ends of the day."""
    rng = np.random.default_rng(zlib.crc32(f"{symbol}:{date.isoformat()}".encode()))
    x = np.linspace(-1, 1, MINUTES)
    shape = 0.6 + 0.8 * x * x
    level = 1.0
    if clustered:
        shocks = rng.normal(0, 0.25, MINUTES)
        log = np.zeros(MINUTES)
        for i in range(1, MINUTES):
            log[i] = 0.95 * log[i - 1] + shocks[i]
        shape = shape * np.exp(log - log.var() / 2)
        level = float(np.exp(rng.normal(0, 0.3) - 0.045))
    base = 20 + zlib.crc32(symbol.encode()) % 200
    steps = rng.normal(0, 0.0006 * level, MINUTES) * shape
    close = base * np.exp(np.cumsum(steps) + rng.normal(0, 0.01))
    gap = rng.normal(0, 0.0001 * level, MINUTES)
    open_ = np.concatenate(([close[0]], close[:-1])) * (1 + gap)
    wick = np.abs(rng.normal(0, 0.0004 * level, (2, MINUTES))) * shape
    high = np.maximum(open_, close) * (1 + wick[0])
    low = np.minimum(open_, close) * (1 - wick[1])
    start = pd.Timestamp(date, tz="America/New_York") + pd.Timedelta(hours=9, minutes=30)
    times = (start + pd.to_timedelta(np.arange(MINUTES), unit="m")).tz_convert("UTC").tz_localize(None)
    cents = lambda v: np.round(v, 2)
    o, c = cents(open_), cents(close)
    return pd.DataFrame(
        {
            "symbol": symbol,
            "interval": "1m",
            "ts": times,
            "open": o,
            "high": np.maximum(cents(high), np.maximum(o, c)),
            "low": np.minimum(cents(low), np.minimum(o, c)),
            "close": c,
            "volume": np.round(rng.lognormal(9, 0.6, MINUTES) * shape) + 1,
        }
    )


def synthetic_bars(spark: SparkSession, symbols: list[str], first: dt.date, last: dt.date, clustered: bool = False) -> DataFrame:
    """Minute bars of every weekday from first to last."""
    days = spark.sql(f"SELECT explode(sequence(DATE'{first}', DATE'{last}')) AS session").filter(F.dayofweek("session").between(2, 6))
    keys = days.select(F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"), "session")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for symbol, day in zip(part["symbol"], part["session"], strict=True):
                yield _day(symbol, day, clustered)

    return keys.repartition("symbol", "session").mapInPandas(run, BARS)
