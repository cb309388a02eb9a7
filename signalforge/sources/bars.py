"""Bars: validation, sessions, resampling, and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalforge.schema import BARS, TRADE_DEFAULTS, TRADES

KEY = ["symbol", "interval", "session"]
#: Regular hours of the exchange, minutes of its local day.
OPEN_MINUTE, CLOSE_MINUTE, ZONE = 570, 960, "America/New_York"
#: Sale conditions that don't set a price (fixed values).
INELIGIBLE = ("W", "4", "I", "7", "V")


def in_order() -> Window:
    """One session's bars in order: the only window that detectors and trades need."""
    return Window.partitionBy(*KEY).orderBy("bar_idx")


def is_sound() -> Column:
    """Prices finite and positive, volume positive, high and low around the body."""
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("open", "high", "low", "close", "volume")]
    test = finite[0]
    for x in finite[1:]:
        test = test & x
    for c in ("open", "high", "low", "close", "volume"):
        test = test & (F.col(c) > 0)
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    return F.coalesce(test & (F.col("high") >= top) & (F.col("low") <= bottom) & (F.col("high") >= F.col("low")), F.lit(False))


def validate(bars: DataFrame, arrival: str | None = None) -> DataFrame:
    """Sound bars, one for each (symbol, interval, ts): the first to arrive, or the least where none is named."""
    order = [F.col(arrival)] if arrival else [F.col(c) for c in ("open", "high", "low", "close", "volume")]
    first = Window.partitionBy("symbol", "interval", "ts").orderBy(*order)
    return bars.filter(is_sound()).withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def local_minute(ts: Column) -> Column:
    local = F.from_utc_timestamp(ts, ZONE)
    return F.hour(local) * 60 + F.minute(local)


def regular_hours(bars: DataFrame) -> DataFrame:
    minute = local_minute(F.col("ts"))
    return bars.filter((minute >= OPEN_MINUTE) & (minute < CLOSE_MINUTE))


def sessionise(bars: DataFrame, session: Column | None = None) -> DataFrame:
    """Add session (exchange-local date unless given), bar_idx from 0, and minute since the open."""
    day = F.to_date(F.from_utc_timestamp("ts", ZONE)) if session is None else session
    rows = bars.withColumns({"session": day, "minute": (local_minute(F.col("ts")) - OPEN_MINUTE).cast("int")})
    by_time = Window.partitionBy(*KEY).orderBy("ts")
    return rows.withColumn("bar_idx", F.row_number().over(by_time) - 1)


def utc(rows: DataFrame, zone: str | None = None) -> DataFrame:
    """Times without a zone become instants: they are UTC, or local to ``zone``. Instants stay, whatever zone they were written in."""
    if rows.schema["ts"].dataType.typeName() != "timestamp_ntz":
        return rows
    return rows.withColumn("ts", F.convert_timezone(F.lit(zone or "UTC"), F.lit("UTC"), F.col("ts")).cast("string").cast("timestamp"))


def resample_ticks(ticks: DataFrame, interval: str, seconds: int, arrival: str | None = None) -> DataFrame:
    """Bars of so many seconds: prices from eligible prints, volume from all; no bar without an eligible print.

    Prints of one time are taken in the order of the column ``arrival``, or of their prices.
    """
    codes = F.coalesce("conditions", F.array().cast("array<string>"))
    rows = ticks.withColumns(
        {
            "ok": ~F.arrays_overlap(codes, F.array(*[F.lit(c) for c in INELIGIBLE])),
            "bin": F.window("ts", f"{seconds} seconds").start,
        }
    )
    price = F.when(F.col("ok"), F.col("price"))
    at = F.when(F.col("ok"), F.struct("ts", *([arrival] if arrival else []), "price"))
    found = rows.groupBy("symbol", F.lit(interval).alias("interval"), F.col("bin").alias("ts")).agg(
        F.min(at)["price"].alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max(at)["price"].alias("close"),
        F.sum("size").cast("double").alias("volume"),
    )
    return found.filter(F.col("open").isNotNull() & (F.col("volume") > 0))


def resample_bars(bars: DataFrame, interval: str, minutes: int) -> DataFrame:
    """Coarser bars of a session, anchored at its first bar."""
    start = F.min("ts").over(Window.partitionBy(*KEY))
    step = F.floor((F.unix_timestamp("ts") - F.unix_timestamp(start)) / (60 * minutes))
    rows = bars.withColumns({"step": step, "start": start})
    return rows.groupBy("symbol", "session", "start", "step").agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).select(
        "symbol",
        F.lit(interval).alias("interval"),
        "session",
        F.timestamp_seconds(F.unix_timestamp("start") + F.col("step") * 60 * minutes).alias("ts"),
        "open",
        "high",
        "low",
        "close",
        "volume",
    )


def write_bars(bars: DataFrame, path: str) -> None:
    """A plain folder of bars, new each time; ``sources.cache`` keeps one that is refreshed."""
    bars.write.mode("errorifexists").partitionBy("interval", "symbol").parquet(path)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of a partitioned folder, validated again; a missing folder is an error."""
    return validate(spark.read.schema(BARS).parquet(path))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    """Trades of a file that may be older: absent columns get their defaults, absent prices stay null."""
    found = spark.read.parquet(path)
    absent = [f for f in TRADES if f.name not in found.columns]
    return found.withColumns({f.name: F.lit(TRADE_DEFAULTS.get(f.name)).cast(f.dataType) for f in absent}).select(TRADES.names)


def flat_share(bars: DataFrame) -> DataFrame:
    """Share of bars without any movement, by interval."""
    flat = (F.col("open") == F.col("high")) & (F.col("high") == F.col("low")) & (F.col("low") == F.col("close"))
    return bars.groupBy("interval").agg(F.count("*").alias("bars"), F.avg(flat.cast("double")).alias("flat_share"))
