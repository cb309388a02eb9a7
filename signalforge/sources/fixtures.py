"""Market tables made from the driver's tables: prints, quotes and bars whose results SQL can check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge.sources.bars import KEY, sessionise, validate


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as prints: the type is the symbol, the value the price; every seventh user's sale doesn't set a price."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    odd = F.when(F.col("user_id") % 7 == 0, F.array(F.lit("I"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("size"), odd.alias("conditions")
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of all prints."""
    rows = ticks(spark, sf_dir)
    found = rows.groupBy("symbol", F.lit("1h").alias("interval"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("size").alias("volume"),
    )
    return found


def bars(spark: SparkSession, sf_dir: str, by: str = "week") -> DataFrame:
    """Validated hourly bars in sessions of a UTC week or day."""
    session = F.to_date(F.date_trunc(by, "ts"))
    return sessionise(validate(raw_bars(spark, sf_dir)), session).select(
        *KEY, "ts", "bar_idx", "open", "high", "low", "close", "volume", "minute"
    )


def maker_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of makers' parts from order lines, in sessions of a year; a day's lines are in the order of their orders."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_brand", 1, 7).alias("maker"))
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(parts, "l_partkey")
    price, at = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber")
    rows = items.groupBy(F.col("maker").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"), F.sum("l_quantity").cast("double").alias("volume")
    )
    held = rows.select("symbol", F.lit("1d").alias("interval"), F.to_date(F.date_trunc("year", "day")).alias("session"), F.col("day").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    return sessionise(validate(held), F.col("session")).select(*KEY, "bar_idx", "open", "high", "low", "close", "volume", "minute")


def five_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bars of all events, in sessions of a UTC day."""
    rows = ticks(spark, sf_dir)
    found = rows.groupBy("symbol", F.lit("5m").alias("interval"), F.window("ts", "5 minutes").start.alias("ts")).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume")
    )
    return sessionise(validate(found), F.to_date("ts")).select(*KEY, "bar_idx", "open", "high", "low", "close", "volume", "minute")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as quotes around the price of a unit, with day and minute since the open."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return rows.select(
        F.col("l_returnflag").alias("symbol"),
        F.to_date("l_shipdate").alias("day"),
        (F.col("l_partkey") % 390).cast("int").alias("minute"),
        F.col("l_linenumber").cast("int").alias("second"),
        (price * (1 - F.col("l_discount"))).alias("bp"),
        (price * (1 + F.col("l_tax"))).alias("ap"),
    )


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of parts' brands from lineitem prices; open and close are the least and largest part's."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(
        spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return items.groupBy(F.col("p_brand").alias("symbol"), F.to_date("l_shipdate").alias("day")).agg(
        F.max(price).alias("high"), F.min(price).alias("low"), F.median(price).alias("close"), F.sum("l_quantity").alias("volume")
    )


def company_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each brand, by arithmetic on its parts' sizes; some are absent, negative or not finite."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    s = F.col("s")
    rows = parts.groupBy(F.col("p_brand").alias("symbol")).agg(F.sum("p_size").cast("long").alias("s"))
    none_at = lambda m, r, x: F.when(s % m != r, x)
    return rows.select(
        "symbol",
        none_at(11, 3, (s % 41 - 5).cast("double")).alias("trailing_pe"),
        none_at(7, 2, (s % 37 - 3).cast("double")).alias("forward_pe"),
        F.when(s % 10 == 4, F.lit(float("inf"))).otherwise((s % 9) / 2 - 0.5).alias("price_to_book"),
        ((s % 30) / 100).alias("return_on_equity"),
        none_at(8, 1, (s % 250 - 20).cast("double")).alias("debt_to_equity"),
        ((s % 35) / 100).alias("profit_margin"),
        ((s % 95) / 100 - 0.1).alias("payout_ratio"),
        none_at(9, 5, (s % 25) / 10).alias("beta"),
        none_at(6, 4, (s * s % 7_000_000).cast("double")).alias("average_volume"),
        (s % 90 + 10).cast("double").alias("bid"),
        ((s % 90 + 10) * (1 + (s % 7 - 1) / 1000)).alias("ask"),
        none_at(5, 2, (s % 11 - 5).cast("double")).alias("change_pct"),
        F.when(s % 2 == 0, "2025-04-01").alias("earnings_date"),
    )


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly figures of each brand from its order lines: the mean discount in tenths of a percent as EPS, thousands sold as revenue; a year may lack one."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(
        spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"
    )
    rows = items.groupBy(F.col("p_brand").alias("symbol"), F.year("l_shipdate").alias("year")).agg(F.sum("l_linenumber").alias("a"), F.count("*").alias("n"))
    return rows.select(
        "symbol",
        "year",
        F.when(F.col("n") % 5 != 1, F.floor(F.col("a") * 10 / F.col("n")).cast("double")).alias("eps"),
        F.floor(F.col("n") / 300).cast("double").alias("revenue"),
    ).filter(F.col("symbol") != "Brand#11")
