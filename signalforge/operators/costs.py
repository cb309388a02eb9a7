"""What a trade pays: spreads estimated from bars, and spreads quoted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalforge.config import INTERVALS, Costs
from signalforge.sources.bars import KEY

#: Minutes from the open at which midday begins and ends.
MIDDAY, LATE = 30, 360


def time_bucket(minute: Column) -> Column:
    return (
        F.when(minute.isNull(), "unknown").when(minute < MIDDAY, "open").when(minute >= LATE, "close").otherwise("midday")
    )


def corwin_schultz(bars: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Spread of a session from its highs and lows: mean over neighbouring bars of the estimate, never below 0."""
    keys = keys or KEY
    usable = bars.filter((F.col("high") >= F.col("low")) & (F.col("low") > 0))
    w = Window.partitionBy(*keys).orderBy("bar_idx")
    rows = usable.withColumns({"h2": F.lead("high").over(w), "l2": F.lead("low").over(w)})
    one = F.pow(F.log(F.col("high") / F.col("low")), 2) + F.pow(F.log(F.col("h2") / F.col("l2")), 2)
    two = F.pow(F.log(F.greatest("high", "h2") / F.least("low", "l2")), 2)
    k = 3 - 2 * 2**0.5
    alpha = (F.sqrt(2 * one) - F.sqrt(one)) / k - F.sqrt(two / k)
    spread = 2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha))
    pair = F.when(F.col("h2").isNotNull(), F.greatest(F.lit(0.0), spread))
    return rows.groupBy(*keys).agg(F.avg(pair).alias("spread"))


def one_way(spread: Column, costs: Costs) -> Column:
    """Half the spread as a share of the price; the fixed slippage where there is no estimate, none above 0, or an implausible one."""
    fixed = F.lit(costs.slippage_bps / 1e4)
    return F.when(spread.isNull() | (spread <= 0) | (spread > costs.ceiling), fixed).otherwise(spread / 2)


def estimated(bars: DataFrame, costs: Costs) -> DataFrame:
    """(symbol, session, spread, cost): one estimate for each session, from its narrowest interval of a minute at least.

    Longer bars give wider estimates, and seconds without movement give none, so every interval
    of a session is charged by the same one.
    """
    minutes = F.create_map(*[F.lit(x) for i, m in INTERVALS.items() for x in (i, float(m))])
    sizes = bars.select("symbol", "session", "interval").distinct().withColumn("_m", minutes[F.col("interval")]).filter("_m >= 1")
    chosen = sizes.groupBy("symbol", "session").agg(F.min_by("interval", "_m").alias("interval"))
    spread = corwin_schultz(bars.join(chosen, KEY, "left_semi"))
    return spread.select("symbol", "session", "spread", one_way(F.col("spread"), costs).alias("cost"))


def half_spread_bps(bid: Column, ask: Column) -> Column:
    """Null for quotes that are one-sided, locked or crossed."""
    return F.when((bid > 0) & (ask > bid), (ask - bid) / ((ask + bid) / 2) * 1e4 / 2)


def quote_table(quotes: DataFrame) -> DataFrame:
    """(symbol, bucket, half_spread_bps): median over days of each day's median. Quotes have day and minute."""
    rows = quotes.select("symbol", "day", time_bucket(F.col("minute")).alias("bucket"), half_spread_bps(F.col("bp"), F.col("ap")).alias("s"))
    days = rows.filter(F.col("s").isNotNull()).groupBy("symbol", "bucket", "day").agg(F.median("s").alias("s"))
    return days.groupBy("symbol", "bucket").agg(F.median("s").alias("half_spread_bps"))


def priced(bars: DataFrame, table: DataFrame, costs: Costs) -> DataFrame:
    """Add cost and cost_source to bars: the bucket's own quote, the mean of the symbol's others, or the fixed cost."""
    own = table.select("symbol", F.col("bucket"), F.col("half_spread_bps").alias("_own"))
    rest = table.groupBy("symbol").agg(F.avg("half_spread_bps").alias("_rest"))
    minute = F.coalesce("minute", F.lit(MIDDAY))
    rows = bars.withColumn("bucket", time_bucket(minute)).join(own, ["symbol", "bucket"], "left").join(rest, "symbol", "left")
    return rows.withColumns(
        {
            "cost": F.coalesce(F.coalesce("_own", "_rest") / 1e4, F.lit(costs.slippage_bps / 1e4)),
            "cost_source": F.when(F.col("_own").isNotNull(), "observed").when(F.col("_rest").isNotNull(), "imputed").otherwise("fallback"),
        }
    ).drop("_own", "_rest")
