"""Ticker scorer: readings of a symbol's daily bars, company figures and yearly statements, and a rating by style.

A symbol's last year is one array of closes, a few hundred numbers, so every reading is an
expression over it. A reading that can't be had has no score, and a rating needs enough of
them. Closes that aren't finite are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A style's ratings: least mean score of a strong and a moderate one, and what a rating needs.
STRONG, MODERATE, LEAST_METRICS, LEAST_COVERAGE = 0.8, 0.6, 3, 0.6
LONG, SHORT, DAY, SWING = "long_term", "short_term", "day_trading", "swing"
#: Styles whose metrics another style counts as well, once.
BASE = {DAY: SHORT, SWING: SHORT}
#: Shares within which two levels are one, and of an earlier band's width that is a squeeze.
NEAR, SQUEEZE = 0.03, 0.7
INFO = (
    "trailing_pe forward_pe price_to_book return_on_equity debt_to_equity profit_margin payout_ratio beta average_volume bid ask change_pct"
).split()


def finite(x: Column) -> Column:
    """x, or null where it isn't a finite number."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def indicators(daily: DataFrame) -> DataFrame:
    """Add moving averages, RSI, Bollinger bands, support, resistance and band width to symbol, day, high, low, close."""
    w = Window.partitionBy("symbol").orderBy("day")
    over = lambda n: w.rowsBetween(-(n - 1), 0)
    full = lambda n, x: F.when(F.count("close").over(over(n)) == n, x)
    change = F.col("close") - F.lag("close").over(w)
    rows = daily.withColumns({"gain": F.greatest(change, F.lit(0.0)), "loss": F.greatest(-change, F.lit(0.0))})
    up, down = F.avg("gain").over(over(14)), F.avg("loss").over(over(14))
    rsi = F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down))
    mean, width = F.avg("close").over(over(20)), F.stddev_samp("close").over(over(20))
    return rows.withColumns(
        {
            "sma20": full(20, mean),
            "sma50": full(50, F.avg("close").over(over(50))),
            "rsi14": F.when(F.count("gain").over(over(14)) == 14, rsi),
            "band_low": full(20, mean - 2 * width),
            "band_high": full(20, mean + 2 * width),
            "support60": full(60, F.min("low").over(over(60))),
            "resistance60": full(60, F.max("high").over(over(60))),
            "range10": full(10, F.avg((F.col("high") - F.col("low")) / F.col("close")).over(over(10))),
            "volume20": full(20, F.avg("volume").over(over(20))),
        }
    )


def latest(daily: DataFrame) -> DataFrame:
    """The newest day of each symbol, with indicators."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("day"))
    return indicators(daily).withColumn("_k", F.row_number().over(newest)).filter("_k = 1").drop("_k")


# -- readings of a year of closes -------------------------------------------------------------------


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)


def spread(a: Column) -> Column:
    """Sample standard deviation, in two passes."""
    held = F.transform(F.array(mean(a)), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / (F.size(a) - 1)))
    return F.element_at(held, 1)


def last(a: Column, n: int) -> Column:
    """The last n of an array that has at least so many."""
    return F.slice(a, -n, n)


def years(daily: DataFrame) -> DataFrame:
    """One row for each symbol: closes of its last 12 and 6 months, day ranges of the last month, and last closes of weeks, oldest first.

    Periods end with the symbol's newest day, weeks with Sunday.
    """
    rows = daily.withColumn("close", finite(F.col("close"))).filter(F.col("close").isNotNull())
    newest = Window.partitionBy("symbol")
    rows = rows.withColumn("_end", F.max("day").over(newest)).filter(F.col("day") > F.add_months("_end", -12))
    at = F.struct("day", "close", ((F.col("high") - F.col("low")) / F.col("close")).alias("range"))
    held = rows.groupBy("symbol").agg(F.max("_end").alias("day"), F.array_sort(F.collect_list(at)).alias("y"))
    since = lambda m: F.filter("y", lambda x: x.day > F.add_months("day", -m))
    week = lambda x: F.date_trunc("week", x.day)
    ends = F.filter("y", lambda x, i: (i == F.size("y") - 1) | (week(x) != week(F.coalesce(F.get(F.col("y"), i + 1), x))))
    return held.select("symbol", "day", F.col("y.close").alias("year"), since(6)["close"].alias("half"), since(1)["range"].alias("ranges"), ends["close"].alias("weeks"))


def extrema(a: Column, sign: int) -> Column:
    """Values above (sign 1) or below (-1) both neighbours, in order."""
    above = lambda x, y: (x > y) if sign > 0 else (x < y)
    return F.filter(a, lambda x, i: above(x, F.get(a, i - 1)) & above(x, F.get(a, i + 1)))


def is_double(points: Column) -> Column:
    """The last two lie within ``NEAR`` of the earlier one."""
    a, b = F.try_element_at(points, F.lit(-2)), F.element_at(points, -1)
    return F.coalesce((F.size(points) >= 2) & (F.abs(b - a) / a <= NEAR), F.lit(False))


def rsi(a: Column, n: int = 14) -> Column:
    """Of the last n changes by simple means: 50 where nothing moved, 100 without a loss, null with too few."""
    moves = F.zip_with(last(a, n + 1), F.slice(a, -n, n), lambda x, y: y - x)
    moves = F.filter(moves, lambda x: x.isNotNull())
    up, down = mean(F.transform(moves, lambda x: F.greatest(x, F.lit(0.0)))), mean(F.transform(moves, lambda x: F.greatest(-x, F.lit(0.0))))
    return F.when(F.size(a) > n, F.when((up == 0) & (down == 0), 50.0).when(down == 0, 100.0).otherwise(100 - 100 / (1 + up / down)))


def steps(x: Column, *bounds: tuple[Column, float], otherwise: float) -> Column:
    """The score of the first condition that holds; null where x is null."""
    out = F.when(x.isNull(), None)
    for condition, score in bounds:
        out = out.when(condition, score)
    return out.otherwise(otherwise)


def trend(values: Column) -> Column:
    """1 where no year fell, 0 where one did, null under two years; values oldest first, nulls left out."""
    held = F.filter(values, lambda x: x.isNotNull())
    falls = F.filter(held, lambda x, i: x < F.get(held, i - 1))
    return F.when(F.size(held) >= 2, F.when(F.size(falls) == 0, 1.0).otherwise(0.0))


def growth(statements: DataFrame) -> DataFrame:
    """(symbol, eps_trend, revenue_trend, years) from one row for each symbol and year: how each figure went over the years."""
    held = statements.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("year", "eps", "revenue"))).alias("s"))
    return held.select("symbol", trend(F.transform("s", lambda x: finite(x.eps))).alias("eps_trend"), trend(F.transform("s", lambda x: finite(x.revenue))).alias("revenue_trend"), F.size("s").alias("years"))


def metrics(daily: DataFrame, info: DataFrame, statements: DataFrame) -> DataFrame:
    """(symbol, style, label, reading, score) of the 24 metrics; a score is 1, 0.5, 0, or null where the metric can't be had.

    info has one row for each symbol (``INFO`` and earnings_date), statements one for each
    symbol and year (eps, revenue); a symbol may lack either.
    """
    known = info.select("symbol", "earnings_date", *[finite(F.col(c)).alias(c) for c in INFO])
    rows = years(daily).join(known, "symbol", "full_outer").join(growth(statements), "symbol", "full_outer")
    year, half, ranges, weeks = (F.coalesce(c, F.array().cast("array<double>")) for c in ("year", "half", "ranges", "weeks"))
    rows = rows.withColumns({"year": year, "half": half, "ranges": ranges, "weeks": weeks})
    c = F.col
    has = lambda a, n, x: F.when(F.size(a) >= n, x)
    price = F.try_element_at("half", F.lit(-1))
    rows = rows.withColumns(
        {
            "price": price,
            "sma20": has("half", 20, mean(last(c("half"), 20))),
            "sma50": has("half", 50, mean(last(c("half"), 50))),
            "sd20": has("half", 20, spread(last(c("half"), 20))),
            "rsi": rsi(c("half")),
            "range10": has("ranges", 10, mean(last(c("ranges"), 10))),
            "support": has("year", 60, F.array_min(last(c("year"), 60))),
            "resistance": has("year", 60, F.array_max(last(c("year"), 60))),
            "own_price": F.try_element_at("year", F.lit(-1)),
            "width": has("year", 80, 4 * spread(last(c("year"), 20)) / mean(last(c("year"), 20))),
            "old_width": has("year", 80, 4 * spread(F.slice("year", -79, 20)) / mean(F.slice("year", -79, 20))),
            "recent": has("year", 40, F.slice("year", -F.least(F.lit(90), F.size("year")), F.least(F.lit(90), F.size("year")))),
            "year20": has("year", 20, mean(last(c("year"), 20))),
            "week10": has("weeks", 10, mean(last(c("weeks"), 10))),
            "quoted": F.when((c("bid") > 0) & (c("ask") > c("bid")), (c("ask") - c("bid")) / c("bid")),
        }
    )
    losses = (c("trailing_pe") <= 0) | (c("forward_pe") <= 0)
    outlook = F.when(~losses, c("forward_pe") - c("trailing_pe"))
    low = c("sma20") - 2 * c("sd20")
    daily_up = c("own_price") > c("year20")
    weekly_up = F.element_at("weeks", -1) > c("week10")
    both = F.when((F.size("year") >= 100) & (F.size("weeks") >= 10), daily_up == weekly_up)
    pe, pb, roe, debt, margin, payout, beta, volume = (c(x) for x in INFO[:1] + INFO[2:9])
    paid = F.when(payout >= 0, payout)
    found = [
        (LONG, "eps_trend", c("eps_trend"), c("eps_trend")),
        (LONG, "revenue_trend", c("revenue_trend"), c("revenue_trend")),
        (LONG, "growth_outlook", outlook, steps(outlook, (outlook < 0, 1.0), (outlook > 0, 0.0), otherwise=0.5)),
        (LONG, "pe", pe, steps(pe, (pe <= 0, 0.0), (pe <= 25, 1.0), otherwise=0.0)),
        (LONG, "pb", pb, steps(pb, (pb <= 0, 0.0), (pb <= 3, 1.0), otherwise=0.0)),
        (LONG, "roe", roe, steps(roe, (roe >= 0.10, 1.0), otherwise=0.0)),
        (LONG, "debt_to_equity", debt, steps(debt, (debt < 0, 0.0), (debt < 100, 1.0), (debt <= 200, 0.5), otherwise=0.0)),
        (LONG, "profit_margin", margin, steps(margin, (margin >= 0.20, 1.0), (margin >= 0.10, 0.5), otherwise=0.0)),
        (LONG, "payout", paid, steps(paid, (paid <= 0.60, 1.0), (paid <= 0.70, 0.5), otherwise=0.0)),
        (LONG, "volatility", beta, steps(beta, (beta <= 1.2, 1.0), (beta <= 1.8, 0.5), otherwise=0.0)),
        (SHORT, "moving_averages", c("sma50"), steps(c("sma50"), ((price > c("sma20")) & (c("sma20") > c("sma50")), 1.0), (price > c("sma20"), 0.5), otherwise=0.0)),
        (SHORT, "rsi", c("rsi"), steps(c("rsi"), (c("rsi") < 30, 1.0), otherwise=0.5)),
        (SHORT, "bands", low, steps(low, (price <= low, 1.0), otherwise=0.5)),
        (SHORT, "earnings", F.lit(None).cast("double"), F.when(c("earnings_date").isNotNull(), 1.0)),
        (SHORT, "average_volume", volume, steps(volume, (volume >= 1_000_000, 1.0), (volume >= 100_000, 0.5), otherwise=0.0)),
        (SHORT, "quote", c("quoted"), steps(c("quoted"), (c("quoted") <= 0.001, 1.0), (c("quoted") <= 0.005, 0.5), otherwise=0.0)),
        (DAY, "daily_range", c("range10"), steps(c("range10"), (c("range10") >= 0.04, 1.0), (c("range10") >= 0.02, 0.5), otherwise=0.0)),
        (DAY, "beta", beta, steps(beta, (beta >= 1.5, 1.0), (beta >= 1.0, 0.5), otherwise=0.0)),
        (DAY, "volume_depth", volume, steps(volume, (volume >= 5_000_000, 1.0), (volume >= 1_000_000, 0.5), otherwise=0.0)),
        (DAY, "change", c("change_pct"), steps(c("change_pct"), (F.abs("change_pct") >= 3, 1.0), otherwise=0.0)),
        (SWING, "support", c("support"), steps(c("support"), ((c("own_price") - c("support")) / c("support") <= NEAR, 1.0), otherwise=0.5)),
        (SWING, "squeeze", c("width"), steps(c("width"), (c("width") < c("old_width") * SQUEEZE, 1.0), (c("width") < c("old_width"), 0.5), otherwise=0.0)),
        (SWING, "double", F.size("recent").cast("double"), steps(c("recent"), (is_double(extrema(c("recent"), -1)) | is_double(extrema(c("recent"), 1)), 1.0), otherwise=0.5)),
        (SWING, "alignment", c("week10"), F.when(both, 1.0).when(~both, 0.0)),
    ]
    each = F.array(*[F.struct(F.lit(s).alias("style"), F.lit(n).alias("label"), F.when(v.isNotNull(), r.cast("double")).alias("reading"), v.cast("double").alias("score")) for s, n, r, v in found])
    return rows.select("symbol", F.explode(each).alias("m")).select("symbol", "m.*")


def ratings(scores: DataFrame) -> DataFrame:
    """(symbol, style, metrics, evaluated, coverage, score, indicator_score, rating): a style counts its base's metrics once.

    Inconclusive below ``LEAST_METRICS`` evaluated metrics or ``LEAST_COVERAGE`` of all.
    """
    counted = F.array(F.col("style"), *[F.when(F.col("style") == b, F.lit(s)) for s, b in BASE.items()])
    rows = scores.withColumn("style", F.explode(F.array_compact(counted)))
    found = rows.groupBy("symbol", "style").agg(F.count("*").alias("metrics"), F.count("score").alias("evaluated"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"))
    mean_, share = F.when(F.col("evaluated") > 0, F.col("score") / F.col("evaluated")), F.col("evaluated") / F.col("metrics")
    rating = F.when((F.col("evaluated") < LEAST_METRICS) | (share < LEAST_COVERAGE), "inconclusive").when(mean_ >= STRONG, "strong").when(mean_ >= MODERATE, "moderate").otherwise("poor")
    return found.withColumns({"coverage": share, "indicator_score": mean_, "rating": rating})


def report(scores: DataFrame, mode: str = "concise") -> DataFrame:
    """Ratings alone (concise), with every metric of a style as text (verbose), or the metrics of each symbol without ratings (info)."""
    if mode == "concise":
        return ratings(scores).select("symbol", "style", "rating", "indicator_score")
    line = F.format_string("%s: %s (%s)", F.col("label"), F.coalesce(F.format_number("reading", 4), F.lit("n/a")), F.coalesce(F.format_number("score", 1), F.lit("n/a")))
    lines = scores.groupBy("symbol", "style").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    if mode == "info":
        return lines
    if mode != "verbose":
        raise ValueError(f"unknown mode {mode!r}")
    return ratings(scores).join(lines, ["symbol", "style"], "left")
