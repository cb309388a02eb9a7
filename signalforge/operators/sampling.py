"""Trials: which sessions are measured, which are held out, and which bars controls enter on."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalforge.config import INTERVALS, Run
from signalforge.sources.bars import KEY


#: Columns that a trade takes over from its trial, where it has one.
TRIAL = ("trial_index", "trial_seed", "window", "sample")


def narrowest(intervals: list[str]) -> str:
    return min(intervals, key=lambda i: INTERVALS[i])


def session_pool(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "session").distinct()


def dates(pool: DataFrame, run: Run) -> DataFrame:
    """(session, sample, window): the newest dates are held out; the rest are split into windows of about equal length.

    Held-out dates are one window.
    """
    all_ = pool.select("session").distinct()
    newest = Window.orderBy(F.desc("session"))  # one row for each date
    rows = all_.withColumns({"_k": F.row_number().over(newest), "_d": F.count("*").over(Window.partitionBy())})
    held = F.least(F.ceil(F.col("_d") * run.holdout_fraction), F.col("_d") - 1)
    rows = rows.withColumn("sample", F.when(F.col("_k") <= held, "validation").otherwise("discovery"))
    window = F.ntile(run.windows).over(Window.partitionBy("sample").orderBy("session")) - 1
    return rows.withColumn("window", F.when(F.col("sample") == "discovery", window).otherwise(0)).select("session", "sample", "window")


def wanted(run: Run) -> list[tuple[str, int, int, int, int]]:
    """(sample, window, k, trials of that window, trial_index) of every trial: windows share the trials, the first get the remainder."""
    held = math.ceil(run.trials * run.holdout_fraction)
    if run.trials - held < run.windows:
        raise ValueError("the holdout leaves too few trials for the windows")
    share, more = divmod(run.trials - held, run.windows)
    sizes = [("discovery", w, share + (w < more)) for w in range(run.windows)] + [("validation", 0, held)] * bool(held)
    rows = [(sample, w, k, n) for sample, w, n in sizes for k in range(n)]
    return [(*x, i) for i, x in enumerate(rows)]


def draw_trials(pool: DataFrame, run: Run) -> DataFrame:
    """Trials: sessions of each sample and window in a seeded order, each once.

    Where a window has fewer sessions than trials, each trial draws its session by itself, so
    sessions repeat and the number of trials is exact. A window or sample without dates is an error.
    """
    parts = ["sample", "window"]
    rows = pool.join(F.broadcast(dates(pool, run)), "session")  # one row for each date
    order = F.md5(F.concat_ws("|", F.lit(str(run.seed)), "symbol", F.col("session").cast("string")))
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*parts).orderBy(order, "symbol", "session")) - 1)
    sizes = rows.groupBy(*parts).agg(F.count("*").alias("_size"))
    asked = pool.sparkSession.createDataFrame(wanted(run), "sample string, window int, k int, n int, trial_index int")
    asked = asked.join(F.broadcast(sizes), parts, "left")  # one row for each window
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(run.seed)), "sample", "window", "k")), 1, 8), 16, 10).cast("long")
    known = F.when(F.col("_size") > 0, F.col("_size")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("no dates for"), "sample", "window")).cast("long"))
    place = F.when(F.col("n") <= known, F.col("k").cast("long")).otherwise(F.pmod(h, known))
    asked = asked.select("trial_index", *parts, place.alias("_place"), h.alias("seed"))
    return asked.join(rows, [*parts, "_place"]).select("trial_index", "symbol", "session", "seed", "window", "sample")


def trial_bars(bars: DataFrame, trials: DataFrame, lookbacks: dict[str, int]) -> DataFrame:
    """Bars of the sessions that a trial drew, each once; sessions without four bars more than their interval's lookback are skipped."""
    rows = bars.join(trials.select("symbol", "session").distinct(), ["symbol", "session"], "left_semi")
    least = F.create_map(*[F.lit(x) for i, k in lookbacks.items() for x in (i, k + 4)])
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY)))
    return rows.filter(F.col("_n") >= least[F.col("interval")]).drop("_n")


def skipped(bars: DataFrame, lookback: int) -> DataFrame:
    """Sessions, and those too short to measure, by interval."""
    sizes = bars.groupBy(*KEY).agg(F.count("*").alias("n"))
    return sizes.groupBy("interval").agg(F.count("*").alias("sessions"), F.count_if(F.col("n") < lookback + 4).alias("skipped"))


def trend_lookback(bars: DataFrame, configured: int, most_bars: int = 5) -> DataFrame:
    """Lookback of each interval: shorter where the median session is too short for the configured one."""
    sizes = bars.groupBy(*KEY).agg(F.count("*").alias("n"))
    room = F.greatest(F.lit(2), (F.median("n") - most_bars - 5).cast("int"))
    return sizes.groupBy("interval").agg(F.least(F.lit(configured), room).alias("trend_lookback"))


def matched_rate(masked: DataFrame, names: list[str], lookback: int) -> DataFrame:
    """Of each session: bars that a pattern may fire on, and the largest share that one pattern fired on."""
    eligible = f"bar_idx >= {lookback}"
    fired = [f"count_if(`{n}` AND {eligible})" for n in names]
    most = f"greatest({', '.join(fired)}, 0)"
    rows = masked.groupBy(*KEY).agg(F.expr(f"count_if({eligible})").alias("eligible"), F.expr(most).alias("most"))
    rate = F.when(F.col("eligible") > 0, F.col("most") / F.col("eligible")).otherwise(F.lit(0.0))
    return rows.select(*KEY, "eligible", rate.alias("rate"))


def control_mask(bars: DataFrame, rates: DataFrame, lookback: int, seed: int, name: str) -> DataFrame:
    """Bars a random control enters on: as many as the rate asks for, each at most once.

    rates may have several trials (trial_index, trial_seed) of a session, which draw each by itself.
    """
    trial = [c for c in TRIAL if c in rates.columns]
    own_seed = F.col("trial_seed").cast("string") if trial else F.lit(str(seed))
    h = F.md5(F.concat_ws("|", own_seed, F.lit(name), *[F.col(k).cast("string") for k in KEY], F.col("bar_idx").cast("string")))
    rows = bars.select(*KEY, "bar_idx").filter(F.col("bar_idx") >= lookback).join(rates, KEY)
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY, *trial).orderBy(h, "bar_idx")))
    return rows.filter(F.col("_k") <= F.rint(F.col("rate") * F.col("eligible"))).select(*KEY, *trial, F.lit(name).alias("pattern"), "bar_idx")
