"""Per-pattern statistics, resampling inference and verdicts. A statistic that can't be had is null, never 0."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalforge.config import ALL, Stats

BY = ["pattern", "interval"]


def pooled(trades: DataFrame) -> DataFrame:
    """The trades once under their interval and once under ``all``."""
    return trades.unionByName(trades.withColumn("interval", F.lit(ALL)))


def summarise(trades: DataFrame, grid: DataFrame) -> DataFrame:
    """One row for each (pattern, interval) of grid, whether it has trades or not."""
    win, net = F.col("net_r") > 0, F.col("net_r")
    gains, losses = F.sum(F.when(win, net)), -F.sum(F.when(net < 0, net))
    found = trades.groupBy(*BY).agg(
        F.count("*").alias("trades"),
        F.avg(win.cast("double")).alias("win_rate"),
        F.avg("net_r").alias("expectancy_r"),
        F.avg("gross_r").alias("gross_expectancy_r"),
        F.sum("return_pct").alias("total_return_pct"),
        F.avg(F.col("bars_held").cast("double")).alias("avg_bars_held"),
        F.when(losses > 0, F.coalesce(gains, F.lit(0.0)) / losses)
        .when(gains > 0, F.lit(float("inf")))
        .alias("profit_factor"),
        (F.avg("net_r") / F.nullif(F.stddev_samp("net_r"), F.lit(0.0))).alias("sharpe_per_trade"),
        F.avg("cost_bps").alias("mean_cost_bps"),
        F.count_distinct("session").alias("sessions"),
    )
    rows = grid.join(found, BY, "left")
    return rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("trades", "sessions")})


def chronological(trades: DataFrame) -> list:
    """A date's trades in order: by the clock minute of entry where they have one, symbol, interval and bar; controls may share a bar."""
    minute = [F.asc_nulls_last("entry_minute")] if "entry_minute" in trades.columns else []
    return [*minute, "symbol", "interval", "entry_index", "net_r"]


def _within_dates(trades: DataFrame) -> DataFrame:
    """Add the running sum of net R and the place within a pattern's date; the running peak may start at 0."""
    order = Window.partitionBy(*BY, "session").orderBy(*chronological(trades))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumns({"_k": F.row_number().over(order), "_sum": F.sum("net_r").over(upto)})
    return rows.withColumn("_top", F.greatest(F.lit(0.0), F.max("_sum").over(upto)))


def equity(trades: DataFrame) -> DataFrame:
    """Running sum of net R and its running peak, in chronological order.

    Dates are summed by themselves and start where the dates before them end, so no window holds
    more than one date's trades, or one row for each date, of a pattern.
    """
    rows = _within_dates(trades)
    days = rows.groupBy(*BY, "session").agg(F.count("*").alias("_n"), F.sum("net_r").alias("_total"), F.max("_top").alias("_high"))
    before = Window.partitionBy(*BY).orderBy("session").rowsBetween(Window.unboundedPreceding, -1)
    starts = days.withColumns({"_first": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_base": F.coalesce(F.sum("_total").over(before), F.lit(0.0))})
    starts = starts.withColumn("_peak", F.coalesce(F.max(F.col("_base") + F.col("_high")).over(before), F.lit(0.0)))
    joined = rows.join(starts.select(*BY, "session", "_first", "_base", "_peak"), [*BY, "session"])
    return joined.select(
        *[trades[c] for c in trades.columns],
        (F.col("_k") + F.col("_first")).cast("int").alias("trade_no"),
        (F.col("_base") + F.col("_sum")).alias("equity_r"),
        F.greatest("_peak", F.col("_base") + F.col("_top")).alias("peak_r"),
    )


def max_drawdown(trades: DataFrame) -> DataFrame:
    """Deepest fall of the equity from its peak, which starts at 0.

    A stretch of trades is summed up by its total, its highest and lowest running sum and its
    deepest fall; two neighbouring stretches combine without their trades. Each date is one
    stretch; a pattern's dates, one row each, are combined in order.
    """
    rows = _within_dates(trades).withColumn("_fall", F.col("_top") - F.col("_sum"))
    days = rows.groupBy(*BY, "session").agg(
        F.sum("net_r").alias("total"), F.max("_top").alias("high"), F.least(F.lit(0.0), F.min("_sum")).alias("low"), F.max("_fall").alias("fall")
    )
    held = F.array_sort(F.collect_list(F.struct("session", "total", "high", "low", "fall")))
    nothing = F.struct(*[F.lit(0.0).alias(c) for c in ("total", "high", "fall")])
    both = lambda a, b: F.struct(
        (a.total + b.total).alias("total"),
        F.greatest(a.high, a.total + b.high).alias("high"),
        F.greatest(a.fall, b.fall, a.high - (a.total + b.low)).alias("fall"),
    )
    return days.groupBy(*BY).agg(F.aggregate(held, nothing, both, lambda x: x.fall).alias("max_drawdown_r"))


def exit_mix(trades: DataFrame) -> DataFrame:
    """Share of each exit reason, as a map."""
    counts = trades.groupBy(*BY, "exit_reason").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*BY))
    rows = counts.withColumn("share", F.col("n") / total)
    pairs = F.sort_array(F.collect_list(F.struct("exit_reason", "share")))
    return rows.groupBy(*BY).agg(F.map_from_entries(pairs).alias("exit_mix"))


def consistency(trades: DataFrame, stats: Stats, unit: tuple[str, ...] = ("symbol", "session")) -> DataFrame:
    """Share of trials, with enough trades each, whose mean is positive; null without any."""
    per = trades.groupBy(*BY, *unit).agg(F.count("*").alias("n"), F.avg("net_r").alias("m"))
    per = per.filter(F.col("n") >= stats.min_trades_per_trial)
    return per.groupBy(*BY).agg(F.avg((F.col("m") > 0).cast("double")).alias("consistency"), F.count("*").alias("trials"))


def stability(trades: DataFrame, stats: Stats) -> DataFrame:
    """Mean of each window with enough trades, and the share of positive ones; null below two windows."""
    per = trades.groupBy(*BY, "window").agg(F.count("*").alias("n"), F.avg("net_r").alias("m")).filter(F.col("n") >= stats.min_trades)
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("window", "m"))))
    good = F.avg((F.col("m") > 0).cast("double"))
    return per.groupBy(*BY).agg(pairs.alias("window_expectancy_r"), F.when(F.count("*") >= 2, good).alias("stability"))


#: Buckets of a session in its own order.
BUCKETS = ("open", "midday", "close", "unknown")


def breakdown(trades: DataFrame, by: str) -> DataFrame:
    """Figures of a pattern's trades by another column, with the share of each exit reason; place orders the groups.

    Times of day come in the session's order, other values in their own.
    """
    rows = trades.groupBy("pattern", by, "exit_reason").agg(
        F.count("*").alias("n"), F.count_if(F.col("net_r") > 0).alias("won"), F.sum("net_r").alias("r")
    )
    found = rows.groupBy("pattern", by).agg(
        F.sum("n").alias("trades"),
        (F.sum("won") / F.sum("n")).alias("win_rate"),
        (F.sum("r") / F.sum("n")).alias("expectancy_r"),
        F.sum("r").alias("total_r"),
        F.array_sort(F.collect_list(F.struct("exit_reason", "n"))).alias("_mix"),
    )
    mix = F.map_from_entries(F.transform("_mix", lambda x: F.struct(x.exit_reason, x.n / F.col("trades"))))
    place = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col(by)) if by == "time_of_day" else F.col(by)
    at = F.row_number().over(Window.partitionBy("pattern").orderBy(F.asc_nulls_last(place))) - 1
    return found.withColumns({"exit_mix": mix, "place": at}).drop("_mix")


def date_totals(trades: DataFrame, dates: DataFrame, value: str = "net_r") -> DataFrame:
    """Sum and count of every (pattern, interval, session), also of dates without a trade.

    Trades on a date that isn't among ``dates`` are an error: their sum would be lost.
    """
    days = dates.select("session").distinct()
    held = trades.groupBy(*BY, "session").agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    known = F.broadcast(days.withColumn("_known", F.lit(True)))  # one row for each date
    held = held.join(known, "session", "left").withColumn(
        "n", F.when(F.col("_known"), F.col("n")).otherwise(F.raise_error(F.concat(F.lit("trades on an unknown date: "), F.col("session").cast("string"))).cast("long"))
    )
    keys = held.groupBy(*BY).agg(F.collect_list(F.struct("session", "total", "n")).alias("held"))
    every = days.agg(F.array_sort(F.collect_list("session")).alias("days"))  # one row
    rows = keys.join(F.broadcast(every)).select(*BY, F.explode("days").alias("session"), F.map_from_entries(F.transform("held", lambda x: F.struct(x.session, F.struct(x.total, x.n)))).alias("m"))
    of = lambda c, none: F.coalesce(F.col("m")[F.col("session")][c], none)
    return rows.select(*BY, "session", of("total", F.lit(0.0)).alias("total"), of("n", F.lit(0).cast("long")).alias("n"))


@dataclass(frozen=True)
class Totals:
    """Sums over each date (rows) of each hypothesis (columns): n and net R of its trades, their gross R, n and gross R of its controls."""

    keys: list[tuple[str, str]]
    dates: list[str]
    sums: np.ndarray
    #: Dates of a hypothesis's controls, and dates that it shares with them.
    control_sessions: np.ndarray
    paired_sessions: np.ndarray


def totals_of(own: DataFrame, control: DataFrame | None, dates: DataFrame) -> Totals:
    """One aggregate of all trades; the driver sees one row for each pattern, interval and date, whatever the bars."""
    one = lambda t, kind: t.groupBy(*BY, "session").agg(
        F.lit(kind).alias("kind"), F.count("*").alias("n"), F.sum("net_r" if "net_r" in t.columns else F.lit(0.0)).alias("net"), F.sum("gross_r" if "gross_r" in t.columns else F.lit(0.0)).alias("gross")
    )
    rows = one(own, "own") if control is None else one(own, "own").unionByName(one(control, "control"))
    held = rows.withColumn("session", F.col("session").cast("string")).toPandas()
    days = sorted(r[0] for r in dates.select(F.col("session").cast("string")).distinct().collect())
    keys = sorted(set(zip(held["pattern"], held["interval"], strict=True)))
    at, day = {k: i for i, k in enumerate(keys)}, {d: i for i, d in enumerate(days)}
    if unknown := set(held["session"]) - set(days):
        raise ValueError(f"trades on an unknown date: {sorted(unknown)[0]}")
    sums = np.zeros((5, len(days), len(keys)))
    for kind, place in (("own", (0, 1, 2)), ("control", (3, None, 4))):
        part = held[held["kind"] == kind]
        row = [day[x] for x in part["session"]]
        column = [at[k] for k in zip(part["pattern"], part["interval"], strict=True)]
        for c, k in zip(("n", "net", "gross"), place, strict=True):
            if k is not None:
                sums[k, row, column] = part[c].astype(float)
    has_own, has_control = sums[0] > 0, sums[3] > 0
    return Totals(keys, days, sums, has_control.sum(0), (has_own & has_control).sum(0))


def weights(ids: list[int], seed: int, days: int) -> np.ndarray:
    """How often each date is drawn, a row for each draw: which date its j-th is follows from (seed, draw, j)."""
    out = np.empty((len(ids), days))
    for i, k in enumerate(ids):
        drawn = [int(hashlib.md5(f"{seed}|{k}|{j}".encode()).hexdigest()[:8], 16) % days for j in range(days)]
        out[i] = np.bincount(drawn, minlength=days)
    return out


def _mean(total: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, total / np.where(n > 0, n, 1.0), np.nan)


def bootstrap_draws(own: DataFrame, dates: DataFrame, samples: int, seed: int) -> DataFrame:
    """Mean of each draw: dates are resampled together for every row, so that rows are comparable.

    A draw takes as many dates as there are. Draws are dealt over tasks, each of which weighs its
    draws' dates once and multiplies them with the sums of all hypotheses.
    """
    spark, t = own.sparkSession, totals_of(own, None, dates)
    kind = "pattern string, interval string, draw long, mean double"
    if not t.keys:
        return spark.createDataFrame([], kind)
    sent = spark.sparkContext.broadcast(t)  # patterns, intervals and dates bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        names = [pa.array([k[i] for k in t.keys], pa.string()) for i in range(len(BY))]
        for batch in batches:
            ids = batch.column("id").to_pylist()
            w = weights(ids, seed, len(t.dates))
            means = _mean(w @ t.sums[1], w @ t.sums[0])
            for k, row in zip(ids, means, strict=True):
                mean = pa.array(row, mask=np.isnan(row))
                yield pa.RecordBatch.from_arrays([*names, pa.array(np.full(len(t.keys), k)), mean], [*BY, "draw", "mean"])

    return spark.range(samples).mapInArrow(run, kind)


EVIDENCE = "pattern string, interval string, ci_low double, ci_high double, p_value double, spread double, delta_r double, delta_low double, delta_high double, delta_p_value double, control_trades long, control_sessions long, paired_sessions long"


def judged(draws: np.ndarray, estimate: float, two_sided: bool) -> tuple[float | None, float | None, float | None, float | None]:
    """(interval's ends, p-value, spread) of an estimate by its draws; None where under 95% of them have a mean.

    The p-value centres the draws on the estimate and counts those at least as extreme, draws
    without a mean and one more against it.
    """
    finite = draws[np.isfinite(draws)]
    if len(finite) < 0.95 * len(draws) or not np.isfinite(estimate):
        return None, None, None, None
    off = finite - estimate
    slack = 1e-12  # equal draws may differ in their last digits
    extreme = np.abs(off) >= abs(estimate) - slack if two_sided else off >= estimate - slack
    against = int(extreme.sum()) + len(draws) - len(finite)
    low, high = np.percentile(finite, [2.5, 97.5])
    return float(low), float(high), (against + 1) / (len(draws) + 1), float(finite.std(ddof=1)) if len(finite) > 1 else None


def tested(totals: Totals, spark: SparkSession, samples: int, seed: int, two_sided: bool = True) -> DataFrame:
    """One row of evidence for each hypothesis: of its expectancy, and of its lead over its controls on the same draws.

    Draws are dealt over tasks; a task returns, for each hypothesis, its draws' means as one
    array, and a hypothesis's arrays meet where it is judged: ``samples`` numbers each.
    """
    if not totals.keys:
        return spark.createDataFrame([], EVIDENCE)
    sent = spark.sparkContext.broadcast(totals)  # patterns, intervals and dates bound it

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for batch in batches:
            w = weights(batch.column("id").to_pylist(), seed, len(t.dates))
            n, net, gross, other_n, other = (w @ x for x in t.sums)
            own, lead = _mean(net, n), _mean(gross, n) - _mean(other, other_n)
            cols = [pa.array(range(len(t.keys)), pa.int32()), *[pa.array([x[:, k].tobytes() for k in range(len(t.keys))], pa.binary()) for x in (own, lead)]]
            yield pa.RecordBatch.from_arrays(cols, ["k", "own", "lead"])

    shape = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[k]) for n, k in (x.split() for x in EVIDENCE.split(", "))])

    def concluded(table: pa.Table) -> pa.Table:
        t, k = sent.value, table.column("k")[0].as_py()
        own, lead = (np.frombuffer(b"".join(table.column(c).to_pylist()), float) for c in ("own", "lead"))
        n, net, gross, other_n, other = t.sums[:, :, k].sum(1)
        delta = gross / n - other / other_n if n and other_n else np.nan
        row = [*t.keys[k], *judged(own, net / n if n else np.nan, two_sided), float(delta) if np.isfinite(delta) else None]
        row += [*judged(lead, delta, False)[:3], int(other_n), int(t.control_sessions[k]), int(t.paired_sessions[k])]
        return pa.Table.from_pylist([dict(zip(shape.names, row, strict=True))], shape)

    parts = max(1, min(samples // 500, spark.sparkContext.defaultParallelism))
    return spark.range(0, samples, 1, parts).mapInArrow(drawn, "k int, own binary, lead binary").groupBy("k").applyInArrow(concluded, EVIDENCE)


def holm(rows: DataFrame, stats: Stats, p: str = "p_value", family: int | None = None) -> DataFrame:
    """Add p_adjusted. A row without a p-value still counts, as 1; a family may be larger than the rows, never smaller."""
    order = Window.orderBy(F.coalesce(p, F.lit(1.0)), *BY)  # one row for each hypothesis
    size = F.greatest(F.count("*").over(Window.partitionBy()), F.lit(family or 0))
    rows = rows.withColumns({"_k": F.row_number().over(order), "_m": size})
    step = (F.col("_m") - F.col("_k") + 1) * F.coalesce(p, F.lit(1.0)) * stats.experiment_count
    upto = F.max(step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), upto))
    return rows.withColumn("p_adjusted", adjusted).drop("_k", "_m")


def one_family(rows: DataFrame, stats: Stats) -> DataFrame:
    """Add p_adjusted and delta_p_adjusted of p_value and delta_p_value: every row's tests are one family, controls have no delta."""
    own = F.struct(F.lit("own").alias("test"), F.col("p_value").alias("p"))
    delta = F.struct(F.lit("delta").alias("test"), F.col("delta_p_value").alias("p"))
    asked = F.when(F.col("kind") == "control", F.array(own)).otherwise(F.array(own, delta))
    both = rows.select(*BY, F.struct(*rows.columns).alias("row"), F.explode(asked).alias("t")).select("*", "t.test", F.col("t.p").alias("p_value"))
    by_test = lambda t: F.max(F.when(F.col("test") == t, F.col("p_adjusted")))
    adjusted = holm(both, stats).groupBy(*BY).agg(
        F.any_value("row").alias("row"), by_test("own").alias("p_adjusted"), by_test("delta").alias("delta_p_adjusted")
    )
    return adjusted.select("row.*", "p_adjusted", "delta_p_adjusted")


def inferred(
    rows: DataFrame, own: DataFrame, control: DataFrame, dates: DataFrame, stats: Stats, seed: int, two_sided: bool = True, common: int | None = None
) -> DataFrame:
    """Add evidence, comparison with the controls and verdict to statistics with kind, trades, sessions and both expectancies.

    Net R is tested for the expectancy, gross R for the lead over the controls, all on the same
    draws of dates. A test needs min_trades trades and min_sessions dates, the comparison also
    of the controls and in common (common: that number if it isn't min_sessions).
    """
    floor = max(2, stats.min_sessions)
    common = floor if common is None else common
    found = tested(totals_of(own, control, dates), rows.sparkSession, stats.bootstrap_samples, seed, two_sided)
    rows = rows.join(found, BY, "left")
    dated, of_pattern = F.col("sessions") >= floor, F.col("kind") != "control"
    enough = dated & (F.col("trades") >= stats.min_trades)
    paired = enough & of_pattern & (F.col("control_trades") >= stats.min_trades) & (F.col("control_sessions") >= common) & (F.col("paired_sessions") >= common)
    gates = {c: F.when(dated, F.col(c)) for c in ("ci_low", "ci_high")} | {"p_value": F.when(enough, F.col("p_value"))}
    gates |= {c: F.when(paired, F.col(c)) for c in ("delta_low", "delta_high", "delta_p_value")} | {"delta_r": F.when(of_pattern, F.col("delta_r"))}
    rows = one_family(rows.withColumns(gates).drop("control_trades"), stats)
    return rows.withColumn("verdict", verdict(stats, F.col("kind") == "control"))


def minimum_detectable(stats: Stats, hypotheses: int, sides: int = 2) -> float | None:
    """Standard errors that an effect must have to be found four times of five; None when draws are too few."""
    level = stats.alpha / (hypotheses * stats.experiment_count)
    if hypotheses * stats.experiment_count / (stats.bootstrap_samples + 1) > stats.alpha:
        return None
    return NormalDist().inv_cdf(1 - level / sides) + NormalDist().inv_cdf(0.8)


def resolution(stats: Stats, hypotheses: int) -> tuple[float, int]:
    """Least adjusted p-value that the draws can give, and the draws needed for it to reach the level."""
    tests = hypotheses * stats.experiment_count
    return tests / (stats.bootstrap_samples + 1), int(tests / stats.alpha)


def verdict(stats: Stats, control: Column) -> Column:
    """From trades, sessions, ci_low, ci_high, p_adjusted, delta_low and delta_p_adjusted."""
    a = F.lit(stats.alpha)
    return (
        F.when((F.col("trades") < stats.min_trades) | (F.col("sessions") < stats.min_sessions) | F.col("ci_low").isNull(), "INSUFFICIENT")
        .when((F.col("ci_high") < 0) & (F.col("p_adjusted") <= a), "NEGATIVE")
        .when(control, "NOISE")
        .when(F.col("delta_low").isNull(), "INSUFFICIENT")
        .when((F.col("ci_low") > 0) & (F.col("delta_low") > 0) & (F.col("p_adjusted") <= a) & (F.col("delta_p_adjusted") <= a), "EDGE")
        .otherwise("NOISE")
    )


def confirmed(discovery: DataFrame, validation: DataFrame) -> DataFrame:
    """An edge of discovery stays one only if validation finds it too; other verdicts stay. Both verdicts stay beside it."""
    later = validation.select(*BY, F.col("verdict").alias("validation_verdict"))
    rows = discovery.join(later, BY, "left")
    lost = (F.col("verdict") == "EDGE") & (F.coalesce("validation_verdict", F.lit("")) != "EDGE")
    return rows.withColumns({"discovery_verdict": F.col("verdict"), "verdict": F.when(lost, "NOISE").otherwise(F.col("verdict"))})


def ranked(rows: DataFrame, stats: Stats) -> DataFrame:
    """Add rank: measurable rows first, then by the chosen figure, win rate and name."""
    value = F.col(stats.rank_by)
    measured = value.isNotNull() & (F.coalesce("verdict", F.lit("")) != "INSUFFICIENT")
    order = Window.orderBy(measured.cast("int").desc(), value.desc_nulls_last(), F.desc_nulls_last("win_rate"), *BY)
    return rows.withColumn("rank", F.row_number().over(order))
