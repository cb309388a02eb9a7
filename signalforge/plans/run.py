"""Whole runs: discovery, selection and confirmation on dates that were not chosen on."""

from __future__ import annotations

import math
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalforge.config import ALL, INTERVALS, Config
from signalforge.operators import costs, metrics, patterns, sampling, trades
from signalforge.operators.patterns import CONTROLS, REGISTRY, catalogue
from signalforge.plans.store import Scratch, settled
from signalforge.sources.bars import KEY


def grid(spark, intervals: list[str], names: list[str] | None = None, controls: bool = False) -> DataFrame:
    """One row for each pattern and interval, with its kind: statistics are joined to it, so that none is lost."""
    chosen = catalogue(names or list(REGISTRY))
    chosen += [(p.name, p.bias, p.direction, p.bars, p.trend, p.kind) for p in CONTROLS.values()] if controls else []
    rows = [(p, i, kind) for p, *_, kind in chosen for i in intervals]
    return spark.createDataFrame(rows, "pattern string, interval string, kind string")


def fitted(bars: DataFrame, config: Config) -> dict[str, int]:
    """The trend's lookback on each interval that the bars have, narrowest first."""
    rows = sampling.trend_lookback(bars, config.thresholds.trend_lookback).collect()  # one row for each interval
    return {r["interval"]: r["trend_lookback"] for r in sorted(rows, key=lambda r: INTERVALS.get(r["interval"], math.inf))}


def own_trades(
    bars: DataFrame, config: Config, lookbacks: dict[str, int], names: list[str] | None = None, bar_costs: DataFrame | None = None
) -> DataFrame:
    """Trades of every interval, each with its own lookback."""
    found = [
        trades.trades(bars.filter(F.col("interval") == i), replace(config.thresholds, trend_lookback=k), config.trade, config.costs, names, bar_costs)
        for i, k in lookbacks.items()
    ]
    return reduce(DataFrame.unionByName, found)


def of_trials(rows: DataFrame, trials: DataFrame | None) -> DataFrame:
    """Rows of a session once for each trial that drew it, with what the trial stamps on them."""
    if trials is None:
        return rows
    return rows.join(trials.select("symbol", "session", "trial_index", F.col("seed").alias("trial_seed"), "window", "sample"), ["symbol", "session"])


def control_trades(
    bars: DataFrame,
    config: Config,
    lookbacks: dict[str, int],
    names: list[str] | None = None,
    bar_costs: DataFrame | None = None,
    trials: DataFrame | None = None,
) -> DataFrame:
    """Trades of random entries, long and short, as often in each session as the most frequent pattern there."""
    found = []
    for i, k in lookbacks.items():
        own = bars.filter(F.col("interval") == i)
        masked = patterns.masks(own, replace(config.thresholds, trend_lookback=k), names)
        rates = of_trials(sampling.matched_rate(masked, list(names or REGISTRY), k), trials)
        at = [
            sampling.control_mask(own, rates, k, config.run.seed, p.name).withColumn("direction", F.lit(p.direction)) for p in CONTROLS.values()
        ]
        rows = trades.entries_at(own, reduce(DataFrame.unionByName, at), config.trade)
        rows = trades.net(trades.exits(rows, own, config.trade), config.trade, config.costs, bar_costs)
        found.append(rows if config.trade.allow_overlapping_trades else trades.without_overlap(rows))
    return reduce(DataFrame.unionByName, found)


def estimated_costs(bars: DataFrame, config: Config) -> DataFrame:
    """(symbol, interval, session, bar_idx, cost): half the session's spread, estimated once from its narrowest interval's highs and lows."""
    return bars.select(*KEY, "bar_idx").join(costs.estimated(bars, config.costs).select("symbol", "session", "cost"), ["symbol", "session"])


def quoted_costs(bars: DataFrame, quotes: DataFrame, config: Config) -> DataFrame:
    """(symbol, interval, session, bar_idx, cost) from quotes; bars have their minute since the open."""
    return costs.priced(bars, costs.quote_table(quotes), config.costs).select(*KEY, "bar_idx", "cost")


def traded(
    bars: DataFrame,
    config: Config,
    names: list[str] | None,
    lookbacks: dict[str, int],
    bar_costs: DataFrame | None,
    trials: DataFrame | None,
    scratch: Scratch,
) -> tuple[DataFrame, DataFrame]:
    """(trades of patterns and random controls, matched controls of the patterns), stored: statistics read them several times."""
    own = scratch.put(of_trials(own_trades(bars, config, lookbacks, names, bar_costs), trials))
    control = trades.net(trades.matched(own, bars, config.trade, config.run.seed), config.trade, config.costs, bar_costs)
    random = control_trades(bars, config, lookbacks, names, bar_costs, trials)
    return own.unionByName(scratch.put(random)), scratch.put(control)


def measured(
    bars: DataFrame,
    config: Config,
    names: list[str] | None = None,
    selected: DataFrame | None = None,
    lookbacks: dict[str, int] | None = None,
    bar_costs: DataFrame | None = None,
    trials: DataFrame | None = None,
) -> DataFrame:
    """Statistics, evidence, comparison with matched controls and verdict of every pattern, on each interval and all.

    Random entries are measured beside the patterns, as controls. Lookbacks are fitted to the
    bars where none are given. selected: the (pattern, interval) whose trades count; the others
    stay rows, and hypotheses of the family, without trades. The result is settled: one row for
    each pattern and interval, made once.
    """
    lookbacks = lookbacks or fitted(bars, config)
    with Scratch(bars.sparkSession) as scratch:
        own, control = (metrics.pooled(x) for x in traded(bars, config, names, lookbacks, bar_costs, trials, scratch))
        if selected is not None:
            few = F.broadcast(selected)  # at most one row for each pattern and interval
            own, control = (x.join(few, metrics.BY, "left_semi") for x in (own, control))
        rows = metrics.summarise(own, grid(bars.sparkSession, [*lookbacks, ALL], names, controls=True))
        unit = ("trial_index",) if trials is not None else ("symbol", "session")
        more = [metrics.max_drawdown(own), metrics.consistency(own, config.stats, unit), metrics.exit_mix(own)]
        more += [metrics.stability(own, config.stats)] if trials is not None else []
        rows = reduce(lambda a, b: a.join(b, metrics.BY, "left"), more, rows)  # one row for each pattern and interval
        return settled(metrics.inferred(rows, own, control, bars.select("session"), config.stats, config.run.seed))


def run(bars: DataFrame, config: Config, names: list[str] | None = None, bar_costs: DataFrame | None = None) -> DataFrame:
    """Ranked statistics of the drawn trials; an edge counts only if the held-out dates show it too.

    Discovery fits the lookbacks, validation takes them, and with them the whole family of hypotheses.
    """
    with Scratch(bars.sparkSession) as scratch:
        pool = sampling.session_pool(bars.filter(F.col("session") <= F.lit(config.run.end_date)) if config.run.end_date else bars)
        trials = scratch.put(sampling.draw_trials(pool, config.run))
        drawn = scratch.put(bars.join(trials.select("symbol", "session", "sample").distinct(), ["symbol", "session"]))
        parts = {s: (drawn.filter(F.col("sample") == s).drop("sample"), trials.filter(F.col("sample") == s)) for s in ("discovery", "validation")}
        lookbacks = fitted(parts["discovery"][0], config)
        if not lookbacks:
            raise ValueError("there are no bars to measure")
        own_costs = bar_costs if bar_costs is None else scratch.put(bar_costs.join(trials.select("symbol", "session").distinct(), ["symbol", "session"], "left_semi"))
        of = lambda s, chosen: measured(sampling.trial_bars(parts[s][0], parts[s][1], lookbacks), config, names, chosen, lookbacks, own_costs, parts[s][1])
        found = of("discovery", None)
        edges = found.filter((F.col("verdict") == "EDGE") & (F.col("kind") == "pattern")).select("pattern", "interval")
        if config.run.holdout_fraction and not edges.isEmpty():
            found = metrics.confirmed(found, of("validation", edges))
        return metrics.ranked(found, config.stats)


def segments(days: list, folds: int) -> list[tuple[list, list]]:
    """(dates before, own dates) of each fold: the first two fifths of the dates are only ever looked back on."""
    first = -(-len(days) * 2 // 5)
    if folds < 1 or first < 2 or len(days) - first < folds:
        raise ValueError(f"{len(days)} dates are too few for {folds} folds")
    cuts = [first + round((len(days) - first) * k / folds) for k in range(folds + 1)]
    return [(days[:a], days[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def walk_forward(
    bars: DataFrame, config: Config, folds: int, names: list[str] | None = None, bar_costs: DataFrame | None = None, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """(trades, matched controls) out of sample: patterns chosen on all dates before a fold, traded on its own.

    scratch keeps the folds' trades until it is closed; without one they are made anew when read.
    """
    days = [r["session"] for r in bars.select("session").distinct().orderBy("session").collect()]  # one row for each date
    own, control = [], []
    for k, (past, now) in enumerate(segments(days, folds)):
        fold = replace(config, run=replace(config.run, seed=config.run.seed + k, holdout_fraction=0.0))
        before = bars.filter(F.col("session") <= past[-1])
        lookbacks = fitted(before, fold)
        chosen = measured(sampling.trial_bars(before, before, lookbacks), fold, names, None, lookbacks, bar_costs)
        edges = chosen.filter((F.col("verdict") == "EDGE") & (F.col("kind") == "pattern")).select(*metrics.BY)
        test = bars.filter(F.col("session").between(now[0], now[-1]))
        test = sampling.trial_bars(test, test, lookbacks)
        rows = own_trades(test, fold, lookbacks, names, bar_costs)
        few = edges.withColumnRenamed("interval", "on")  # at most one row for each pattern and interval
        rows = _chosen(rows, few).withColumn("fold", F.lit(k))
        rows = scratch.put(rows) if scratch else rows
        matched = trades.net(trades.matched(rows, test, fold.trade, fold.run.seed), fold.trade, fold.costs, bar_costs).withColumn("fold", F.lit(k))
        own.append(rows)
        control.append(scratch.put(matched) if scratch else matched)
    return reduce(DataFrame.unionByName, own), reduce(DataFrame.unionByName, control)


def _chosen(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of the edges (pattern, on); an edge on ``all`` takes every interval."""
    fits = (rows["pattern"] == edges["pattern"]) & ((edges["on"] == ALL) | (rows["interval"] == edges["on"]))
    return rows.join(F.broadcast(edges), fits, "left_semi")


def walk_forward_test(own: DataFrame, control: DataFrame, config: Config) -> DataFrame:
    """One row: the pooled trades' expectancy, and their lead over the controls, each tested one-sided, both as one family.

    Null figures where there are too few dates or no controls.
    """
    name = {"pattern": F.lit("walk_forward"), "interval": F.lit(ALL)}
    own, control = own.withColumns(name), control.withColumns(name)
    dates = own.select("session").union(control.select("session")).distinct()
    rows = own.groupBy(*metrics.BY).agg(
        F.count("*").alias("trades"), F.count_distinct("session").alias("sessions"), F.avg("net_r").alias("expectancy_r"), F.avg("gross_r").alias("gross_expectancy_r")
    )
    loose = replace(config.stats, min_trades=1)
    rows = metrics.inferred(rows.withColumn("kind", F.lit("pattern")), own, control, dates, loose, config.run.seed, two_sided=False, common=1)
    good = (F.col("expectancy_r") > 0) & (F.col("delta_r") > 0) & (F.col("p_adjusted") <= config.stats.alpha) & (F.col("delta_p_adjusted") <= config.stats.alpha)
    figures = ["trades", "sessions", "expectancy_r", "ci_low", "ci_high", "p_value", "p_adjusted", "delta_r", "delta_low", "delta_p_value", "delta_p_adjusted"]
    return rows.select(*figures, F.coalesce(good, F.lit(False)).alias("confirmed"))
