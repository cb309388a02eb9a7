"""Drill-down over stored trades: filters, pages, curves and comparisons."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalforge.config import Thresholds
from signalforge.functions.geometry import BASE, LAGGED, LAGS, OVER, with_sql
from signalforge.operators.metrics import equity
from signalforge.operators.patterns import CONTROLS, REGISTRY
from signalforge.sources.bars import KEY

FILTERS = ("pattern", "interval", "symbol", "sample", "matched", "session", "exit_reason")
SORTS = ("session", "net_r", "gross_r", "return_pct", "bars_held", "entry_index", "symbol", "pattern")
ORDER = ["session", "pattern", "interval", "symbol", "entry_index"]
MOST_ROWS = 500


def chosen(trades: DataFrame, where: dict) -> DataFrame:
    """Trades that match; matched controls only where they are asked for, a None keeps both."""
    unknown = [k for k in where if k not in FILTERS]
    if unknown:
        raise ValueError(f"unknown filter: {unknown[0]}")
    if "matched" in trades.columns:
        where = {"matched": False} | where
    for k, v in where.items():
        if v is not None or k != "matched":
            trades = trades.filter(F.col(k) == v)
    return trades


def page(trades: DataFrame, where: dict, sort: str = "session", descending: bool = False, offset: int = 0, limit: int = 200) -> DataFrame:
    """One page of the trades that match; ties keep the stored order, nulls come last either way.

    A page has ``MOST_ROWS`` at most; ``counted_page`` says how many trades there are.
    """
    if sort not in SORTS:
        raise ValueError(f"unknown sort: {sort}")
    key = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return chosen(trades, where).orderBy(key, *ORDER).offset(offset).limit(min(limit, MOST_ROWS))


def counted_page(trades: DataFrame, where: dict, *args, **kwargs) -> DataFrame:
    """A page with the number of all trades that match beside each row."""
    total = chosen(trades, where).agg(F.count("*").alias("total"))
    return page(trades, where, *args, **kwargs).join(F.broadcast(total))  # one row


def report_order(trades: DataFrame) -> DataFrame:
    """Trades as a report lists them: by sample, pattern, interval, trial and entry."""
    return trades.orderBy(*[c for c in ("sample", "pattern", "interval", "trial_index", "symbol", "session", "entry_index") if c in trades.columns])


def top_symbols(trades: DataFrame, n: int = 12) -> DataFrame:
    return trades.groupBy("symbol").agg(F.count("*").alias("trades")).orderBy(F.desc("trades"), "symbol").limit(n)


def curve(trades: DataFrame, points: int) -> DataFrame:
    """Equity curve thinned to about so many points, the last always among them."""
    rows = equity(trades)
    last = F.max("trade_no").over(Window.partitionBy("pattern", "interval"))
    step = F.greatest(F.lit(1), F.ceil(last / points))
    rows = rows.withColumns({"_last": last, "_step": step})
    kept = rows.filter(((F.col("trade_no") - 1) % F.col("_step") == 0) | (F.col("trade_no") == F.col("_last")))
    return kept.select("pattern", "interval", "trade_no", "session", "equity_r")


def compared(before: DataFrame, after: DataFrame, figures: list[str]) -> DataFrame:
    """Figures of two runs side by side, with their differences, for rows that both have.

    Where both have verdicts, they and whether they differ come too; the largest change of the
    first figure comes first, in either direction.
    """
    by = ["pattern", "interval"]
    told = ["verdict"] if "verdict" in before.columns and "verdict" in after.columns else []
    of = lambda df, end: df.select(*by, *[F.col(f).alias(f"{f}_{end}") for f in (*figures, *told)])
    rows = of(before, "before").join(of(after, "after"), by)
    rows = rows.withColumns({f"{f}_delta": F.col(f"{f}_after") - F.col(f"{f}_before") for f in figures})
    if told:
        rows = rows.withColumn("flipped", ~F.col("verdict_before").eqNullSafe(F.col("verdict_after")))
    return rows.orderBy(F.desc_nulls_last(F.abs(f"{figures[0]}_delta")), *by)


def losing_controls(rows: DataFrame) -> DataFrame:
    """(interval, losing_controls, cost_dominated): random entries with evidence of losses, which costs then outweigh."""
    lost = F.when((F.col("kind") == "control") & (F.col("verdict") == "NEGATIVE"), F.col("pattern"))
    return rows.groupBy("interval").agg(F.array_sort(F.collect_set(lost)).alias("losing_controls"), F.max(lost.isNotNull()).alias("cost_dominated"))


def comparison_curve(trades: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The curve that each pattern's equity is drawn against, and its kind; random entries have none.

    A pattern's own matched controls where the run stored them, else the random entries of its direction.
    """
    patterns = [REGISTRY[n] for n in names or REGISTRY]
    rows = trades.filter(F.col("pattern").isin([p.name for p in patterns]) & F.col("matched"))
    of = {p.name: next(c.name for c in CONTROLS.values() if c.direction == p.direction) for p in patterns}
    pairs = trades.sparkSession.createDataFrame(list(of.items()), "own string, pattern string")
    alone = pairs.join(rows.select(F.col("pattern").alias("own")).distinct(), "own", "left_anti")
    other = trades.filter(~F.col("matched")).join(F.broadcast(alone), "pattern")  # one row for each pattern
    other = other.withColumn("pattern", F.col("own")).drop("own")
    both = rows.withColumn("kind", F.lit("matched")).unionByName(other.withColumn("kind", F.lit("reference")))
    return equity(both).select("pattern", "interval", "kind", "session", "trade_no", "equity_r", "peak_r")


def session_view(bars: DataFrame, trades: DataFrame | None, runs: dict[str, tuple[Thresholds, dict[str, int]]], pattern: str) -> DataFrame:
    """Bars of sessions, once for each run, with the bars that the pattern signals and the trades that the run entered there.

    Signals are found anew with each run's own thresholds and lookbacks, which are parameters
    beside the bars, so all runs are one plan; a run without a lookback for an interval takes
    the one that fits the session. A session too short for its run has none. Trades (with a
    column run) are those stored, never made anew. Filter bars to the sessions to be shown.
    """
    p, spark = REGISTRY[pattern], bars.sparkSession
    names = [f.name for f in fields(Thresholds)]
    longest = max(x.bars for x in REGISTRY.values())
    rows = [(r, {k: int(v) for k, v in looks.items()}, *[float(getattr(t, n)) for n in names]) for r, (t, looks) in runs.items()]
    params = spark.createDataFrame(rows, "run string, _looks map<string,int>, " + ", ".join(f"_t_{n} double" for n in names))
    shown = bars.select(*KEY, "bar_idx", "minute", "open", "high", "low", "close", "volume").join(F.broadcast(params))  # one row for each run
    shown = shown.withColumns({"_symbol": F.col("symbol"), "symbol": F.concat_ws("\u0001", "run", "symbol")})  # each run's sessions are windows of their own
    fits = f"least(CAST(_t_trend_lookback AS INT), greatest(2, CAST(count(*) OVER (PARTITION BY {', '.join(KEY)}) AS INT) - {longest} - 5))"
    shown = with_sql(shown, {"lookback": f"coalesce(_looks[interval], {fits})", "measured": f"count(*) OVER (PARTITION BY {', '.join(KEY)}) >= coalesce(_looks[interval], {fits}) + 4"})
    lags = {f"{c}{k}": f"lag({c}, {k}) {OVER}" for k in range(1, LAGS + 1) for c in LAGGED}
    shown = with_sql(with_sql(shown, BASE), lags | {"_upto": f"collect_list(c) {OVER[:-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})
    tail = "slice(_upto, -lookback, lookback)"
    rise = f"aggregate(transform({tail}, (x, k) -> (k - (lookback - 1) / 2D) * (x - element_at(_upto, -lookback))), 0D, (t, x) -> t + x)"
    norm = "aggregate(transform(sequence(1, lookback), k -> pow(k - (lookback + 1) / 2D, 2)), 0D, (t, x) -> t + x)"
    share = f"{rise} / {norm} / IF(_t_trend_min_slope > 0, aggregate({tail}, 0D, (t, x) -> t + x) / lookback, 1D)"
    shown = with_sql(shown, {"_share": f"CASE WHEN size(_upto) >= lookback THEN {share} END"})
    least = "_t_trend_min_slope"
    shown = with_sql(shown, {"trend": f"CASE WHEN _share > 0 AND _share >= {least} THEN 1 WHEN _share < 0 AND _share <= -{least} THEN -1 ELSE 0 END"})
    rule = p.rule.format(**{n: f"_t_{n}" for n in names}) if isinstance(p.rule, str) else None
    if rule is None:
        raise ValueError(f"{pattern} isn't written as SQL, so its thresholds can't vary by run")
    gate = f"bar_idx >= {p.bars - 1} + lookback" + (f" AND lag(trend, {p.bars}) {OVER} = {p.trend}" if p.trend else "")
    shown = with_sql(shown, {"signal": f"measured AND coalesce(({rule}) AND {gate}, false)", "symbol": "_symbol"})
    out = shown.select("run", *KEY, "bar_idx", "minute", "open", "high", "low", "close", "volume", "lookback", "measured", "signal")
    if trades is None:
        return out
    mark = [c for c in ("direction", "exit_index", "exit_reason", "entry_price", "exit_price", "stop", "target", "net_r") if c in trades.columns]
    marks = chosen(trades, {"pattern": pattern}).groupBy("run", *KEY, F.col("entry_index").alias("bar_idx")).agg(F.array_sort(F.collect_list(F.struct(*mark))).alias("trades"))
    return out.join(marks, ["run", *KEY, "bar_idx"], "left")


def without_prices(trades: DataFrame) -> DataFrame:
    """Trades without the columns that prices could be read from."""
    hidden = ("entry_price", "exit_price", "stop_price", "target_price", "risk_per_share", "return_pct")
    return trades.withColumns({c: F.lit(None).cast("double") for c in hidden if c in trades.columns})
