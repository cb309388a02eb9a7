"""From signals to trades: entries, stops, exits, costs, non-overlap and matched controls.

An exit depends on its entry, its levels and the bars that the trade may be held, so each entry
brings those bars along as an array, from the window that its own bar lies in, and looks for the
first touch there: no trade meets more bars than it may be held. Only the choice among
overlapping trades is sequential; it is a fold over the candidates of one pattern and session.

Rows may carry a trial (trial_index, trial_seed): several trials of one session are traded each
by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalforge.config import Costs, Thresholds, TradeRules
from signalforge.operators.patterns import REGISTRY, fired, masks
from signalforge.operators.sampling import TRIAL
from signalforge.sources.bars import KEY, in_order

#: Bars held up to which each bar carries those ahead of it; longer trades look into their session's bars.
SHORT = 64


def _trial(df: DataFrame) -> list[str]:
    return [c for c in TRIAL if c in df.columns]


def _bar() -> Column:
    return F.struct(F.col("bar_idx").alias("i"), "open", "high", "low", "close")


def bars_ahead(bars: DataFrame, rules: TradeRules) -> DataFrame:
    """(KEY, entry_index, ahead): the bars that a trade entered at each bar may be held."""
    if rules.max_hold_bars <= SHORT:
        ahead = F.collect_list(_bar()).over(in_order().rowsBetween(0, rules.max_hold_bars - 1))
        return bars.select(*KEY, F.col("bar_idx").alias("entry_index"), ahead.alias("ahead"))
    whole = bars.groupBy(*KEY).agg(F.array_sort(F.collect_list(_bar())).alias("all"))  # one session's bars
    rows = whole.select(*KEY, "all", F.explode("all.i").alias("entry_index"))
    return rows.select(*KEY, "entry_index", F.filter("all", lambda x: x.i.between(F.col("entry_index"), F.col("entry_index") + (rules.max_hold_bars - 1))).alias("ahead"))


def entries(bars: DataFrame, t: Thresholds, rules: TradeRules, names: list[str] | None = None) -> DataFrame:
    """Candidate trades: entry at the next open, stop beyond the pattern's extreme, target a multiple of the risk."""
    chosen = [REGISTRY[n] for n in names or REGISTRY]
    w = in_order()
    ahead = {"next_open": F.lead("o").over(w), "bars_in_session": F.count("*").over(Window.partitionBy(*KEY))}
    ahead |= {"entry_minute": F.lead("minute").over(w)} if "minute" in bars.columns else {}
    if rules.max_hold_bars <= SHORT:
        ahead["ahead"] = F.collect_list(_bar()).over(w.rowsBetween(1, rules.max_hold_bars))
    carried = [c for c in ("entry_minute", "ahead") if c in ahead]
    side = lambda p: f"_x{p.bars}_{'up' if p.direction > 0 else 'down'}"
    reach = {side(p): (F.min("l") if p.direction > 0 else F.max("h")).over(w.rowsBetween(-(p.bars - 1), 0)) for p in chosen}
    rows = masks(bars, t, [p.name for p in chosen]).withColumns(ahead | reach).filter(F.col("next_open").isNotNull())
    found = fired({p.name: f"named_struct('pattern', '{p.name}', 'direction', {p.direction}, 'extreme', {side(p)})" for p in chosen})
    rows = rows.withColumn("s", F.explode(F.expr(found))).select(
        *KEY, "bars_in_session", "s.*", (F.col("bar_idx") + 1).alias("entry_index"), F.col("next_open").alias("entry"), *carried
    )
    stop = F.col("extreme") * (1 - F.col("direction") * F.lit(rules.stop_buffer))
    return with_levels(rows.withColumn("stop", stop).drop("extreme"), rules)


def entries_at(bars: DataFrame, signals: DataFrame, rules: TradeRules) -> DataFrame:
    """Candidate trades of signals given as KEY, pattern, direction, bar_idx: the stop lies beyond the signal's own bar."""
    w = in_order()
    ahead = {"next_open": F.lead("open").over(w), "bars_in_session": F.count("*").over(Window.partitionBy(*KEY))}
    clock = {"entry_minute": F.lead("minute").over(w)} if "minute" in bars.columns else {}
    rows = bars.select(*KEY, "bar_idx", "open", "high", "low", *(["minute"] if clock else [])).withColumns(ahead | clock)
    rows = rows.join(signals, [*KEY, "bar_idx"]).filter(F.col("next_open").isNotNull())
    extreme = F.when(F.col("direction") > 0, F.col("low")).otherwise(F.col("high"))
    rows = rows.select(
        *KEY,
        *_trial(signals),
        "bars_in_session",
        "pattern",
        "direction",
        (F.col("bar_idx") + 1).alias("entry_index"),
        *clock,
        F.col("next_open").alias("entry"),
        (extreme * (1 - F.col("direction") * F.lit(rules.stop_buffer))).alias("stop"),
    )
    return with_levels(rows, rules)


def with_levels(rows: DataFrame, rules: TradeRules) -> DataFrame:
    """Add risk and target; drop trades whose risk is not positive or too small."""
    rows = rows.withColumn("risk", F.col("direction") * (F.col("entry") - F.col("stop")))
    rows = rows.filter((F.col("risk") > 0) & (F.col("risk") / F.col("entry") >= rules.min_risk_pct))
    target = F.col("entry") + F.col("direction") * F.col("risk") * F.lit(rules.reward_multiple)
    last = F.least(F.col("entry_index") + (rules.max_hold_bars - 1), F.col("bars_in_session") - 1)
    return rows.withColumns({"target": target, "last_index": last})


def exits(rows: DataFrame, bars: DataFrame, rules: TradeRules) -> DataFrame:
    """Add exit_index, exit and exit_reason: the first bar that touches a level, or the last one held.

    Where one bar touches both, the stop counts, unless the bar opened beyond the target. A
    level is filled at the open when the bar opened beyond it.
    """
    if "ahead" not in rows.columns:
        rows = rows.join(bars_ahead(bars, rules), [*KEY, "entry_index"])
    long, stop, target = F.col("direction") > 0, F.col("stop"), F.col("target")
    stopped = lambda x: F.when(long, x.low <= stop).otherwise(x.high >= stop)
    reached = lambda x: F.when(long, x.high >= target).otherwise(x.low <= target)
    rows = rows.withColumns({"_first": F.try_element_at(F.filter("ahead", lambda x: stopped(x) | reached(x)), F.lit(1)), "_last": F.element_at("ahead", -1)})
    x = F.col("_first")
    first_open = x["open"]
    beyond = F.when(long, first_open >= target).otherwise(first_open <= target)
    won = F.when(long, x["high"] >= target).otherwise(x["low"] <= target) & (~F.when(long, x["low"] <= stop).otherwise(x["high"] >= stop) | beyond)
    at_target = F.when(long, F.greatest(target, first_open)).otherwise(F.least(target, first_open))
    at_stop = F.when(long, F.least(stop, first_open)).otherwise(F.greatest(stop, first_open))
    held = F.col("entry_index") + (rules.max_hold_bars - 1) <= F.col("bars_in_session") - 1
    late = F.when(held, F.lit("timeout")).otherwise(F.lit("session_end"))
    return rows.withColumns(
        {
            "exit_index": F.coalesce(x["i"], F.col("_last")["i"]),
            "exit": F.when(x.isNull(), F.col("_last")["close"]).when(won, at_target).otherwise(at_stop),
            "exit_reason": F.when(x.isNull(), late).when(won, F.lit("target")).otherwise(F.lit("stop")),
        }
    ).drop("ahead", "_first", "_last")


def net(rows: DataFrame, rules: TradeRules, costs: Costs, bar_costs: DataFrame | None = None) -> DataFrame:
    """Add R, returns and costs. bar_costs: KEY, bar_idx, cost as a share of the price; else the fixed slippage."""
    fixed = F.lit(costs.slippage_bps / 1e4)
    rows = rows.withColumns({"cost_in": fixed, "cost_out": fixed})
    if bar_costs is not None:
        a = bar_costs.select(*KEY, F.col("bar_idx").alias("entry_index"), F.col("cost").alias("_a"))
        b = bar_costs.select(*KEY, F.col("bar_idx").alias("exit_index"), F.col("cost").alias("_b"))
        rows = rows.join(a, [*KEY, "entry_index"], "left").join(b, [*KEY, "exit_index"], "left")
        rows = rows.withColumns({"cost_in": F.coalesce("_a", "cost_in"), "cost_out": F.coalesce("_b", "cost_out")}).drop("_a", "_b")
    d, risk = F.col("direction"), F.col("risk")
    paid = F.lit(costs.commission / rules.risk_per_trade_usd)
    rows = rows.withColumns(
        {
            "entry_price": F.col("entry") * (1 + d * F.col("cost_in")),
            "exit_price": F.col("exit") * (1 - d * F.col("cost_out")),
            "gross_r": d * (F.col("exit") - F.col("entry")) / risk,
        }
    )
    moved = d * (F.col("exit_price") - F.col("entry_price"))
    return rows.withColumns(
        {
            "net_r": moved / risk - paid,
            "return_pct": moved / F.col("entry_price") - paid * risk / F.col("entry_price"),
            "cost_bps": (F.col("cost_in") + F.col("cost_out")) / 2 * 1e4,
            "bars_held": F.col("exit_index") - F.col("entry_index"),
        }
    )


def without_overlap(rows: DataFrame) -> DataFrame:
    """Of one pattern's trades in a session, and trial, each that starts after the last one taken has ended."""
    by = [*KEY, *_trial(rows), "pattern"]
    rest = [c for c in rows.columns if c not in (*by, "entry_index", "exit_index")]
    trade = F.struct("entry_index", "exit_index", *rest)
    held = rows.groupBy(*by).agg(F.sort_array(F.collect_list(trade)).alias("all"))
    kind = held.schema["all"].dataType.simpleString()
    empty = F.struct(F.lit(-1).alias("until"), F.array().cast(kind).alias("taken"))
    picked = F.aggregate(
        "all",
        empty,
        lambda s, x: F.when(
            x.entry_index > s.until,
            F.struct(x.exit_index.cast("int").alias("until"), F.array_append(s.taken, x).alias("taken")),
        ).otherwise(s),
    )
    return held.select(*by, F.explode(picked.taken).alias("t")).select(*by, "t.*")


def draw(parts: list[Column], n: Column) -> Column:
    """A whole number from 0 below n, the same for the same parts, spread evenly."""
    h = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), n)


def matched(rows: DataFrame, bars: DataFrame, rules: TradeRules, seed: int) -> DataFrame:
    """For each trade one control: same direction and stop distance, entered at random up to some bars later.

    None where no bar is left. Controls may overlap. The draw follows from the trade and its
    trial's seed, or the given one where there is no trial.
    """
    room = F.least(F.lit(rules.matched_window), F.col("bars_in_session") - 1 - F.col("entry_index"))
    own_seed = F.col("trial_seed") if "trial_seed" in rows.columns else F.lit(seed)
    key = [own_seed, F.col("pattern"), F.col("interval"), F.col("symbol"), F.col("session"), F.col("entry_index")]
    rows = rows.withColumn("room", room).filter("room > 0")
    rows = rows.withColumn("start", (F.col("entry_index") + 1 + draw(key, F.col("room"))).cast("int"))
    w = in_order()
    clock = ["minute"] if "minute" in bars.columns else []
    close = bars.select(*KEY, "bar_idx", "open", *clock, F.lag("close").over(w).alias("before"))
    first = close.select(*KEY, F.col("bar_idx").alias("entry_index"), F.col("before").alias("_own"))
    then = close.select(*KEY, F.col("bar_idx").alias("start"), F.col("before").alias("_then"), F.col("open").alias("_open"), *clock)
    rows = rows.join(first, [*KEY, "entry_index"]).join(then, [*KEY, "start"])
    reach = F.col("direction") * (F.col("_own") - F.col("stop"))
    rows = rows.select(
        *KEY,
        *_trial(rows),
        "pattern",
        "direction",
        "bars_in_session",
        F.col("entry_index").alias("template_index"),
        F.col("start").alias("entry_index"),
        *([F.col("minute").alias("entry_minute")] if clock else []),
        F.col("_open").alias("entry"),
        (F.col("_then") - F.col("direction") * reach).alias("stop"),
    )
    return exits(with_levels(rows, rules), bars, rules)


def trades(
    bars: DataFrame,
    t: Thresholds,
    rules: TradeRules,
    costs: Costs,
    names: list[str] | None = None,
    bar_costs: DataFrame | None = None,
) -> DataFrame:
    """Signals to net trades, without overlap unless the rules allow it."""
    rows = net(exits(entries(bars, t, rules, names), bars, rules), rules, costs, bar_costs)
    return rows if rules.allow_overlapping_trades else without_overlap(rows)
