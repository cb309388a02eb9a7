"""Bars, trades, costs and statistics on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalforge import config, queries
from signalforge.operators import costs, drill, metrics, patterns, sampling, ticker, trades
from signalforge.plans import run as plan
from signalforge.sources import bars as bar
from signalforge.sources.synthetic import synthetic_bars

DAY = dt.date(2026, 9, 14)
OPEN = dt.datetime(2026, 9, 14, 13, 30)
RULES = config.TradeRules(max_hold_bars=10, allow_overlapping_trades=True, stop_buffer=0.0)
FREE = config.Costs(slippage_bps=0.0)


def raw(spark, rows):
    return spark.createDataFrame(rows, "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double")


def session(spark, rows):
    kind = "symbol string, interval string, session date, bar_idx int, open double, high double, low double, close double, volume double"
    return spark.createDataFrame([("X", "1m", DAY, i, *map(float, r), 1.0) for i, r in enumerate(rows)], kind)


GOOD = (100.0, 100.5, 99.5, 100.2, 1000.0)
BROKEN = [
    (100.0, 100.1, 99.5, 100.2, 1000.0),
    (100.0, 100.5, 100.1, 100.2, 1000.0),
    (100.0, 99.0, 99.5, 100.2, 1000.0),
    (100.0, 100.5, 99.5, 100.2, 0.0),
    (100.0, 100.5, 99.5, None, 1000.0),
    (100.0, math.inf, 99.5, 100.2, 1000.0),
    (100.0, 100.5, -99.5, 100.2, 1000.0),
    (0.0, 100.5, 99.5, 100.2, 1000.0),
    (100.0, 100.5, 99.5, 100.2, math.inf),
    (100.0, 100.5, 99.5, math.nan, 1000.0),
]


@pytest.mark.parametrize("bad", BROKEN)
def test_broken_bars_go(spark, bad):
    rows = [("X", "1m", OPEN + dt.timedelta(minutes=i), *r) for i, r in enumerate((GOOD, bad, GOOD))]
    assert bar.validate(raw(spark, rows)).count() == 2


def test_one_bar_for_each_time(spark):
    assert bar.validate(raw(spark, [("X", "1m", OPEN, *GOOD)] * 2)).count() == 1
    assert bar.validate(raw(spark, [])).count() == 0


def test_sessions_are_local_days(spark):
    times = [OPEN - dt.timedelta(minutes=1), OPEN, OPEN + dt.timedelta(minutes=389), OPEN + dt.timedelta(minutes=390), OPEN.replace(hour=23, minute=0)]
    rows = bar.sessionise(raw(spark, [("X", "1m", t, *GOOD) for t in times]))
    assert [r.minute for r in rows.orderBy("ts").collect()] == [-1, 0, 389, 390, 570]
    assert {r.session for r in rows.collect()} == {DAY}
    assert bar.regular_hours(rows).count() == 2


def test_ticks_take_volume_from_all_and_prices_from_eligible(spark):
    prints = [(100.0, 10.0, []), (101.5, 5.0, None), (99.5, 20.0, ["@"]), (500.0, 7.0, ["I"]), (100.5, 1.0, [])]
    rows = [("X", OPEN + dt.timedelta(milliseconds=i), p, s, c) for i, (p, s, c) in enumerate(prints)]
    rows.append(("X", OPEN + dt.timedelta(seconds=5), 9.0, 1.0, ["W"]))
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, conditions array<string>")
    found = bar.resample_ticks(ticks, "1s", 1).collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in found] == [(100.0, 101.5, 99.5, 100.5, 43.0)]


def exit_of(spark, rows, direction=1, rules=RULES):
    """A trade entered on the open of bar 1 with stop 99 and target 102 (mirrored for shorts)."""
    bars = session(spark, rows)
    stop, target = (99.0, 102.0) if direction > 0 else (101.0, 98.0)
    last = min(rules.max_hold_bars, len(rows) - 1)
    entry = spark.createDataFrame(
        [("X", "1m", DAY, "p", 1, direction, len(rows), 100.0, stop, 1.0, target, last)],
        "symbol string, interval string, session date, pattern string, entry_index int, direction int, bars_in_session long, "
        "entry double, stop double, risk double, target double, last_index int",
    )
    r = trades.exits(entry, bars, rules).first()
    return r.exit_index, r.exit, r.exit_reason


FLAT = (100, 100.5, 99.5, 100)


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([FLAT, FLAT, (100, 100.5, 98.5, 99)], (2, 99.0, "stop")),
        ([FLAT, FLAT, (100, 102.5, 99.5, 102)], (2, 102.0, "target")),
        ([FLAT, FLAT, (100, 102.5, 98.5, 101)], (2, 99.0, "stop")),
        ([FLAT, FLAT, (98, 98.5, 97.5, 98)], (2, 98.0, "stop")),
        ([FLAT, FLAT, (103, 103.5, 102.5, 103)], (2, 103.0, "target")),
        ([FLAT, FLAT, (103, 103.5, 98.5, 99)], (2, 103.0, "target")),
        ([FLAT] * 4, (3, 100.0, "session_end")),
        ([FLAT] * 20, (10, 100.0, "timeout")),
    ],
)
def test_exits(spark, rows, want):
    assert exit_of(spark, rows) == want


def test_short_mirror(spark):
    assert exit_of(spark, [FLAT, FLAT, (100, 101.5, 99.5, 101)], -1) == (2, 101.0, "stop")
    assert exit_of(spark, [FLAT, FLAT, (97, 97.5, 96.5, 97)], -1) == (2, 97.0, "target")


def test_greedy_choice_of_trades(spark):
    pairs = [(1, 5), (2, 3), (6, 6), (7, 8), (8, 9), (9, 9)]
    rows = spark.createDataFrame(
        [("X", "1m", DAY, "p", a, b, 0.5) for a, b in pairs],
        "symbol string, interval string, session date, pattern string, entry_index int, exit_index int, net_r double",
    )
    taken = sorted((r.entry_index, r.exit_index) for r in trades.without_overlap(rows).collect())
    assert taken == [(1, 5), (6, 6), (7, 8), (9, 9)]


def test_net_of_costs(spark):
    rows = spark.createDataFrame(
        [("X", "1m", DAY, "p", 1, 3, 1, 100.0, 102.0, 1.0)],
        "symbol string, interval string, session date, pattern string, entry_index int, exit_index int, direction int, entry double, exit double, risk double",
    )
    r = trades.net(rows, RULES, config.Costs(slippage_bps=10.0, commission=5.0)).first()
    assert r.gross_r == 2.0
    assert r.entry_price == pytest.approx(100.1) and r.exit_price == pytest.approx(101.898)
    assert r.net_r == pytest.approx(1.798 - 0.05)


def test_corwin_schultz(spark):
    def spread(highs, lows):
        rows = [("X", "1m", DAY, i, h, low) for i, (h, low) in enumerate(zip(highs, lows, strict=True))]
        df = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, high double, low double")
        return costs.corwin_schultz(df).first().spread

    assert spread([101.0, 100.5], [99.0, 98.5]) == pytest.approx(0.0079485334033943)
    assert spread([101.0, 100.5, 110.0], [99.0, 98.5, 109.9]) == pytest.approx(0.00397426670169715)
    assert spread([100.0, 110.0], [99.9, 109.9]) == 0
    assert spread([100.0], [99.0]) is None


def test_quotes(spark):
    quotes = [("X", DAY, 10, 100.0, 100.02)] * 9 + [("X", DAY, 10, 100.0, 140.0), ("X", DAY, 10, 5.0, 5.0), ("X", DAY, 10, 0.0, 5.0)]
    df = spark.createDataFrame(quotes, "symbol string, day date, minute int, bp double, ap double")
    r = costs.quote_table(df).first()
    assert (r.bucket, round(r.half_spread_bps, 4)) == ("open", 0.9999)


TRADE = "pattern string, interval string, symbol string, session date, entry_index int, exit_reason string, net_r double, gross_r double, return_pct double, bars_held int, cost_bps double, window int"


def some_trades(spark, nets, name="p"):
    rows = [(name, "1h", "X", DAY + dt.timedelta(days=i), 1, "stop", n, n, n / 100, 2, 1.0, i % 2) for i, n in enumerate(nets)]
    return spark.createDataFrame(rows, TRADE)


def test_summary_keeps_rows_without_trades(spark):
    grid = spark.createDataFrame([("p", "1h"), ("q", "1h")], "pattern string, interval string")
    rows = {r.pattern: r for r in metrics.summarise(some_trades(spark, [1.0, -1.0, 2.0]), grid).collect()}
    assert rows["p"].trades == 3 and rows["p"].profit_factor == 3.0
    assert rows["q"].trades == 0 and rows["q"].expectancy_r is None


def test_drawdown_starts_at_zero(spark):
    assert metrics.max_drawdown(some_trades(spark, [-1.0, -1.0, 5.0, -0.5])).first().max_drawdown_r == 2.0


def test_holm_counts_unavailable_rows(spark):
    rows = spark.createDataFrame([("a", "1h", 0.01), ("b", "1h", None), ("c", "1h", 0.02)], "pattern string, interval string, p_value double")
    found = {r.pattern: r.p_adjusted for r in metrics.holm(rows, config.Stats()).collect()}
    assert found == {"a": pytest.approx(0.03), "b": None, "c": pytest.approx(0.04)}


def test_bootstrap_is_reproducible_and_centred(spark):
    own = some_trades(spark, [1.0, 0.5, -0.2, 0.8, 0.1, 0.4])
    a = metrics.bootstrap_draws(own, own, 200, 1)
    assert a.exceptAll(metrics.bootstrap_draws(own, own, 200, 1)).count() == 0
    r = metrics.tested(metrics.totals_of(own, None, own), spark, 200, 1).first()
    assert r.ci_low < 2.6 / 6 < r.ci_high and 0 < r.p_value < 0.2
    means = [x["mean"] for x in a.collect()]
    assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_trades_on_an_unknown_date_are_an_error(spark):
    own = some_trades(spark, [1.0, 0.5])
    dates = own.filter(F.col("session") > F.lit(str(DAY)))
    with pytest.raises(Exception, match="unknown date"):
        metrics.date_totals(own, dates).collect()
    with pytest.raises(ValueError, match="unknown date"):
        metrics.totals_of(own, None, dates)


def test_drawdown_and_equity_are_those_of_a_plain_walk(spark):
    """One pattern holds nearly all trades; dates are summed up and combined, in the order of clock minutes, symbols and bars."""
    r = np.random.default_rng(4)
    rows = [
        ("p" if r.random() < 0.95 else f"q{r.integers(3)}", "1h", "AB"[r.integers(2)], DAY + dt.timedelta(days=int(r.integers(40))), k, round(float(r.normal()), 3), None if r.random() < 0.1 else int(r.integers(5)))
        for k in range(1500)
    ]
    df = spark.createDataFrame(rows, "pattern string, interval string, symbol string, session date, entry_index int, net_r double, entry_minute int")
    deepest = {x.pattern: x.max_drawdown_r for x in metrics.max_drawdown(df).collect()}
    curve = {(x.pattern, x.trade_no): (x.entry_index, x.equity_r, x.peak_r) for x in metrics.equity(df).collect()}
    assert len(curve) == len(rows)
    for name in {x[0] for x in rows}:
        total = peak = worst = 0.0
        ordered = sorted((x for x in rows if x[0] == name), key=lambda x: (x[3], x[6] is None, x[6] or 0, x[2], x[4]))
        for k, x in enumerate(ordered, 1):
            total += x[5]
            peak = max(peak, total)
            worst = max(worst, peak - total)
            assert curve[name, k] == (x[4], pytest.approx(total), pytest.approx(peak))
        assert deepest[name] == pytest.approx(worst)


def test_implausible_spreads_fall_back(spark):
    rows = [(0.019, 0.0095), (0.02, 0.01), (0.03, 0.0001), (0.0, 0.0001), (None, 0.0001)]
    found = spark.createDataFrame(rows, "spread double, want double").withColumn("got", costs.one_way(F.col("spread"), config.Costs()))
    assert all(x.got == pytest.approx(x.want) for x in found.collect())


def test_one_estimate_from_the_narrowest_interval(spark):
    bar_row = lambda i, k, wide: ("X", i, DAY, k, 10.0 + wide, 10.0)
    rows = [bar_row(i, k, w) for i, w in (("30s", 0.5), ("1m", 0.05), ("1h", 0.9)) for k in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, high double, low double")
    alone = costs.corwin_schultz(bars.filter("interval = '1m'")).first().spread
    found = costs.estimated(bars, config.Costs()).collect()
    assert [(x.spread, x.cost) for x in found] == [(alone, pytest.approx(alone / 2))]
    assert costs.estimated(bars.filter("interval = '30s'"), config.Costs()).count() == 0


def test_trials_repeat_sessions_where_there_are_too_few(spark):
    pool = spark.createDataFrame([("X", DAY + dt.timedelta(days=i)) for i in range(10)], "symbol string, session date")
    run = config.Run(trials=50, windows=2, holdout_fraction=0.2)
    found = sampling.draw_trials(pool, run).collect()
    assert sorted(x.trial_index for x in found) == list(range(50)) and len({x.seed for x in found}) == 50
    assert sum(x["sample"] == "validation" for x in found) == 10
    assert found == sampling.draw_trials(pool.repartition(3), run).collect() or sorted(found) == sorted(sampling.draw_trials(pool.repartition(3), run).collect())
    once = sampling.draw_trials(pool, config.Run(trials=8, holdout_fraction=0.25)).collect()
    assert len({x.session for x in once}) == 8
    with pytest.raises(ValueError):
        sampling.wanted(config.Run(trials=4, windows=4, holdout_fraction=0.25))
    with pytest.raises(Exception, match="no dates for"):
        sampling.draw_trials(pool, config.Run(trials=50, windows=30)).collect()


def test_long_holds_look_into_the_session(spark):
    r = np.random.default_rng(1)
    rows = [("X", "1m", DAY, k, *map(float, (x := 10 + r.normal(size=4) / 50)[:1]), float(x.max()), float(x.min()), float(x[1])) for k in range(150)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, open double, high double, low double, close double")
    at = bars.filter("bar_idx % 7 = 3").select("symbol", "interval", "session", F.lit("p").alias("pattern"), F.lit(1).alias("direction"), "bar_idx")
    for hold in (5, 64, 65, 200):
        rules = config.TradeRules(max_hold_bars=hold, min_risk_pct=0.0)
        found = trades.exits(trades.entries_at(bars, at, rules), bars, rules).collect()
        assert found
        for x in found:
            for k in range(x.entry_index, min(x.entry_index + hold, 150)):
                _, _, _, _, o, h, low, c = rows[k]
                if low <= x.stop or h >= x.target:
                    won = h >= x.target and (low > x.stop or o >= x.target)
                    want = (k, max(x.target, o) if won else min(x.stop, o), "target" if won else "stop")
                    break
            else:
                want = (k, c, "timeout" if x.entry_index + hold - 1 <= 149 else "session_end")
            assert (x.exit_index, x.exit, x.exit_reason) == want


def test_verdicts(spark):
    kind = "trades int, sessions int, ci_low double, ci_high double, p_adjusted double, delta_low double, delta_p_adjusted double, want string"
    rows = [
        (10, 20, 0.1, 0.2, 0.01, 0.1, 0.01, "INSUFFICIENT"),
        (50, 20, -0.2, -0.1, 0.01, 0.1, 0.01, "NEGATIVE"),
        (50, 20, 0.1, 0.2, 0.01, None, None, "INSUFFICIENT"),
        (50, 20, 0.1, 0.2, 0.01, 0.1, 0.01, "EDGE"),
        (50, 20, 0.1, 0.2, 0.20, 0.1, 0.01, "NOISE"),
    ]
    found = spark.createDataFrame(rows, kind).withColumn("v", metrics.verdict(config.Stats(), F.lit(False)))
    assert [r.v for r in found.collect()] == [r[-1] for r in rows]


def test_holdout_takes_the_newest_dates(spark):
    pool = spark.createDataFrame([("X", DAY + dt.timedelta(days=i)) for i in range(10)], "symbol string, session date")
    rows = sampling.dates(pool, config.Run(windows=3, holdout_fraction=0.25)).orderBy("session").collect()
    assert [r["sample"] for r in rows] == ["discovery"] * 7 + ["validation"] * 3
    assert [r["window"] for r in rows][:7] == [0, 0, 0, 1, 1, 2, 2]


def test_pages_refuse_unknown_columns(spark):
    with pytest.raises(ValueError):
        drill.page(some_trades(spark, [1.0]), {"1=1 --": 1})
    assert drill.page(some_trades(spark, [1.0, 3.0, 2.0]), {"pattern": "p"}, "net_r", True, 1, 1).first().net_r == 2.0


@pytest.mark.parametrize(("closes", "want"), [([10.0] * 30, 50.0), (list(map(float, range(1, 31))), 100.0), (list(map(float, range(30, 0, -1))), 0.0), ([1.0] * 5, None)])
def test_rsi(spark, closes, want):
    rows = [("X", DAY + dt.timedelta(days=i), c, c, c, 1.0) for i, c in enumerate(closes)]
    df = spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double, volume double")
    assert ticker.latest(df).first().rsi14 == want


def test_config_refuses_unknown_keys():
    assert config.load({"run": {"trials": 5}}).run.trials == 5
    with pytest.raises(ValueError):
        config.load({"run": {"trails": 5}})
    with pytest.raises(ValueError):
        config.load({"run": {"windows": 0}})


def test_minimum_detectable():
    assert metrics.minimum_detectable(config.Stats(bootstrap_samples=100), 66) is None
    assert metrics.minimum_detectable(config.Stats(), 1) == pytest.approx(2.8016, abs=1e-3)


def test_inference_queries_draw_enough_for_every_pattern():
    """The least adjusted p-value over all patterns reaches the level."""
    assert metrics.resolution(config.Stats(bootstrap_samples=queries.DRAWS), len(patterns.REGISTRY))[0] <= config.Stats().alpha
    assert queries.DRAWS == config.Stats().bootstrap_samples


def test_runs_measure_every_interval(spark):
    minutes = bar.sessionise(bar.validate(synthetic_bars(spark, ["AAA"], DAY, DAY)), F.to_date("ts"))
    few = spark.createDataFrame(minutes.collect(), minutes.schema).coalesce(1)
    bars = few.unionByName(few.withColumn("interval", F.lit("5m"))).cache()
    conf = config.Config(stats=config.Stats(bootstrap_samples=2))
    assert plan.fitted(bars, conf) == {"1m": 10, "5m": 10}
    found = {r.interval: r for r in plan.measured(bars, conf, ["hammer"]).filter("kind = 'pattern'").collect()}
    assert set(found) == {"1m", "5m", "all"}
    assert found["1m"].trades == found["5m"].trades > 0 and found["all"].trades == 2 * found["1m"].trades


def test_sessions_too_short_for_the_lookback_are_skipped(spark):
    bars = session(spark, [(1, 2, 0.5, 1)] * 8)
    assert [sampling.trial_bars(bars, bars, {"1m": k}).count() for k in (4, 5)] == [8, 0]
