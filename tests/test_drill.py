"""Drill-down, user signals, quotes and the ticker scorer on small tables."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from signalforge.config import Thresholds
from signalforge.operators import drill, patterns, ticker, user_signals
from signalforge.operators.patterns import REGISTRY
from signalforge.sources import quotes

DAY = dt.date(2025, 3, 3)
HEAD = "from pyspark.sql import Window\nfrom pyspark.sql import functions as F\nfrom signalforge.operators.patterns import pattern, register\nW = Window.partitionBy('symbol', 'interval', 'session').orderBy('bar_idx')\n"


@pytest.fixture
def registry():
    before = dict(REGISTRY)
    yield REGISTRY
    REGISTRY.clear()
    REGISTRY.update(before)


def put(folder, name, body):
    path = folder / name
    path.write_text(HEAD + body)
    return path


GOOD = "@pattern('own_breakout', 'bull', 1, 0)\ndef f(t):\n    return F.col('c') > F.max('h').over(W.rowsBetween(-20, -1))\n"


def test_a_good_file_is_registered_and_runs(spark, tmp_path, registry):
    assert user_signals.load(spark, put(tmp_path, "good.py", GOOD + "register('own_up', 'bull', 2, 0, 'bull AND bull1')\n")) == ("own_breakout", "own_up")
    rows = [("S", "1m", DAY, k, 1.0 + k, 2.0 + k, 0.5 + k, 2.0 + k) for k in range(40)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, open double, high double, low double, close double")
    assert patterns.signals(bars, Thresholds(), ["own_up"]).count() == 40 - 11
    with pytest.raises(user_signals.SignalError, match="loaded already"):
        user_signals.load(spark, tmp_path / "good.py")


@pytest.mark.parametrize(
    ("body", "why"),
    [
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.lead('c').over(W) > F.col('c')\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.lag('c', -1).over(W) > F.col('c')\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.max('h').over(W.rowsBetween(-2, 2)) > 0\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.avg('c').over(Window.partitionBy('symbol', 'interval', 'session')) > 0\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.lag('c').over(Window.partitionBy('symbol', 'interval', 'session').orderBy(F.desc('bar_idx'))) > 0\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.lag('c').over(Window.partitionBy('symbol').orderBy('bar_idx')) > 0\n", "ahead"),
        ("register('own_peek', 'bull', 1, 0, 'lead(c) OVER (PARTITION BY symbol, interval, session ORDER BY bar_idx) > c')\n", "ahead"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.col('c') * 2\n", "boolean"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return F.col('nowhere') > 0\n", "analysed"),
        ("@pattern('own_peek', 'bull', 1, 0)\ndef f(t):\n    return 1 / 0\n", r"ZeroDivisionError.*\(line 7\)"),
        ("raise KeyError('x')\n", r"KeyError.*\(line 5\)"),
        ("x = 1\n", "registers no detector"),
        ("register('hammer', 'bull', 1, 0, 'bull')\n", "registered already"),
        ("register('own_x', 'sideways', 1, 0, 'bull')\n", "out of range"),
    ],
)
def test_a_bad_file_registers_nothing(spark, tmp_path, registry, body, why):
    before = dict(registry)
    path = put(tmp_path, "bad.py", body)
    with pytest.raises(user_signals.SignalError, match=why):
        user_signals.load(spark, path)
    with pytest.raises(user_signals.SignalError, match=why):  # a mended file can be loaded anew
        user_signals.load(spark, path)
    assert registry == before


def test_one_bad_file_registers_nothing_of_any(spark, tmp_path, registry):
    before = dict(registry)
    good, bad = put(tmp_path, "a.py", GOOD), put(tmp_path, "b.py", GOOD.replace("own_breakout", "own_other").replace("-20, -1", "0, 1"))
    with pytest.raises(user_signals.SignalError, match="own_other"):
        user_signals.load_all(spark, [good, bad])
    assert registry == before and user_signals.load_all(spark, [good]) == ("own_breakout",)
    with pytest.raises(FileNotFoundError):
        user_signals.load(spark, tmp_path / "none.py")


TRADE = "pattern string, interval string, symbol string, session date, entry_index int, net_r double, exit_reason string, matched boolean"


def trades(spark):
    rows = [("hammer", "1h", "S", DAY, k, float(k % 5), "stop", k % 3 == 0) for k in range(30)]
    return spark.createDataFrame(rows, TRADE)


def test_pages_leave_controls_out_and_count_all(spark):
    rows = drill.counted_page(trades(spark), {"pattern": "hammer"}, "net_r", True, 5, 4).collect()
    assert [r.total for r in rows] == [20] * 4 and not any(r.matched for r in rows)
    assert drill.counted_page(trades(spark), {"matched": None}, limit=1).first().total == 30
    assert drill.counted_page(trades(spark), {"matched": True}, limit=1).first().total == 10
    assert drill.counted_page(trades(spark), {"symbol": "none"}).collect() == []
    with pytest.raises(ValueError):
        drill.page(trades(spark), {}, "1; DROP")


def test_compared_runs_show_flips(spark):
    kind = "pattern string, interval string, verdict string, expectancy_r double"
    a = spark.createDataFrame([("p", "1h", "EDGE", 0.1), ("q", "1h", "NOISE", 0.2), ("r", "1h", "NOISE", None)], kind)
    b = spark.createDataFrame([("p", "1h", "NOISE", 0.2), ("q", "1h", "NOISE", -0.5), ("r", "1h", None, 1.0), ("s", "1h", "EDGE", 1.0)], kind)
    assert [(x.pattern, x.flipped) for x in drill.compared(a, b, ["expectancy_r"]).collect()] == [("q", False), ("p", True), ("r", True)]


def test_losing_controls(spark):
    rows = [("random_short", "1h", "control", "NEGATIVE"), ("random_long", "1h", "control", "NEGATIVE"), ("random_long", "5m", "control", "NOISE"), ("hammer", "5m", "pattern", "NEGATIVE")]
    found = {x.interval: (x.losing_controls, x.cost_dominated) for x in drill.losing_controls(spark.createDataFrame(rows, "pattern string, interval string, kind string, verdict string")).collect()}
    assert found == {"1h": (["random_long", "random_short"], True), "5m": ([], False)}


def test_short_sessions_show_no_signals(spark):
    rows = [("S", "1h", DAY, k, 60 * k, 2.0, 2.2, 0.9, 1.0 if k % 2 else 2.1, 1.0) for k in range(9)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, minute int, open double, high double, low double, close double, volume double")
    shown = drill.session_view(bars, None, {"a": (Thresholds(), {"1h": 6}), "b": (Thresholds(), {}), "c": (Thresholds(trend_min_slope=0.5), {"1h": 2})}, "bearish_marubozu").collect()
    of = {r: {(x.lookback, x.measured) for x in shown if x.run == r} for r in "abc"}
    assert of == {"a": {(6, False)}, "b": {(2, True)}, "c": {(2, True)}} and len(shown) == 27
    assert not any(x.signal for x in shown if x.run == "a") and any(x.signal for x in shown if x.run == "b") is any(x.signal for x in shown if x.run == "c")
    with pytest.raises(KeyError):
        drill.session_view(bars, None, {}, "nothing")


def test_sampling_reaches_the_scan(spark, tmp_path):
    rows = [("S", DAY + dt.timedelta(days=d), m, s, 10.0, 10.1) for d in range(2) for m in (0, 1, 25, 60, 200, 385) for s in (0, 1, 2)]
    quotes.write_quotes(spark.createDataFrame(rows, "symbol string, day date, minute int, second int, bp double, ap double"), f"file://{tmp_path}/q")
    held = quotes.sampled(spark.read.parquet(f"file://{tmp_path}/q"))
    assert {(x.minute, x.second) for x in held.collect()} == {(m, s) for m in (1, 25, 60, 385) for s in (0, 1)}
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "In(minute" in plan and "LessThan(second,2)" in plan.split("PushedFilters")[1]


def test_the_newest_readable_table_counts(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    table = lambda v: spark.createDataFrame([("S", "open", v)], quotes.TABLE)
    assert quotes.read_table(spark, root).count() == 0
    at = dt.datetime(2025, 1, 1)
    quotes.write_table(table(1.0), root, at)
    quotes.write_table(table(2.0), root, at + dt.timedelta(seconds=1))
    assert quotes.read_table(spark, root).first().half_spread_bps == 2.0
    begun = tmp_path / "t" / (at + dt.timedelta(seconds=2)).strftime("%Y%m%dT%H%M%S%f")
    begun.mkdir()
    assert quotes.read_table(spark, root).first().half_spread_bps == 2.0
    (begun / "_SUCCESS").touch()
    (begun / "part-0.parquet").write_bytes(b"no table")
    assert quotes.read_table(spark, root).first().half_spread_bps == 2.0


def daily(spark, closes, symbol="S"):
    rows = [(symbol, DAY + dt.timedelta(days=k), c + 0.2, c - 0.2, c) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, day date, high double, low double, close double")


def info(spark, **given):
    names = [*ticker.INFO, "earnings_date"]
    kind = "symbol string, " + ", ".join(f"{n} double" for n in ticker.INFO) + ", earnings_date string"
    return spark.createDataFrame([("S", *[given.get(n) for n in names])], kind)


def statements(spark, rows=()):
    return spark.createDataFrame(list(rows), "symbol string, year int, eps double, revenue double")


def scores(spark, closes, figures=None, years=()):
    return {(x.style, x.label): x.score for x in ticker.metrics(daily(spark, closes), info(spark, **(figures or {})), statements(spark, years)).collect()}


def test_growth_over_the_years(spark):
    rows = [("up", 1, 1.0, 5.0), ("up", 2, 2.0, 5.0), ("down", 3, 1.0, 9.0), ("down", 1, 1.0, None), ("down", 2, 2.0, 1.0), ("one", 1, 1.0, math.nan), ("one", 2, None, 1.0)]
    found = {x.symbol: (x.eps_trend, x.revenue_trend) for x in ticker.growth(statements(spark, rows)).collect()}
    assert found == {"up": (1.0, 1.0), "down": (0.0, 1.0), "one": (None, None)}


def test_double_tops_and_bottoms(spark):
    flat = [10 + k / 100 for k in range(40)]  # rises, so that it has no extremum of its own
    for end, want in (([10, 12, 10.2, 12, 11], 1.0), ([9, 12, 7, 14, 11], 0.5), ([20, 12, 19.9, 18], 1.0)):
        assert scores(spark, flat + list(map(float, end)))["swing", "double"] == want
    assert scores(spark, flat[:39])["swing", "double"] is None


def test_what_cannot_be_had_has_no_score(spark):
    found = scores(spark, [10.0, math.nan, math.inf, 11.0], {"trailing_pe": math.inf, "forward_pe": 3.0, "payout_ratio": -0.1, "bid": 5.0, "ask": 5.0, "beta": math.nan})
    assert len(found) == 24 and all(v is None for v in found.values())
    losses = scores(spark, [10.0], {"trailing_pe": -2.0, "forward_pe": 3.0})
    assert losses["long_term", "growth_outlook"] is None and losses["long_term", "pe"] == 0.0


def test_ratings_need_enough_metrics_and_count_the_base_once(spark):
    rows = [("S", "short_term", f"m{k}", 1.0 if k < 4 else None) for k in range(6)] + [("S", "day_trading", f"d{k}", 0.0 if k < 2 else None) for k in range(4)]
    rows += [("S", "long_term", f"l{k}", 1.0 if k < 2 else None) for k in range(3)]
    found = {x.style: x for x in ticker.ratings(spark.createDataFrame(rows, "symbol string, style string, label string, score double")).collect()}
    assert (found["short_term"].rating, found["short_term"].evaluated) == ("strong", 4)
    assert (found["day_trading"].metrics, found["day_trading"].evaluated, found["day_trading"].rating) == (10, 6, "moderate")
    assert found["long_term"].rating == "inconclusive" and "swing" in found
    kind = spark.createDataFrame([("S", "swing", "a", 1.5, 1.0), ("S", "swing", "b", None, None)], "symbol string, style string, label string, reading double, score double")
    assert ticker.report(kind, "info").first().lines == ["a: 1.5000 (1.0)", "b: n/a (n/a)"]
    assert ticker.report(kind, "verbose").first().rating == "inconclusive" and "lines" not in ticker.report(kind).columns
    with pytest.raises(ValueError):
        ticker.report(kind, "loud")


def test_alignment_and_squeeze(spark):
    rising = [100 + k / 3 for k in range(120)]
    assert scores(spark, rising)["swing", "alignment"] == 1.0
    assert scores(spark, rising[:-1] + [100.0])["swing", "alignment"] == 1.0  # both turn down
    assert scores(spark, rising[:99])["swing", "alignment"] is None
    wide = [100 + 20 * (-1) ** k for k in range(100)]
    calm = wide[:60] + [100 + (-1) ** k for k in range(40)]
    assert (scores(spark, list(map(float, calm)))["swing", "squeeze"], scores(spark, list(map(float, wide)))["swing", "squeeze"]) == (1.0, 0.0)
