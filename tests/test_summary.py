"""Figures in words, calibration and detection counts, times and loads."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalforge.config import Costs, Stats
from signalforge.operators import summary
from signalforge.sources import bars as bar
from signalforge.sources import registry

ROW = "seed int, pattern string, interval string, kind string, trades int, sessions int, expectancy_r double, gross_expectancy_r double, delta_r double, ci_low double, delta_low double, p_adjusted double, delta_p_adjusted double, verdict string, discovery_verdict string, validation_verdict string"


def rows(spark):
    held = [
        (1, "up", "1h", "pattern", 1200, 40, 0.2, 0.3, 0.1, 0.1, 0.05, 0.01, 0.02, "EDGE", "EDGE", "EDGE"),
        (1, "down", "1h", "pattern", 50, 20, -0.2, -0.1, -0.004, -0.3, None, 0.01, None, "NEGATIVE", "NEGATIVE", None),
        (2, "lost", "all", "pattern", 50, 20, 0.2, 0.3, 0.3, 0.1, 0.1, 0.01, 0.01, "NOISE", "EDGE", "NOISE"),
        (2, "few", "1h", "pattern", 3, 2, None, None, None, None, None, None, None, "INSUFFICIENT", "INSUFFICIENT", None),
        (2, "random_long", "1h", "control", 50, 20, 0.2, 0.3, None, 0.1, None, 0.01, None, "NOISE", "NOISE", None),
    ]
    return spark.createDataFrame(held, ROW)


def test_verdicts_in_words(spark):
    told = {x.pattern: x.told for x in summary.explained(rows(spark), Stats()).collect()}
    assert told["up"] == "up at 1h: EDGE: 1,200 trades on 40 dates earned +0.20R each after costs and led their controls by +0.10R (adjusted p 0.020)"
    assert "+0.00R against" in told["down"] and "-0.00" not in told["down"]
    assert told["lost"].startswith("lost at all intervals: NOISE") and told["lost"].endswith("the held-out dates gave NOISE")
    assert "too few: 30 trades on 10 dates" in told["few"]


def test_figures_as_text(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (-0.001,), (1.005,)], "x double")
    shown = [r[0] for r in df.select(summary.number(F.col("x"))).collect()]
    assert shown[:4] == ["n/a", "n/a", "inf", "+0.00"] and shown[4] in ("+1.00", "+1.01")
    one = spark.range(1).select(summary.percent(F.lit(0.1234)), summary.percent(F.lit(None).cast("double")), summary.span(F.lit(-0.5), F.lit(0.25)), summary.span(F.lit(None).cast("double"), F.lit(1.0)))
    assert tuple(one.first()) == ("12.3", "n/a", "[-0.50,+0.25]", "n/a")


def test_calibration_and_detection(spark):
    found = {(x.seed, x.interval): x for x in summary.calibration(rows(spark)).collect()}
    assert (found[1, "1h"].rows, found[1, "1h"].beats_control, found[1, "1h"].positive_expectancy, found[1, "1h"].confirmed_edge) == (2, 1, 1, 1)
    assert (found[2, "all"].discovery_edge, found[2, "all"].confirmed_edge) == (1, 0) and found[2, "1h"].rows == 1
    x = summary.detection(rows(spark).filter("pattern in ('up', 'lost')"), ["kind"]).first()
    assert (x.markets, x.beats_control, x.confirmed_edge) == (2, 1.0, 0.5) and x.delta_se == pytest.approx(0.1)


def test_costs_in_words(spark):
    assert summary.costs_told(Costs(), None) == "1 bps for a leg, fixed"
    assert "from quotes (observed 75%)" in summary.costs_told(Costs(), 1.5, {"observed": 0.75, "imputed": 0.0})
    assert "estimated" in summary.costs_told(Costs(), 1.5, {"fallback": 1.0})
    kind = "interval string, cost_bps double, matched boolean"
    x = summary.executed_cost(spark.createDataFrame([("1h", 1.0, False), ("1h", None, False), ("1h", 3.0, False), ("1h", 99.0, True)], kind)).first()
    assert (x.legs_priced, x.mean_cost_bps) == (4, 2.0)


def test_times_become_instants(spark):
    at = dt.datetime(2025, 7, 1, 9, 30)
    plain = spark.createDataFrame([(at,)], "ts timestamp_ntz")
    assert bar.utc(plain).first().ts == at and bar.utc(plain, "America/New_York").first().ts == dt.datetime(2025, 7, 1, 13, 30)
    assert bar.utc(spark.createDataFrame([(at,)], "ts timestamp"), "America/New_York").first().ts == at


def test_prints_of_one_time_come_in_order_of_arrival(spark):
    at = dt.datetime(2025, 7, 1, 13, 30)
    rows = [("S", at, 5.0, 1.0, [], 2), ("S", at, 7.0, 1.0, [], 1), ("S", at, 6.0, 1.0, [], 3)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, conditions array<string>, n int")
    x = bar.resample_ticks(ticks, "1s", 1, "n").first()
    assert (x.open, x.close, x.high, x.low, x.volume) == (7.0, 6.0, 7.0, 5.0, 3.0)


def test_loads_of_seconds_are_refused():
    registry.check_load("landed", ["1m", "1s"], 2, 10)
    with pytest.raises(ValueError, match="30 symbol-days"):
        registry.check_load("landed", ["1m", "1s"], 3, 10)
