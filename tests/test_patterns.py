"""Detectors: each fires on a shape found for it, misses by any one condition, needs its trend and history, never looks ahead."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from signalforge.config import Thresholds
from signalforge.operators import patterns
from tests import showcase
from signalforge.sources.bars import in_order

T = Thresholds()
NAMES = list(patterns.REGISTRY)
#: Conditions that no bars can break alone, because others imply them, or that the search didn't isolate.
SHARE = 0.75


def frame(spark, sessions):
    day = dt.date(2025, 1, 6)
    rows = [(s, "5m", day, k, *map(float, bar), 10.0) for s, bars in sessions.items() for k, bar in enumerate(bars)]
    return spark.createDataFrame(rows, showcase.SCHEMA)


def fired(spark, sessions, names=None):
    return {(r.symbol, r.pattern, r.bar_idx) for r in patterns.signals(frame(spark, sessions), T, names).collect()}


@pytest.fixture(scope="module")
def examples():
    return {symbol: bars for name in NAMES for symbol, bars in showcase.shown(name, T)}


@pytest.fixture(scope="module")
def found(spark, examples):
    return fired(spark, examples)


def test_there_are_as_many_detectors_as_names():
    assert len(NAMES) == 66
    with pytest.raises(ValueError, match="registered"):
        patterns.register(NAMES[0], "bull", 1, 0, "true")


@pytest.mark.parametrize("name", NAMES)
def test_fires_on_its_shape_only(found, name):
    own = showcase.shown(name, T)
    last = len(own[0][1]) - 1
    assert (own[0][0], name, last) in found
    assert not [s for s, _ in own[1:] if (s, name, last) in found]


def test_most_conditions_are_broken_alone():
    broken = sum(len(showcase.shown(n, T)) - 1 for n in NAMES)
    assert broken >= SHARE * sum(len(showcase.conditions(patterns.REGISTRY[n], T)) for n in NAMES)


def test_every_signal_agrees_with_plain_evaluation(found, examples):
    """All detectors on the last bar of all examples, by the search's own geometry."""
    rules = {n: [compile(c, n, "eval") for c in showcase.conditions(patterns.REGISTRY[n], T)] for n in NAMES}
    for symbol, bars in examples.items():
        for name, conditions in rules.items():
            p = patterns.REGISTRY[name]
            closes = [c for *_, c in bars[len(bars) - p.bars - T.trend_lookback : len(bars) - p.bars]]
            middle = (len(closes) - 1) / 2
            rise = sum((k - middle) * (c - closes[0]) for k, c in enumerate(closes))
            trend = (rise > 0) - (rise < 0)
            values = showcase.names(list(bars[-5:]))
            want = (not p.trend or trend == p.trend) and all(eval(c, {"abs": abs, "max": max, "min": min}, values) for c in conditions)
            enough = len(bars) - 1 >= p.bars - 1 + T.trend_lookback
            assert ((symbol, name, len(bars) - 1) in found) == (want and enough), (symbol, name)


@pytest.mark.parametrize("name", ["bearish_breakaway", "hammer", "three_black_crows"])
def test_trend_and_history_are_needed(spark, name):
    p = patterns.REGISTRY[name]
    shape = showcase.shown(name, T)[0][1][-p.bars :]
    against = showcase._before(-p.trend, T.trend_lookback + 1)
    short = showcase._before(p.trend, T.trend_lookback - 1)
    assert not fired(spark, {"against": [*against, *shape], "short": [*short, *shape]}, [name])


def test_bars_without_a_range_match_nothing(spark):
    assert not fired(spark, {"still": [(50, 50, 50, 50)] * 20})


def test_no_detector_looks_ahead(spark, examples):
    bars = [b for name in NAMES[::5] for b in showcase.shown(name, T)[0][1]]
    after = fired(spark, {"one": [*bars, (1500, 1900, 1400, 1850)], "two": [*bars, (700, 710, 300, 350)]})
    one, two = ({(p, k) for s, p, k in after if s == which and k < len(bars)} for which in ("one", "two"))
    assert one == two and one


def test_own_detector(spark):
    @patterns.pattern("above_three_highs", "bull")
    def rule(t):
        return F.col("c") > F.max("h").over(in_order().rowsBetween(-3, -1))

    try:
        bars = [*showcase._before(-1, 12), (1000, 1200, 990, 1190)]
        assert fired(spark, {"x": bars}, ["above_three_highs"]) == {("x", "above_three_highs", 12)}
    finally:
        del patterns.REGISTRY["above_three_highs"]
