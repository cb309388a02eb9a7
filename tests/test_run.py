"""Whole runs: inference against plain numpy, one family of hypotheses, controls, costs and walk-forward folds."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from signalforge.config import Config, Run, Stats, Thresholds
from signalforge.operators import metrics
from signalforge.plans import run as plan
from signalforge.sources import bars as bar
from signalforge.sources.synthetic import synthetic_bars

DAYS = [dt.date(2025, 3, 3) + dt.timedelta(days=k) for k in range(12)]
STATS = Stats(min_trades=10, min_sessions=5, bootstrap_samples=300)


def rows_of(seed, lift):
    r = random.Random(seed)
    return [
        (p, i, r.choice(DAYS), k, "S", round(r.gauss(lift[p], 1), 3), round(r.gauss(lift[p] + 0.1, 1), 3))
        for p in lift
        for i in ("5m", "1h")
        for k in range(r.randint(15, 40))
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pattern string, interval string, session date, entry_index int, symbol string, net_r double, gross_r double")


def drawn(samples, seed, days):
    n = len(days)
    for b in range(samples):
        at = [int(hashlib.md5(f"{seed}|{b}|{j}".encode()).hexdigest()[:8], 16) % n for j in range(n)]
        yield np.bincount(at, minlength=n)


def means(rows, key, value, weights):
    total, count = np.zeros(len(DAYS)), np.zeros(len(DAYS))
    for r in rows:
        if r[:2] == key:
            total[DAYS.index(r[2])] += r[value]
            count[DAYS.index(r[2])] += 1
    return np.array([w @ total / (w @ count) for w in weights]), total.sum() / count.sum()


@pytest.fixture(scope="module")
def inferred(spark):
    own, control = rows_of(1, {"up": 2.5, "flat": 0.0, "random_long": -2.5}), rows_of(2, {"up": 0.0, "flat": 0.0})
    a, b = frame(spark, own), frame(spark, control)
    rows = a.groupBy("pattern", "interval").agg(
        F.count("*").alias("trades"), F.count_distinct("session").alias("sessions"), F.avg("net_r").alias("expectancy_r"), F.avg("gross_r").alias("gross_expectancy_r")
    )
    rows = rows.withColumn("kind", F.when(F.col("pattern") == "random_long", "control").otherwise("pattern"))
    dates = spark.createDataFrame([(d,) for d in DAYS], "session date")
    found = metrics.inferred(rows, a, b, dates, STATS, 7)
    return own, control, {(r.pattern, r.interval): r for r in found.collect()}


def test_evidence_equals_numpy(inferred):
    own, control, found = inferred
    weights = list(drawn(300, 7, DAYS))
    for key, r in found.items():
        net, estimate = means(own, key, 5, weights)
        assert (r.ci_low, r.ci_high) == pytest.approx(tuple(np.percentile(net, [2.5, 97.5])))
        assert r.p_value == pytest.approx((np.sum(np.abs(net - estimate) >= abs(estimate) - 1e-12) + 1) / 301)
        if r.kind == "control":
            assert r.delta_p_value is None and r.delta_r is None
            continue
        gross, a = means(own, key, 6, weights)
        other, b = means(control, key, 6, weights)
        assert r.delta_r == pytest.approx(a - b)
        assert r.delta_p_value == pytest.approx((np.sum(gross - other - (a - b) >= a - b - 1e-12) + 1) / 301)
        assert r.delta_low == pytest.approx(np.percentile(gross - other, 2.5))


def test_all_tests_are_one_family(inferred):
    found = inferred[2]
    tests = sorted(
        [(r.p_value, k, "own") for k, r in found.items()] + [(r.delta_p_value, k, "delta") for k, r in found.items() if r.kind != "control"]
    )
    most, want = 0.0, {}
    for rank, (p, k, which) in enumerate(tests):
        most = max(most, min(1.0, (len(tests) - rank) * p))
        want[k, which] = most
    assert len(tests) == 10
    for k, r in found.items():
        assert r.p_adjusted == pytest.approx(want[k, "own"])
        assert r.kind == "control" or r.delta_p_adjusted == pytest.approx(want[k, "delta"])


def test_verdicts_of_controls_and_patterns(inferred):
    verdicts = {k: r.verdict for k, r in inferred[2].items()}
    assert {verdicts["up", i] for i in ("5m", "1h")} == {"EDGE"}
    assert {verdicts["random_long", i] for i in ("5m", "1h")} <= {"NEGATIVE", "NOISE"}
    assert {verdicts["flat", i] for i in ("5m", "1h")} == {"NOISE"}


def test_segments_cover_the_later_dates_once():
    for n in (5, 11, 30):
        days = list(range(n))
        folds = plan.segments(days, 3)
        assert [d for _, own in folds for d in own] == days[-(-n * 2 // 5) :]
        assert all(past and past[-1] + 1 == own[0] for past, own in folds)
    for n, k in ((0, 3), (2, 1), (6, 4), (9, 0)):
        with pytest.raises(ValueError):
            plan.segments(list(range(n)), k)


def test_controls_trade_and_bars_have_costs_of_their_own(spark):
    bars = synthetic_bars(spark, ["AA"], dt.date(2025, 3, 3), dt.date(2025, 3, 5))
    bars = bar.sessionise(bar.validate(bars), F.to_date("ts")).filter("bar_idx < 100")
    bars = spark.createDataFrame(bars.collect(), bars.schema).coalesce(1).cache()
    config, names = Config(), ["bullish_engulfing"]
    lookbacks = plan.fitted(bars, config)
    random = plan.control_trades(bars, config, lookbacks, names).toPandas()
    assert set(random.pattern) == {"random_long", "random_short"} and (random.entry_index > lookbacks["1m"]).all()
    assert plan.own_trades(bars, config, lookbacks, names).filter("cost_bps <> 1.0").count() == 0
    bar_costs = plan.estimated_costs(bars, config)
    assert bar_costs.count() == bars.count()
    assert plan.own_trades(bars, config, lookbacks, names, bar_costs).filter("cost_bps <> 1.0").count() > 0


def test_walk_forward_test_pools_all_trades(spark):
    own, control = frame(spark, rows_of(3, {"up": 0.8})), frame(spark, rows_of(4, {"up": 0.0}))
    r = plan.walk_forward_test(own, control, Config(stats=STATS)).first()
    assert r.confirmed and r.trades == own.count() and r.p_adjusted <= 0.05 and r.delta_p_adjusted <= 0.05
    assert plan.walk_forward_test(own.limit(0), control.limit(0), Config(stats=STATS)).count() == 0


# -- a whole run against plain Python ---------------------------------------------------------------

RUN = Config(
    run=Run(trials=40, seed=5, holdout_fraction=0.25), stats=Stats(min_trades=5, min_trades_per_trial=1, min_sessions=3, bootstrap_samples=400), thresholds=Thresholds(trend_lookback=4)
)
NAMES = ["bullish_engulfing", "bearish_engulfing"]


def hexed(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


def plain_trade(bars, direction, at, stop):
    """(entry, exit bar, exit, gross R) of a trade entered at a bar's open, or None."""
    entry, rules = bars[at][0], RUN.trade
    risk = direction * (entry - stop)
    if risk <= 0 or risk / entry < rules.min_risk_pct:
        return None
    target = entry + direction * risk * rules.reward_multiple
    for k in range(at, min(at + rules.max_hold_bars, len(bars))):
        o, h, low, c = bars[k]
        hit, won = (low <= stop, h >= target) if direction > 0 else (h >= stop, low <= target)
        beyond = o >= target if direction > 0 else o <= target
        if won and (not hit or beyond):
            return entry, k, max(target, o) if direction > 0 else min(target, o), risk
        if hit:
            return entry, k, min(stop, o) if direction > 0 else max(stop, o), risk
    return entry, k, c, risk


def plain_sample(sessions, trials, look):
    """{pattern: [(session, net, gross)]} of patterns, random entries and matched controls."""
    own, control = {n: [] for n in (*NAMES, "random_long", "random_short")}, {n: [] for n in NAMES}
    slip = RUN.costs.slippage_bps / 1e4

    def result(day, direction, t):
        entry, _, out, risk = t
        paid, got = entry * (1 + direction * slip), out * (1 - direction * slip)
        return day, direction * (got - paid) / risk, direction * (out - entry) / risk

    for (symbol, day), seed in trials:
        bars = sessions[symbol, day]
        n = len(bars)
        if n < look + 4:
            continue
        trend = [0] * n
        for i in range(look - 1, n):
            rise = sum((k - (look - 1) / 2) * (bars[i - look + 1 + k][3] - bars[i - look + 1][3]) for k in range(1, look))
            trend[i] = (rise > 0) - (rise < 0)
        fired = {x: [] for x in NAMES}
        for i in range(look + 1, n):
            (o, _, _, c), (o1, _, _, c1) = bars[i], bars[i - 1]
            around = min(o, c) <= min(o1, c1) and max(o, c) >= max(o1, c1) and c != o
            for name, d in zip(NAMES, (1, -1), strict=True):
                if around and d * (c - o) > 0 and d * (c1 - o1) < 0 and trend[i - 2] == -d:
                    fired[name].append(i)
        rate = max(len(x) for x in fired.values()) / (n - look)
        for name, d in (("random_long", 1), ("random_short", -1)):
            order = sorted(range(look, n), key=lambda i: hexed(seed, name, symbol, "15m", day, i))
            fired[name] = sorted(order[: round(rate * (n - look))])
        for name, at in fired.items():
            d, free = (1 if name in ("bullish_engulfing", "random_long") else -1), -1
            reach = 2 if name in NAMES else 1
            for i in at:
                if i + 1 >= n or i + 1 <= free:
                    continue
                span = bars[i - reach + 1 : i + 1]
                stop = (min(b[2] for b in span) if d > 0 else max(b[1] for b in span)) * (1 - d * RUN.trade.stop_buffer)
                t = plain_trade(bars, d, i + 1, stop)
                if t is None:
                    continue
                free = t[1]
                own[name].append(result(day, d, t))
                room = min(RUN.trade.matched_window, n - 1 - (i + 1))
                if name in NAMES and room > 0:
                    start = i + 2 + int(hexed(seed, name, "15m", symbol, day, i + 1)[:8], 16) % room
                    m = plain_trade(bars, d, start, bars[start - 1][3] - (bars[i][3] - stop))
                    if m:
                        control[name].append(result(day, d, m))
    return own, control


def plain_figures(own, control, days):
    stats, out = RUN.stats, {}
    weights = list(drawn(stats.bootstrap_samples, RUN.run.seed, days))
    at = {d: i for i, d in enumerate(days)}

    def sums(rows, value):
        total, n = np.zeros(len(days)), np.zeros(len(days))
        for r in rows:
            total[at[r[0]]] += r[value]
            n[at[r[0]]] += 1
        return total, n

    def means(rows, value):
        total, n = sums(rows, value)
        return np.array([w @ total / (w @ n) if w @ n else np.nan for w in weights])

    def test(draws, estimate, two):
        good = draws[np.isfinite(draws)]
        off = good - estimate
        extreme = np.abs(off) >= abs(estimate) - 1e-12 if two else off >= estimate - 1e-12
        return (*np.percentile(good, [2.5, 97.5]), (extreme.sum() + len(draws) - len(good) + 1) / (len(draws) + 1)) if len(good) >= 0.95 * len(draws) else (None,) * 3

    for name, rows in own.items():
        mine, other = {r[0] for r in rows}, {r[0] for r in control.get(name, [])}
        low = high = p = delta = dlow = dp = None
        if rows:
            low, high, p = test(means(rows, 1), np.mean([r[1] for r in rows]), True)
        if len(mine) < stats.min_sessions:
            low = high = p = None
        p = p if len(rows) >= stats.min_trades else None
        if name in NAMES and rows and control[name]:
            delta = np.mean([r[2] for r in rows]) - np.mean([r[2] for r in control[name]])
            if len(rows) >= stats.min_trades and len(control[name]) >= stats.min_trades and min(len(mine), len(other), len(mine & other)) >= stats.min_sessions:
                dlow, _, dp = test(means(rows, 2) - means(control[name], 2), delta, False)
        out[name] = [len(rows), np.mean([r[1] for r in rows]) if rows else None, low, high, p, delta, dlow, dp]
    return out


def plain_verdicts(figures):
    asked = [(p if p is not None else 1.0, n, i, "own") for n, f in figures.items() for i in ("15m", "all") for p in [f[4]]]
    asked += [(p if p is not None else 1.0, n, i, "delta") for n, f in figures.items() if n in NAMES for i in ("15m", "all") for p in [f[7]]]
    adjusted, most = {}, 0.0
    for k, (p, n, i, which) in enumerate(sorted(asked, key=lambda x: x[0])):
        most = max(most, min(1.0, (len(asked) - k) * p))
        adjusted[n, i, which] = most
    out = {}
    for n, (count, _, low, high, p, _, dlow, dp) in figures.items():
        for i in ("15m", "all"):
            pa, da = adjusted[n, i, "own"] if p is not None else None, adjusted.get((n, i, "delta")) if dp is not None else None
            if count < RUN.stats.min_trades or low is None:
                v = "INSUFFICIENT"
            elif high < 0 and pa is not None and pa <= 0.05:
                v = "NEGATIVE"
            elif n not in NAMES:
                v = "NOISE"
            elif dlow is None:
                v = "INSUFFICIENT"
            else:
                v = "EDGE" if low > 0 and dlow > 0 and pa <= 0.05 and da <= 0.05 else "NOISE"
            out[n, i] = (v, pa, da)
    return out


def market(seed, lift):
    """{(symbol, day): [(o, h, l, c)]}: random walks; after an engulfing bar prices go its way by ``lift``."""
    r = random.Random(seed)
    out = {}
    for symbol in ("AA", "BB", "CC"):
        for day in DAYS:
            bars, price, push = [], 100.0, 0.0
            for _ in range(60):
                o = round(price + r.gauss(0, 0.02), 2)
                c = round(o + r.gauss(0, 0.3) + push, 2)
                h, low = round(max(o, c) + abs(r.gauss(0, 0.05)), 2), round(min(o, c) - abs(r.gauss(0, 0.05)), 2)
                push *= 0.3
                if bars:
                    o1, _, _, c1 = bars[-1]
                    if (c - o) * (c1 - o1) < 0 and min(o, c) <= min(o1, c1) and max(o, c) >= max(o1, c1):
                        push = lift if c > o else -lift
                bars.append((o, h, low, c))
                price = c
            out[symbol, day] = bars
    return out


@pytest.mark.parametrize(("seed", "lift"), [(1, 0.0), (2, 1.5)])
def test_a_whole_run_equals_plain_python(spark, seed, lift):
    sessions = market(seed, lift)
    rows = [(s, "15m", d, k, 10 * k, *b, 1.0) for (s, d), bars in sessions.items() for k, b in enumerate(bars)]
    bars = spark.createDataFrame(rows, "symbol string, interval string, session date, bar_idx int, minute int, open double, high double, low double, close double, volume double")
    found = {(r.pattern, r.interval): r for r in plan.run(bars, RUN, NAMES).collect()}

    held = 3  # a quarter of twelve dates
    days = {"discovery": DAYS[:-held], "validation": DAYS[-held:]}
    figures = {}
    for sample, n in (("discovery", 30), ("validation", 10)):
        pool = sorted((k for k in sessions if k[1] in days[sample]), key=lambda k: hexed(5, *k))
        seeds = [int(hexed(5, sample, 0, k)[:8], 16) for k in range(n)]
        pick = [pool[k] if n <= len(pool) else pool[seeds[k] % len(pool)] for k in range(n)]
        drawn_days = sorted({d for _, d in pick})
        own, control = plain_sample(sessions, list(zip(pick, seeds, strict=True)), 4)
        if sample == "validation":  # only the edges are looked at; the others stay hypotheses without trades
            own, control = ({k: v if k in edges else [] for k, v in x.items()} for x in (own, control))
        figures[sample] = plain_figures(own, control, drawn_days)
        verdicts = plain_verdicts(figures[sample])
        if sample == "discovery":
            first, edges = verdicts, {n for (n, _), v in verdicts.items() if v[0] == "EDGE"}
    final = {k: "NOISE" if v[0] == "EDGE" and verdicts[k][0] != "EDGE" else v[0] for k, v in first.items()}
    assert len(found) == 8
    for (n, i), r in found.items():
        count, mean, low, high, p, delta, dlow, dp = figures["discovery"][n]
        assert (r.trades, r.verdict) == (count, final[n, i]), (n, i)
        for got, want in ((r.expectancy_r, mean), (r.ci_low, low), (r.ci_high, high), (r.p_value, p), (r.delta_r, delta), (r.delta_low, dlow), (r.delta_p_value, dp), (r.p_adjusted, first[n, i][1]), (r.delta_p_adjusted, first[n, i][2])):
            assert got == (None if want is None else pytest.approx(want)), (n, i)
    if lift:
        assert edges == set(NAMES)
