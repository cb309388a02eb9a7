"""Bars that show detectors: for each one a session on which it fires, and sessions that miss one of its conditions.

The bars are searched for, not listed: a search over whole prices starts anywhere and changes
one price after another, keeping what meets more of the detector's conditions. A miss starts
from the hit and is kept when exactly one condition fails. The same names and thresholds give
the same bars.
"""

from __future__ import annotations

import datetime as dt
import random
import zlib
from dataclasses import asdict
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from signalforge.config import Thresholds
from signalforge.operators.patterns import REGISTRY, Pattern

SCHEMA = "symbol string, interval string, session date, bar_idx int, open double, high double, low double, close double, volume double"
#: Prices are whole numbers within this distance of the level.
LEVEL, REACH = 1000, 60
#: Changes tried before a search starts anew, and before a miss is given up.
TRIES, MISS_TRIES = 3000, 1500
SESSION = dt.date(2024, 3, 4)

Bar = tuple[int, int, int, int]


def conditions(p: Pattern, t: Thresholds) -> list[str]:
    """The detector's conditions, each an expression of geometry names."""
    assert isinstance(p.rule, str)
    said = p.rule.format(**asdict(t)).replace("greatest(", "max(").replace("least(", "min(")
    return said.split(" AND ")


def names(bars: list[Bar]) -> dict[str, float]:
    """Geometry of the last bars by name; the newest has no digit."""
    found: dict[str, float] = {}
    for back, (o, h, low, c) in enumerate(reversed(bars)):
        rng, body, top, bottom = h - low, abs(c - o), max(o, c), min(o, c)
        own = {"o": o, "h": h, "l": low, "c": c, "rng": rng, "body": body, "bt": top, "bb": bottom, "us": h - top, "ls": bottom - low}
        own |= {"br": body / rng if rng else 0.0, "bull": c > o, "bear": c < o}
        found |= {f"{k}{back or ''}": v for k, v in own.items()}
    return found


def _drawn(r: random.Random) -> Bar:
    o, c = (LEVEL + r.randint(-REACH, REACH) for _ in range(2))
    up, down = r.choice((0, 1, 3, 10, 30)), r.choice((0, 1, 3, 10, 30))
    return o, max(o, c) + up, min(o, c) - down, c


def _changed(bars: list[Bar], r: random.Random) -> list[Bar]:
    """One bar drawn anew, moved, or with another price that may be one of its neighbours'."""
    k, way = r.randrange(len(bars)), r.random()
    o, h, low, c = bars[k]
    if way < 0.2:
        new = _drawn(r)
    elif way < 0.4:
        d = r.randint(-20, 20)
        new = (o + d, h + d, low + d, c + d)
    else:
        near = r.choice(bars[r.randrange(len(bars))]) if r.random() < 0.5 else None
        step = r.randint(-8, 8)
        field = r.randrange(4)
        x = [o, h, low, c]
        x[field] = near + r.randint(-1, 1) if near is not None else x[field] + step
        o, c = x[0], x[3]
        new = (o, max(x[1], o, c), min(x[2], o, c), c)
    return [*bars[:k], new, *bars[k + 1 :]]


def _before(trend: int, n: int) -> list[Bar]:
    """Bars before the shape that rise, fall or alternate."""
    closes = [LEVEL + 7 * trend * k + (0 if trend else 5 * (-1) ** k) for k in range(n)]
    return [(c - 3 * trend, c + 4, c - 4, c) for c in closes]


@lru_cache(maxsize=512)
def shown(name: str, t: Thresholds) -> tuple[tuple[str, tuple[Bar, ...]], ...]:
    """(symbol, bars): first the hit, then a miss for every condition that can fail alone."""
    p = REGISTRY[name]
    r = random.Random(zlib.crc32(name.encode()))
    rules = [compile(x, name, "eval") for x in conditions(p, t)]
    met = lambda bars: [bool(eval(x, {"abs": abs, "max": max, "min": min}, names(bars))) for x in rules]  # noqa: E731,S307
    bars: list[Bar] = []
    score, tries = -1, TRIES
    while score < len(rules):
        if tries >= TRIES:
            bars, tries = [_drawn(r) for _ in range(p.bars)], 0
            score = sum(met(bars))
        other = _changed(bars, r)
        if (s := sum(met(other))) >= score:
            bars, score = other, s
        tries += 1
    before = _before(p.trend, t.trend_lookback + 1)
    found = [(f"{name}/hit", (*before, *bars))]
    missed: dict[int, list[Bar]] = {}
    walk = bars
    for k in range(MISS_TRIES):
        other = _changed(walk, r)
        held = met(other)
        if held.count(False) == 1:
            missed.setdefault(held.index(False), other)
        walk = other if all(held) and k % 3 == 0 else walk
    found += [(f"{name}/miss {k}", (*before, *missed[k])) for k in sorted(missed)]
    return tuple(found)


def rows(t: Thresholds, chosen: list[str]) -> list[tuple]:
    return [
        (symbol, "1h", SESSION, k, float(o), float(h), float(low), float(c), 1.0)
        for name in chosen
        for symbol, bars in shown(name, t)
        for k, (o, h, low, c) in enumerate(bars)
    ]


def bars(spark: SparkSession, t: Thresholds, chosen: list[str]) -> DataFrame:
    """Sessionised bars that show the chosen detectors."""
    return spark.createDataFrame(rows(t, chosen), SCHEMA)
