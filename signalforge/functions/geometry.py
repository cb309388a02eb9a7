"""Candle geometry: the columns that detectors are written in.

``o h l c`` are a bar's prices, ``rng body bt bb us ls`` its range, body, body top and bottom,
upper and lower shadow, ``br`` the body's share of the range (0 for none), ``bull bear`` its
direction; a digit behind a name means so many bars back. One window serves every column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.config import Thresholds
from signalforge.sources.bars import KEY, in_order

BASE = {
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "rng": "high - low",
    "body": "abs(close - open)",
    "bt": "greatest(open, close)",
    "bb": "least(open, close)",
    "us": "high - greatest(open, close)",
    "ls": "least(open, close) - low",
    "br": "CASE WHEN high - low > 0 THEN abs(close - open) / (high - low) ELSE CAST(0 AS DOUBLE) END",
    "bull": "close > open",
    "bear": "close < open",
}
LAGS = 4
LAGGED = ("o", "h", "l", "c", "body", "bt", "bb", "us", "br", "bull", "bear", "rng")


def slope(lookback: int, close: str = "c", lag: str = "lag({}, {}) OVER w") -> str:
    """Least-squares slope of the last closes, as SQL; taken from the first close, so flat prices give exactly 0."""
    mid = (lookback - 1) / 2
    first = lag.format(close, lookback - 1)
    terms = []
    for k in range(1, lookback):  # k: place in the stretch, 0 the oldest
        back = lookback - 1 - k
        at = close if back == 0 else lag.format(close, back)
        terms.append(f"CAST({k - mid} AS DOUBLE) * ({at} - {first})")
    norm = sum((k - mid) ** 2 for k in range(lookback))
    return f"({' + '.join(terms)}) / CAST({norm} AS DOUBLE)"


#: The one window, as SQL. Wide sets of columns are given to Spark as SQL texts: one call, where columns take thousands.
OVER = f"OVER (PARTITION BY {', '.join(KEY)} ORDER BY bar_idx)"


def with_sql(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add, or replace, columns given as SQL."""
    return df.selectExpr(*[f"`{c}`" for c in df.columns if c not in columns], *[f"{v} AS `{k}`" for k, v in columns.items()])


def trend(t: Thresholds) -> str:
    """1 up, -1 down, 0 neither or fewer bars than the lookback."""
    n = t.trend_lookback
    rise = slope(n, lag=f"lag({{}}, {{}}) {OVER}")
    if not t.trend_min_slope:
        return f"CASE WHEN bar_idx < {n - 1} THEN 0 WHEN {rise} > 0 THEN 1 WHEN {rise} < 0 THEN -1 ELSE 0 END"
    share, least = f"{rise} / avg(c) {OVER[:-1]} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)", f"CAST({t.trend_min_slope!r} AS DOUBLE)"
    return f"CASE WHEN bar_idx < {n - 1} THEN 0 WHEN {share} >= {least} THEN 1 WHEN {share} <= -{least} THEN -1 ELSE 0 END"


def geometry(bars: DataFrame, t: Thresholds) -> DataFrame:
    """Add geometry, its lags and the trend to sessionised bars."""
    lags = {f"{c}{k}": f"lag({c}, {k}) {OVER}" for k in range(1, LAGS + 1) for c in LAGGED}
    return with_sql(with_sql(bars, BASE), lags | {"trend": trend(t)})


def rolling_min(column: str, n: int) -> Column:
    return F.min(column).over(in_order().rowsBetween(-(n - 1), 0))


def rolling_max(column: str, n: int) -> Column:
    return F.max(column).over(in_order().rowsBetween(-(n - 1), 0))
