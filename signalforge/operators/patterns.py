"""The catalogue of candlestick detectors, their gates, and detectors of one's own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalforge.config import Thresholds
from signalforge.functions.geometry import OVER, geometry, with_sql


@dataclass(frozen=True)
class Pattern:
    """rule: SQL over geometry columns, with thresholds in braces, or a function of the thresholds giving a column."""

    name: str
    bias: str
    bars: int
    trend: int
    rule: str | Callable[[Thresholds], Column]
    kind: str = "pattern"

    @property
    def direction(self) -> int:
        return 1 if self.bias == "bull" else -1

    def sql(self, t: Thresholds) -> str:
        assert isinstance(self.rule, str)
        return self.rule.format(**{k: f"CAST({v!r} AS DOUBLE)" for k, v in asdict(t).items()})

    def column(self, t: Thresholds) -> Column:
        return F.expr(self.sql(t)) if isinstance(self.rule, str) else self.rule(t)


REGISTRY: dict[str, Pattern] = {}


def register(name: str, bias: str, bars: int, trend: int, rule: str | Callable[[Thresholds], Column]) -> Pattern:
    if name in REGISTRY:
        raise ValueError(f"pattern {name} is registered already")
    if bias not in ("bull", "bear") or trend not in (-1, 0, 1) or bars < 1:
        raise ValueError(f"pattern {name}: bias, trend or bars out of range")
    REGISTRY[name] = Pattern(name, bias, bars, trend, rule)
    return REGISTRY[name]


def pattern(name: str, bias: str, bars: int = 1, trend: int = 0):
    """Decorator for a detector of one's own: a function of the thresholds that gives a boolean column."""

    def wrap(rule: Callable[[Thresholds], Column]) -> Callable[[Thresholds], Column]:
        register(name, bias, bars, trend, rule)
        return rule

    return wrap


def _near(a: str, b: str) -> str:
    return f"abs({a} - {b}) <= {{near_equal}} * {b}"


_HAMMER = "rng > 0 AND br <= {small_body} AND ls >= {shadow_dominance} * body AND us <= {opposite_shadow_max} * rng"
_INVERTED = "rng > 0 AND br <= {small_body} AND us >= {shadow_dominance} * body AND ls <= {opposite_shadow_max} * rng"
_DOJI = "rng{0} > 0 AND br{0} <= {{doji_body}}".format
_LONG = "br{0} >= {{long_body}}".format
_SMALL = "br{0} <= {{small_body}}".format
_WITHIN = "bt <= bt1 AND bb >= bb1"
_MID = "(bb{0} + 0.5 * body{0})".format
_NECK = f"bear1 AND {_LONG(1)} AND bull AND o < l1"
_MORNING = f"bear2 AND {_LONG(2)} AND {_SMALL(1)} AND bt1 < bb2 AND bull AND c > {_MID(2)}"
_EVENING = f"bull2 AND {_LONG(2)} AND {_SMALL(1)} AND bb1 > bt2 AND bear AND c < {_MID(2)}"
_INSIDE4 = " AND ".join(f"{_SMALL(k)} AND h{k} <= h4 AND l{k} >= l4" for k in (1, 2, 3))
_STEPS = "bb2 < o1 AND o1 < bt2 AND bb1 < o AND o < bt1"
_LONGS = f"{_LONG('')} AND {_LONG(1)} AND {_LONG(2)}"
_DOJIS = f"{_DOJI('')} AND {_DOJI(1)} AND {_DOJI(2)}"


def _run(side: str, last: int) -> str:
    """Three bars of one direction, each closing beyond the one before; last: the newest of them."""
    sign = "<" if side == "bear" else ">"
    a, b, d = last, last + 1, last + 2
    return f"{side}{a} AND {side}{b} AND {side}{d} AND c{a} {sign} c{b} AND c{b} {sign} c{d}"


#: name, bias, bars, trend before, rule.
for _spec in (
    ("hammer", "bull", 1, -1, _HAMMER),
    ("hanging_man", "bear", 1, 1, _HAMMER),
    ("inverted_hammer", "bull", 1, -1, _INVERTED),
    ("shooting_star", "bear", 1, 1, _INVERTED),
    ("dragonfly_doji", "bull", 1, -1, f"{_DOJI('')} AND ls >= {{doji_shadow_min}} * rng AND us <= {{opposite_shadow_max}} * rng"),
    ("gravestone_doji", "bear", 1, 1, f"{_DOJI('')} AND us >= {{doji_shadow_min}} * rng AND ls <= {{opposite_shadow_max}} * rng"),
    ("bullish_marubozu", "bull", 1, 0, "rng > 0 AND bull AND br >= {marubozu_body}"),
    ("bearish_marubozu", "bear", 1, 0, "rng > 0 AND bear AND br >= {marubozu_body}"),
    ("bullish_belt_hold", "bull", 1, -1, f"rng > 0 AND bull AND {_LONG('')} AND ls <= (1 - {{marubozu_body}}) * rng"),
    ("bearish_belt_hold", "bear", 1, 1, f"rng > 0 AND bear AND {_LONG('')} AND us <= (1 - {{marubozu_body}}) * rng"),
    ("bullish_engulfing", "bull", 2, -1, "bear1 AND bull AND bb <= bb1 AND bt >= bt1 AND body > 0"),
    ("bearish_engulfing", "bear", 2, 1, "bull1 AND bear AND bb <= bb1 AND bt >= bt1 AND body > 0"),
    ("bullish_harami", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND bull AND {_WITHIN}"),
    ("bearish_harami", "bear", 2, 1, f"bull1 AND {_LONG(1)} AND bear AND {_WITHIN}"),
    ("piercing_line", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND bull AND o < c1 AND c > {_MID(1)} AND c < o1"),
    ("dark_cloud_cover", "bear", 2, 1, f"bull1 AND {_LONG(1)} AND bear AND o > c1 AND c < {_MID(1)} AND c > o1"),
    ("tweezer_bottom", "bull", 2, -1, f"bear1 AND bull AND {_near('l', 'l1')}"),
    ("tweezer_top", "bear", 2, 1, f"bull1 AND bear AND {_near('h', 'h1')}"),
    ("bullish_kicker", "bull", 2, 0, "bear1 AND bull AND o >= h1 * (1 + {gap_min})"),
    ("bearish_kicker", "bear", 2, 0, "bull1 AND bear AND o <= l1 * (1 - {gap_min})"),
    ("bullish_harami_cross", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND {_DOJI('')} AND {_WITHIN}"),
    ("bearish_harami_cross", "bear", 2, 1, f"bull1 AND {_LONG(1)} AND {_DOJI('')} AND {_WITHIN}"),
    ("bullish_counterattack", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND bull AND {_LONG('')} AND o < c1 AND {_near('c', 'c1')}"),
    ("bearish_counterattack", "bear", 2, 1, f"bull1 AND {_LONG(1)} AND bear AND {_LONG('')} AND o > c1 AND {_near('c', 'c1')}"),
    ("homing_pigeon", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND bear AND {_WITHIN}"),
    ("descending_hawk", "bear", 2, 1, f"bull1 AND {_LONG(1)} AND bull AND {_WITHIN}"),
    ("bullish_separating_lines", "bull", 2, 1, f"bear1 AND bull AND {_LONG('')} AND {_near('o', 'o1')}"),
    ("bearish_separating_lines", "bear", 2, -1, f"bull1 AND bear AND {_LONG('')} AND {_near('o', 'o1')}"),
    ("on_neck", "bear", 2, -1, f"{_NECK} AND {_near('c', 'l1')}"),
    ("in_neck", "bear", 2, -1, f"{_NECK} AND c >= c1 AND c <= c1 + 0.1 * body1"),
    ("thrusting", "bear", 2, -1, f"{_NECK} AND c > c1 + 0.1 * body1 AND c < {_MID(1)}"),
    ("matching_low", "bull", 2, -1, f"bear1 AND {_LONG(1)} AND bear AND {_near('c', 'c1')}"),
    ("morning_star", "bull", 3, -1, _MORNING),
    ("evening_star", "bear", 3, 1, _EVENING),
    ("three_white_soldiers", "bull", 3, -1, f"bull AND bull1 AND bull2 AND {_LONGS} AND c > c1 AND c1 > c2 AND {_STEPS}"),
    ("three_black_crows", "bear", 3, 1, f"bear AND bear1 AND bear2 AND {_LONGS} AND c < c1 AND c1 < c2 AND {_STEPS}"),
    ("three_inside_up", "bull", 3, -1, f"bear2 AND {_LONG(2)} AND bull1 AND bt1 <= bt2 AND bb1 >= bb2 AND bull AND c > o2"),
    ("three_inside_down", "bear", 3, 1, f"bull2 AND {_LONG(2)} AND bear1 AND bt1 <= bt2 AND bb1 >= bb2 AND bear AND c < o2"),
    ("three_outside_up", "bull", 3, -1, "bear2 AND bull1 AND body1 > 0 AND bb1 <= bb2 AND bt1 >= bt2 AND bull AND c > c1"),
    ("three_outside_down", "bear", 3, 1, "bull2 AND bear1 AND body1 > 0 AND bb1 <= bb2 AND bt1 >= bt2 AND bear AND c < c1"),
    ("morning_doji_star", "bull", 3, -1, f"{_MORNING} AND {_DOJI(1)}"),
    ("evening_doji_star", "bear", 3, 1, f"{_EVENING} AND {_DOJI(1)}"),
    ("bullish_abandoned_baby", "bull", 3, -1, f"{_MORNING} AND {_DOJI(1)} AND h1 < l2 AND l > h1"),
    ("bearish_abandoned_baby", "bear", 3, 1, f"{_EVENING} AND {_DOJI(1)} AND l1 > h2 AND h < l1"),
    ("rising_three_methods", "bull", 5, 1, f"bull4 AND {_LONG(4)} AND {_INSIDE4} AND bull AND {_LONG('')} AND c > c4"),
    ("falling_three_methods", "bear", 5, -1, f"bear4 AND {_LONG(4)} AND {_INSIDE4} AND bear AND {_LONG('')} AND c < c4"),
    ("two_crows", "bear", 3, 1, f"bull2 AND {_LONG(2)} AND bear1 AND bb1 > c2 AND bear AND o > c1 AND o < o1 AND c > o2 AND c < c2"),
    ("upside_gap_two_crows", "bear", 3, 1, f"bull2 AND {_LONG(2)} AND bear1 AND {_SMALL(1)} AND bb1 > c2 AND bear AND o > o1 AND c < c1 AND c > c2"),
    ("identical_three_crows", "bear", 3, 1, f"bear AND bear1 AND bear2 AND {_LONGS} AND c < c1 AND c1 < c2 AND {_near('o1', 'c2')} AND {_near('o', 'c1')}"),
    ("stick_sandwich", "bull", 3, -1, f"bear2 AND bull1 AND l1 > c2 AND bear AND {_near('c', 'c2')}"),
    ("unique_three_river", "bull", 3, -1, f"bear2 AND {_LONG(2)} AND bear1 AND bt1 <= bt2 AND bb1 >= bb2 AND l1 < l2 AND bull AND {_SMALL('')} AND c < c1"),
    ("upside_tasuki_gap", "bull", 3, 1, "bull2 AND bull1 AND l1 > h2 AND bear AND o > o1 AND o < c1 AND c > h2 AND c < l1"),
    ("downside_tasuki_gap", "bear", 3, -1, "bear2 AND bear1 AND h1 < l2 AND bull AND o > c1 AND o < o1 AND c > h1 AND c < l2"),
    ("upside_gap_three_methods", "bull", 3, 1, "bull2 AND bull1 AND bb1 > bt2 AND bear AND o > bb1 AND o < bt1 AND c > bb2 AND c < bt2"),
    ("downside_gap_three_methods", "bear", 3, -1, "bear2 AND bear1 AND bt1 < bb2 AND bull AND o > bb1 AND o < bt1 AND c > bb2 AND c < bt2"),
    ("advance_block", "bear", 3, 1, f"bull AND bull1 AND bull2 AND c > c1 AND c1 > c2 AND {_STEPS} AND body < body1 AND body1 < body2 AND us > us1"),
    ("bullish_tri_star", "bull", 3, -1, f"{_DOJIS} AND bt1 < bb2 AND bt1 < bb"),
    ("bearish_tri_star", "bear", 3, 1, f"{_DOJIS} AND bb1 > bt2 AND bb1 > bt"),
    ("bullish_hikkake", "bull", 3, 0, "h1 < h2 AND l1 > l2 AND h < h1 AND l < l1"),
    ("bearish_hikkake", "bear", 3, 0, "h1 < h2 AND l1 > l2 AND h > h1 AND l > l1"),
    ("ladder_bottom", "bull", 5, -1, f"{_run('bear', 2)} AND bear1 AND us1 > body1 AND bull AND o > bt1 AND c > h1"),
    ("mat_hold", "bull", 5, 1, f"bull4 AND {_LONG(4)} AND bb3 > c4 AND " + " AND ".join(f"{_SMALL(k)} AND bb{k} > bb4" for k in (1, 2, 3)) + " AND bull AND c > greatest(h1, h2, h3)"),
    ("bullish_breakaway", "bull", 5, -1, f"bear4 AND {_LONG(4)} AND bear3 AND bt3 < bb4 AND c2 < c3 AND bear1 AND c1 < c2 AND bull AND {_LONG('')} AND c > bt3 AND c < bb4"),
    ("bearish_breakaway", "bear", 5, 1, f"bull4 AND {_LONG(4)} AND bull3 AND bb3 > bt4 AND c2 > c3 AND bull1 AND c1 > c2 AND bear AND {_LONG('')} AND c < bb3 AND c > bt4"),
    ("bullish_three_line_strike", "bull", 4, -1, f"{_run('bear', 1)} AND bull AND o < c1 AND c > o3"),
    ("bearish_three_line_strike", "bear", 4, 1, f"{_run('bull', 1)} AND bear AND o > c1 AND c < o3"),
):
    register(*_spec)

CONTROLS = {
    "random_long": Pattern("random_long", "bull", 1, 0, "false", "control"),
    "random_short": Pattern("random_short", "bear", 1, 0, "false", "control"),
}


def gates(p: Pattern, t: Thresholds) -> str:
    """Enough history, and the trend just before the detector's first bar."""
    rule = f"bar_idx >= {p.bars - 1 + t.trend_lookback}"
    return f"{rule} AND lag(trend, {p.bars}) {OVER} = {p.trend}" if p.trend else rule


def masks(bars: DataFrame, t: Thresholds, names: list[str] | None = None) -> DataFrame:
    """Geometry with one boolean column for each pattern; all share the session's one exchange and sort."""
    chosen = [REGISTRY[n] for n in names or REGISTRY]
    rows = geometry(bars, t)
    own = {p.name: p.column(t) for p in chosen if not isinstance(p.rule, str)}
    if own:
        rows = rows.withColumns(own)
    return with_sql(rows, {p.name: f"coalesce(({p.name if p.name in own else p.sql(t)}) AND {gates(p, t)}, false)" for p in chosen})


def fired(what: dict[str, str]) -> str:
    """SQL of the array of what stands for each pattern that fires."""
    return f"filter(array({', '.join(f'CASE WHEN `{n}` THEN {x} END' for n, x in what.items())}), x -> x IS NOT NULL)"


def signals(bars: DataFrame, t: Thresholds, names: list[str] | None = None) -> DataFrame:
    """(symbol, interval, session, pattern, bar_idx) where a pattern fires."""
    chosen = list(names or REGISTRY)
    rows = masks(bars, t, chosen).select("symbol", "interval", "session", "bar_idx", F.explode(F.expr(fired({n: f"'{n}'" for n in chosen}))).alias("pattern"))
    return rows.select("symbol", "interval", "session", "pattern", "bar_idx")


def catalogue(names: list[str] | None = None) -> list[tuple[str, str, int, int, int, str]]:
    chosen = [REGISTRY[n] for n in names] if names else [*REGISTRY.values(), *CONTROLS.values()]
    return [(p.name, p.bias, p.direction, p.bars, p.trend, p.kind) for p in chosen]
