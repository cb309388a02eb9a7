"""SQL that gives the same rows as the queries, for a check by another engine."""

from __future__ import annotations

from signalforge.config import Costs, Stats, Thresholds, TradeRules
from signalforge.functions.geometry import BASE, LAGGED, LAGS
from signalforge.operators.patterns import REGISTRY

K = "symbol, interval, session"


def r6(x: str) -> str:
    """Six decimals, by the same arithmetic everywhere."""
    return f"floor({x} * 1000000.0 + 0.5) / 1000000.0"


TICKS = """ticks AS (
  SELECT event_type AS symbol, ts, value AS price, CAST(1 AS DOUBLE) AS size, user_id % 7 = 0 AS odd FROM events
)"""
RAW = """raw AS (
  SELECT symbol, '1h' AS interval, date_trunc('hour', ts) AS ts, arg_min(price, ts) AS open, max(price) AS high,
    min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume
  FROM ticks GROUP BY ALL
)"""


def bars(by: str = "week", shown: str = "") -> str:
    """shown: more rows of bars, as a UNION."""
    return f"""{TICKS}, {RAW}, bars AS (
  SELECT symbol, interval, CAST(date_trunc('{by}', ts) AS DATE) AS session, ts,
    CAST(row_number() OVER (PARTITION BY symbol, interval, date_trunc('{by}', ts) ORDER BY ts) - 1 AS INTEGER) AS bar_idx,
    open, high, low, close, volume,
    CAST(extract(hour FROM lts) * 60 + extract(minute FROM lts) - 570 AS INTEGER) AS minute
  FROM (SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lts FROM raw)
  WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 AND high >= greatest(open, close)
    AND low <= least(open, close) AND high >= low{shown}
)"""


def slope(n: int) -> str:
    mid, terms = (n - 1) / 2, []
    for k in range(1, n):
        at = "c" if k == n - 1 else f"lag(c, {n - 1 - k}) OVER w"
        terms.append(f"CAST({float(k - mid)} AS DOUBLE) * ({at} - lag(c, {n - 1}) OVER w)")
    norm = float(sum((k - mid) ** 2 for k in range(n)))
    return f"({' + '.join(terms)}) / CAST({norm} AS DOUBLE)"


def geometry(t: Thresholds, by: str = "week", shown: str = "") -> str:
    base = ", ".join(f"{v} AS {k}" for k, v in BASE.items())
    lags = ", ".join(f"lag({c}, {k}) OVER w AS {c}{k}" for k in range(1, LAGS + 1) for c in LAGGED)
    n = t.trend_lookback
    return f"""{bars(by, shown)}, base AS (SELECT *, {base} FROM bars), geo AS (
  SELECT *, {lags}, CASE WHEN bar_idx < {n - 1} THEN 0 WHEN {slope(n)} > 0 THEN 1 WHEN {slope(n)} < 0 THEN -1 ELSE 0 END AS trend
  FROM base WINDOW w AS (PARTITION BY {K} ORDER BY bar_idx)
)"""


def signals(t: Thresholds, names: list[str] | None = None, by: str = "week", shown: str = "") -> str:
    parts = []
    for p in (REGISTRY[n] for n in names or REGISTRY):
        gate = f" AND before{p.bars} = {p.trend}" if p.trend else ""
        parts.append(
            f"SELECT {K}, '{p.name}' AS pattern, {p.direction} AS direction, {p.bars} AS n, bar_idx FROM gated "
            f"WHERE ({p.sql(t)}) AND bar_idx >= {p.bars - 1 + t.trend_lookback}{gate}"
        )
    befores = ", ".join(f"lag(trend, {k}) OVER w AS before{k}" for k in range(1, 6))
    return f"""{geometry(t, by, shown)}, gated AS (
  SELECT *, {befores} FROM geo WINDOW w AS (PARTITION BY {K} ORDER BY bar_idx)
), signals AS ({' UNION ALL '.join(parts)})"""


def levels(rules: TradeRules) -> str:
    """From rows with entry and stop: risk, target and the last bar."""
    return f"""*, direction * (entry - stop) AS risk,
    entry + direction * (direction * (entry - stop)) * CAST({rules.reward_multiple} AS DOUBLE) AS target,
    least(entry_index + {rules.max_hold_bars - 1}, bars_in_session - 1) AS last_index"""


def entries(t: Thresholds, rules: TradeRules, names: list[str] | None = None, by: str = "week") -> str:
    lows = ", ".join(f"min(l) OVER (PARTITION BY {K} ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS lo{n}" for n in range(1, 6))
    highs = ", ".join(f"max(h) OVER (PARTITION BY {K} ORDER BY bar_idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS hi{n}" for n in range(1, 6))
    pick = " ".join(f"WHEN n = {n} THEN CASE WHEN direction > 0 THEN lo{n} ELSE hi{n} END" for n in range(1, 6))
    return f"""{signals(t, names, by)}, ahead AS (
  SELECT {K}, bar_idx, lead(o) OVER (PARTITION BY {K} ORDER BY bar_idx) AS next_open,
    count(*) OVER (PARTITION BY {K}) AS bars_in_session, {lows}, {highs} FROM geo
), raw_entries AS (
  SELECT {K}, pattern, direction, CAST(bars_in_session AS BIGINT) AS bars_in_session, bar_idx + 1 AS entry_index, next_open AS entry,
    (CASE {pick} END) * (1 - direction * CAST({rules.stop_buffer} AS DOUBLE)) AS stop
  FROM signals JOIN ahead USING ({K}, bar_idx) WHERE next_open IS NOT NULL
), entries AS (
  SELECT {levels(rules)} FROM raw_entries
  WHERE direction * (entry - stop) > 0 AND direction * (entry - stop) / entry >= {rules.min_risk_pct}
)"""


def exits(source: str, out: str, rules: TradeRules, key: str = f"{K}, pattern, entry_index") -> str:
    return f"""{out}_ahead AS (
  SELECT e.*, b.bar_idx AS x, b.close AS x_close,
    CASE WHEN direction > 0 THEN b.low <= stop ELSE b.high >= stop END AS stopped,
    CASE WHEN direction > 0 THEN b.high >= target ELSE b.low <= target END AS reached,
    CASE WHEN direction > 0 THEN b.open >= target ELSE b.open <= target END AS beyond,
    CASE WHEN direction > 0 THEN greatest(target, b.open) ELSE least(target, b.open) END AS at_target,
    CASE WHEN direction > 0 THEN least(stop, b.open) ELSE greatest(stop, b.open) END AS at_stop
  FROM {source} e JOIN bars b USING ({K}) WHERE b.bar_idx BETWEEN entry_index AND last_index
), {out} AS (
  SELECT * EXCLUDE (x, x_close, stopped, reached, beyond, at_target, at_stop), x AS exit_index,
    CASE WHEN reached AND (NOT stopped OR beyond) THEN at_target WHEN stopped THEN at_stop ELSE x_close END AS exit,
    CASE WHEN reached AND (NOT stopped OR beyond) THEN 'target' WHEN stopped THEN 'stop'
      WHEN entry_index + {rules.max_hold_bars - 1} <= bars_in_session - 1 THEN 'timeout' ELSE 'session_end' END AS exit_reason
  FROM {out}_ahead
  QUALIFY row_number() OVER (PARTITION BY {key}
    ORDER BY CASE WHEN stopped OR reached THEN 0 ELSE 1 END, CASE WHEN stopped OR reached THEN x ELSE -x END) = 1
)"""


def net(source: str, out: str, rules: TradeRules, costs: Costs) -> str:
    c, paid = costs.slippage_bps / 1e4, costs.commission / rules.risk_per_trade_usd
    return f"""{out}_filled AS (
  SELECT *, entry * (1 + direction * CAST({c!r} AS DOUBLE)) AS entry_price, exit * (1 - direction * CAST({c!r} AS DOUBLE)) AS exit_price,
    direction * (exit - entry) / risk AS gross_r FROM {source}
), {out} AS (
  SELECT *, direction * (exit_price - entry_price) / risk - CAST({paid!r} AS DOUBLE) AS net_r,
    direction * (exit_price - entry_price) / entry_price - CAST({paid!r} AS DOUBLE) * risk / entry_price AS return_pct,
    CAST({costs.slippage_bps} AS DOUBLE) AS cost_bps, exit_index - entry_index AS bars_held FROM {out}_filled
)"""


def all_trades(t: Thresholds, rules: TradeRules, costs: Costs, names: list[str] | None = None, by: str = "week") -> str:
    return f"{entries(t, rules, names, by)}, {exits('entries', 'exited', rules)}, {net('exited', 'candidates', rules, costs)}"


def trades(t: Thresholds, rules: TradeRules, costs: Costs, names: list[str] | None = None, by: str = "week") -> str:
    """Non-overlapping trades, picked one after another."""
    return f"""{all_trades(t, rules, costs, names, by)}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {K}, pattern ORDER BY entry_index) AS k FROM candidates
), picked AS (
  SELECT {K}, pattern, k, entry_index, exit_index, exit_index AS until, true AS taken FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.symbol, n.interval, n.session, n.pattern, n.k, n.entry_index, n.exit_index,
    CASE WHEN n.entry_index > p.until THEN n.exit_index ELSE p.until END, n.entry_index > p.until
  FROM picked p JOIN numbered n ON n.symbol = p.symbol AND n.interval = p.interval AND n.session = p.session
    AND n.pattern = p.pattern AND n.k = p.k + 1
), trades AS (
  SELECT c.* FROM candidates c JOIN picked p USING ({K}, pattern, entry_index) WHERE p.taken
)"""


def matched(rules: TradeRules, seed: int) -> str:
    """Controls of ``trades``."""
    pick = f"md5('{seed}|' || pattern || '|' || interval || '|' || symbol || '|' || session || '|' || entry_index)"
    return f"""room AS (
  SELECT *, least({rules.matched_window}, bars_in_session - 1 - entry_index) AS room FROM trades
), started AS (
  SELECT *, CAST(entry_index + 1 + CAST('0x' || substr({pick}, 1, 8) AS BIGINT) % room AS INTEGER) AS start FROM room WHERE room > 0
), closes AS (
  SELECT {K}, bar_idx, open, lag(close) OVER (PARTITION BY {K} ORDER BY bar_idx) AS before FROM bars
), raw_controls AS (
  SELECT s.symbol, s.interval, s.session, s.pattern, s.direction, s.bars_in_session, s.entry_index AS template_index,
    s.start AS entry_index, t.open AS entry, t.before - s.direction * (s.direction * (a.before - s.stop)) AS stop
  FROM started s
  JOIN closes a ON a.symbol = s.symbol AND a.interval = s.interval AND a.session = s.session AND a.bar_idx = s.entry_index
  JOIN closes t ON t.symbol = s.symbol AND t.interval = s.interval AND t.session = s.session AND t.bar_idx = s.start
), controls AS (
  SELECT {levels(rules)} FROM raw_controls
  WHERE direction * (entry - stop) > 0 AND direction * (entry - stop) / entry >= {rules.min_risk_pct}
), {exits('controls', 'control_exits', rules, f'{K}, pattern, template_index')}"""


def draws(totals: str, samples: int, seed: int) -> str:
    """Means of bootstrap draws over (pattern, interval, session, total, n)."""
    return f"""day AS (
  SELECT session, row_number() OVER (ORDER BY session) - 1 AS date_idx, count(*) OVER () AS days FROM (SELECT DISTINCT session FROM {totals})
), slot AS (
  SELECT i // d AS draw, i % d AS j, d FROM (SELECT max(days) AS d FROM day), unnest(range({samples} * d)) AS u(i)
), weight AS (
  SELECT draw, CAST('0x' || substr(md5('{seed}|' || draw || '|' || j), 1, 8) AS BIGINT) % d AS date_idx, count(*) AS w FROM slot GROUP BY ALL
), means AS (
  SELECT pattern, interval, draw, CASE WHEN sum(w * n) > 0 THEN sum(w * total) / sum(w * n) END AS mean
  FROM {totals} JOIN day USING (session) JOIN weight USING (date_idx) GROUP BY pattern, interval, draw
)"""


def default() -> tuple[Thresholds, TradeRules, Costs, Stats]:
    return Thresholds(), TradeRules(), Costs(), Stats()
