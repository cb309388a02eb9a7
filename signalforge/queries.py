"""Queries of the engine's operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalforge import detectors
from signalforge import oracles as sql
from signalforge.config import Config, Run, Stats, Thresholds, TradeRules
from signalforge.functions.geometry import geometry, rolling_max, rolling_min
from signalforge.operators import costs as cost
from signalforge.operators import drill, metrics, patterns, sampling, summary, ticker
from signalforge.operators import trades as trade
from signalforge.plans import run as plan
from signalforge.plans.run import grid
from signalforge.sources import bars as bar
from signalforge.sources import cache, fixtures, quotes, registry

T, RULES, COSTS, STATS = sql.default()
#: Bootstrap draws of the queries, as many as runs take.
DRAWS, SEED = STATS.bootstrap_samples, 42
KEY = bar.KEY


def r6(x: Column | str) -> Column:
    """Six decimals of a finite number; an infinite one stays."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(F.abs(x) < float("inf"), F.floor(x * 1000000.0 + 0.5) / 1000000.0).otherwise(x)


def _round(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def _own(spark: SparkSession, d: str, rules: TradeRules = RULES) -> DataFrame:
    return trade.trades(fixtures.bars(spark, d), T, rules, COSTS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str | Callable[[], str]] = {}


def query(oracle: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if oracle:
            SQL[f.__name__] = oracle
        return f

    return wrap


# -- bars ---------------------------------------------------------------------------------------


@query(f"WITH {sql.bars()} SELECT symbol, interval, session, bar_idx, open, high, low, close, volume FROM bars")
def bars_validate(spark, d):
    return fixtures.bars(spark, d).select(*KEY, "bar_idx", "open", "high", "low", "close", "volume")




@query(
    f"WITH {sql.TICKS}, {sql.RAW}, broken AS (SELECT *, CASE WHEN volume % 3 = 0 THEN -low ELSE low END AS l2 FROM raw) "
    "SELECT count(*) AS bars, count(*) FILTER (WHERE l2 <= 0) AS dropped FROM broken"
)
def bars_dropped_count(spark, d):
    raw = fixtures.raw_bars(spark, d)
    broken = raw.withColumn("low", F.when(F.col("volume") % 3 == 0, -F.col("low")).otherwise(F.col("low")))
    return broken.agg(F.count("*").alias("bars"), F.count_if(~bar.is_sound()).alias("dropped"))


@query(
    f"WITH {sql.bars()} SELECT symbol, interval, ts, minute FROM bars WHERE minute >= 0 AND minute < 390"
)
def regular_hours(spark, d):
    return bar.regular_hours(fixtures.bars(spark, d)).select("symbol", "interval", "ts", "minute")


@query(f"WITH {sql.bars('day')} SELECT symbol, session, count(*) AS bars, min(minute) AS first_minute FROM bars GROUP BY symbol, session")
def session_index(spark, d):
    return fixtures.bars(spark, d, "day").groupBy("symbol", "session").agg(F.count("*").alias("bars"), F.min("minute").alias("first_minute"))


@query(
    f"WITH {sql.bars('day')} SELECT interval, count(*) AS bars, "
    f"{sql.r6('avg(CASE WHEN open = high AND high = low AND low = close THEN 1.0 ELSE 0.0 END)')} AS flat_share FROM bars GROUP BY interval"
)
def flat_share(spark, d):
    return _round(bar.flat_share(fixtures.bars(spark, d, "day")), ["flat_share"])


@query(
    f"""WITH {sql.TICKS} SELECT symbol, '15m' AS interval, time_bucket(INTERVAL '15 minutes', ts) AS ts,
  arg_min(price, ts) FILTER (WHERE NOT odd) AS open, max(price) FILTER (WHERE NOT odd) AS high,
  min(price) FILTER (WHERE NOT odd) AS low, arg_max(price, ts) FILTER (WHERE NOT odd) AS close, sum(size) AS volume
FROM ticks GROUP BY ALL HAVING count(*) FILTER (WHERE NOT odd) > 0"""
)
def tick_resample(spark, d):
    return bar.resample_ticks(fixtures.ticks(spark, d), "15m", 900)


@query(
    f"""WITH {sql.bars('day')}, s AS (
  SELECT *, min(ts) OVER (PARTITION BY {sql.K}) AS start FROM bars
) SELECT symbol, '4h' AS interval, session, start + to_hours(CAST(4 * (CAST(epoch(ts - start) AS BIGINT) // 14400) AS INTEGER)) AS ts,
  arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
FROM s GROUP BY symbol, session, start, CAST(epoch(ts - start) AS BIGINT) // 14400"""
)
def coarse_resample(spark, d):
    return bar.resample_bars(fixtures.bars(spark, d, "day"), "4h", 240)


# -- geometry and detectors ---------------------------------------------------------------------

_GEO = ["rng", "body", "bt", "bb", "us", "ls", "br"]


@query(f"WITH {sql.geometry(T)} SELECT {sql.K}, bar_idx, {', '.join(_GEO)}, bull, bear, trend FROM geo")
def geometry_columns(spark, d):
    return geometry(fixtures.bars(spark, d), T).select(*KEY, "bar_idx", *_GEO, "bull", "bear", "trend")


@query(
    f"WITH {sql.geometry(T)} SELECT {sql.K}, bar_idx, o1, c2, h3, l4, "
    f"min(l) OVER (PARTITION BY {sql.K} ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS low5, "
    f"max(h) OVER (PARTITION BY {sql.K} ORDER BY bar_idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS high5 FROM geo"
)
def lags_and_extremes(spark, d):
    rows = geometry(fixtures.bars(spark, d), T)
    return rows.select(*KEY, "bar_idx", "o1", "c2", "h3", "l4", rolling_min("l", 5).alias("low5"), rolling_max("h", 5).alias("high5"))


@query(f"WITH {sql.signals(T)} SELECT {sql.K}, pattern, bar_idx FROM signals")
def signals(spark, d):
    return patterns.signals(fixtures.bars(spark, d), T)


#: Limits under which the tables' jumping prices show nearly every pattern.
WIDE = Thresholds(
    doji_body=0.3, small_body=0.7, long_body=0.2, near_equal=0.05, trend_lookback=3, opposite_shadow_max=0.4, doji_shadow_min=0.4, marubozu_body=0.7, shadow_dominance=1.5
)


def _detect(name: str, spark: SparkSession, d: str) -> DataFrame:
    """Signals of one detector on all bars that the tables hold: events by hours and five minutes, order lines by maker and day."""
    bars = fixtures.bars(spark, d).drop("ts").unionByName(fixtures.maker_bars(spark, d)).unionByName(fixtures.five_minute_bars(spark, d))
    return patterns.signals(bars, WIDE, [name])


for _name in patterns.REGISTRY:
    QUERIES[f"detect_{_name}"] = partial(_detect, _name)
    SQL[f"detect_{_name}"] = partial(detectors.detected, WIDE, _name)


@query(f"WITH {sql.signals(T)} SELECT pattern, symbol, count(*) AS signals FROM signals GROUP BY pattern, symbol")
def signal_counts(spark, d):
    return patterns.signals(fixtures.bars(spark, d), T).groupBy("pattern", "symbol").agg(F.count("*").alias("signals"))


_RATES = f"""rates AS (
  SELECT g.symbol, g.interval, g.session, max(e) AS eligible, max(coalesce(f, 0) / nullif(e, 0)) AS rate FROM (
    SELECT {sql.K}, count(*) FILTER (WHERE bar_idx >= {T.trend_lookback}) AS e FROM bars GROUP BY {sql.K}) g
  LEFT JOIN (SELECT {sql.K}, pattern, count(*) FILTER (WHERE bar_idx >= {T.trend_lookback}) AS f FROM signals GROUP BY {sql.K}, pattern) s
    ON s.symbol = g.symbol AND s.interval = g.interval AND s.session = g.session
  GROUP BY g.symbol, g.interval, g.session
)"""


@query(f"WITH {sql.signals(T)}, {_RATES} SELECT {sql.K}, eligible, {sql.r6('coalesce(rate, 0)')} AS rate FROM rates")
def control_rate(spark, d):
    names = list(patterns.REGISTRY)
    return _round(sampling.matched_rate(patterns.masks(fixtures.bars(spark, d), T), names, T.trend_lookback), ["rate"])


@query(
    f"""WITH {sql.signals(T)}, {_RATES} SELECT b.symbol, b.interval, b.session, 'random_long' AS pattern, bar_idx
FROM bars b JOIN rates r ON b.symbol = r.symbol AND b.interval = r.interval AND b.session = r.session
WHERE bar_idx >= {T.trend_lookback} QUALIFY row_number() OVER (PARTITION BY b.symbol, b.interval, b.session
  ORDER BY md5('{SEED}|random_long|' || b.symbol || '|' || b.interval || '|' || b.session || '|' || bar_idx), bar_idx)
  <= round_even(coalesce(rate, 0) * eligible, 0)"""
)
def control_mask(spark, d):
    bars = fixtures.bars(spark, d)
    rates = sampling.matched_rate(patterns.masks(bars, T), list(patterns.REGISTRY), T.trend_lookback)
    return sampling.control_mask(bars, rates, T.trend_lookback, SEED, "random_long")


# -- trades -------------------------------------------------------------------------------------

_ENTRY = ["entry", "stop", "risk", "target"]
_COLS = f"{sql.K}, pattern, direction, entry_index"


@query(f"WITH {sql.entries(T, RULES)} SELECT {_COLS}, {', '.join(f'{sql.r6(c)} AS {c}' for c in _ENTRY)} FROM entries")
def candidates(spark, d):
    rows = trade.entries(fixtures.bars(spark, d), T, RULES)
    return _round(rows.select(*KEY, "pattern", "direction", "entry_index", *_ENTRY), _ENTRY)


@query(
    f"WITH {sql.entries(T, RULES)}, {sql.exits('entries', 'exited', RULES)} "
    f"SELECT {_COLS}, exit_index, exit_reason, {sql.r6('exit')} AS exit FROM exited"
)
def exits_first_touch(spark, d):
    bars = fixtures.bars(spark, d)
    rows = trade.exits(trade.entries(bars, T, RULES), bars, RULES)
    return _round(rows.select(*KEY, "pattern", "direction", "entry_index", "exit_index", "exit_reason", "exit"), ["exit"])


_NET = ["entry_price", "exit_price", "gross_r", "net_r", "return_pct", "cost_bps"]


@query(f"WITH {sql.all_trades(T, RULES, COSTS)} SELECT {_COLS}, exit_index, bars_held, {', '.join(f'{sql.r6(c)} AS {c}' for c in _NET)} FROM candidates")
def trades_overlap_allowed(spark, d):
    rows = _own(spark, d, TradeRules(allow_overlapping_trades=True))
    return _round(rows.select(*KEY, "pattern", "direction", "entry_index", "exit_index", "bars_held", *_NET), _NET)


_TRADES = sql.trades(T, RULES, COSTS)


@query(f"WITH RECURSIVE {_TRADES} SELECT {_COLS}, exit_index, exit_reason, {sql.r6('net_r')} AS net_r FROM trades")
def trades_nonoverlap(spark, d):
    rows = _own(spark, d)
    return _round(rows.select(*KEY, "pattern", "direction", "entry_index", "exit_index", "exit_reason", "net_r"), ["net_r"])


@query(
    f"WITH RECURSIVE {_TRADES}, {sql.matched(RULES, SEED)} SELECT {_COLS}, template_index, exit_index, exit_reason, "
    f"{sql.r6('entry')} AS entry, {sql.r6('stop')} AS stop, {sql.r6('exit')} AS exit FROM control_exits"
)
def matched_controls(spark, d):
    bars = fixtures.bars(spark, d)
    rows = trade.matched(_own(spark, d), bars, RULES, SEED)
    figures = ["entry", "stop", "exit"]
    return _round(rows.select(*KEY, "pattern", "direction", "entry_index", "template_index", "exit_index", "exit_reason", *figures), figures)


# -- costs --------------------------------------------------------------------------------------


@query(
    f"""WITH {sql.bars('day')}, p AS (
  SELECT *, lead(high) OVER w AS h2, lead(low) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY {sql.K} ORDER BY bar_idx)
), a AS (
  SELECT {sql.K}, h2, pow(ln(high / low), 2) + pow(ln(h2 / l2), 2) AS one, pow(ln(greatest(high, h2) / least(low, l2)), 2) AS two FROM p
), b AS (
  SELECT *, (sqrt(2 * one) - sqrt(one)) / (3 - 2 * sqrt(2)) - sqrt(two / (3 - 2 * sqrt(2))) AS alpha FROM a
) SELECT {sql.K}, {sql.r6("avg(CASE WHEN h2 IS NOT NULL THEN greatest(0.0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))) END)")} AS spread FROM b GROUP BY {sql.K}"""
)
def corwin_schultz(spark, d):
    return _round(cost.corwin_schultz(fixtures.bars(spark, d, "day")), ["spread"])


_QUOTES = """q AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(l_partkey % 390 AS INTEGER) AS minute,
    l_extendedprice / l_quantity * (1 - l_discount) AS bp, l_extendedprice / l_quantity * (1 + l_tax) AS ap FROM lineitem
), s AS (
  SELECT symbol, day, CASE WHEN minute < 30 THEN 'open' WHEN minute >= 360 THEN 'close' ELSE 'midday' END AS bucket,
    (ap - bp) / ((ap + bp) / 2) * 10000 / 2 AS s FROM q WHERE bp > 0 AND ap > bp
), qt AS (
  SELECT symbol, bucket, median(s) AS half_spread_bps FROM (SELECT symbol, bucket, day, median(s) AS s FROM s GROUP BY ALL) GROUP BY ALL
)"""


_SAMPLED = _QUOTES.replace("FROM lineitem", "FROM lineitem WHERE l_partkey % 390 IN (1, 10, 25, 60, 180, 300, 361, 372, 385) AND l_linenumber < 2")


@query(f"WITH {_SAMPLED} SELECT symbol, bucket, {sql.r6('half_spread_bps')} AS half_spread_bps FROM qt")
def quote_table_sampled(spark, d):
    """The table from the quotes at each bucket's sample points alone."""
    return _round(cost.quote_table(quotes.sampled(fixtures.quotes(spark, d))), ["half_spread_bps"])


@query(f"WITH {_QUOTES} SELECT symbol, bucket, {sql.r6('half_spread_bps')} AS half_spread_bps FROM qt")
def quote_table(spark, d):
    return _round(cost.quote_table(fixtures.quotes(spark, d)), ["half_spread_bps"])


@query(
    f"""WITH {sql.bars()}, {_QUOTES}, half AS (SELECT * FROM qt WHERE bucket <> 'open'),
b AS (SELECT *, CASE symbol WHEN 'view' THEN 'R' WHEN 'click' THEN 'N' ELSE symbol END AS s2,
  CASE WHEN minute < 30 THEN 'open' WHEN minute >= 360 THEN 'close' ELSE 'midday' END AS bucket FROM bars)
SELECT b.symbol, b.session, bar_idx, CASE WHEN o.half_spread_bps IS NOT NULL THEN 'observed' WHEN r.m IS NOT NULL THEN 'imputed' ELSE 'fallback' END AS cost_source,
  {sql.r6("coalesce(coalesce(o.half_spread_bps, r.m) / 10000, 0.0001)")} AS cost
FROM b LEFT JOIN half o ON o.symbol = b.s2 AND o.bucket = b.bucket
LEFT JOIN (SELECT symbol, avg(half_spread_bps) AS m FROM half GROUP BY symbol) r ON r.symbol = b.s2"""
)
def quote_lookup(spark, d):
    table = cost.quote_table(fixtures.quotes(spark, d)).filter("bucket <> 'open'")
    named = F.when(F.col("symbol") == "view", "R").when(F.col("symbol") == "click", "N").otherwise(F.col("symbol"))
    rows = fixtures.bars(spark, d).withColumns({"own": F.col("symbol"), "symbol": named})
    rows = cost.priced(rows, table, COSTS)
    return _round(rows.select(F.col("own").alias("symbol"), "session", "bar_idx", "cost_source", "cost"), ["cost"])


@query(
    f"""WITH {sql.bars()}, {_QUOTES}, half AS (SELECT * FROM qt WHERE bucket <> 'open'),
b AS (SELECT *, CASE symbol WHEN 'view' THEN 'R' WHEN 'click' THEN 'N' ELSE symbol END AS s2,
  CASE WHEN minute < 30 THEN 'open' WHEN minute >= 360 THEN 'close' ELSE 'midday' END AS bucket FROM bars),
x AS (SELECT b.interval, CASE WHEN o.half_spread_bps IS NOT NULL THEN 'observed' WHEN r.symbol IS NOT NULL THEN 'imputed' ELSE 'fallback' END AS cost_source
FROM b LEFT JOIN half o ON o.symbol = b.s2 AND o.bucket = b.bucket LEFT JOIN (SELECT DISTINCT symbol FROM half) r ON r.symbol = b.s2)
SELECT interval, cost_source, count(*) AS bars, {sql.r6("count(*) / sum(count(*)) OVER (PARTITION BY interval)")} AS share FROM x GROUP BY interval, cost_source"""
)
def quote_source_shares(spark, d):
    table = cost.quote_table(fixtures.quotes(spark, d)).filter("bucket <> 'open'")
    named = F.when(F.col("symbol") == "view", "R").when(F.col("symbol") == "click", "N").otherwise(F.col("symbol"))
    return _round(quotes.source_shares(cost.priced(fixtures.bars(spark, d).withColumn("symbol", named), table, COSTS)), ["share"])


_ESTIMATED = f"""p AS (
  SELECT *, lead(high) OVER w AS h2, lead(low) OVER w AS l2 FROM bars WINDOW w AS (PARTITION BY {sql.K} ORDER BY bar_idx)
), a AS (
  SELECT {sql.K}, h2, pow(ln(high / low), 2) + pow(ln(h2 / l2), 2) AS one, pow(ln(greatest(high, h2) / least(low, l2)), 2) AS two FROM p
), b AS (
  SELECT *, (sqrt(2 * one) - sqrt(one)) / (3 - 2 * sqrt(2)) - sqrt(two / (3 - 2 * sqrt(2))) AS alpha FROM a
), spread AS (
  SELECT symbol, session, avg(CASE WHEN h2 IS NOT NULL THEN greatest(0.0, 2 * (exp(alpha) - 1) / (1 + exp(alpha))) END) AS spread FROM b GROUP BY symbol, session
)"""
#: Prices of the tables move far more than a market's; a session's highs are drawn to its lows by a divisor of its own.
_CALMED = "SELECT * REPLACE (low + (high - low) / (500 + 400 * (dayofyear(session) % 7)) AS high) FROM bars"


@query(
    f"""WITH {sql.bars('day').replace('bars AS (', 'wide AS (')}, bars AS ({_CALMED.replace('FROM bars', 'FROM wide')}), {_ESTIMATED}
SELECT symbol, session, {sql.r6('spread')} AS spread, {sql.r6('CASE WHEN spread IS NULL OR spread <= 0 OR spread > 0.02 THEN 0.0001 ELSE spread / 2 END')} AS cost FROM spread"""
)
def spread_costs(spark, d):
    """What a session is charged: half its estimated spread, or the fixed cost where the estimate is none or implausible."""
    part = 500 + 400 * (F.dayofyear("session") % 7)
    bars = fixtures.bars(spark, d, "day").withColumn("high", F.col("low") + (F.col("high") - F.col("low")) / part)
    return _round(cost.estimated(bars, COSTS), ["spread", "cost"])


@query(
    f"""WITH {sql.bars()} SELECT interval, count(DISTINCT symbol) AS symbols, count(DISTINCT session) AS dates, count(DISTINCT symbol || '|' || session) AS sessions,
count(*) AS bars, CAST(min(session) AS VARCHAR) AS first_session, CAST(max(session) AS VARCHAR) AS last_session FROM bars GROUP BY interval"""
)
def cache_description(spark, d):
    rows = cache.description(fixtures.bars(spark, d))
    return rows.withColumns({c: F.col(c).cast("string") for c in ("first_session", "last_session")})


@query(f"WITH {sql.bars('day')} SELECT symbol, session, CAST(row_number() OVER (PARTITION BY symbol ORDER BY session DESC) AS INTEGER) AS place FROM (SELECT DISTINCT symbol, session FROM bars) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY session DESC) <= 5")
def newest_sessions(spark, d):
    return cache.newest_sessions(fixtures.bars(spark, d, "day"), 5)


@query(f"WITH {sql.bars()} SELECT symbol, CAST(ts AS VARCHAR) AS at, open, high, low, close, volume FROM bars")
def wide_extract(spark, d):
    """Bars from a wide table with one row for each time, as a download of several symbols gives them."""
    bars = fixtures.bars(spark, d)
    fields = ("open", "high", "low", "close", "volume")
    wide = bars.groupBy("ts").pivot("symbol").agg(*[F.first(c).alias(c) for c in fields])
    named = [F.col(f"`{c}`").alias(".".join(c.rsplit("_", 1))) for c in wide.columns if c != "ts"]
    return registry.extracted(wide.select("ts", *named)).select("symbol", F.col("ts").cast("string").alias("at"), *fields)


# -- statistics ---------------------------------------------------------------------------------

_FIGURES = ["win_rate", "expectancy_r", "gross_expectancy_r", "total_return_pct", "avg_bars_held", "profit_factor", "sharpe_per_trade"]
_SUMMARY = """count(net_r) AS trades, count(DISTINCT session) AS sessions,
  avg(CASE WHEN net_r > 0 THEN 1.0 WHEN net_r IS NOT NULL THEN 0.0 END) AS win_rate, avg(net_r) AS expectancy_r,
  avg(gross_r) AS gross_expectancy_r, sum(return_pct) AS total_return_pct, avg(bars_held) AS avg_bars_held,
  CASE WHEN sum(CASE WHEN net_r < 0 THEN -net_r END) > 0
    THEN coalesce(sum(CASE WHEN net_r > 0 THEN net_r END), 0) / sum(CASE WHEN net_r < 0 THEN -net_r END)
    WHEN sum(CASE WHEN net_r > 0 THEN net_r END) > 0 THEN 'inf'::DOUBLE END AS profit_factor,
  avg(net_r) / nullif(stddev_samp(net_r), 0) AS sharpe_per_trade"""
_GRID = "grid AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in patterns.REGISTRY) + "]) AS pattern, '1h' AS interval)"


@query(
    f"WITH RECURSIVE {_TRADES}, {_GRID}, x AS (SELECT g.pattern, g.interval, {_SUMMARY} FROM grid g LEFT JOIN trades t "
    f"ON g.pattern = t.pattern AND g.interval = t.interval GROUP BY g.pattern, g.interval) "
    f"SELECT pattern, interval, trades, sessions, {', '.join(f'{sql.r6(c)} AS {c}' for c in _FIGURES)} FROM x"
)
def summarise(spark, d):
    rows = metrics.summarise(_own(spark, d), grid(spark, ["1h"]))
    return _round(rows.select("pattern", "interval", "trades", "sessions", *_FIGURES), _FIGURES)


@query(
    f"WITH RECURSIVE {_TRADES}, x AS (SELECT pattern, i.interval, {_SUMMARY} FROM trades t, (VALUES ('1h'), ('all')) i(interval) GROUP BY pattern, i.interval) "
    f"SELECT pattern, interval, trades, sessions, {', '.join(f'{sql.r6(c)} AS {c}' for c in _FIGURES)} FROM x"
)
def summarise_pooled(spark, d):
    own = metrics.pooled(_own(spark, d))
    rows = metrics.summarise(own, own.select("pattern", "interval").distinct())
    return _round(rows.select("pattern", "interval", "trades", "sessions", *_FIGURES), _FIGURES)


_EQUITY = f"""timed AS (
  SELECT t.*, b.minute AS entry_minute FROM trades t
  JOIN bars b ON b.symbol = t.symbol AND b.interval = t.interval AND b.session = t.session AND b.bar_idx = t.entry_index
), eq AS (
  SELECT pattern, interval, session, row_number() OVER w AS trade_no,
    sum(net_r) OVER (PARTITION BY pattern, interval ORDER BY session, entry_minute, symbol, entry_index ROWS UNBOUNDED PRECEDING) AS equity_r
  FROM timed WINDOW w AS (PARTITION BY pattern, interval ORDER BY session, entry_minute, symbol, entry_index)
), pk AS (
  SELECT *, greatest(0, max(equity_r) OVER (PARTITION BY pattern, interval ORDER BY trade_no ROWS UNBOUNDED PRECEDING)) AS peak_r FROM eq
)"""


@query(f"WITH RECURSIVE {_TRADES}, {_EQUITY} SELECT pattern, interval, session, CAST(trade_no AS INTEGER) AS trade_no, {sql.r6('equity_r')} AS equity_r, {sql.r6('peak_r')} AS peak_r FROM pk")
def equity_curve(spark, d):
    rows = metrics.equity(_own(spark, d)).select("pattern", "interval", "session", "trade_no", "equity_r", "peak_r")
    return _round(rows, ["equity_r", "peak_r"])


@query(f"WITH RECURSIVE {_TRADES}, {_EQUITY} SELECT pattern, interval, {sql.r6('max(peak_r - equity_r)')} AS max_drawdown_r FROM pk GROUP BY pattern, interval")
def max_drawdown(spark, d):
    return _round(metrics.max_drawdown(_own(spark, d)), ["max_drawdown_r"])


@query(f"WITH RECURSIVE {_TRADES} SELECT pattern, exit_reason, {sql.r6('count(*) / sum(count(*)) OVER (PARTITION BY pattern)')} AS share FROM trades GROUP BY pattern, exit_reason")
def exit_reason_mix(spark, d):
    rows = metrics.exit_mix(_own(spark, d)).select("pattern", F.explode("exit_mix").alias("exit_reason", "share"))
    return _round(rows, ["share"])


_LOOSE = Stats(min_trades_per_trial=2, min_trades=3)


@query(
    f"WITH RECURSIVE {_TRADES}, p AS (SELECT pattern, interval, symbol, session, count(*) AS n, avg(net_r) AS m FROM trades GROUP BY ALL) "
    f"SELECT pattern, interval, {sql.r6('avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END)')} AS consistency, count(*) AS trials FROM p WHERE n >= 2 GROUP BY pattern, interval"
)
def consistency(spark, d):
    return _round(metrics.consistency(_own(spark, d), _LOOSE), ["consistency"])


_WINDOWED = "w AS (SELECT *, month(session) AS win FROM trades), p AS (SELECT pattern, interval, win, count(*) AS n, avg(net_r) AS m FROM w GROUP BY ALL)"


@query(
    f"WITH RECURSIVE {_TRADES}, {_WINDOWED} SELECT pattern, interval, count(*) AS windows, "
    f"{sql.r6('CASE WHEN count(*) >= 2 THEN avg(CASE WHEN m > 0 THEN 1.0 ELSE 0.0 END) END')} AS stability FROM p WHERE n >= 3 GROUP BY pattern, interval"
)
def stability(spark, d):
    own = _own(spark, d).withColumn("window", F.month("session"))
    rows = metrics.stability(own, _LOOSE)
    return _round(rows.select("pattern", "interval", F.size("window_expectancy_r").cast("long").alias("windows"), "stability"), ["stability"])


def _breakdown(by: str, spark: SparkSession, d: str) -> DataFrame:
    own = _own(spark, d).withColumn("time_of_day", cost.time_bucket(F.col("entry_minute")))
    rows = metrics.breakdown(own, by)
    mix = F.array_join(F.transform(F.array_sort(F.map_entries("exit_mix")), lambda e: F.concat(e.key, F.lit("="), F.round(e.value * 1000).cast("long"))), ";")
    return _round(rows.withColumn("exit_mix", mix), ["win_rate", "expectancy_r", "total_r"])


for _by in ("symbol", "exit_reason", "session", "time_of_day"):
    QUERIES[f"breakdown_{_by}"] = partial(_breakdown, _by)
    _from = "trades"
    if _by == "time_of_day":
        _from = (
            "(SELECT t.*, CASE WHEN minute < 30 THEN 'open' WHEN minute >= 360 THEN 'close' ELSE 'midday' END AS time_of_day FROM trades t "
            "JOIN bars b ON b.symbol = t.symbol AND b.interval = t.interval AND b.session = t.session AND b.bar_idx = t.entry_index)"
        )
    _place = f"list_position(['open', 'midday', 'close', 'unknown'], {_by})" if _by == "time_of_day" else _by
    SQL[f"breakdown_{_by}"] = (
        f"WITH RECURSIVE {_TRADES}, cut AS (SELECT * FROM {_from}), shares AS ("
        f"SELECT pattern, {_by}, string_agg(exit_reason || '=' || CAST(round(1000.0 * n / total) AS BIGINT), ';' ORDER BY exit_reason) AS exit_mix FROM ("
        f"SELECT pattern, {_by}, exit_reason, count(*) AS n, sum(count(*)) OVER (PARTITION BY pattern, {_by}) AS total FROM cut GROUP BY pattern, {_by}, exit_reason) GROUP BY pattern, {_by}) "
        f"SELECT c.pattern, c.{_by}, count(*) AS trades, "
        f"{sql.r6('avg(CASE WHEN net_r > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate, {sql.r6('avg(net_r)')} AS expectancy_r, "
        f"{sql.r6('sum(net_r)')} AS total_r, any_value(s.exit_mix) AS exit_mix, "
        f"CAST(row_number() OVER (PARTITION BY c.pattern ORDER BY {_place.replace(_by, 'c.' + _by)}) - 1 AS INTEGER) AS place "
        f"FROM cut c JOIN shares s ON s.pattern = c.pattern AND s.{_by} = c.{_by} GROUP BY c.pattern, c.{_by}"
    )

_TOTALS = """totals AS (
  SELECT k.pattern, k.interval, d.session, coalesce(sum(net_r), 0) AS total, count(net_r) AS n
  FROM (SELECT DISTINCT pattern, interval FROM trades) k, (SELECT DISTINCT session FROM bars) d
  LEFT JOIN trades t ON t.pattern = k.pattern AND t.interval = k.interval AND t.session = d.session
  GROUP BY k.pattern, k.interval, d.session
)"""
_DAILY = sql.trades(T, RULES, COSTS, by="day")


def _totals(spark: SparkSession, d: str) -> DataFrame:
    bars = fixtures.bars(spark, d, "day")
    return metrics.date_totals(trade.trades(bars, T, RULES, COSTS), bars)


@query(f"WITH RECURSIVE {_DAILY}, {_TOTALS} SELECT pattern, interval, session, {sql.r6('total')} AS total, n FROM totals")
def date_totals(spark, d):
    return _round(_totals(spark, d), ["total"])


@query(f"WITH RECURSIVE {_DAILY}, {_TOTALS}, {sql.draws('totals', DRAWS, SEED)} SELECT pattern, interval, draw, {sql.r6('mean')} AS mean FROM means")
def bootstrap_draws(spark, d):
    bars = fixtures.bars(spark, d, "day")
    return _round(metrics.bootstrap_draws(trade.trades(bars, T, RULES, COSTS), bars, DRAWS, SEED), ["mean"])


_EVIDENCE = f"""est AS (SELECT pattern, interval, avg(net_r) AS estimate FROM trades GROUP BY ALL), ev0 AS (
  SELECT m.pattern, m.interval, count(mean) AS finite, quantile_cont(mean, [0.025, 0.975]) AS ci,
    count(*) FILTER (WHERE mean IS NULL OR abs(mean - estimate) >= abs(estimate) - 1e-12) AS against
  FROM means m JOIN est e ON e.pattern = m.pattern AND e.interval = m.interval GROUP BY m.pattern, m.interval
), ev AS (
  SELECT pattern, interval, CASE WHEN finite >= {0.95 * DRAWS} THEN ci[1] END AS ci_low, CASE WHEN finite >= {0.95 * DRAWS} THEN ci[2] END AS ci_high,
    CASE WHEN finite >= {0.95 * DRAWS} THEN (against + 1) / {DRAWS + 1}.0 END AS p_value FROM ev0
)"""


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    bars = fixtures.bars(spark, d, "day")
    return metrics.tested(metrics.totals_of(trade.trades(bars, T, RULES, COSTS), None, bars), spark, DRAWS, SEED)


@query(f"WITH RECURSIVE {_DAILY}, {_TOTALS}, {sql.draws('totals', DRAWS, SEED)}, {_EVIDENCE} SELECT pattern, interval, {', '.join(f'{sql.r6(c)} AS {c}' for c in ('ci_low', 'ci_high', 'p_value'))} FROM ev")
def bootstrap_ci(spark, d):
    figures = ["ci_low", "ci_high", "p_value"]
    return _round(_evidence(spark, d).select("pattern", "interval", *figures), figures)


@query(
    f"""WITH RECURSIVE {_DAILY}, {_TOTALS}, {sql.draws('totals', DRAWS, SEED)}, {_EVIDENCE}, k AS (
  SELECT *, row_number() OVER (ORDER BY coalesce(p_value, 1), pattern, interval) AS r, count(*) OVER () AS m FROM ev
) SELECT pattern, interval, {sql.r6("CASE WHEN p_value IS NOT NULL THEN least(1, max((m - r + 1) * coalesce(p_value, 1)) OVER (ORDER BY r)) END")} AS p_adjusted FROM k"""
)
def holm(spark, d):
    return _round(metrics.holm(_evidence(spark, d), STATS).select("pattern", "interval", "p_adjusted"), ["p_adjusted"])


@query(
    "WITH RECURSIVE "
    + f"{_DAILY}, {_TOTALS}, "
    + ", ".join(
        sql.draws("totals", 2000, k).replace("day AS", f"day{k} AS").replace("JOIN day USING", f"JOIN day{k} USING").replace("FROM day)", f"FROM day{k})")
        .replace("slot AS", f"slot{k} AS").replace("FROM slot", f"FROM slot{k}").replace("weight AS", f"weight{k} AS").replace("JOIN weight", f"JOIN weight{k}").replace("means AS", f"means{k} AS")
        for k in (1, 2, 3)
    )
    + """, est AS (SELECT pattern, interval, avg(net_r) AS estimate FROM trades GROUP BY ALL),
m AS (SELECT 1 AS seed, * FROM means1 UNION ALL SELECT 2, * FROM means2 UNION ALL SELECT 3, * FROM means3),
e AS (SELECT seed, m.pattern, m.interval, count(mean) AS finite, quantile_cont(mean, 0.025) AS ci_low,
  (count(*) FILTER (WHERE mean IS NULL OR abs(mean - estimate) >= abs(estimate) - 1e-12) + 1) / 2001.0 AS p FROM m JOIN est USING (pattern, interval) GROUP BY ALL)
SELECT seed, interval, count(*) AS rows, count(*) FILTER (WHERE finite >= 1900 AND p <= 0.05 AND ci_low > 0) AS positive_expectancy FROM e GROUP BY seed, interval"""
)
def null_calibration(spark, d):
    """How many patterns' unadjusted tests pass, by seed of the draws."""
    bars = fixtures.bars(spark, d, "day")
    totals = metrics.totals_of(trade.trades(bars, T, RULES, COSTS), None, bars)
    rows = [metrics.tested(totals, spark, 2000, k).withColumn("seed", F.lit(k)) for k in (1, 2, 3)]
    told = {"p_adjusted": F.col("p_value"), "delta_p_adjusted": F.lit(None).cast("double"), "verdict": F.lit(""), "kind": F.lit("pattern")}
    found = summary.calibration(reduce(DataFrame.unionByName, rows).withColumns(told))
    return found.select("seed", "interval", "rows", "positive_expectancy")


@query(f"WITH RECURSIVE {_TRADES} SELECT interval, 2 * count(cost_bps) AS legs_priced, {sql.r6('avg(cost_bps)')} AS mean_cost_bps FROM trades GROUP BY interval")
def executed_cost(spark, d):
    return _round(summary.executed_cost(_own(spark, d)), ["mean_cost_bps"])


# -- sampling -----------------------------------------------------------------------------------

_RUN_DATES = """pool AS (SELECT DISTINCT symbol, session FROM bars), dd AS (
  SELECT session, row_number() OVER (ORDER BY session DESC) AS k, count(*) OVER () AS d FROM (SELECT DISTINCT session FROM pool)
), dates AS (
  SELECT session, CASE WHEN k <= least(ceil(d * CAST(0.2 AS DOUBLE)), d - 1) THEN 'validation' ELSE 'discovery' END AS sample FROM dd
), split AS (
  SELECT *, CASE WHEN sample = 'validation' THEN 0 ELSE CAST(ntile(3) OVER (PARTITION BY sample ORDER BY session) - 1 AS INTEGER) END AS win FROM dates
)"""


def _run(trials: int = 40) -> Run:
    return Run(trials=trials, seed=SEED, windows=3, holdout_fraction=0.2)


@query(f"WITH {sql.bars('day')}, {_RUN_DATES} SELECT session, sample, win AS \"window\" FROM split")
def holdout_split(spark, d):
    return sampling.dates(sampling.session_pool(fixtures.bars(spark, d, "day")), _run())


def _drawn(trials: int) -> str:
    """Each window's trials by place, or by a draw of their own where it has fewer sessions than trials."""
    held = -(-trials // 5)
    share, more = divmod(trials - held, 3)
    sizes = ", ".join(f"('discovery', {w}, {share + (w < more)}, {share * w + min(w, more)})" for w in range(3))
    return f"""WITH {sql.bars('day')}, {_RUN_DATES}, placed AS (
  SELECT symbol, session, sample, win, row_number() OVER (PARTITION BY sample, win ORDER BY md5('{SEED}|' || symbol || '|' || session), symbol, session) - 1 AS place,
    count(*) OVER (PARTITION BY sample, win) AS size FROM pool JOIN split USING (session)
), asked AS (
  SELECT sample, CAST(win AS INTEGER) AS win, n, first, k, CAST('0x' || substr(md5('{SEED}|' || sample || '|' || win || '|' || k), 1, 8) AS BIGINT) AS seed
  FROM (VALUES {sizes}, ('validation', 0, {held}, {trials - held})) AS w(sample, win, n, first), unnest(range(n)) AS u(k)
)
SELECT CAST(first + k AS INTEGER) AS trial_index, symbol, session, seed, a.win AS "window", a.sample FROM asked a JOIN placed p
ON p.sample = a.sample AND p.win = a.win AND p.place = CASE WHEN n <= size THEN k ELSE seed % size END"""


@query(_drawn(40))
def draw_trials(spark, d):
    return sampling.draw_trials(sampling.session_pool(fixtures.bars(spark, d, "day")), _run())


@query(_drawn(5000))
def draw_trials_with_replacement(spark, d):
    """More trials than there are sessions: each draws its session by itself."""
    return sampling.draw_trials(sampling.session_pool(fixtures.bars(spark, d, "day")), _run(5000))


@query(f"WITH {sql.bars('day')}, n AS (SELECT interval, count(*) AS n FROM bars GROUP BY {sql.K}) SELECT interval, count(*) AS sessions, count(*) FILTER (WHERE n < 24) AS skipped FROM n GROUP BY interval")
def skipped_sessions(spark, d):
    return sampling.skipped(fixtures.bars(spark, d, "day"), 20)


@query(f"WITH {sql.bars('day')}, n AS (SELECT interval, count(*) AS n FROM bars GROUP BY {sql.K}) SELECT interval, CAST(least(30, greatest(2, trunc(median(n) - 10))) AS INTEGER) AS trend_lookback FROM n GROUP BY interval")
def trend_window_reduction(spark, d):
    return sampling.trend_lookback(fixtures.bars(spark, d, "day"), 30)


# -- whole runs ---------------------------------------------------------------------------------

_VERDICT = ["expectancy_r", "ci_low", "ci_high", "p_value", "p_adjusted", "delta_r", "delta_p_value", "delta_p_adjusted"]


@query()
def run_verdicts(spark, d):
    """Discovery, confirmation and rank of every pattern and both controls, with costs estimated from the bars."""
    bars = fixtures.bars(spark, d, "day")
    rows = plan.run(bars, Config(), None, plan.estimated_costs(bars, Config()))
    return _round(rows.select("rank", "pattern", "interval", "kind", "trades", "verdict", *_VERDICT), _VERDICT)


# -- drill-down and ticker ----------------------------------------------------------------------


@query(
    f"WITH RECURSIVE {_TRADES} SELECT session, pattern, symbol, entry_index, exit_reason, {sql.r6('net_r')} AS net_r FROM trades "
    "WHERE exit_reason = 'target' ORDER BY bars_held DESC, session, pattern, interval, symbol, entry_index LIMIT 50 OFFSET 20"
)
def trades_page(spark, d):
    rows = drill.page(_own(spark, d), {"exit_reason": "target"}, "bars_held", True, 20, 50)
    return _round(rows.select("session", "pattern", "symbol", "entry_index", "exit_reason", "net_r"), ["net_r"])


@query(
    f"WITH RECURSIVE {_TRADES}, hit AS (SELECT * FROM trades WHERE exit_reason = 'stop') SELECT session, pattern, symbol, entry_index, {sql.r6('net_r')} AS net_r, "
    "(SELECT count(*) FROM hit) AS total FROM hit ORDER BY net_r, session, pattern, interval, symbol, entry_index LIMIT 25"
)
def trades_page_with_total(spark, d):
    rows = drill.counted_page(_own(spark, d), {"exit_reason": "stop"}, "net_r", False, 0, 25)
    return _round(rows.select("session", "pattern", "symbol", "entry_index", "net_r", "total"), ["net_r"])


_COMPARED = f"""{_TRADES}, {sql.matched(RULES, SEED)}, {sql.net('control_exits', 'paid', RULES, COSTS)}, both_kinds AS (
  SELECT pattern, interval, symbol, session, entry_index, net_r, false AS matched FROM trades
  UNION ALL SELECT 'random_short', interval, symbol, session, entry_index, net_r, false FROM trades WHERE pattern = 'bearish_hikkake'
  UNION ALL SELECT pattern, interval, symbol, session, entry_index, net_r, true FROM paid WHERE direction > 0
), against AS (
  SELECT 'bullish_hikkake' AS pattern, 'matched' AS kind, interval, symbol, session, entry_index, net_r FROM both_kinds WHERE pattern = 'bullish_hikkake' AND matched
  UNION ALL SELECT 'bearish_hikkake', 'reference', interval, symbol, session, entry_index, net_r FROM both_kinds WHERE pattern = 'random_short' AND NOT matched
), curve AS (
  SELECT a.*, row_number() OVER w AS trade_no, sum(net_r) OVER (w ROWS UNBOUNDED PRECEDING) AS equity_r
  FROM (SELECT a.*, b.minute FROM against a JOIN bars b ON b.symbol = a.symbol AND b.interval = a.interval AND b.session = a.session AND b.bar_idx = a.entry_index) a
  WINDOW w AS (PARTITION BY pattern, a.interval ORDER BY a.session, minute, a.symbol, entry_index, net_r)
)"""


@query(f"WITH RECURSIVE {_COMPARED} SELECT pattern, interval, kind, session, CAST(trade_no AS INTEGER) AS trade_no, {sql.r6('equity_r')} AS equity_r FROM curve")
def comparison_curve(spark, d):
    """A pattern with matched controls is held against them, one without against random entries of its direction."""
    bars = fixtures.bars(spark, d)
    own = trade.trades(bars, T, RULES, COSTS, ["bullish_hikkake", "bearish_hikkake"])
    controls = trade.net(trade.matched(own, bars, RULES, SEED), RULES, COSTS).filter("direction > 0")
    few = lambda t, m: t.select("pattern", "interval", "symbol", "session", "entry_index", "entry_minute", "net_r", F.lit(m).alias("matched"))
    reference = few(own.filter("pattern = 'bearish_hikkake'"), False).withColumn("pattern", F.lit("random_short"))
    rows = few(own, False).unionByName(reference).unionByName(few(controls, True))
    found = drill.comparison_curve(rows, ["bullish_hikkake", "bearish_hikkake"])
    return _round(found.select("pattern", "interval", "kind", "session", "trade_no", "equity_r"), ["equity_r"])


_OTHER = Thresholds(long_body=0.4, small_body=0.5, near_equal=0.01, trend_lookback=6)


def _viewed(run: str, t: Thresholds) -> str:
    return (
        f"(WITH RECURSIVE {sql.trades(t, RULES, COSTS)} SELECT '{run}' AS run, b.symbol, b.interval, b.session, b.bar_idx, b.close, s.bar_idx IS NOT NULL AS signal, "
        f"{sql.r6('tr.net_r')} AS net_r, tr.exit_reason FROM bars b LEFT JOIN (SELECT * FROM signals WHERE pattern = 'bullish_harami') s "
        "ON s.symbol = b.symbol AND s.interval = b.interval AND s.session = b.session AND s.bar_idx = b.bar_idx LEFT JOIN (SELECT * FROM trades WHERE pattern = 'bullish_harami') tr "
        "ON tr.symbol = b.symbol AND tr.interval = b.interval AND tr.session = b.session AND tr.entry_index = b.bar_idx)"
    )


@query(f"SELECT * FROM {_viewed('first', T)} UNION ALL SELECT * FROM {_viewed('second', _OTHER)}")
def session_view(spark, d):
    """Every session as two runs with other thresholds saw it: bars, signals found anew, stored trades where they were entered."""
    bars = fixtures.bars(spark, d)
    stored = trade.trades(bars, T, RULES, COSTS, ["bullish_harami"]).withColumn("run", F.lit("first"))
    stored = stored.unionByName(trade.trades(bars, _OTHER, RULES, COSTS, ["bullish_harami"]).withColumn("run", F.lit("second")))
    runs = {"first": (T, {"1h": T.trend_lookback}), "second": (_OTHER, {"1h": _OTHER.trend_lookback})}
    rows = drill.session_view(bars, stored, runs, "bullish_harami")
    one = F.try_element_at("trades", F.lit(1))  # non-overlapping trades: one at a bar at most
    return _round(rows.select("run", *KEY, "bar_idx", "close", "signal", one["net_r"].alias("net_r"), one["exit_reason"].alias("exit_reason")), ["net_r"])


@query(f"WITH RECURSIVE {_TRADES} SELECT symbol, count(*) AS trades FROM trades GROUP BY symbol ORDER BY trades DESC, symbol LIMIT 3")
def top_symbols(spark, d):
    return drill.top_symbols(_own(spark, d), 3)


_DAILY_CLOSE = """days AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    median(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
), ch AS (
  SELECT *, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss FROM days WINDOW w AS (PARTITION BY symbol ORDER BY day)
), ind AS (
  SELECT symbol, day, CASE WHEN count(close) OVER s20 = 20 THEN avg(close) OVER s20 END AS sma20,
    CASE WHEN count(close) OVER s50 = 50 THEN avg(close) OVER s50 END AS sma50,
    CASE WHEN count(gain) OVER s14 = 14 THEN CASE WHEN avg(gain) OVER s14 = 0 AND avg(loss) OVER s14 = 0 THEN 50
      WHEN avg(loss) OVER s14 = 0 THEN 100 ELSE 100 - 100 / (1 + avg(gain) OVER s14 / avg(loss) OVER s14) END END AS rsi14,
    CASE WHEN count(close) OVER s60 = 60 THEN min(low) OVER s60 END AS support60,
    CASE WHEN count(close) OVER s60 = 60 THEN max(high) OVER s60 END AS resistance60
  FROM ch WINDOW s14 AS (PARTITION BY symbol ORDER BY day ROWS 13 PRECEDING), s20 AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING),
    s50 AS (PARTITION BY symbol ORDER BY day ROWS 49 PRECEDING), s60 AS (PARTITION BY symbol ORDER BY day ROWS 59 PRECEDING)
)"""
_IND = ["sma20", "sma50", "rsi14", "support60", "resistance60"]


@query(f"WITH {_DAILY_CLOSE} SELECT symbol, day, {', '.join(f'{sql.r6(c)} AS {c}' for c in _IND)} FROM ind QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY day DESC) = 1")
def ticker_indicators(spark, d):
    return _round(ticker.latest(fixtures.daily(spark, d)).select("symbol", "day", *_IND), _IND)


_INFO_SQL = """parts AS (
  SELECT p_brand AS symbol, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY p_brand
), info AS (
  SELECT symbol, CASE WHEN s % 11 <> 3 THEN s % 41 - 5 END AS tpe, CASE WHEN s % 7 <> 2 THEN s % 37 - 3 END AS fpe,
    CASE WHEN s % 10 <> 4 THEN (s % 9) / 2 - CAST(0.5 AS DOUBLE) END AS pb, CAST(s % 30 AS DOUBLE) / 100 AS roe,
    CASE WHEN s % 8 <> 1 THEN s % 250 - 20 END AS debt, CAST(s % 35 AS DOUBLE) / 100 AS margin, CAST(s % 95 AS DOUBLE) / 100 - CAST(0.1 AS DOUBLE) AS payout,
    CASE WHEN s % 9 <> 5 THEN CAST(s % 25 AS DOUBLE) / 10 END AS beta, CASE WHEN s % 6 <> 4 THEN s * s % 7000000 END AS volume,
    CAST(s % 90 + 10 AS DOUBLE) AS bid, (s % 90 + 10) * (1 + CAST(s % 7 - 1 AS DOUBLE) / 1000) AS ask,
    CASE WHEN s % 5 <> 2 THEN s % 11 - 5 END AS change, s % 2 = 0 AS earnings FROM parts
)"""
_GROWTH_SQL = """y0 AS (
  SELECT p_brand AS symbol, year(l_shipdate) AS year, sum(l_linenumber) AS a, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#11' GROUP BY ALL
), yearly AS (
  SELECT symbol, year, CASE WHEN n % 5 <> 1 THEN floor(CAST(a AS DOUBLE) * 10 / n) END AS eps, floor(CAST(n AS DOUBLE) / 300) AS revenue FROM y0
), steps AS (
  SELECT symbol, 'eps' AS what, eps AS v, lag(eps) OVER (PARTITION BY symbol ORDER BY year) AS was FROM yearly WHERE eps IS NOT NULL
  UNION ALL SELECT symbol, 'revenue', revenue, lag(revenue) OVER (PARTITION BY symbol ORDER BY year) FROM yearly
), growth AS (
  SELECT symbol, what, CASE WHEN count(*) >= 2 THEN CASE WHEN bool_or(v < was) THEN 0.0 ELSE 1.0 END END AS trend FROM steps GROUP BY symbol, what
)"""


@query(f"WITH {_GROWTH_SQL} SELECT symbol, max(CASE WHEN what = 'eps' THEN trend END) AS eps_trend, max(CASE WHEN what = 'revenue' THEN trend END) AS revenue_trend FROM growth GROUP BY symbol")
def ticker_growth(spark, d):
    return ticker.growth(fixtures.statements(spark, d)).select("symbol", "eps_trend", "revenue_trend")


_YEAR_SQL = """px AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
    median(l_extendedprice / l_quantity) AS close FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL
), yr AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n12, last_day,
    count(*) FILTER (WHERE day > last_day - INTERVAL 6 MONTH) OVER (PARTITION BY symbol) AS n6, count(*) FILTER (WHERE day > last_day - INTERVAL 1 MONTH) OVER (PARTITION BY symbol) AS n1,
    lag(close) OVER w AS before, lead(close) OVER w AS after, date_trunc('week', day) <> coalesce(date_trunc('week', lead(day) OVER w), DATE '1900-01-01') AS week_end
  FROM (SELECT *, max(day) OVER (PARTITION BY symbol) AS last_day FROM px) WHERE day > last_day - INTERVAL 12 MONTH WINDOW w AS (PARTITION BY symbol ORDER BY day)
), back AS (
  SELECT *, n12 - i AS b, greatest(close - before, 0) AS gain, greatest(before - close, 0) AS loss,
    close > before AND close > after AS peak, close < before AND close < after AS trough FROM yr
), weeks AS (
  SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM yr WHERE week_end
), ends AS (
  SELECT symbol, max(n) AS weeks, max(CASE WHEN k = 1 THEN close END) AS week, avg(CASE WHEN k <= 10 THEN close END) AS week10 FROM weeks GROUP BY symbol
), turns AS (
  SELECT symbol, kind, max(CASE WHEN k = 1 THEN close END) AS newer, max(CASE WHEN k = 2 THEN close END) AS older FROM (
    SELECT symbol, close, kind, row_number() OVER (PARTITION BY symbol, kind ORDER BY i DESC) AS k FROM (
      SELECT symbol, i, close, 'peak' AS kind FROM back WHERE peak AND b BETWEEN 1 AND least(90, n12) - 2
      UNION ALL SELECT symbol, i, close, 'trough' FROM back WHERE trough AND b BETWEEN 1 AND least(90, n12) - 2)) GROUP BY symbol, kind
), doubles AS (
  SELECT symbol, bool_or(coalesce(abs(newer - older) / older <= 0.03, false)) AS doubled FROM turns GROUP BY symbol
), own AS (
  SELECT symbol, any_value(n12) AS n12, any_value(n6) AS n6, any_value(n1) AS n1, max(CASE WHEN b = 0 THEN close END) AS price,
    avg(CASE WHEN b < 20 THEN close END) AS s20, avg(CASE WHEN b < 50 THEN close END) AS s50, stddev_samp(CASE WHEN b < 20 THEN close END) AS sd,
    avg(CASE WHEN b < 14 THEN gain END) AS up, avg(CASE WHEN b < 14 THEN loss END) AS down, avg(CASE WHEN b < 10 THEN (high - low) / close END) AS range10,
    min(CASE WHEN b < 60 THEN close END) AS support, 4 * stddev_samp(CASE WHEN b < 20 THEN close END) / avg(CASE WHEN b < 20 THEN close END) AS width,
    4 * stddev_samp(CASE WHEN b BETWEEN 59 AND 78 THEN close END) / avg(CASE WHEN b BETWEEN 59 AND 78 THEN close END) AS old_width
  FROM back GROUP BY symbol
)"""
_SCORES_SQL = f"""{_INFO_SQL}, {_GROWTH_SQL}, {_YEAR_SQL}, x AS (
  SELECT i.*, o.* EXCLUDE (symbol), e.* EXCLUDE (symbol), coalesce(d.doubled, false) AS doubled, g.trend AS eps, r.trend AS revenue,
    CASE WHEN bid > 0 AND ask > bid THEN (ask - bid) / bid END AS quoted,
    CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi
  FROM info i LEFT JOIN own o USING (symbol) LEFT JOIN ends e USING (symbol) LEFT JOIN doubles d USING (symbol)
  LEFT JOIN growth g ON g.symbol = i.symbol AND g.what = 'eps' LEFT JOIN growth r ON r.symbol = i.symbol AND r.what = 'revenue'
), scores AS (
  SELECT symbol, style, label, CAST(score AS DOUBLE) AS score FROM x, LATERAL (VALUES
    ('long_term', 'eps_trend', eps), ('long_term', 'revenue_trend', revenue),
    ('long_term', 'growth_outlook', CASE WHEN tpe > 0 AND fpe > 0 THEN CASE WHEN fpe < tpe THEN 1 WHEN fpe > tpe THEN 0 ELSE 0.5 END END),
    ('long_term', 'pe', CASE WHEN tpe IS NOT NULL THEN CASE WHEN tpe > 0 AND tpe <= 25 THEN 1 ELSE 0 END END),
    ('long_term', 'pb', CASE WHEN pb IS NOT NULL THEN CASE WHEN pb > 0 AND pb <= 3 THEN 1 ELSE 0 END END),
    ('long_term', 'roe', CASE WHEN roe >= CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END),
    ('long_term', 'debt_to_equity', CASE WHEN debt IS NOT NULL THEN CASE WHEN debt < 0 THEN 0 WHEN debt < 100 THEN 1 WHEN debt <= 200 THEN 0.5 ELSE 0 END END),
    ('long_term', 'profit_margin', CASE WHEN margin >= CAST(0.2 AS DOUBLE) THEN 1 WHEN margin >= CAST(0.1 AS DOUBLE) THEN 0.5 ELSE 0 END),
    ('long_term', 'payout', CASE WHEN payout >= 0 THEN CASE WHEN payout <= CAST(0.6 AS DOUBLE) THEN 1 WHEN payout <= CAST(0.7 AS DOUBLE) THEN 0.5 ELSE 0 END END),
    ('long_term', 'volatility', CASE WHEN beta IS NOT NULL THEN CASE WHEN beta <= CAST(1.2 AS DOUBLE) THEN 1 WHEN beta <= CAST(1.8 AS DOUBLE) THEN 0.5 ELSE 0 END END),
    ('short_term', 'moving_averages', CASE WHEN n6 >= 50 THEN CASE WHEN price > s20 AND s20 > s50 THEN 1 WHEN price > s20 THEN 0.5 ELSE 0 END END),
    ('short_term', 'rsi', CASE WHEN n6 > 14 THEN CASE WHEN rsi < 30 THEN 1 ELSE 0.5 END END),
    ('short_term', 'bands', CASE WHEN n6 >= 20 THEN CASE WHEN price <= s20 - 2 * sd THEN 1 ELSE 0.5 END END),
    ('short_term', 'earnings', CASE WHEN earnings THEN 1 END),
    ('short_term', 'average_volume', CASE WHEN volume IS NOT NULL THEN CASE WHEN volume >= 1000000 THEN 1 WHEN volume >= 100000 THEN 0.5 ELSE 0 END END),
    ('short_term', 'quote', CASE WHEN quoted IS NOT NULL THEN CASE WHEN quoted <= CAST(0.001 AS DOUBLE) THEN 1 WHEN quoted <= CAST(0.005 AS DOUBLE) THEN 0.5 ELSE 0 END END),
    ('day_trading', 'daily_range', CASE WHEN n1 >= 10 THEN CASE WHEN range10 >= 0.04 THEN 1 WHEN range10 >= 0.02 THEN 0.5 ELSE 0 END END),
    ('day_trading', 'beta', CASE WHEN beta IS NOT NULL THEN CASE WHEN beta >= CAST(1.5 AS DOUBLE) THEN 1 WHEN beta >= 1 THEN 0.5 ELSE 0 END END),
    ('day_trading', 'volume_depth', CASE WHEN volume IS NOT NULL THEN CASE WHEN volume >= 5000000 THEN 1 WHEN volume >= 1000000 THEN 0.5 ELSE 0 END END),
    ('day_trading', 'change', CASE WHEN change IS NOT NULL THEN CASE WHEN abs(change) >= 3 THEN 1 ELSE 0 END END),
    ('swing', 'support', CASE WHEN n12 >= 60 THEN CASE WHEN (price - support) / support <= 0.03 THEN 1 ELSE 0.5 END END),
    ('swing', 'squeeze', CASE WHEN n12 >= 80 THEN CASE WHEN width < old_width * 0.7 THEN 1 WHEN width < old_width THEN 0.5 ELSE 0 END END),
    ('swing', 'double', CASE WHEN n12 >= 40 THEN CASE WHEN doubled THEN 1 ELSE 0.5 END END),
    ('swing', 'alignment', CASE WHEN n12 >= 100 AND weeks >= 10 THEN CASE WHEN (price > s20) = (week > week10) THEN 1 ELSE 0 END END)) AS t(style, label, score)
)"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    return ticker.metrics(fixtures.daily(spark, d), fixtures.company_info(spark, d), fixtures.statements(spark, d))


@query(f"WITH {_SCORES_SQL} SELECT symbol, style, label, score FROM scores")
def ticker_metrics(spark, d):
    """All 24 metrics of every symbol."""
    return _scores(spark, d).select("symbol", "style", "label", "score")


@query(
    f"""WITH {_SCORES_SQL}, counted AS (
  SELECT symbol, style, score FROM scores
  UNION ALL SELECT symbol, t.style, score FROM scores, (VALUES ('day_trading'), ('swing')) AS t(style) WHERE scores.style = 'short_term'
), r AS (
  SELECT symbol, style, count(*) AS metrics, count(score) AS evaluated, coalesce(sum(score), 0) AS score FROM counted GROUP BY symbol, style
) SELECT symbol, style, metrics, evaluated, score, {sql.r6("score / nullif(evaluated, 0)")} AS indicator_score,
  CASE WHEN evaluated < 3 OR CAST(evaluated AS DOUBLE) / metrics < 0.6 THEN 'inconclusive' WHEN score / evaluated >= CAST(0.8 AS DOUBLE) THEN 'strong' WHEN score / evaluated >= CAST(0.6 AS DOUBLE) THEN 'moderate' ELSE 'poor' END AS rating FROM r"""
)
def ticker_verdicts(spark, d):
    """Ratings of every symbol and style."""
    rows = ticker.ratings(_scores(spark, d))
    return _round(rows.select("symbol", "style", "metrics", "evaluated", "score", "indicator_score", "rating"), ["indicator_score"])


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """One row for each pattern: trades, expectancy and drawdown, best first."""
    own = _own(spark, d)
    rows = metrics.summarise(own, grid(spark, ["1h"])).join(metrics.max_drawdown(own), metrics.BY, "left")
    rows = metrics.ranked(rows.withColumn("verdict", F.lit("")), Stats(rank_by="expectancy_r"))
    return _round(rows.select("rank", "pattern", "trades", "win_rate", "expectancy_r", "max_drawdown_r"), ["win_rate", "expectancy_r", "max_drawdown_r"])


QUERIES["rank_leaderboard"] = leaderboard
SQL["rank_leaderboard"] = (
    f"WITH RECURSIVE {_TRADES}, {_GRID}, {_EQUITY}, dd AS (SELECT pattern, max(peak_r - equity_r) AS max_drawdown_r FROM pk GROUP BY pattern), "
    f"x AS (SELECT g.pattern, {_SUMMARY} FROM grid g LEFT JOIN trades t ON g.pattern = t.pattern GROUP BY g.pattern) "
    "SELECT CAST(row_number() OVER (ORDER BY (expectancy_r IS NOT NULL) DESC, expectancy_r DESC NULLS LAST, win_rate DESC NULLS LAST, x.pattern) AS INTEGER) AS rank, "
    f"x.pattern, trades, {sql.r6('win_rate')} AS win_rate, {sql.r6('expectancy_r')} AS expectancy_r, {sql.r6('max_drawdown_r')} AS max_drawdown_r "
    "FROM x LEFT JOIN dd ON dd.pattern = x.pattern"
)


#: Dates and times that queries return; they are compared as text.
_TIMES = ("session", "day", "ts")


def _as_text(found: Callable[[SparkSession, str], DataFrame], spark: SparkSession, d: str) -> DataFrame:
    rows = found(spark, d)
    return rows.withColumns({c: F.col(c).cast("string") for c in rows.columns if c in _TIMES})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_as_text, found) for name, found in QUERIES.items()}


def _texted(q: str, times: tuple[str, ...]) -> str:
    """The query with its dates and times as text."""
    names = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in times)
    return f"SELECT * REPLACE ({names}) FROM ({q}) AS q"


#: Queries whose SQL returns dates or times, and which.
OUT = dict.fromkeys(
    (
        "bars_validate session_index geometry_columns lags_and_extremes signals control_rate control_mask candidates "
        "exits_first_touch trades_overlap_allowed trades_nonoverlap matched_controls corwin_schultz quote_lookup "
        "equity_curve breakdown_session date_totals holdout_split draw_trials draw_trials_with_replacement trades_page trades_page_with_total spread_costs newest_sessions comparison_curve session_view"
    ).split(),
    ("session",),
)
OUT |= {f"detect_{name}": ("session",) for name in patterns.REGISTRY}
OUT |= {"regular_hours": ("ts",), "tick_resample": ("ts",), "coarse_resample": ("session", "ts"), "ticker_indicators": ("day",)}


def oracle_sql() -> dict[str, str]:
    made = {name: q if isinstance(q, str) else q() for name, q in SQL.items()}
    return {name: _texted(q, OUT[name]) if name in OUT else q for name, q in made.items()}
