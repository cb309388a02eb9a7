"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as t

_KINDS = {
    "string": t.StringType(),
    "timestamp": t.TimestampType(),
    "date": t.DateType(),
    "double": t.DoubleType(),
    "int": t.IntegerType(),
    "long": t.LongType(),
    "boolean": t.BooleanType(),
    "strings": t.ArrayType(t.StringType()),
}


def _schema(columns: str) -> t.StructType:
    pairs = (c.split() for c in columns.split(","))
    return t.StructType([t.StructField(name, _KINDS[kind]) for name, kind in pairs])


BARS = _schema(
    "symbol string, interval string, ts timestamp, open double, high double, low double, close double, volume double"
)
TICKS = _schema("symbol string, ts timestamp, price double, size double, conditions strings")
QUOTES = _schema("symbol string, ts timestamp, bp double, ap double")
TRIALS = _schema("trial_index int, symbol string, session date, seed long, window int, sample string")
#: Entry and exit prices are after costs; stop and target before.
TRADES = _schema(
    "pattern string, interval string, symbol string, session date, trial_index int, direction int, entry_index int, "
    "exit_index int, entry_price double, exit_price double, stop_price double, target_price double, "
    "risk_per_share double, exit_reason string, gross_r double, net_r double, return_pct double, window int, "
    "entry_minute int, sample string, cost_bps double, matched boolean, bars_held int"
)
#: What older trade files may lack, and what it then is.
TRADE_DEFAULTS = {"sample": "discovery", "cost_bps": None, "matched": False}
