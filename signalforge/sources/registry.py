"""Where bars come from: providers, the windows that they are asked for, and a data source that follows their pages.

A provider answers a request (symbol, interval, start, end, page_token) with one page: bars as
``{"t", "o", "h", "l", "c", "v"}`` and the token of the next page, if any. Each symbol and
window is one input partition of the data source, which follows the tokens inside it, so
requests run side by side and nothing passes through the driver. A window that fails gives one
row with its error and none of its bars; a later refresh can ask again.

Providers on the network aren't built in. ``landed`` answers from pages that a collector has
left in a folder.
"""

from __future__ import annotations

import datetime as dt
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from signalforge.config import INTERVALS

Page = dict
#: What asks a provider for a page: its folder or address, symbol, interval, start, end and the page's token.
Fetch = Callable[[str, str, str, dt.datetime, dt.datetime, "str | None"], Page]

FETCHED = "symbol string, interval string, window_start timestamp, ts timestamp, open double, high double, low double, close double, volume double, error string"


@dataclass(frozen=True)
class Source:
    """A provider: what asks it, its intervals, and how far back it reaches.

    chunk_days: most days of a request, by interval; cap: most days served, None for years;
    end_lag: how far short of the present a request must stop.
    """

    fetch: Fetch
    intervals: tuple[str, ...] = tuple(INTERVALS)
    chunk_days: dict[str, int] = field(default_factory=dict)
    cap: dict[str, int] | None = None
    default_lookback: int | Callable[[str], int] = 730
    end_lag: dt.timedelta = dt.timedelta(0)


SOURCES: dict[str, Source] = {}


def register(name: str, source: Source) -> Source:
    if name in SOURCES:
        raise ValueError(f"source {name} is registered already")
    if unknown := [i for i in source.intervals if i not in INTERVALS]:
        raise ValueError(f"source {name}: unknown intervals {', '.join(unknown)}")
    SOURCES[name] = source
    return source


def source_of(name: str, interval: str | None = None) -> Source:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name!r}; there are {', '.join(sorted(SOURCES))}")
    if interval is not None and interval not in SOURCES[name].intervals:
        raise ValueError(f"source {name} has no {interval} bars")
    return SOURCES[name]


def lookback_days(name: str, interval: str, configured: int = 0) -> int:
    """Days to ask for: what is configured, or for 0 the provider's default; never over its cap."""
    source = source_of(name, interval)
    default = source.default_lookback(interval) if callable(source.default_lookback) else source.default_lookback
    most = (source.cap or {}).get(interval)
    span = configured or default
    return span if most is None else min(span, most)


def windows(name: str, interval: str, now: dt.datetime, configured: int = 0) -> list[tuple[dt.datetime, dt.datetime]]:
    """(start, end) of each request, oldest first: the lookback in chunks, the newest full, moved back whole by the end lag."""
    source, left = source_of(name, interval), lookback_days(name, interval, configured)
    chunk, end, out = source.chunk_days.get(interval) or left, now - source.end_lag, []
    while left > 0:
        days = min(chunk, left)
        out.append((end - dt.timedelta(days=days), end))
        end, left = out[-1][0], left - days
    return out[::-1]


#: Most days of one symbol's seconds that may be asked for at once; prints come by the million.
SYMBOL_DAYS = 20


def check_load(name: str, intervals: list[str], symbols: int, configured: int = 0) -> None:
    """Refuse bars of seconds over more than ``SYMBOL_DAYS`` days of one symbol."""
    for i in intervals:
        days = lookback_days(name, i, configured) * symbols
        if INTERVALS[i] < 1 and days > SYMBOL_DAYS:
            raise ValueError(f"{i} bars of {symbols} symbols are {days:,} symbol-days, more than {SYMBOL_DAYS}: take fewer symbols or days")


def pages(fetch: Fetch, place: str, symbol: str, interval: str, start: dt.datetime, end: dt.datetime, retries: int, pause: float) -> Iterator[Page]:
    """Every page of a window, by their tokens; a failed request is repeated with a doubled pause, a token that comes again is an error."""
    token, seen = None, set()
    while True:
        for attempt in range(retries + 1):
            try:
                page = fetch(place, symbol, interval, start, end, token)
                break
            except Exception:
                if attempt == retries:
                    raise
                time.sleep(pause * 2**attempt)
        yield page
        token = page.get("next_page_token")
        if not token:
            return
        if token in seen:
            raise ValueError(f"page {token!r} comes again")
        seen.add(token)


class _Window(InputPartition):
    def __init__(self, symbol: str, interval: str, start: dt.datetime, end: dt.datetime):
        self.symbol, self.interval, self.start, self.end = symbol, interval, start, end


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Fetch, asked: list[_Window]):
        self.place, self.fetch, self.asked = options["path"], fetch, asked
        self.retries, self.pause = int(options.get("retries", "3")), float(options.get("pause", "1"))

    def partitions(self) -> list[_Window]:
        return self.asked

    def read(self, w: _Window) -> Iterator[tuple]:
        rows = []
        try:
            for page in pages(self.fetch, self.place, w.symbol, w.interval, w.start, w.end, self.retries, self.pause):
                for b in page.get("bars") or []:
                    at = dt.datetime.fromisoformat(b["t"])
                    at = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at
                    if w.start <= at < w.end:  # neighbouring windows share no bar
                        rows.append((w.symbol, w.interval, w.start, at, *[None if b[k] is None else float(b[k]) for k in "ohlcv"], None))
            error = None if rows else "no data returned"
        except Exception as x:  # one window's failure is a row, not the end of the others
            rows, error = [], f"{type(x).__name__}: {x}"[:500]
        if error:
            rows = [(w.symbol, w.interval, w.start, None, None, None, None, None, None, error)]
        yield from rows


class PagedBars(DataSource):
    """``spark.read.format("paged_bars")`` with options source, path, symbols, interval, now and lookback_days."""

    @classmethod
    def name(cls) -> str:
        return "paged_bars"

    def schema(self) -> str:
        return FETCHED

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        now = dt.datetime.fromisoformat(o["now"])
        now = now.replace(tzinfo=dt.timezone.utc) if now.tzinfo is None else now
        spans = windows(o["source"], o["interval"], now, int(o.get("lookback_days", "0")))
        asked = [_Window(s, o["interval"], a, b) for s in json.loads(o["symbols"]) for a, b in spans]
        return _Reader(o, source_of(o["source"]).fetch, asked)


def fetched(
    spark: SparkSession, source: str, path: str, symbols: list[str], interval: str, now: dt.datetime, lookback: int = 0, retries: int = 3, pause: float = 1.0
) -> DataFrame:
    """Bars of every symbol and window, and one row with an error for each window that failed."""
    source_of(source, interval)

    class Held(PagedBars):
        """Brings the registry's entry along to the Python workers."""

        entry = SOURCES[source]

        def reader(self, schema) -> DataSourceReader:
            SOURCES.setdefault(self.options["source"], self.entry)
            return super().reader(schema)

    spark.dataSource.register(Held)
    options = {"source": source, "path": path, "symbols": json.dumps(list(symbols)), "interval": interval, "now": now.isoformat()}
    options |= {"lookback_days": str(lookback), "retries": str(retries), "pause": str(pause)}
    return spark.read.format("paged_bars").options(**options).load()


def landed(place: str, symbol: str, interval: str, start: dt.datetime, end: dt.datetime, token: str | None) -> Page:
    """A page that lies in ``place`` as interval/symbol/token.json, the first as first.json. Windows share a symbol's pages."""
    store, root = fs.FileSystem.from_uri(place) if ":" in place else (fs.LocalFileSystem(), place)
    with store.open_input_stream(f"{root}/{interval}/{symbol}/{token or 'first'}.json") as f:
        return json.loads(f.read())


register("landed", Source(landed, default_lookback=30))


def extracted(wide: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """(symbol, ts, open .. volume) of a wide table: ts, and columns named symbol.field, or plain fields for the one symbol given.

    Field names may have capitals. A symbol with a field missing has no rows; rows without any
    value, which stand for other symbols' times, are left out.
    """
    fields = ("open", "high", "low", "close", "volume")
    held: dict[str, dict[str, str]] = {}
    for c in wide.columns:
        if c == "ts":
            continue
        symbol, _, name = c.rpartition(".")
        if not symbol:
            if symbols is None or len(symbols) != 1:
                raise ValueError(f"column {c} names no symbol")
            symbol = symbols[0]
        held.setdefault(symbol, {})[name.lower()] = c
    whole = {s: f for s, f in held.items() if set(fields) <= set(f) and (symbols is None or s in symbols)}
    if not whole:
        return wide.sparkSession.createDataFrame([], "symbol string, ts timestamp, " + ", ".join(f"{f} double" for f in fields))
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = ", ".join(f"{quoted(s)}, " + ", ".join(f"CAST(`{f[k].replace('`', '``')}` AS DOUBLE)" for k in fields) for s, f in whole.items())
    rows = wide.selectExpr("ts", f"stack({len(whole)}, {parts}) AS (symbol, {', '.join(fields)})")
    return rows.dropna("all", subset=list(fields)).select("symbol", "ts", *fields)


def universe(spark: SparkSession, symbols: list[str], sample_size: int | None = None) -> DataFrame:
    """(place, symbol): the first sample_size of the named symbols, all of them if they are fewer; a symbol counts once."""
    once = list(dict.fromkeys(symbols))
    chosen = once if sample_size is None else once[: max(0, sample_size)]
    return spark.createDataFrame(list(enumerate(chosen)), "place int, symbol string").orderBy(F.col("place"))
