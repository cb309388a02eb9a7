"""Providers, pages, the cache, kept runs and provenance."""

from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from signalforge.config import Config, TradeRules
from signalforge.plans import report
from signalforge.plans.history import History
from signalforge.sources import cache, registry
from signalforge.sources.registry import Source

UTC = dt.timezone.utc
NOW = dt.datetime(2025, 3, 31, 12, tzinfo=UTC)


def test_windows_cover_the_lookback_once():
    lag = dt.timedelta(minutes=16)
    registry.SOURCES["probe"] = Source(registry.landed, chunk_days={"1m": 7}, cap={"1m": 28}, default_lookback=lambda i: 10, end_lag=lag)
    try:
        spans = registry.windows("probe", "1m", NOW, 20)
        assert [(b - a).days for a, b in spans] == [6, 7, 7] and spans[-1][1] == NOW - lag
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] == NOW - lag - dt.timedelta(days=20)
        assert len(registry.windows("probe", "1h", NOW)) == 1 and registry.lookback_days("probe", "1m", 99) == 28
        with pytest.raises(ValueError):
            registry.register("probe", Source(registry.landed))
    finally:
        del registry.SOURCES["probe"]
    with pytest.raises(ValueError):
        registry.windows("nowhere", "1m", NOW)
    with pytest.raises(ValueError):
        registry.register("odd", Source(registry.landed, intervals=("7m",)))


def series(symbol, days=6):
    r = random.Random(symbol)
    out = []
    for k in range(days * 4):
        at = NOW - dt.timedelta(hours=6 * k + 1)
        o = 10 + r.random()
        out.append({"t": at.isoformat(), "o": o, "h": o + 1, "l": o - 1, "c": o + 0.5, "v": 100 + k})
    return out[::-1]


def land(root, symbol, bars, cuts):
    """Pages of a symbol's bars, cut at the given places."""
    folder = root / "1h" / symbol
    folder.mkdir(parents=True)
    edges = [0, *sorted(cuts), len(bars)]
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        page = {"bars": bars[a:b], "next_page_token": f"t{k + 1}" if b < len(bars) else None}
        (folder / f"{'first' if k == 0 else f't{k}'}.json").write_text(json.dumps(page))


def test_pages_give_the_same_bars_wherever_they_are_cut(spark, tmp_path):
    r, found = random.Random(1), []
    for k in range(3):
        root = tmp_path / str(k)
        for s in ("AA", "BB"):
            bars = series(s)
            land(root, s, bars, r.sample(range(1, len(bars)), k * 3))
        rows = registry.fetched(spark, "landed", str(root), ["AA", "BB"], "1h", NOW, 4)
        assert rows.filter("error IS NOT NULL").count() == 0
        found.append(sorted(map(tuple, rows.drop("window_start").collect()), key=str))
    assert found[0] == found[1] == found[2] and len(found[0]) == 2 * 16


def test_failures_are_rows(spark, tmp_path):
    land(tmp_path, "AA", series("AA"), [5])
    land(tmp_path, "LOOP", series("LOOP"), [5])
    page = tmp_path / "1h" / "LOOP" / "t1.json"
    page.write_text(page.read_text().replace('"next_page_token": null', '"next_page_token": "t1"'))
    land(tmp_path, "OLD", [b | {"t": "2001-01-01T00:00:00+00:00"} for b in series("OLD")], [])
    rows = registry.fetched(spark, "landed", str(tmp_path), ["AA", "GONE", "LOOP", "OLD"], "1h", NOW, 4, retries=1, pause=0.0)
    errors = {x.symbol: x.error for x in rows.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"GONE", "LOOP", "OLD"}
    assert "FileNotFound" in errors["GONE"] and "comes again" in errors["LOOP"] and errors["OLD"] == "no data returned"
    assert {x.symbol for x in rows.filter("error IS NULL").select("symbol").distinct().collect()} == {"AA"}


def test_a_request_is_repeated():
    asked = []

    def shaky(place, symbol, interval, start, end, token):
        asked.append(token)
        if len(asked) < 3:
            raise OSError("busy")
        return {"bars": [], "next_page_token": None}

    assert len(list(registry.pages(shaky, "", "A", "1m", NOW, NOW, 2, 0.0))) == 1 and asked == [None] * 3
    asked.clear()
    with pytest.raises(OSError):
        list(registry.pages(shaky, "", "A", "1m", NOW, NOW, 1, 0.0))


def fetched_rows(spark, rows):
    kind = registry.FETCHED
    full = [(s, "1h", NOW, at, *([None] * 5 if e else [o, o + 1, o - 1, o, v]), e) for s, at, o, v, e in rows]
    return spark.createDataFrame(full, kind)


def at(h):
    return NOW + dt.timedelta(hours=h)


def contents(spark, root):
    return {(x.symbol, x.ts.hour, x.open) for x in cache.load(spark, root, "1h").collect()}


def test_a_refresh_publishes_whole_series_only(spark, tmp_path):
    root = f"file://{tmp_path}/c"
    with pytest.raises(FileNotFoundError):
        cache.load(spark, root)
    first = fetched_rows(spark, [("A", at(0), 5.0, 1.0, None), ("A", at(1), 6.0, 1.0, None), ("B", at(0), 7.0, 1.0, None), ("BAD", at(0), 7.0, -1.0, None), ("C", None, 0, 0, "down")])
    told = {x.symbol: x for x in cache.refresh(spark, root, first, NOW).collect()}
    assert (told["A"].bars, told["A"].published, told["A"].failure) == (2, True, None)
    assert (told["BAD"].published, told["BAD"].dropped, told["BAD"].failure) == (False, 1, "no sound bars") and "down" in told["C"].failure
    assert contents(spark, root) == {("A", at(0).hour, 5.0), ("A", at(1).hour, 6.0), ("B", at(0).hour, 7.0)}

    # A's refresh misses a window: the older, longer series stays; B's is whole; D is new, so a part is better than none
    later = fetched_rows(spark, [("A", at(1), 60.0, 1.0, None), ("A", None, 0, 0, "down"), ("B", at(2), 70.0, 1.0, None), ("D", at(0), 1.5, 1.0, None), ("D", None, 0, 0, "down")])
    told = {x.symbol: x for x in cache.refresh(spark, root, later, NOW + dt.timedelta(hours=1)).collect()}
    assert (told["A"].published, told["B"].published, told["D"].published) == (False, True, True)
    assert told["A"].failure.endswith("the older, whole series stays") and told["D"].failure
    want = {("A", at(0).hour, 5.0), ("A", at(1).hour, 6.0), ("B", at(2).hour, 70.0), ("D", at(0).hour, 1.5)}
    assert contents(spark, root) == want
    with pytest.raises(ValueError):
        cache.refresh(spark, root, later, NOW)
    with pytest.raises(FileNotFoundError, match="C"):
        cache.load(spark, root, "1h", ["A", "C"])
    # repeated times: the first to arrive counts
    twice = fetched_rows(spark, [("E", at(0), 3.0, 1.0, None), ("E", at(0), 2.0, 1.0, None)]).coalesce(1)
    cache.refresh(spark, root, twice, NOW + dt.timedelta(hours=2))
    assert contents(spark, root) == want | {("E", at(0).hour, 3.0)}


def test_an_interrupted_refresh_leaves_the_cache_as_it_was(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/c"
    cache.refresh(spark, root, fetched_rows(spark, [("A", at(0), 5.0, 1.0, None)]), NOW)
    before = contents(spark, root)

    def broken(*_):
        raise OSError("lost")

    monkeypatch.setattr(cache, "held", broken)  # bars are written by then, the list isn't
    with pytest.raises(OSError):
        cache.refresh(spark, root, fetched_rows(spark, [("A", at(3), 9.0, 1.0, None)]), NOW + dt.timedelta(hours=1))
    monkeypatch.undo()
    assert len(list((tmp_path / "c" / "data").iterdir())) == 2 and contents(spark, root) == before
    (tmp_path / "c" / "lists" / "99990101T000000000000").mkdir()  # a list that was begun only
    assert contents(spark, root) == before
    cache.refresh(spark, root, fetched_rows(spark, [("A", at(4), 9.0, 1.0, None)]), NOW + dt.timedelta(hours=2))
    assert contents(spark, root) == {("A", at(4).hour, 9.0)} and len(list((tmp_path / "c" / "data").iterdir())) == 2


def some_trades(spark):
    return spark.createDataFrame([("hammer", "1h", "A", dt.date(2025, 3, 3), 1.5)], "pattern string, interval string, symbol string, session date, net_r double")


def test_history_keeps_the_newest_runs(spark, tmp_path):
    kept = History(spark, f"file://{tmp_path}/h", keep=2)
    assert kept.summaries() == []
    body = {"config": {"run": {"trials": 3, "seed": 1, "windows": 1}}, "patterns": [{"pattern": "p", "interval": "1h", "verdict": "EDGE"}, {"pattern": "p", "interval": "all", "verdict": "EDGE"}]}
    ids = [kept.save(body | {"x": float("nan")}, some_trades(spark), NOW.replace(tzinfo=None)) for _ in range(3)]
    assert ids == sorted(set(ids)) and kept.ids() == ids[:0:-1]  # one second apart, the oldest gone
    assert kept.save(body, some_trades(spark), dt.datetime(2020, 1, 1)) > ids[-1]  # never below one given out
    assert [s["edges"] for s in kept.summaries()] == [1, 1] and kept.report(kept.ids()[1])["x"] is None
    assert kept.trades(kept.ids()[0]).first().net_r == 1.5 and kept.report(ids[0]) is None and kept.trades(ids[0]) is None
    for odd in ("../x", "", "20250101T000000\n"):
        with pytest.raises(ValueError):
            kept.report(odd)
    (tmp_path / "h" / f"{kept.ids()[0]}.json").write_text("{")
    assert len(kept.summaries()) == 1


def test_trades_come_before_their_report(spark, tmp_path, monkeypatch):
    kept = History(spark, f"file://{tmp_path}/h")

    def broken(*_):
        raise OSError("full")

    monkeypatch.setattr("signalforge.plans.history.put_text", broken)
    with pytest.raises(OSError):
        kept.save({}, some_trades(spark), NOW)
    assert kept.ids() == [] and not list((tmp_path / "h").glob("*.trades"))


def test_data_hash_follows_contents_only(spark, tmp_path):
    for root, order in (("a", (1, 2, 3)), ("b", (3, 1, 2))):
        for k in order:
            folder = tmp_path / root / "1h" / "S"
            folder.mkdir(parents=True, exist_ok=True)
            (folder / f"{k}.bin").write_bytes(bytes([k]) * 1000)
    a, b = (report.data_fingerprint(spark, [f"file://{tmp_path}/{r}", f"file://{tmp_path}/none"]) for r in "ab")
    assert a == b and (a["files"], a["missing"]) == (3, 1)
    (tmp_path / "b" / "1h" / "S" / "2.bin").write_bytes(bytes([2]) * 999 + b"x")
    assert report.data_fingerprint(spark, [f"file://{tmp_path}/b"])["sha256"] != a["sha256"]
    assert report.data_fingerprint(spark, [f"file://{tmp_path}/none"]) == {"sha256": report.hashlib.sha256().hexdigest(), "files": 0, "missing": 1}
    told = report.provenance(Config(), spark, [f"file://{tmp_path}/a"], spark.createDataFrame([(dt.date(2025, 1, 2),), (dt.date(2025, 1, 1),)], "session date"))
    assert told["data"] == {k: v for k, v in a.items() if k != "missing"} | {"missing": 0, "first_session": "2025-01-01", "last_session": "2025-01-02"}
    assert told["config_sha256"] == report.config_hash(Config()) != report.config_hash(Config(trade=TradeRules(max_hold_bars=5)))
    assert report.revision(str(tmp_path / "a")) is None


def test_wide_tables_become_rows(spark):
    names = [f"{s}.{f}" for s in ("A", "B.X") for f in ("Open", "High", "Low", "Close", "Volume")]
    rows = [(NOW, *map(float, range(10)), 1.0), (at(1), *[None] * 5, *map(float, range(5)), None)]
    wide = spark.createDataFrame(rows, "ts timestamp, " + ", ".join(f"`{n}` double" for n in names) + ", `C.open` double")
    rows = registry.extracted(wide)
    assert sorted((x.symbol, x.ts == NOW.replace(tzinfo=None), x.open) for x in rows.collect()) == [("A", True, 0.0), ("B.X", False, 0.0), ("B.X", True, 5.0)]
    assert registry.extracted(wide, ["C"]).count() == 0 and registry.extracted(wide, ["A"]).count() == 1
    flat = wide.select("ts", *[F.col(f"`A.{f}`").alias(f) for f in ("Open", "High", "Low", "Close", "Volume")])
    assert registry.extracted(flat, ["Q"]).first().symbol == "Q"
    with pytest.raises(ValueError):
        registry.extracted(flat)


def test_universe_never_pads(spark):
    assert [r.symbol for r in registry.universe(spark, ["C", "A", "C", "B"], 2).collect()] == ["C", "A"]
    assert registry.universe(spark, ["C", "A"], 9).count() == 2 and registry.universe(spark, [], 3).count() == 0
