"""Synthetic bars, streams and files."""

from __future__ import annotations

import datetime as dt
import json

from signalforge.config import Config
from signalforge.plans import report
from signalforge.sources import bars as bar
from signalforge.sources.synthetic import synthetic_bars
from signalforge.streaming.bars import stream_bars


def test_synthetic_bars_are_a_function_of_their_name(spark):
    a = synthetic_bars(spark, ["AA", "BB"], dt.date(2026, 9, 11), dt.date(2026, 9, 15))
    b = synthetic_bars(spark, ["BB"], dt.date(2026, 9, 14), dt.date(2026, 9, 14), False)
    assert a.count() == 2 * 3 * 390 and bar.validate(a).count() == a.count()
    days = bar.sessionise(a)
    assert days.filter("symbol = 'BB' and session = date'2026-09-14'").select(b.columns).exceptAll(b).count() == 0
    assert days.agg({"minute": "max"}).first()[0] == 389


def test_coarse_bars_are_their_fine_bars(spark):
    fine = bar.sessionise(synthetic_bars(spark, ["AA"], dt.date(2026, 9, 14), dt.date(2026, 9, 14)))
    coarse = bar.resample_bars(fine, "1h", 60).orderBy("ts").collect()
    rows = fine.orderBy("ts").collect()
    assert len(coarse) == 7 and coarse[0].ts == rows[0].ts
    first = rows[:60]
    assert (coarse[0].open, coarse[0].close) == (first[0].open, first[-1].close)
    assert (coarse[0].high, coarse[0].low) == (max(r.high for r in first), min(r.low for r in first))


def test_bars_round_trip(spark, tmp_path):
    a = synthetic_bars(spark, ["AA"], dt.date(2026, 9, 14), dt.date(2026, 9, 14))
    bar.write_bars(a, f"file://{tmp_path}/bars")
    assert bar.read_bars(spark, f"file://{tmp_path}/bars").count() == 390


def test_older_trade_files_are_readable(spark, tmp_path):
    spark.createDataFrame([("p", 1.0)], "pattern string, net_r double").write.parquet(f"{tmp_path}/t")
    r = bar.read_trades(spark, f"{tmp_path}/t").first()
    assert (r["sample"], r["matched"], r["cost_bps"], r["net_r"]) == ("discovery", False, None, 1.0)


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2026, 9, 14, 13, 30)
    rows = [("X", start + dt.timedelta(seconds=i), 100.0 + i % 7, 1.0, ["I"] if i % 5 == 0 else []) for i in range(120)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, size double, conditions array<string>")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/in")
    query = stream_bars(stream, "10s", 10).writeStream.format("memory").queryName("bars10").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    batch = bar.resample_ticks(ticks, "10s", 10)
    assert spark.table("bars10").exceptAll(batch).count() == 0 and batch.count() == 12


def test_json_has_no_numbers_that_json_lacks(spark):
    stats = spark.createDataFrame([("p", float("inf"), float("nan"))], "pattern string, profit_factor double, x double")
    found = json.loads(report.to_json(stats, Config()))["patterns"][0]
    assert found == {"pattern": "p", "profit_factor": "Infinity", "x": None}
