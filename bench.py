"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and
cores. Each query runs twice after a warm-up of the JVM; the shorter time counts.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import time

from pyspark.sql import functions as F

from tickloom import driver_tables as src
from tickloom.catalog import QUERIES
from tickloom.operators import analytics as an, bars as ba, indicators as ind, ledger as le
from tickloom.session import build_session, release_staged, stage, staged_folder
from tickloom.sources import bars as bar_files, ledger_store as store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Queries of the catalog, by name.
NAMED = (
    "bars_hourly", "vwap", "rsi", "macd", "bollinger", "atr", "sma", "indicators_all", "supplier_bars_indicators",
    "latest_per_ticker", "ensemble", "backtest_ledger", "resolve_forward", "resolve_phase2", "sweep_orphans",
    "merge_replay", "balance_events", "train_split", "overall_accuracy", "accuracy_by_ticker", "rolling_accuracy",
    "cumulative_return", "value_median_by_ticker", "latency_histogram", "normalize_responses", "room_transcript",
    "snapshot_latest",
)


def bars_5min(spark, d):
    return ba.build_bars(src.ticks(spark, d), "5 minutes")


def indicators_5min(spark, d):
    return ind.compute_indicators(src.bars(spark, d, "5 minutes"))


def backtest_5min(spark, d):
    return le.backtest(src.bars(spark, d, "5 minutes"))


def indicators_one_ticker(spark, d):
    """About as many bars as the reference times for one ticker, from bars already stored."""
    one = _STORED.where(F.col("ticker") == "click")
    return ind.compute_indicators(one)


def accuracy_stored(spark, d):
    """Statistics alone, on predictions that are already stored."""
    return an.accuracy_by_ticker(_PREDICTIONS)


def histogram_stored(spark, d):
    return an.histogram(_PREDICTIONS, "inference_latency_ms")


def load_bar_files(spark, d):
    """Bars from one CSV file per ticker."""
    return bar_files.read_bars_csv(spark, _FILES)


def append_one_row(spark, d):
    store.append_predictions(_PREDICTIONS.limit(1).drop(*src.ANALYST_COLUMNS), staged_folder(spark, "one-row"))
    return spark.range(0)


def resolve_ten_pending(spark, d):
    """Ten open rows in a ledger whose other rows are resolved."""
    return le.resolve_phase2(_TEN, _PRICES, dt.datetime(2024, 3, 1))


EXTRA = {f.__name__: f for f in (
    bars_5min, indicators_5min, backtest_5min, indicators_one_ticker, accuracy_stored, histogram_stored, load_bar_files,
    append_one_row, resolve_ten_pending,
)}
_STORED = _PREDICTIONS = _FILES = _TEN = _PRICES = None


def prepare(spark) -> None:
    """Inputs of the timings above, stored outside the timer."""
    global _STORED, _PREDICTIONS, _FILES, _TEN, _PRICES
    _STORED = src.bars(spark, SF_DIR)
    _PREDICTIONS = src.predictions(spark, SF_DIR)
    _FILES = staged_folder(spark, "files")
    bar_files.write_bars_csv(_STORED, _FILES)
    ledger = src.predictions(spark, SF_DIR, step=1).drop(*src.ANALYST_COLUMNS)
    ten = ledger.orderBy("row_id").limit(10)
    rest = ledger.join(ten.select("row_id"), "row_id", "left_anti")
    _TEN = stage(rest.unionByName(ten.withColumns(le.empty_phase2())), "ten-pending")
    stored = staged_folder(spark, "prices")
    bar_files.write_prices(src.ticks(spark, SF_DIR).select("ticker", "ts", "price"), stored)
    _PRICES = bar_files.read_prices(spark, stored)


def run(fn, spark) -> float:
    start = time.perf_counter()
    fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    QUERIES["indicators_all"](spark, SF_DIR).count()
    times: dict[str, float] = {}
    for name, fn in {**{n: QUERIES[n] for n in NAMED}, **EXTRA}.items():
        times[name] = round(min(run(fn, spark), run(fn, spark)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    release_staged(spark)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
