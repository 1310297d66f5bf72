"""Rows that are not as they should be: nulls, NaN, gaps, late state, repeated keys."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tickloom.functions import market_time as mt
from tickloom.operators import bars as ba, indicators as ind, ledger as le, replay as rp, rooms as ro
from tickloom.plans.asof import asof_forward
from tickloom.schema import BAR, LEDGER
from tickloom.sources import ledger_store as store
from tickloom.streaming import live

COLUMNS = ("rsi_14", "macd", "macd_signal", "atr_14", "sma_50", "bb_upper")


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_a_missing_close_is_skipped(spark, bad):
    rows = walk("NSE:X", 400)
    gone = {80, 81, 200, 399}
    damaged = [(*r[:5], bad, r[6]) if i in gone else r for i, r in enumerate(rows)]
    got = {r["bar_ts"]: r for r in ind.compute_indicators(spark.createDataFrame(damaged, BAR)).collect()}
    want = {r["bar_ts"]: r for r in ind.compute_indicators(spark.createDataFrame([r for i, r in enumerate(rows) if i not in gone], BAR)).collect()}
    assert len(got) == 400
    for i, r in enumerate(rows):
        for c in COLUMNS:
            if i in gone:
                assert got[r[1]][c] is None and got[r[1]]["series_idx"] is None
            else:
                a, b = got[r[1]][c], want[r[1]][c]
                assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12))


def test_constant_prices_stay_flat_over_a_gap(spark):
    at = dt.datetime(2024, 1, 2, 9, 25)
    rows = [("NSE:F", at + dt.timedelta(minutes=5 * i), 100.0, 101.0, 99.0, None if i == 60 else 100.0, 10) for i in range(120)]
    df = spark.createDataFrame(rows, BAR)
    assert {round(r[0], 9) for r in ind.macd(df).where("macd IS NOT NULL").select("macd").collect()} == {0.0}
    assert {round(r[0], 9) for r in ind.atr(df).where("atr_14 IS NOT NULL").select("atr_14").collect()} == {2.0}
    assert {round(r[0], 9) for r in ind.ema(df, "close", 10).where("ema_10 IS NOT NULL").select("ema_10").collect()} == {100.0}


def test_rows_without_key_or_time_come_back(spark):
    rows = walk("NSE:K", 40) + [(None, dt.datetime(2024, 1, 3), 1.0, 1.0, 1.0, 1.0, 1), ("NSE:K", None, 1.0, 1.0, 1.0, 1.0, 1)]
    df = spark.createDataFrame(rows, BAR)
    for done in (ind.compute_indicators(df), ind.rsi(df), ba.series_index(df), ba.bar_returns(df)):
        assert done.count() == 42 and done.where("series_idx IS NULL").count() == 2
    good, bad = ba.validate_bars(spark.createDataFrame(rows + rows[:1] + [(*rows[1][:3], float("nan"), *rows[1][4:])], BAR))
    assert good.count() == 40 and sorted(r["problem"] for r in bad.collect()) == ["duplicate", "key", "key", "price"]


def test_ticks_that_make_no_bar_are_listed(spark):
    at = dt.datetime(2024, 1, 2, 9, 25)
    ticks = spark.createDataFrame([("A", at, 1.0, 1), (None, at, 1.0, 1), ("A", at, None, 1), ("A", at, float("nan"), 1), ("A", None, 2.0, 1)], "ticker string, ts timestamp, price double, volume long")
    assert ba.unusable_ticks(ticks).count() == 4
    assert [tuple(r)[2:6] for r in ba.build_bars(ticks).collect()] == [(1.0, 1.0, 1.0, 1.0)]


def test_transcript_with_gaps_between_turns(spark):
    m = spark.createDataFrame([("r", t, "u", x) for t, x in ((0, "hello"), (1000, "there"), (2000, "bye"))], "room_id string, turn int, sender string, text string")
    got = ro.room_transcript(m).first()
    assert got["transcript"] == "[u] hello\n[u] there\n[u] bye" and got["n_messages"] == 3
    cut = ro.room_transcript(m, 12).first()
    assert cut["transcript"] == "[u] hello\n[u" + ro.TRUNCATED


def test_holidays_of_any_year_and_from_a_table(spark):
    days = [dt.datetime(y, m, d, 10) for y, m, d in ((1990, 1, 26), (2055, 10, 2), (2024, 3, 25), (2024, 3, 26), (2024, 3, 23))]
    df = spark.createDataFrame([(d,) for d in days], "bar_ts timestamp")
    assert [r[0] for r in df.select(mt.is_trading_day(F.col("bar_ts"))).collect()] == [False, False, True, True, False]
    moved = spark.createDataFrame([(dt.date(2024, 3, 25),), (dt.date(2024, 3, 25),), (None,)], "date date")
    flagged = mt.with_closed(df, moved).orderBy("bar_ts")
    got = flagged.select(mt.is_trading_day(F.col("bar_ts"), F.col("closed")), mt.within_trading_hours(F.col("bar_ts"), F.col("closed"))).collect()
    assert [tuple(r) for r in got] == [(False, False), (False, False), (False, False), (True, True), (False, False)]


def pending(spark, n=9):
    at = dt.datetime(2024, 1, 2, 10)
    rows = [{"row_id": f"r{i}", "timestamp": at + dt.timedelta(minutes=i), "ticker": "A" if i % 2 else "B", "close": 100.0, "prediction_direction": "UP"} for i in range(n)]
    return spark.createDataFrame([tuple(r.get(c) for c in LEDGER.names) for r in rows], LEDGER)


def test_outcomes_are_stored_once(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    store.append_predictions(pending(spark), path)
    at = dt.datetime(2024, 1, 2, 10)
    prices = spark.createDataFrame([(t, at + dt.timedelta(minutes=m), 100.0 + m) for t in "AB" for m in (6, 20)], "ticker string, ts timestamp, price double")
    assert store.read_ledger(spark, path).where("actual_direction IS NULL").count() == 9
    early = le.resolve_phase2(store.read_ledger(spark, path), prices, at + dt.timedelta(minutes=10))
    store.append_outcomes(early, path)
    first = store.read_ledger(spark, path)
    assert first.count() == 9 and first.where("actual_direction IS NOT NULL").count() == 2
    for _ in range(2):
        store.append_outcomes(le.resolve_phase2(store.read_ledger(spark, path), prices, at + dt.timedelta(hours=2)), path)
    rows = store.read_ledger(spark, path)
    assert rows.count() == rows.select("row_id").distinct().count() == 9
    assert rows.where("actual_direction IS NULL").count() == 0
    assert {r["row_id"]: r["resolution_price"] for r in rows.collect()} == {f"r{i}": 106.0 if i < 2 else 120.0 for i in range(9)}
    store.append_outcomes(le.sweep_orphans(rows, at + dt.timedelta(hours=3)), path)
    assert spark.read.parquet(f"{path}-outcomes").count() == 9
    assert store.read_ledger(spark, path, ["A"]).where("actual_direction IS NOT NULL").count() == 4


def test_resolved_rows_stay_out_of_the_join(spark):
    ledger = pending(spark)
    done = ledger.withColumn("actual_direction", F.when(F.col("row_id") > "r3", "UP")).withColumn("reward", F.lit(7.0))
    prices = spark.createDataFrame([("A", dt.datetime(2024, 1, 2, 10, 30), 101.0)], "ticker string, ts timestamp, price double")
    got = le.resolve_phase2(done, prices, dt.datetime(2024, 1, 2, 12))
    rows = {r["row_id"]: r for r in got.collect()}
    assert len(rows) == 9 and all(rows[f"r{i}"]["reward"] == 7.0 for i in range(4, 9)) and rows["r1"]["resolution_price"] == 101.0
    assert le.resolve_phase2(ledger.where("false"), prices, dt.datetime(2024, 1, 2, 12)).count() == 0


def test_asof_keeps_repeated_rows_and_sorts_narrow_ones(spark):
    at = dt.datetime(2024, 1, 2, 10)
    left = spark.createDataFrame([("A", at, "wide" * 50)] * 3 + [(None, at, "x"), ("A", None, "y")], "ticker string, t timestamp, blob string")
    right = spark.createDataFrame([("A", at + dt.timedelta(seconds=s), float(s)) for s in (0, 400, 400, 900)], "ticker string, ts timestamp, price double")
    df = asof_forward(left, right, "ticker", "t", "ts", "price", 300)
    assert sorted(r["matched_value"] or 0 for r in df.collect()) == [0, 0, 400, 400, 400]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert all("blob" not in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window"))


def test_merges_of_repeated_keys_take_the_last(spark):
    cols = "row_id string, timestamp timestamp, resolution_timestamp timestamp, used_in_training boolean, v int"
    at = lambda d: dt.datetime(2024, 1, d)
    old = spark.createDataFrame([("a", at(2), at(2), True, 1), ("b", at(2), at(2), None, 2), ("z", at(1), at(1), True, 0)], cols)
    new = spark.createDataFrame([("a", at(3), at(4), False, 3), ("a", at(3), at(5), False, 4), ("c", at(3), None, None, 5)], cols)
    got = {r["row_id"]: (r["v"], r["used_in_training"]) for r in rp.update_replay(old, new, at(3), 1).collect()}
    assert got == {"a": (4, True), "b": (2, False), "c": (5, False)}
    merged = {r["row_id"]: r["v"] for r in rp.merge_latest(old, new.where("row_id <> 'c'"), "row_id", "resolution_timestamp").collect()}
    assert merged == {"a": 4, "b": 2, "z": 0}


def test_old_replay_versions_go(spark, tmp_path):
    path = f"file://{tmp_path}/replay"
    for i in range(4):
        store.write_replay(pending(spark, i + 1), path)
    assert store.read_replay(spark, path).count() == 4
    assert len([p for p in tmp_path.joinpath("replay").iterdir() if p.name.startswith("v-")]) == 2


def test_missing_state_is_an_error(spark, tmp_path):
    sink = live.indicator_sink(f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    rows = walk("NSE:A", 60) + walk("NSE:B", 40)
    sink(spark.createDataFrame(rows[:50], BAR), 0)
    with pytest.raises(ValueError, match="missing"):
        sink(spark.createDataFrame(rows[50:60], BAR), 7)
    sink(spark.createDataFrame(rows[50:60], BAR), 1)
    one = spark.read.parquet(f"file://{tmp_path}/out/batch=1")
    assert sorted(r["series_idx"] for r in one.collect()) == list(range(50, 60))
    with pytest.raises(ValueError, match="new state folder"):
        sink(spark.createDataFrame(rows[:50], BAR), 0)


def test_a_batch_works_on_its_own_tickers(spark):
    old = walk("NSE:A", 60) + walk("NSE:B", 60)
    _, history, _ = live.indicator_batch(spark.createDataFrame(old, BAR), None)
    new = [r for r in walk("NSE:A", 61)[60:]] + [("NSE:A", None, 1.0, 1.0, 1.0, 1.0, 1)]
    result, keep, late = live.indicator_batch(spark.createDataFrame(new, BAR), history)
    assert result.count() == 1 and late.count() == 1
    assert {r["ticker"]: r["count"] for r in keep.groupBy("ticker").count().collect()} == {"NSE:A": 61, "NSE:B": 60}


def test_indicator_names(spark):
    assert ind.indicator("rsi") is ind.rsi
    with pytest.raises(ValueError, match="unknown indicator"):
        ind.indicator("nothing")
