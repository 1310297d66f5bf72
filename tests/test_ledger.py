import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import curation as cu, ledger as le, replay as rp
from tickloom.operators.signals import baseline_predictions
from tickloom.schema import LEDGER
from tickloom.sources import ledger_store as store

T0 = dt.datetime(2024, 1, 2, 10, 0)


def row(row_id="r1", ticker="NSE:A", at=T0, close=1650.0, predicted="UP", conf="MED", **over):
    base = {f.name: None for f in LEDGER}
    base.update(row_id=row_id, ticker=ticker, timestamp=at, close=close, open=close, high=close, low=close,
                volume=1.0, prediction_direction=predicted, prediction_confidence=conf, prediction_return_pct=0.1,
                agent_contributions="[]", cycle_id="c", **over)
    return tuple(base[f.name] for f in LEDGER)


def ledger(spark, *rows):
    return spark.createDataFrame(list(rows), LEDGER)


def prices(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, ts timestamp, price double")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_resolve_up(spark):
    p = prices(spark, ("NSE:A", T0 + dt.timedelta(seconds=360), 1660.0))
    r = one(le.resolve_phase2(ledger(spark, row()), p, T0 + dt.timedelta(seconds=360)))
    assert (r.actual_direction, r.actual_return_pct, r.prediction_accuracy, r.reward) == ("UP", 0.6061, True, 1.0)
    assert r.resolution_price == 1660.0 and r.used_in_training is False


def test_resolve_down_at_current_prices(spark):
    now = T0 + dt.timedelta(seconds=400)
    cur = spark.createDataFrame([("NSE:A", 1470.0)], "ticker string, price double")
    r = one(le.resolve_at_current(ledger(spark, row(close=1480.0)), cur, now))
    assert (r.actual_direction, r.actual_return_pct, r.prediction_accuracy) == ("DOWN", -0.6757, False)


def test_too_early_stays_open_and_price_before_the_gap_is_ignored(spark):
    p = prices(spark, ("NSE:A", T0 + dt.timedelta(seconds=299), 1700.0))
    assert one(le.resolve_phase2(ledger(spark, row()), p, T0 + dt.timedelta(seconds=400))).actual_direction is None


def test_missing_ticker_falls_back_to_entry_price(spark):
    cur = spark.createDataFrame([("NSE:X", 1.0)], "ticker string, price double")
    r = one(le.resolve_at_current(ledger(spark, row()), cur, T0 + dt.timedelta(hours=1)))
    assert (r.actual_direction, r.resolution_price) == ("SIDEWAYS", 1650.0)


def test_zero_entry_price_gives_no_return(spark):
    cur = spark.createDataFrame([("NSE:A", 10.0)], "ticker string, price double")
    r = one(le.resolve_at_current(ledger(spark, row(close=0.0)), cur, T0 + dt.timedelta(hours=1)))
    assert (r.actual_direction, r.actual_return_pct) == ("SIDEWAYS", 0.0)


@pytest.mark.parametrize("age,label,price", [(7200, "EXPIRED", 0.0), (3600, "SIDEWAYS", 1650.0), (301, "SIDEWAYS", 1650.0), (300, None, None)])
def test_sweep(spark, age, label, price):
    r = one(le.sweep_orphans(ledger(spark, row(predicted="SIDEWAYS")), T0 + dt.timedelta(seconds=age)))
    assert (r.actual_direction, r.resolution_price) == (label, price)
    assert r.prediction_accuracy in (False, None)


def test_outcomes_already_known_are_kept(spark):
    done = row(actual_direction="DOWN", prediction_accuracy=False)
    r = one(le.sweep_orphans(ledger(spark, done), T0 + dt.timedelta(days=1)))
    assert r.actual_direction == "DOWN"


def test_replay_merge_keeps_one_row_and_its_training_mark(spark):
    old = ledger(spark, row(actual_direction="UP", used_in_training=True))
    new = ledger(spark, row(actual_direction="UP", used_in_training=False))
    now = T0 + dt.timedelta(days=45)
    assert one(rp.update_replay(old, new, now)).used_in_training is True
    assert rp.update_replay(old, new, now + dt.timedelta(seconds=1)).count() == 0


def test_merge_latest_with_many_copies_of_one_key(spark):
    old = ledger(spark, *[row(row_id="hot", conf="LOW")] * 200, row(row_id="b"))
    new = ledger(spark, *[row(row_id="hot", conf="HIGH")] * 200)
    got = {r.row_id: r.prediction_confidence for r in rp.merge_latest(old, new, "row_id").collect()}
    assert got == {"hot": "HIGH", "b": "MED"}


@pytest.mark.parametrize("sizes,each", [((10, 5, 2), 2), ((2, 1, 0), 1), ((5, 0, 0), 5)])
def test_balance(spark, sizes, each):
    rows = [row(row_id=f"{d}{i}", actual_direction=d) for d, n in zip(("UP", "DOWN", "SIDEWAYS"), sizes) for i in range(n)]
    rows.append(row(row_id="x", actual_direction="EXPIRED"))
    got = {r.actual_direction: r["count"] for r in cu.balance_classes(ledger(spark, *rows)).groupBy("actual_direction").count().collect()}
    assert got == {d: each for d, n in zip(("UP", "DOWN", "SIDEWAYS"), sizes) if n}


def test_eligible_and_pairs(spark):
    rows = [
        row("ok", actual_direction="DOWN", prediction_accuracy=True, actual_return_pct=-0.5, used_in_training=False),
        row("used", actual_direction="UP", prediction_accuracy=True, used_in_training=True),
        row("miss", actual_direction="UP", prediction_accuracy=False, used_in_training=False),
        row("open", prediction_accuracy=True),
    ]
    pairs = cu.training_pairs(cu.eligible(ledger(spark, *rows))).collect()
    assert [p.row_id for p in pairs] == ["ok"]
    answer = json.loads(pairs[0].completion)
    assert answer == {"direction": "DOWN", "target_return_pct": -0.5, "confidence": "MED"}
    assert "RSI(14): 0.00" in pairs[0].prompt and "C=1650.00" in pairs[0].prompt


def test_split_is_repeatable_and_near_its_share(spark):
    df = spark.range(20_000).selectExpr("string(id) AS row_id")
    n = cu.split(df).where("part = 'validation'").count()
    assert n == cu.split(df.repartition(3)).where("part = 'validation'").count()
    assert 1800 < n < 2200


def test_mark_trained_and_mix(spark):
    df = ledger(spark, *[row(f"r{i}", used_in_training=False) for i in range(14)])
    used = spark.createDataFrame([("r1",), ("r1",), ("zz",)], "row_id string")
    assert {r.row_id for r in rp.mark_trained(df, used).where("used_in_training").collect()} == {"r1"}
    mixed = rp.mix_replay(df.where("row_id < 'r2' AND row_id <> 'r1'"), df.where("row_id >= 'r2' OR row_id = 'r1'"))
    counts = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert counts == {"rolling": 5, "static": 2}


def test_backtest_counts_and_offset(spark, bars):
    got = le.backtest(bars).toPandas()
    per = got.groupby("ticker").size().to_dict()
    assert per == {"NSE:HOT": len(range(30, 1500, 20)), "NSE:B": len(range(30, 260, 20)), "NSE:C": 1}
    closes = {(r.ticker, r.bar_ts): r.close for r in bars.collect()}
    series = {}
    for (t, ts), c in sorted(closes.items()):
        series.setdefault(t, []).append(c)
    for r in got.itertuples():
        i = int(r.cycle_id.split("_")[1])
        s = series[r.ticker]
        assert r.close == s[i] and r.resolution_price == s[min(i + 20, len(s) - 1)]
    assert got.row_id.is_unique


def test_backtest_in_short_slices_gives_the_same(bars):
    key = ["row_id", "prediction_direction", "prediction_confidence", "actual_direction", "resolution_price"]
    rows = lambda df: sorted(tuple(r) for r in df.select(*key).collect())
    assert rows(le.backtest(bars)) == rows(le.backtest(bars, size=1150))


def test_predictor_can_be_replaced(bars):
    flat = lambda df: df.withColumns(
        {"prediction_direction": F.lit("SIDEWAYS"), "prediction_return_pct": F.lit(0.0), "prediction_confidence": F.lit("LOW")}
    )
    assert {r[0] for r in le.backtest(bars, predictor=flat).select("prediction_direction").distinct().collect()} == {"SIDEWAYS"}


def test_random_baseline_uses_all_classes(spark):
    df = spark.range(3000).selectExpr("string(id) AS row_id", "'UP' AS technical_direction", "'UP' AS prediction_direction")
    got = baseline_predictions(df, ["random"]).groupBy("method_direction").count().collect()
    assert len(got) == 3 and all(900 < r["count"] < 1100 for r in got)


def test_store_prunes_tickers_and_replaces_replay(spark, tmp_path):
    df = ledger(spark, row("a", "NSE:A"), row("b", "NSE:B"))
    store.append_predictions(df, f"{tmp_path}/ledger")
    store.append_predictions(ledger(spark, row("c", "NSE:A")), f"{tmp_path}/ledger")
    back = store.read_ledger(spark, f"{tmp_path}/ledger", ["NSE:A"])
    assert {r.row_id for r in back.collect()} == {"a", "c"} and back.columns == LEDGER.names
    assert "PartitionFilters: [ticker" in back._jdf.queryExecution().executedPlan().toString().replace("isnotnull(ticker", "ticker")
    assert store.read_replay(spark, f"{tmp_path}/replay").count() == 0
    store.write_replay(df, f"{tmp_path}/replay")
    store.write_replay(store.read_replay(spark, f"{tmp_path}/replay").where("row_id = 'b'"), f"{tmp_path}/replay")
    assert [r.row_id for r in store.read_replay(spark, f"{tmp_path}/replay").collect()] == ["b"]


def test_only_the_days_of_pending_windows_are_read(spark, tmp_path):
    from tickloom.sources import bars as bar_files

    start = dt.datetime(2024, 1, 1)
    ticks = [("NSE:A", start + dt.timedelta(minutes=20 * i), 100.0 + i % 7) for i in range(72 * 20)]
    bar_files.write_prices(spark.createDataFrame(ticks, "ticker string, ts timestamp, price double"), f"{tmp_path}/prices")
    prices = bar_files.read_prices(spark, f"{tmp_path}/prices")
    open_rows = ledger(spark, row("a", "NSE:A"), row("b", "NSE:A")).withColumn("timestamp", F.lit(start + dt.timedelta(days=7, hours=3)).cast("timestamp"))
    done = le.resolve_phase2(open_rows.withColumns(le.empty_phase2()), prices, start + dt.timedelta(days=30))
    assert "PartitionFilters: [isnotnull(day" in done._jdf.queryExecution().executedPlan().toString()
    found = {(r.row_id, r.resolution_timestamp) for r in done.collect()}
    assert found == {(i, start + dt.timedelta(days=7, hours=3, minutes=20)) for i in "ab"}


def test_short_windows_in_buckets_of_their_own_length(spark):
    import random

    from tickloom.plans.asof import asof_forward

    r = random.Random(5)
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    left = [("AB"[r.randrange(2)], at(r.randrange(40000)), i) for i in range(300)]
    right = [("A", at(r.randrange(40000)), float(i)) for i in range(150)]
    for low, high in ((0, 0), (10, 500), (300, 3600), (0, 7200), (100, 9000)):
        got = asof_forward(spark.createDataFrame(left, "k string, t timestamp, i int"), spark.createDataFrame(right, "k string, ts timestamp, v double"),
                           "k", "t", "ts", "v", low, high)
        want = []
        for k, t, i in left:
            ok = sorted((ts, v) for g, ts, v in right if g == k and t + dt.timedelta(seconds=low) <= ts <= t + dt.timedelta(seconds=high))
            want.append((i, *(ok[0] if ok else (None, None))))
        assert sorted(map(str, want)) == sorted(str((x.i, x.matched_ts, x.matched_value)) for x in got.collect())
