import datetime as dt

from pyspark.sql import functions as F, types as T

from tickloom.streaming.newest import CycleLatency, NewestRows, newest_predictions

T0 = dt.datetime(2024, 1, 2, 9, 15)
BARS = T.StructType().add("ticker", "string").add("bar_ts", "timestamp").add("close", "double").add("volume", "long").add("note", "string")


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def bars(spark, rows):
    return spark.createDataFrame([(k, at(m) if m is not None else None, c, 1, "x") for k, m, c in rows], BARS)


def test_newest_rows_after_late_and_revised_bars(spark, tmp_path):
    state = NewestRows(spark, f"file://{tmp_path}/s", BARS, "bar_ts", ["close", "volume"], buckets=8)
    state.merge(bars(spark, [("a", 0, 1.0), ("a", 5, 2.0), ("b", 0, 9.0), (None, 1, 5.0), ("c", None, 5.0)]), 0)
    state.merge(bars(spark, [("a", 3, 7.0), ("b", 0, 4.0)]), 1)  # late for a, revised downwards for b
    assert {r.ticker: r.close for r in state.read().collect()} == {"a": 2.0, "b": 4.0}
    state.merge(bars(spark, [("d", 1, 3.0)]), 2)
    state.merge(bars(spark, [("d", 1, 3.0)]), 2)  # the same batch again
    assert {r.ticker: r.close for r in state.read().collect()} == {"a": 2.0, "b": 4.0, "d": 3.0}
    assert {r.ticker for r in state.read(1).collect()} == {"a", "b"}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    state = NewestRows(spark, f"file://{tmp_path}/s", BARS, "bar_ts", ["close"], buckets=16)
    many = [(f"t{i}", 0, float(i)) for i in range(200)]
    state.merge(bars(spark, many), 0)
    state.merge(bars(spark, [("t7", 5, -1.0)]), 1)
    versions = state.state.manifest(1)
    assert sorted(versions.values()) == [0] * 15 + [1]
    assert state.read().count() == 200 and state.read().filter("ticker = 't7'").first().close == -1.0


def test_cycle_totals_and_rows_of_equal_time(spark, tmp_path):
    schema = "ticker string, timestamp timestamp, row_id string, cycle_id string, inference_latency_ms double"
    rows = [("a", at(0), "r1", "c1", 10.0), ("b", at(1), "r2", "c1", None), ("a", at(2), "r3", "c2", 5.0), ("b", at(2), "r9", "c1", 2.0)]
    make = lambda some: spark.createDataFrame(some, schema)
    cycles = CycleLatency(spark, f"file://{tmp_path}/c")
    preds = newest_predictions(spark, f"file://{tmp_path}", make([]).schema)
    for i, part in enumerate((rows[2:], rows[:2], rows[:2])):
        for state in (cycles, preds):
            state.merge(make(part), min(i, 1))
    got = cycles.newest().first()
    assert (got.cycle_id, got.latency_ms) == ("c1", 12.0)
    assert {r.ticker: r.row_id for r in preds.read().collect()} == {"a": "r3", "b": "r9"}
    cycles.merge(make([("a", at(60 * 24 * 3), "r10", None, 1.0)]), 2)
    assert cycles.newest().first().cycle_id == "c1"
    cycles.merge(make([("a", at(60 * 24 * 3), "r11", "c3", 1.5)]), 3)
    assert cycles.newest().first().latency_ms == 1.5


def test_states_before_the_first_batch_are_empty(spark, tmp_path):
    state = NewestRows(spark, f"file://{tmp_path}/s", BARS, "bar_ts", ["close"])
    assert state.read().count() == 0
    assert CycleLatency(spark, f"file://{tmp_path}/c").newest().count() == 0
    state.merge(bars(spark, []), 0)
    assert state.read().count() == 0
