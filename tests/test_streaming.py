import datetime as dt
import random

from pyspark.sql import functions as F

from tickloom.operators import indicators as ind, ledger as le
from tickloom.operators.analytics import rolling_accuracy
from tickloom.operators.bars import build_bars
from tickloom.schema import BAR, INDICATOR_COLUMNS
from tickloom.streaming import live
from tests.conftest import walk

T0 = dt.datetime(2024, 1, 2, 10, 0)
TICK = "ticker string, ts timestamp, price double, volume long"


def drain(stream, path, mode="append"):
    q = (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{path}/state")
         .option("path", f"{path}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def test_bars_over_many_batches(spark, tmp_path):
    """Files one after the other, each a batch of its own, with a late but not too late tick."""
    ticks = [("A", T0 + dt.timedelta(seconds=37 * i), 100.0 + i % 17, i) for i in range(300)]
    ticks[40], ticks[41] = ticks[41], ticks[40]
    for part in range(0, 300, 41):
        spark.createDataFrame(ticks[part:part + 41], TICK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("~", T0 + dt.timedelta(days=1), 0.0, 0)], TICK).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema(TICK).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(live.stream_build_bars(feed), str(tmp_path)).where("ticker <> '~'")
    want = build_bars(spark.createDataFrame(ticks, TICK))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_and_batch_resolve_alike(spark, tmp_path):
    preds = [(f"r{i}", T0 + dt.timedelta(minutes=5 * i), "AB"[i % 2], 100.0, "UP") for i in range(40)]
    prices = [("A", T0 + dt.timedelta(minutes=5 * i), 100.0 + (-1) ** i * i / 10) for i in range(60) if not 20 <= i < 40]
    end = T0 + dt.timedelta(days=2)
    pschema = "row_id string, timestamp timestamp, ticker string, close double, prediction_direction string"
    qschema = "ticker string, ts timestamp, price double"
    spark.createDataFrame(preds + [("~", end, "~", 1.0, "UP")], pschema).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame(prices + [("~", end, 1.0)], qschema).write.parquet(f"{tmp_path}/q")
    stream = live.stream_resolve(spark.readStream.schema(pschema).parquet(f"{tmp_path}/p"), spark.readStream.schema(qschema).parquet(f"{tmp_path}/q"))
    cols = ["row_id", "actual_direction", "actual_return_pct", "prediction_accuracy", "resolution_price", "resolution_timestamp"]
    got = drain(stream, str(tmp_path)).where("ticker <> '~'").select(*cols)
    open_rows = spark.createDataFrame(preds, pschema).withColumns(le.empty_phase2())
    want = le.resolve_phase2(open_rows, spark.createDataFrame(prices, qschema), end).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    labels = {r[0] for r in want.select("actual_direction").distinct().collect()}
    assert "EXPIRED" in labels and "UP" in labels


def test_stream_of_ticks_takes_the_earliest_price_and_not_the_first_to_arrive(spark, tmp_path):
    """Windows that begin inside a slot, ticks out of order within a batch and over batches, ties, an empty slot."""
    r = random.Random(11)
    preds = [(f"r{i}", T0 + dt.timedelta(seconds=97 * i), "AB"[i % 2], 100.0, "UP") for i in range(60)]
    ticks = [("A", T0 + dt.timedelta(seconds=r.randrange(300, 9000), microseconds=r.randrange(3)), 90 + r.random() * 20) for _ in range(400)]
    ticks = [t for t in ticks if not 3000 < (t[1] - T0).total_seconds() < 4300]
    ticks += [("A", ticks[0][1], 91.5), (None, T0, 1.0), ("A", T0 + dt.timedelta(seconds=301), None)]
    ticks.sort(key=lambda t: t[1].replace(microsecond=0) + dt.timedelta(seconds=r.randrange(50)))
    end = T0 + dt.timedelta(days=2)
    pschema = "row_id string, timestamp timestamp, ticker string, close double, prediction_direction string"
    qschema = "ticker string, ts timestamp, price double"
    spark.createDataFrame(preds, pschema).coalesce(1).write.parquet(f"{tmp_path}/p")
    for part in range(0, len(ticks), 80):
        spark.createDataFrame(ticks[part:part + 80], qschema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    spark.createDataFrame([("~", end, "~", 1.0, "UP")], pschema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
    spark.createDataFrame([("~", end, 1.0)], qschema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    feed = lambda s, x: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}")
    got = drain(live.stream_resolve(feed(pschema, "p"), feed(qschema, "q")), str(tmp_path)).where("ticker <> '~'")
    cols = ["row_id", "actual_direction", "actual_return_pct", "resolution_price", "resolution_timestamp"]
    open_rows = spark.createDataFrame(preds, pschema).withColumns(le.empty_phase2())
    want = le.resolve_phase2(open_rows, spark.createDataFrame(ticks, qschema), end).select(*cols)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.collect()))
    assert {r[0] for r in want.select("actual_direction").distinct().collect()} > {"EXPIRED"}


def test_indicators_continue_over_batches(spark, tmp_path):
    """A long series in four feeds, a series that starts late, and one late bar."""
    rows = sorted(walk("L", 2300) + walk("N", 100, start=dt.datetime(2024, 2, 1, 9, 25)), key=lambda r: r[1])
    cuts = [0, 700, 1300, 1800, len(rows)]
    for a, b in zip(cuts, cuts[1:]):
        extra = [rows[5]] if a == 1300 else []
        spark.createDataFrame(rows[a:b] + extra, BAR).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(BAR).parquet(f"{tmp_path}/in")
        live.stream_indicators(feed, f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/progress").awaitTermination()
    cols = ["ticker", "bar_ts", "series_idx", *[F.round(c, 8).alias(c) for c in INDICATOR_COLUMNS]]
    got = spark.read.parquet(f"{tmp_path}/out").select(*cols)
    want = ind.compute_indicators(spark.createDataFrame(rows, BAR)).select(*cols)
    assert got.count() == len(rows)
    assert got.exceptAll(want).count() == 0
    assert spark.read.parquet(f"{tmp_path}/out-late").count() == 1
    state = live.indicator_state(spark, f"{tmp_path}/state").read(3)
    assert state.where("ticker = 'L'").count() <= ind.INDICATOR_BACK + 71


def test_repeating_a_batch_changes_nothing(spark, tmp_path):
    rows = walk("L", 200)
    sink = live.indicator_sink(f"{tmp_path}/out", f"{tmp_path}/state")
    first, second = spark.createDataFrame(rows[:120], BAR), spark.createDataFrame(rows[120:], BAR)
    sink(first, 0)
    sink(second, 1)
    once = sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect()))
    sink(second, 1)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == once and len(once) == 200


def test_rolling_accuracy_over_batches(spark, tmp_path):
    rows = [(f"r{i:03d}", T0 + dt.timedelta(minutes=i), i % 3 == 0, "UP") for i in range(90)]
    schema = "row_id string, timestamp timestamp, prediction_accuracy boolean, actual_direction string"
    sink = live.rolling_sink(f"{tmp_path}/out", f"{tmp_path}/state")
    for batch, (a, b) in enumerate([(0, 7), (7, 50), (50, 50), (50, 90)]):
        sink(spark.createDataFrame(rows[a:b], schema), batch)
    cols = ["row_id", "series_idx", "rolling_accuracy_pct"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*cols)
    want = rolling_accuracy(spark.createDataFrame(rows, schema)).select(*cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_dedupe_and_latest(spark, tmp_path):
    rows = [("a", T0, 1), ("a", T0, 1), ("b", T0, 2)]
    spark.createDataFrame(rows, "row_id string, timestamp timestamp, x int").write.parquet(f"{tmp_path}/in")
    feed = spark.readStream.schema("row_id string, timestamp timestamp, x int").parquet(f"{tmp_path}/in")
    assert drain(live.stream_dedupe(feed, ["row_id"], "timestamp"), str(tmp_path)).count() == 2


def test_post_market_is_repeatable(spark, tmp_path, bars):
    rows = le.backtest(bars).cache()
    when = rows.agg(F.max("timestamp")).first()[0] + dt.timedelta(days=1)
    def run():
        after = live.run_post_market(rows, rows, str(tmp_path), dt.date(2024, 2, 1), when, 1)
        return sorted(tuple(r) for r in after.select("row_id", "used_in_training").collect())

    assert run() == run()
    pairs = spark.read.parquet(f"{tmp_path}/date=2024-02-01/pairs").count()
    assert pairs == sum(used for _, used in run()) > 0
