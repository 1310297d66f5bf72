import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market_time as mt, scoring as sc, text as tx
from tickloom.operators import bars as ba, prompts as pr, responses as rs, rooms as ro
from tickloom.schema import BAR
from tickloom.sources import bars as source
from tests.conftest import walk

CALENDAR = [
    ("2026-08-10 12:00", "day", True), ("2026-08-08 12:00", "day", False), ("2026-08-09 12:00", "day", False),
    ("2026-08-15 12:00", "day", False), ("2026-01-26 12:00", "day", False), ("2026-08-12 12:00", "hours", True),
    ("2026-08-12 08:00", "hours", False), ("2026-08-12 16:00", "hours", False), ("2026-08-12 15:15", "hours", False),
    ("2026-08-12 09:25", "hours", True), ("2026-01-26 12:00", "hours", False), ("2026-08-14 14:55", "hours", True),
    ("2026-08-14 15:05", "hours", False), ("2026-08-12 09:18", "pre", True), ("2026-08-12 09:10", "pre", False),
    ("2026-08-12 09:25", "pre", False), ("2026-08-12 15:30", "post", True), ("2026-08-15 15:30", "post", False),
]


def test_calendar(spark):
    df = spark.createDataFrame([(dt.datetime.fromisoformat(a), k, w) for a, k, w in CALENDAR], "ts timestamp, kind string, want boolean")
    ts = F.col("ts")
    got = (
        F.when(F.col("kind") == "day", mt.is_trading_day(ts)).when(F.col("kind") == "hours", mt.within_trading_hours(ts))
        .when(F.col("kind") == "pre", mt.is_premarket(ts)).otherwise(mt.is_postmarket(ts))
    )
    assert df.where(got != F.col("want")).count() == 0
    closed = spark.createDataFrame([(dt.date(2026, 8, 10),)], "date date")
    assert mt.trading_days(df, closed, "ts").where("date(ts) = '2026-08-10'").count() == 0


def test_aware_times_are_converted(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 8, 12, 6, 30),)], "ts timestamp")
    assert df.select(mt.to_ist(F.col("ts"))).first()[0] == dt.datetime(2026, 8, 12, 12, 0)


@pytest.mark.parametrize("ret,label", [(0.25, "SIDEWAYS"), (0.2501, "UP"), (-0.25, "SIDEWAYS"), (-0.2501, "DOWN"), (None, None)])
def test_direction_label(spark, ret, label):
    df = spark.createDataFrame([(ret,)], "x double")
    assert df.select(sc.direction_label("x")).first()[0] == label


def test_sign_agreement_of_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (-1.0, -2.0)], "a double, b double")
    assert [r[0] for r in df.select(sc.sign_agree("a", "b")).collect()] == [True, False, True]


def test_text_helpers(spark):
    df = spark.createDataFrame([(0.125, "backtest_50", "abcdef"), (None, "cycle_9", None), (-0.001, "backtest_", "ab")], "x double, c string, s string")
    got = df.select(tx.fmt("x"), tx.fmt("x", 0), tx.sample_index("c"), tx.truncate_text("s", 3, "..")).collect()
    assert [tuple(r) for r in got] == [("0.13", "0", 50, "abc.."), ("N/A", "N/A", None, None), ("-0.00", "-0", None, "ab")]


RESPONSES = [
    ("proper", 1, '{"direction":"up","target_return_pct":0.5,"confidence":"high"}', ("UP", 0.5, "HIGH")),
    ("text number", 1, '{"direction":"DOWN","target_return_pct":" -0.5 ","confidence":"MED"}', ("DOWN", -0.5, "MED")),
    ("bad enum", 1, '{"direction":"INVALID","target_return_pct":1,"confidence":"SURE"}', ("SIDEWAYS", 1.0, "LOW")),
    ("empty object", 1, "{}", ("SIDEWAYS", 0.0, "LOW")),
    ("not a number", 1, '{"direction":"UP","target_return_pct":"much","confidence":"HIGH"}', ("SIDEWAYS", 0.0, "LOW")),
    ("null label", 1, '{"direction":null,"target_return_pct":1,"confidence":"HIGH"}', ("SIDEWAYS", 0.0, "LOW")),
    ("number as label", 1, '{"direction":5,"target_return_pct":1,"confidence":"HIGH"}', ("SIDEWAYS", 0.0, "LOW")),
    ("list", 1, "[1, 2]", ("SIDEWAYS", 0.0, "LOW")),
    ("two values", 1, '{"direction":"UP"},{"direction":"UP"}', ("SIDEWAYS", 0.0, "LOW")),
    ("never json", 1, "no idea", ("SIDEWAYS", 0.0, "LOW")),
    ("never json", 2, "still none", ("SIDEWAYS", 0.0, "LOW")),
    ("retry", 1, '{"direction":"UP", and then some', ("DOWN", 0.25, "MED")),
    ("retry", 2, '{"direction":"down","target_return_pct":0.25,"confidence":"med"}', ("DOWN", 0.25, "MED")),
    ("no retry", 1, '{"direction":"UP","target_return_pct":"x"}', ("SIDEWAYS", 0.0, "LOW")),
    ("no retry", 2, '{"direction":"DOWN"}', ("SIDEWAYS", 0.0, "LOW")),
    ("trailing", 1, '{"direction":"UP"} as asked', ("SIDEWAYS", 0.0, "LOW")),
]


def test_response_normalisation(spark):
    df = spark.createDataFrame([r[:3] for r in RESPONSES], "row_id string, attempt int, response string")
    got = {r.row_id: (r.direction, r.target_return_pct, r.confidence) for r in rs.normalize_responses(df).collect()}
    assert got == {r[0]: r[3] for r in RESPONSES}


def test_latency_counts_first_calls(spark):
    calls = [("a", 1, True, 10.0), ("a", 1, False, 5.0), ("a", 2, True, 7.0), ("b", 1, False, 3.0)]
    df = spark.createDataFrame(calls, "row_id string, attempt int, ok boolean, latency_ms double")
    assert {tuple(r) for r in rs.prediction_latency(df).collect()} == {("a", 10.0), ("b", 0.0)}
    assert {tuple(r) for r in rs.prediction_latency(df, count_failed=True).collect()} == {("a", 15.0), ("b", 3.0)}


def test_failed_role_is_marked(spark):
    preds = spark.createDataFrame([("a",)], "row_id string")
    answers = spark.createDataFrame(
        [("a", "technical_analyst", "UP", True), ("a", "volatility_analyst", "timeout", False)],
        "row_id string, role string, text string, ok boolean",
    )
    text = pr.synthesis_prompt(pr.gather_agents(preds, answers)).first().synthesis_prompt
    assert "--- Technical Analyst ---\nUP\n\n--- Volatility Analyst --- [FAILED: timeout]\n\n--- Volume Analyst --- [FAILED]" in text


def test_rooms(spark):
    rows = [(f"room_{i}", t, "s", "contribution", "x" * 10) for i in (1, 2, 10, 11, 12) for t in (0, 1)]
    m = spark.createDataFrame(rows, "room_id string, turn int, sender string, type string, text string")
    assert [(r.turn) for r in ro.room_history(m, "room_2").collect()] == [0, 1]
    assert ro.room_history(m, "room_99").count() == 0
    kept = {r.room_id for r in ro.keep_newest_rooms(m, 3).collect()}
    assert kept == {"room_10", "room_11", "room_12"}
    assert ro.drop_orphans(m, m.where("room_id = 'room_1'")).count() == 2


def test_transcript_cut_matches_plain_join(spark):
    """One room far longer than the cut, with lines shorter and longer than it."""
    texts = [""] * 40 + ["y" * 300] + ["z"] * 2000
    rows = [("long", i, "", "t", x) for i, x in enumerate(texts)] + [("fits", 0, "me", "t", None), ("fits", 1, "you", "t", "b")]
    m = spark.createDataFrame(rows, "room_id string, turn int, sender string, type string, text string").repartition(9)
    got = {r.room_id: r for r in ro.room_transcript(m, 200).collect()}
    full = "\n".join(f"[] {x}" for x in texts)
    assert got["long"].transcript == full[:200] + "...[truncated]"
    assert got["long"].n_chars == len(full) and got["long"].n_messages == len(texts)
    assert got["fits"].transcript == "[me] \n[you] b"


def test_messages_round_trip(spark):
    df = spark.createDataFrame([('[{"sender":"a","text":"t","type":"system","turn":0}]',), (None,)], "j string")
    got = df.select(tx.decode_messages("j").alias("m")).collect()
    assert [len(r.m) for r in got] == [1, 0]
    assert df.where("j IS NOT NULL").select(tx.encode_messages(tx.decode_messages("j"))).first()[0] == df.first().j


def test_bar_files(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    (tmp_path / "NSE_TCS.csv").write_text(head + "2024-01-02 09:25:00,1,2,0.5,1.5,10\n2024-01-02 09:30:00,NaN,2,0.5,1.5,10\n")
    (tmp_path / "INFY.csv").write_text(head + "2024-01-02 09:25:00,1,2,0.5,1.5,10\n")
    (tmp_path / "NSE_ITC.csv").write_text(head)
    got = source.read_bars_csv(spark, str(tmp_path))
    assert {(r.ticker, r["count"]) for r in got.groupBy("ticker").count().collect()} == {("NSE:TCS", 2), ("NSE:INFY", 1)}
    assert got.where("open IS NULL").count() == 1
    missing = ba.missing_sources(ba.universe_table(spark), got)
    assert missing.count() == 8 and missing.where("ticker = 'NSE:ITC'").count() == 1
    assert [r.ticker for r in ba.active_universe(ba.universe_table(spark), 3).collect()] == ["NSE:RELIANCE", "NSE:TCS", "NSE:HDFCBANK"]


def test_cycles_wrap_after_a_short_portion(spark, bars):
    c = bars.where("ticker = 'NSE:SHORT'")
    served = ba.assign_cycles(c, step=3, n_cycles=6).groupBy("cycle").agg(F.array_sort(F.collect_list("series_idx")).alias("i"))
    got = {r.cycle: r.i for r in served.collect()}
    assert got == {0: [0, 1, 2], 1: [3, 4, 5], 2: [6, 7, 8], 3: [9], 4: [0, 1, 2], 5: [3, 4, 5]}
    assert ba.assign_cycles(c, step=3, n_cycles=6, loop=False).agg(F.max("cycle")).first()[0] == 3


def test_session_grid(spark):
    days = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "date date")
    got = [r.bar_ts for r in ba.session_grid(days).orderBy("bar_ts").collect()]
    assert len(got) == 71 and got[0] == dt.datetime(2024, 1, 5, 9, 25) and got[-1] == dt.datetime(2024, 1, 5, 15, 15)


def test_stored_bars_prune_days(spark, tmp_path, bars):
    source.write_bars(bars, f"{tmp_path}/bars")
    day = dt.date(2024, 1, 3)
    back = source.read_bars(spark, f"{tmp_path}/bars").where(F.col("day") == F.lit(day))
    assert back.count() == bars.where(F.to_date("bar_ts") == F.lit(day)).count() > 0
    assert "PartitionFilters: [isnotnull(day" in back._jdf.queryExecution().executedPlan().toString()


def test_bar_file_stream(spark, tmp_path):
    head = "timestamp,open,high,low,close,volume\n"
    for name in ("NSE_TCS", "NSE_ITC"):
        (tmp_path / f"{name}.csv").write_text(head + "2024-01-02 09:25:00,1,2,0.5,1.5,10\n")
    q = (source.stream_bars(spark, str(tmp_path)).writeStream.format("memory").queryName("bar_files")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.ticker for r in spark.table("bar_files").collect()} == {"NSE:TCS", "NSE:ITC"}


def test_predicates_and_registry(spark, bars):
    from tickloom.operators.indicators import INDICATORS
    assert set(INDICATORS) >= {"vwap", "rsi", "macd", "bollinger", "atr", "sma"}
    assert all(INDICATORS[n](bars).columns for n in ("vwap", "true_range"))
    df = spark.createDataFrame([("UP",), (None,)], "actual_direction string")
    assert df.where(sc.resolved()).count() == df.where(sc.pending()).count() == 1


def test_column_names_and_union(spark):
    from tickloom.operators.replay import union_all
    a = ba.normalize_columns(spark.createDataFrame([(1, 2)], "Open int, CLOSE int"))
    assert a.columns == ["open", "close"]
    rows = union_all(a, spark.createDataFrame([(5,)], "close int")).collect()
    assert sorted((r.open or 0, r.close) for r in rows) == [(0, 5), (1, 2)]


def test_snapshot_document(spark, bars, tmp_path):
    import json

    from tickloom.operators.ledger import backtest
    from tickloom.sources.snapshot import dashboard_snapshot, write_snapshot
    active = spark.createDataFrame([("NSE:HOT",), ("NSE:B",)], "ticker string")
    doc = dashboard_snapshot(bars, backtest(bars), active, {"mode": "BACKTEST"})
    write_snapshot(doc, f"{tmp_path}/snap")
    got = json.loads(spark.read.text(f"{tmp_path}/snap").first().value)
    assert set(got) == {"market", "predictions", "status"} and set(got["market"]) == {"HOT", "B"}
    last = bars.where("ticker = 'NSE:B'").orderBy(F.desc("bar_ts")).first()
    assert got["market"]["B"]["close"] == last.close and got["predictions"]["HOT"]["direction"] in ("UP", "DOWN", "SIDEWAYS")


def test_bar_files_by_ticker_in_one_write(spark, tmp_path):
    names = ["A", "M&M", "BAJAJ-AUTO", "x y", "100%", "a+b", "k:v"]
    rows = [row for n in names for row in walk(n, 3)] + walk("HOT", 25)
    df = spark.createDataFrame(rows, BAR)
    source.write_bars_csv(df, f"{tmp_path}/files", rows_per_file=10)
    back = source.read_bars_csv(spark, f"{tmp_path}/files")
    assert {(r.ticker, r.bar_ts, r.close, r.volume) for r in back.collect()} == {(f"NSE:{t}", at, c, v) for t, at, _, _, _, c, v in rows}
    assert len(list((tmp_path / "files" / "ticker=HOT").glob("*.csv"))) == 3


def test_supplier_tickers_without_the_formatter(spark):
    from tickloom.driver_tables import supplier_ticker

    df = spark.createDataFrame([(n,) for n in (0, 7, 123456, 999_999, 1_000_000, 12_345_678, -5, None)], "n long")
    got = df.select(supplier_ticker("n").alias("a"), F.format_string("S%06d", "n").alias("b"))
    assert all(r.a == r.b for r in got.collect())
    plan = df.groupBy("n").count().select(supplier_ticker("n"))._jdf.queryExecution().executedPlan().toString()
    assert "lpad" in plan


def test_rounded_is_round(spark):
    from tickloom.catalog import rounded

    import random

    r = random.Random(4)
    values = [0.0, -0.0, 0.5, 1.0005, 2.675, -2.675, 0.0005, 1e-9, 999999.9995, 1e12 + 0.5, -1e300, float("inf"), float("-inf"), float("nan"), None]
    values += [r.gauss(0, 10 ** r.randrange(-6, 10)) for _ in range(20000)]
    values += [k / 2000 for k in range(-4001, 4001)] + [(2 * k + 1) / 2e6 for k in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 3, 4, 6):
        x = F.col("x") + F.signum("x") * 1e-9
        same = (rounded(x, digits) + F.lit(0.0)).eqNullSafe(F.round(x, digits) + F.lit(0.0))
        assert df.where(~same).count() == 0
