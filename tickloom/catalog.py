"""Named queries over the given tables, one per operator or group of operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom import driver_tables as src
from tickloom.functions import market_time as mt, scoring as sc, text as tx
from tickloom.operators import (
    analytics as an, bars as ba, curation as cu, indicators as ind, ledger as le, prompts as pr,
    replay as rp, responses as rs, rooms as ro, signals as sg,
)
from tickloom.plans.asof import asof_forward
from tickloom.plans.selection import select_quantile
from tickloom.schema import BAR
from tickloom.session import stage, staged_folder
from tickloom.sources import bars as bar_files, ledger_store as store
from tickloom.sources.snapshot import activity_snapshot, dashboard_snapshot
from tickloom.streaming import live, newest, restate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed points in time inside the span of the given events.
ASOF = dt.datetime(2024, 1, 25)
SWEEP_AT = dt.datetime(2024, 1, 20, 12, 30)
REPLAY_NOW = dt.datetime(2024, 2, 28)
OLD_FROM, OLD_TO = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(x: Column, digits: int) -> Column:
    """``round(x, digits)``, by whole numbers where these decide it.

    Spark rounds a double by its decimal digits, which takes longer than most indicators. The scaled number is off by
    less than 0.001 below 1e12, so unless it is that near to a tie, the next whole number is the same, and its quotient
    by a power of ten is the double nearest to that decimal.
    """
    power = F.lit(float(10**digits))
    scaled = x * power
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.rint(scaled)) < 0.499)
    return F.when(clear, F.rint(scaled) / power).otherwise(F.round(x, digits))


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Comparable output: doubles rounded, times as text, integers as BIGINT.

    The nudge before rounding keeps the last bits of a sum from deciding an exact tie.
    """
    out: list[Column] = []
    for f in df.select(*columns).schema if columns else df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = rounded(c + F.signum(c) * 1e-9, digits) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- bars and indicators ---------------------------------------------------------------------------


@query
def bars_hourly(spark, d):
    return shown(ba.build_bars(src.ticks(spark, d), "1 hour"))


@query
def vwap(spark, d):
    return shown(ind.vwap(ba.build_bars(src.ticks(spark, d), "1 hour")), "ticker", "bar_ts", "vwap")


@query
def rsi(spark, d):
    return shown(ind.rsi(src.bars(spark, d)), "ticker", "bar_ts", "rsi_14")


@query
def macd(spark, d):
    return shown(ind.macd(src.bars(spark, d)), "ticker", "bar_ts", "macd", "macd_signal", "macd_hist")


@query
def bollinger(spark, d):
    return shown(ind.bollinger(src.bars(spark, d)), "ticker", "bar_ts", "bb_lower", "bb_middle", "bb_upper")


@query
def true_range(spark, d):
    return shown(ind.true_range(src.bars(spark, d)), "ticker", "bar_ts", "true_range")


@query
def atr(spark, d):
    return shown(ind.atr(src.bars(spark, d)), "ticker", "bar_ts", "atr_14")


@query
def sma(spark, d):
    return shown(ind.sma(src.bars(spark, d)), "ticker", "bar_ts", "sma_50", "sma_200")


@query
def ema_generic(spark, d):
    return shown(ind.rma(ind.ema(src.bars(spark, d), "close", 20), "close", 10), "ticker", "bar_ts", "ema_20", "rma_10")


@query
def ema_long(spark, d):
    """An average that remembers 9,200 bars, over blocks of 512 bars that carry no copies."""
    bars = ind.ema(src.bars(spark, d, "5 minutes"), "close", 400, size=512)
    return shown(ind.rma(bars, "close", 300, size=512), "ticker", "bar_ts", "ema_400", "rma_300")


@query
def min_history_gate(spark, d):
    gated = ind.min_history_gate(ind.vwap(src.bars(spark, d)), rows=680)
    return shown(gated, "ticker", "bar_ts", "series_len", "vwap")


@query
def indicators_all(spark, d):
    return shown(ind.compute_indicators(src.bars(spark, d)))


@query
def supplier_bars_indicators(spark, d):
    done = ind.compute_indicators(src.supplier_bars(spark, d))
    return shown(done, "ticker", "bar_ts", "close", "vwap", "rsi_14", "macd", "macd_signal", "bb_upper", "atr_14", "sma_50", digits=3)


# --- selections, checks, positions -------------------------------------------------------------------


@query
def latest_per_ticker(spark, d):
    return shown(ba.latest_per_key(ba.build_bars(src.ticks(spark, d), "1 hour")))


@query
def last_n_bars(spark, d):
    return shown(ba.last_n(ba.build_bars(src.ticks(spark, d), "1 hour"), ["ticker"], F.desc("bar_ts"), 100))


@query
def bar_change(spark, d):
    bars = ba.build_bars(src.ticks(spark, d), "1 hour")
    changed = ba.bar_side(ba.bar_change(bars)).withColumn("symbol", sc.short_ticker(F.concat(F.lit("NSE:"), "ticker")))
    return shown(changed, "symbol", "bar_ts", "change", "change_pct", "side")


@query
def bar_returns(spark, d):
    return shown(ba.bar_returns(src.bars(spark, d)), "ticker", "bar_ts", "prev_close", "simple_return")


@query
def ohlc_violations(spark, d):
    """Supplier bars opened at the previous close leave their range at times."""
    gapped = ba.bar_returns(src.supplier_bars(spark, d)).withColumn("open", F.col("prev_close"))
    return shown(ba.ohlc_violations(gapped), "ticker", "bar_ts", "open", "high", "low", "close", digits=4)


@query
def series_index(spark, d):
    return shown(ba.series_index(src.bars(spark, d)), "ticker", "bar_ts", "series_idx", "series_len")


@query
def systematic_sample(spark, d):
    return shown(ba.systematic_sample(src.bars(spark, d)), "ticker", "bar_ts", "series_idx", "close")


@query
def replay_cycles(spark, d):
    return shown(ba.assign_cycles(src.bars(spark, d), step=7, n_cycles=150), "cycle", "ticker", "bar_ts", "close")


@query
def replay_cycles_once(spark, d):
    served = ba.assign_cycles(src.bars(spark, d), step=7, n_cycles=150, loop=False)
    return shown(served, "cycle", "ticker", "bar_ts", "close")


@query
def session_grid_missing(spark, d):
    return shown(ba.missing_bars(ba.build_bars(src.ticks(spark, d), "5 minutes")), "ticker", "date", "bar_ts")


@query
def market_calendar(spark, d):
    ts = F.col("ts")
    flags = src.ticks(spark, d).select(
        "event_id",
        mt.is_trading_day(ts).alias("trading_day"),
        mt.within_trading_hours(ts).alias("in_session"),
        mt.is_premarket(ts).alias("premarket"),
        mt.is_postmarket(ts).alias("postmarket"),
    )
    return shown(flags)


@query
def market_zone(spark, d):
    """The same events read as UTC instants, converted to exchange time first."""
    ts = mt.to_ist(F.col("ts"))
    return shown(src.ticks(spark, d).select("event_id", ts.alias("ist_ts"), mt.within_trading_hours(ts).alias("in_session")))


@query
def trading_day_bars(spark, d):
    bars = src.bars(spark, d)
    dates = bars.select(F.to_date("bar_ts").alias("date")).distinct()
    return shown(mt.trading_days(bars, dates.where(mt.is_national_holiday(F.col("date")))), "ticker", "bar_ts", "close")


@query
def universe_audit(spark, d):
    lines = src.table(spark, d, "lineitem").select(F.format_string("S%06d", "l_suppkey").alias("ticker"))
    return shown(ba.missing_sources(src.universe(spark, d), lines))


@query
def active_universe(spark, d):
    active = ba.active_universe(src.universe(spark, d), 3)
    return shown(ba.restrict_to(src.supplier_bars(spark, d), active), "ticker", "bar_ts", "close", "volume", digits=4)


@query
def dedupe_last(spark, d):
    return shown(ba.dedupe_last(src.ticks(spark, d), ["ticker"], "ts", "event_id"))


@query
def distinct_last(spark, d):
    return shown(rp.distinct_last(src.table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id"))


@query
def required_keys(spark, d):
    """Ticks with a size below 10 lose their ticker and are set aside."""
    damaged = src.ticks(spark, d).withColumn("ticker", F.when(F.col("volume") >= 10, F.col("ticker")))
    good, bad = ba.require_not_null(damaged, "ticker", "price")
    both = rp.union_all(good.withColumn("part", F.lit("valid")), bad.withColumn("part", F.lit("quarantine")))
    return shown(both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("id_sum")))


@query
def quarantine_ticks(spark, d):
    """Ticks with some prices and tickers missing: those that make no bar."""
    return shown(ba.unusable_ticks(src.gappy_ticks(spark, d)).select("event_id", "ticker"))


@query
def bars_csv_roundtrip(spark, d):
    """Hourly bars written as one CSV file set per series and read back with the file reader."""
    path = staged_folder(spark, "bar-files")
    bar_files.write_bars_csv(src.bars(spark, d), path)
    return shown(bar_files.read_bars_csv(spark, path))


@query
def bars_csv_stream(spark, d):
    """The same files through the streaming reader, a few per micro-batch."""
    path, base = staged_folder(spark, "bar-files"), staged_folder(spark, "bar-stream")
    bar_files.write_bars_csv(src.bars(spark, d), path)
    done = bar_files.stream_bars(spark, path, 2).writeStream.format("parquet").option("path", f"{base}/out")
    done.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return shown(spark.read.schema(BAR).parquet(f"{base}/out"))


@query
def normalize_columns(spark, d):
    """Columns named in mixed case, as files come."""
    named = src.bars(spark, d).toDF("Ticker", "BAR_TS", "Open", "High", "LOW", "Close", "Volume")
    return shown(ba.normalize_columns(named), "ticker", "bar_ts", "open", "high", "low", "close", "volume")


@query
def row_keys(spark, d):
    """Ledger keys of the bars in one cycle."""
    return shown(src.bars(spark, d).withColumn("cycle_id", F.lit("cycle_1")).select("ticker", "bar_ts", tx.row_key().alias("row_id")))


@query
def rounded_prices(spark, d):
    nudged = F.col("close") + F.lit(1e-9)
    return shown(src.bars(spark, d).select("ticker", "bar_ts", sc.round_n(nudged, 1).alias("tenth"), sc.round_n(nudged, 0).alias("whole")))


@query
def id_numbers(spark, d):
    """The sample index at the end of each cycle id."""
    preds = src.predictions(spark, d)
    return shown(preds.select("row_id", tx.sample_index("cycle_id").alias("sample_idx")))


@query
def indicator_registry(spark, d):
    """Operators looked up by name."""
    bars = src.bars(spark, d)
    long = None
    for name, column in (("vwap", "vwap"), ("rsi", "rsi_14"), ("sma", "sma_50"), ("true_range", "true_range")):
        one = ind.indicator(name)(bars).select("ticker", "bar_ts", F.lit(name).alias("indicator"), F.col(column).alias("value"))
        long = one if long is None else long.unionByName(one)
    return shown(long)


@query
def indicators_with_gaps(spark, d):
    """Bars of which some have a null or NaN close: they have no indicators, and the others skip them."""
    done = ind.compute_indicators(src.gappy_bars(spark, d))
    return shown(done.withColumn("close", F.nanvl("close", F.lit(None))), "ticker", "bar_ts", "close", "rsi_14", "macd", "macd_signal", "bb_upper", "atr_14", "sma_50")


# --- signals and predictions -------------------------------------------------------------------------


@query
def technical_signal(spark, d):
    return shown(sg.technical_signal(src.bars(spark, d)))


@query
def volatility_signal(spark, d):
    return shown(sg.volatility_signal(src.bars(spark, d)))


@query
def volume_signal(spark, d):
    return shown(sg.volume_signal(src.bars(spark, d)))


@query
def ensemble(spark, d):
    done = sg.ensemble(sg.analyse(src.bars(spark, d)))
    return shown(done, "ticker", "bar_ts", "vote", "prediction_direction", "prediction_return_pct", "prediction_confidence")


@query
def backtest_ledger(spark, d):
    rows = le.backtest(src.bars(spark, d), latency=src.latency())
    return shown(rows.drop("resolution_timestamp"))


@query
def baseline_compare(spark, d):
    methods = sg.baseline_predictions(src.predictions(spark, d))
    scored = methods.withColumn("method_hit", sc.hit("method_direction", "actual_direction"))
    return shown(an.compare_methods(scored))


@query
def market_text(spark, d):
    return shown(pr.market_text(src.predictions(spark, d)), "row_id", "market_text")


@query
def agent_prompts(spark, d):
    return shown(pr.agent_prompts(src.predictions(spark, d)))


@query
def gather_agents(spark, d):
    preds = src.predictions(spark, d)
    gathered = pr.gather_agents(preds.select("row_id"), src.agent_answers(preds))
    return shown(gathered)


@query
def synthesis_prompt(spark, d):
    preds = src.predictions(spark, d)
    gathered = pr.gather_agents(preds.select("row_id"), src.agent_answers(preds))
    return shown(pr.synthesis_prompt(gathered), "row_id", "synthesis_prompt")


@query
def normalize_responses(spark, d):
    return shown(rs.normalize_responses(src.responses(src.predictions(spark, d))))


@query
def prediction_latency(spark, d):
    calls = stage(src.agent_answers(src.predictions(spark, d)), "calls")
    live_way = rs.prediction_latency(calls)
    backtest_way = rs.prediction_latency(calls, count_failed=True).withColumnRenamed("inference_latency_ms", "with_failed_ms")
    return shown(live_way.join(backtest_way, "row_id"))


# --- outcomes ----------------------------------------------------------------------------------------


@query
def return_label(spark, d):
    rows = ba.bar_returns(src.bars(spark, d))
    ret = sc.return_pct("prev_close", "close")
    labelled = rows.withColumns({"return_pct": ret, "direction": sc.direction_label(ret)})
    return shown(labelled, "ticker", "bar_ts", "return_pct", "direction")


@query
def resolve_offset(spark, d):
    return shown(le.resolve_by_offset(src.bars(spark, d)), "ticker", "bar_ts", "close", "resolution_price")


def _tick_asof(spark, d, max_gap):
    t = src.ticks(spark, d)
    left = t.select("ticker", "event_id", F.col("ts").alias("timestamp"), F.col("price").alias("close"))
    found = asof_forward(left, t, "ticker", "timestamp", "ts", "price", 300, max_gap)
    return shown(found, "event_id", "matched_ts", "matched_value")


@query
def resolve_forward(spark, d):
    return _tick_asof(spark, d, 3600)


@query
def resolve_forward_unbounded(spark, d):
    return _tick_asof(spark, d, None)


def _outcomes(df: DataFrame) -> DataFrame:
    """Outcome columns, with flags as text because rows still open have none."""
    flags = ("prediction_accuracy", "used_in_training")
    return shown(df.withColumns({c: F.col(c).cast("string") for c in flags}), "row_id", *le.PHASE2_COLUMNS)


@query
def resolve_phase2(spark, d):
    prices = src.ticks(spark, d).select("ticker", "ts", "price")
    done = le.resolve_phase2(src.pending_ledger(spark, d), prices, ASOF)
    return _outcomes(done)


def _last_prices(spark, d):
    """Latest prices, but none for one of the series."""
    prices = src.ticks(spark, d).filter(F.col("ticker") != "error")
    return ba.latest_per_key(prices, ts="ts").select("ticker", "price")


@query
def attach_price(spark, d):
    done = le.attach_current_price(src.predictions(spark, d), _last_prices(spark, d))
    return shown(done, "row_id", "ticker", "close", "current_price")


@query
def resolve_current(spark, d):
    done = le.resolve_at_current(src.pending_ledger(spark, d), _last_prices(spark, d), SWEEP_AT)
    return _outcomes(done)


@query
def sweep_orphans(spark, d):
    return _outcomes(le.sweep_orphans(src.pending_ledger(spark, d), SWEEP_AT))


# --- replay and curation -----------------------------------------------------------------------------


def _two_versions(preds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An earlier replay table, whose rows were trained on, and a later set of completed rows."""
    old = preds.filter(F.col("timestamp") < OLD_TO).withColumn("used_in_training", F.lit(True))
    new = preds.filter(F.col("timestamp") >= OLD_FROM)
    return old, new


@query
def merge_replay(spark, d):
    old, new = _two_versions(src.predictions(spark, d))
    merged = rp.update_replay(old, rp.completed(new), REPLAY_NOW)
    return shown(merged, "row_id", "timestamp", "actual_direction", "used_in_training")


@query
def merge_latest(spark, d):
    old, new = _two_versions(src.predictions(spark, d))
    return shown(rp.merge_latest(old, new, "row_id"), "row_id", "timestamp", "used_in_training")


@query
def mark_trained(spark, d):
    preds = src.predictions(spark, d)
    used = preds.filter(F.col("prediction_direction") == "UP").select("row_id")
    return shown(rp.mark_trained(preds, used), "row_id", "used_in_training")


@query
def mix_replay(spark, d):
    preds = src.predictions(spark, d)
    rolling, static = preds.filter(F.col("timestamp") >= OLD_TO), preds.filter(F.col("timestamp") < OLD_TO)
    return shown(rp.mix_replay(rolling, static), "row_id", "source")


@query
def eligible_pairs(spark, d):
    return shown(cu.training_pairs(cu.eligible(src.predictions(spark, d))))


@query
def class_counts(spark, d):
    return shown(cu.class_counts(src.predictions(spark, d)))


@query
def training_ready(spark, d):
    return shown(cu.training_ready(rp.completed(src.predictions(spark, d))))


@query
def balance_classes(spark, d):
    return shown(cu.balance_classes(src.predictions(spark, d)), "row_id", "actual_direction")


@query
def balance_events(spark, d):
    """The same cut on all events, with their value sorted into three classes."""
    rows = src.table(spark, d, "events").select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("value") > 60, "UP").when(F.col("value") > 20, "DOWN").otherwise("SIDEWAYS").alias("actual_direction"),
    )
    return shown(cu.balance_classes(rows))


@query
def train_split(spark, d):
    rows = src.table(spark, d, "events").select("event_id")
    return shown(cu.split(rows, id_col="event_id"))


@query
def pair_text(spark, d):
    pairs = cu.training_pairs(src.predictions(spark, d))
    return shown(cu.pair_text(pairs, 120), "row_id", "n_chars", "cut_text")


# --- statistics --------------------------------------------------------------------------------------


@query
def overall_accuracy(spark, d):
    return shown(an.overall_accuracy(src.predictions(spark, d)))


@query
def overall_accuracy_expired(spark, d):
    swept = le.sweep_orphans(src.pending_ledger(spark, d), SWEEP_AT)
    return shown(an.overall_accuracy(swept, include_expired=True))


@query
def accuracy_by_confidence(spark, d):
    return shown(an.accuracy_by_confidence(src.predictions(spark, d)))


@query
def calibration(spark, d):
    return shown(an.calibration(src.predictions(spark, d)))


@query
def accuracy_by_ticker(spark, d):
    return shown(an.accuracy_by_ticker(src.predictions(spark, d)))


@query
def direction_distribution(spark, d):
    return shown(an.direction_distribution(src.predictions(spark, d)))


@query
def sign_agreement(spark, d):
    agree = sc.sign_agree("prediction_return_pct", "actual_return_pct")
    return shown(src.predictions(spark, d).select("row_id", agree.alias("agree")))


@query
def return_correlation(spark, d):
    return shown(an.return_correlation(src.predictions(spark, d)))


@query
def latency_median(spark, d):
    return shown(an.latency_median(src.predictions(spark, d)))


@query
def value_median_by_ticker(spark, d):
    return shown(an.quantile(src.ticks(spark, d).select("ticker", "price"), "price", 0.5, ["ticker"]))


@query
def line_price_quartile(spark, d):
    """Lower quartile of the line prices by return flag: ranges are narrowed until they hold 1,000 values."""
    lines = src.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("ticker"), "l_extendedprice")
    return shown(select_quantile(lines, "l_extendedprice", 0.25, ["ticker"], small=1000))


@query
def latency_histogram(spark, d):
    return shown(an.histogram(src.predictions(spark, d), "inference_latency_ms"))


@query
def run_summary(spark, d):
    return shown(an.run_summary(src.predictions(spark, d)))


@query
def cycle_latency(spark, d):
    return shown(an.cycle_latency(src.predictions(spark, d), 5))


@query
def prediction_index(spark, d):
    return shown(an.prediction_index(src.predictions(spark, d)), "row_id", "series_idx", "series_len")


@query
def rolling_accuracy(spark, d):
    rows = an.rolling_accuracy(src.predictions(spark, d))
    return shown(rows, "row_id", "series_idx", "rolling_accuracy_pct")


@query
def rolling_accuracy_by_ticker(spark, d):
    rows = an.rolling_accuracy(src.predictions(spark, d), by="ticker")
    return shown(rows, "row_id", "series_idx", "rolling_accuracy_pct")


@query
def rolling_accuracy_auto(spark, d):
    rows = an.rolling_accuracy(src.predictions(spark, d, step=2), "auto", 5)
    return shown(rows, "row_id", "series_idx", "window_rows", "rolling_accuracy_pct", "random_level_pct")


@query
def cumulative_return(spark, d):
    rows = an.cumulative_return(src.predictions(spark, d))
    return shown(rows, "row_id", "series_idx", "cumulative_return_pct")


@query
def centered_ma(spark, d):
    rolled = an.rolling_accuracy(src.predictions(spark, d))
    smooth5 = an.centered_ma(rolled, "rolling_accuracy_pct", 5).withColumnRenamed("centered_ma", "ma_5")
    return shown(an.centered_ma(smooth5, "rolling_accuracy_pct", 30), "row_id", "ma_5", "centered_ma")


@query
def order_predictions(spark, d):
    return shown(an.order_predictions(src.predictions(spark, d)), "row_id", "timestamp", "ticker")


@query
def scatter_last_100(spark, d):
    """The newest 100 return pairs of hits and of misses."""
    newest = ba.last_n(
        src.predictions(spark, d, step=2), ["prediction_accuracy"], [F.desc("timestamp"), F.desc("row_id")], 100
    )
    return shown(newest, "row_id", "prediction_accuracy", "prediction_return_pct", "actual_return_pct")


# --- rooms, storage, snapshot ------------------------------------------------------------------------


@query
def room_history(spark, d):
    return shown(ro.room_history(src.messages(spark, d)))


@query
def room_transcript(spark, d):
    return shown(ro.room_transcript(src.messages(spark, d)))


@query
def room_transcript_gaps(spark, d):
    """The same rooms with turns that are far apart."""
    return shown(ro.room_transcript(src.messages(spark, d).withColumn("turn", F.col("turn") * 1000)))


@query
def keep_newest_rooms(spark, d):
    return shown(ro.keep_newest_rooms(src.messages(spark, d), 10), "room_id", "turn", "sender")


@query
def drop_orphans(spark, d):
    """Rooms opened by a user are registered, all others are not."""
    m = src.messages(spark, d)
    rooms = m.filter((F.col("turn") == 0) & (F.col("sender") == "user")).select("room_id")
    return shown(ro.drop_orphans(m, rooms), "room_id", "turn", "sender")


@query
def assign_turns(spark, d):
    """Each series as a room, its events as messages in order of time."""
    events = src.ticks(spark, d).select(F.col("ticker").alias("room_id"), "ts", "event_id")
    return shown(ro.assign_turns(events, ["ts", "event_id"]), "room_id", "event_id", "turn")


@query
def contributions(spark, d):
    preds = src.predictions(spark, d)
    ids = preds.filter(F.col("prediction_confidence") != "LOW").select("row_id")
    return shown(ro.contributions_for(preds, ids))


@query
def ledger_roundtrip(spark, d):
    """Rows appended to the store and read back for two tickers."""
    path = staged_folder(spark, "ledger")
    preds = src.predictions(spark, d).drop(*src.ANALYST_COLUMNS)
    store.append_predictions(preds.filter(F.col("timestamp") < OLD_TO), path)
    store.append_predictions(preds.filter(F.col("timestamp") >= OLD_TO), path)
    back = store.read_ledger(spark, path, ["click", "error"])
    return shown(back, "row_id", "ticker", "timestamp", "close", "prediction_direction", "actual_direction")


@query
def ledger_lifecycle(spark, d):
    """Pending predictions stored, resolved twice with the same result, and read back."""
    path = staged_folder(spark, "ledger")
    store.append_predictions(src.pending_ledger(spark, d).drop(*src.ANALYST_COLUMNS), path)
    prices = src.ticks(spark, d).select("ticker", "ts", "price")
    for _ in range(2):
        store.append_outcomes(le.resolve_phase2(store.read_ledger(spark, path), prices, ASOF), path)
    return _outcomes(store.read_ledger(spark, path))


@query
def replay_roundtrip(spark, d):
    """The replay table written, then replaced by a version made from itself."""
    path = staged_folder(spark, "replay")
    old, new = _two_versions(src.predictions(spark, d).drop(*src.ANALYST_COLUMNS))
    store.write_replay(old, path)
    store.write_replay(rp.update_replay(store.read_replay(spark, path), new, REPLAY_NOW), path)
    return shown(store.read_replay(spark, path), "row_id", "timestamp", "used_in_training")


@query
def ledger_two_writers(spark, d):
    """Two writers append in turns, each from the state it saw before the other's commit, while a third compacts."""
    path = staged_folder(spark, "ledger-log")
    preds = stage(src.predictions(spark, d).drop(*src.ANALYST_COLUMNS), "ledger-rows")
    one, two, third = (store.ledger_table(spark, path) for _ in range(3))
    part = F.pmod(F.crc32("row_id"), F.lit(6))
    for k in range(0, 6, 2):
        seen = one.snapshot()
        two.append(preds.filter(part == k))
        one.append(preds.filter(part == k + 1), base=seen)
        third.compact(at_least=4)
    return shown(one.read(), "row_id", "ticker", "timestamp", "close", "prediction_direction", "actual_direction")


@query
def replay_merge_days(spark, d):
    """The replay table with newly completed rows, where only their days are written again."""
    old, new = _two_versions(stage(src.predictions(spark, d).drop(*src.ANALYST_COLUMNS), "replay-rows"))
    table = store.replay_table(spark, staged_folder(spark, "replay-log"))
    table.append(old)
    store.merge_replay_days(table, rp.completed(new), REPLAY_NOW)
    return shown(table.read(), "row_id", "timestamp", "actual_direction", "used_in_training")


@query
def contributions_lookup(spark, d):
    """What the agents said about ten rows, found by their keys in a ledger of several commits."""
    table = store.ledger_table(spark, staged_folder(spark, "ledger-log"))
    preds = stage(src.predictions(spark, d).drop(*src.ANALYST_COLUMNS), "ledger-rows")
    for k in range(4):
        table.append(preds.filter(F.pmod(F.crc32("row_id"), F.lit(4)) == k))
    ids = preds.select("row_id").orderBy("row_id").limit(10)
    return shown(ro.contributions_for(table.lookup([r[0] for r in ids.collect()]), ids))


@query
def resolve_stored_prices(spark, d):
    """The pending rows of a few days, resolved with prices stored by day."""
    path = staged_folder(spark, "prices")
    bar_files.write_prices(src.ticks(spark, d).select("ticker", "ts", "price"), path)
    pending = src.pending_ledger(spark, d).filter((F.col("timestamp") >= OLD_FROM) & (F.col("timestamp") < OLD_FROM + dt.timedelta(days=3)))
    return _outcomes(le.resolve_phase2(stage(pending, "pending"), bar_files.read_prices(spark, path), ASOF))


@query
def snapshot_latest(spark, d):
    bars = src.bars(spark, d)
    preds = le.backtest(bars, latency=src.latency())
    active = bars.select("ticker").distinct()
    rounded = bars.withColumns({c: F.round(c, 2) for c in ("open", "high", "low", "close")})
    preds = preds.withColumn("prediction_return_pct", F.round("prediction_return_pct", 2))
    return dashboard_snapshot(rounded, preds, active, {"mode": "INFERENCE_ONLY", "data_source": "events"})


@query
def snapshot_activity(spark, d):
    preds = src.predictions(spark, d)
    return activity_snapshot(preds, preds.select("ticker").distinct())


# --- streaming ---------------------------------------------------------------------------------------


def _append_parts(df: DataFrame, path: str, parts: list[Column]) -> None:
    for keep in parts:
        df.filter(keep).write.mode("append").parquet(path)


class _Feed:
    """A table as a stream that arrives in three parts, by time."""

    def __init__(self, df: DataFrame, ts: str, label: str):
        self.rows, self.path = stage(df, label), staged_folder(df.sparkSession, f"{label}-feed")
        at = F.col(ts)
        self.parts = [at < OLD_FROM, (at >= OLD_FROM) & (at < OLD_TO), at >= OLD_TO]
        self.rows.limit(0).write.parquet(self.path)
        self.stream = df.sparkSession.readStream.schema(self.rows.schema).parquet(self.path)

    def send(self, part: int) -> None:
        self.rows.filter(self.parts[part]).write.mode("append").parquet(self.path)


def _drain(stream: DataFrame, label: str, *feeds: _Feed) -> DataFrame:
    """Send the parts one by one, run the stream over what has come after each, and read its output."""
    spark = stream.sparkSession
    base = staged_folder(spark, label)
    for part in range(3):
        for feed in feeds:
            feed.send(part)
        (
            stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/state")
            .option("path", f"{base}/out").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _heartbeat(df: DataFrame, ts: str, key: str = "ticker", days: int = 3) -> DataFrame:
    """One more row far ahead in time, which moves the watermark past all others."""
    last = df.agg(F.max(ts).alias(ts)).withColumn(ts, F.col(ts) + F.make_dt_interval(days=F.lit(days)))
    marker = last.withColumn(key, F.lit("~end"))
    return df.unionByName(marker, allowMissingColumns=True).select(*df.columns)


@query
def stream_bars(spark, d):
    ticks = _heartbeat(src.ticks(spark, d), "ts").fillna({"price": 0.0})
    feed = _Feed(ticks, "ts", "ticks")
    bars = _drain(live.stream_build_bars(feed.stream, "1 hour"), "stream-bars", feed)
    return shown(bars.filter(F.col("ticker") != "~end"))


@query
def stream_resolve(spark, d):
    bars = src.bars(spark, d, "5 minutes")
    preds = src.pending_ledger(spark, d).select("row_id", "timestamp", "ticker", "close", "prediction_direction")
    prices = bars.select("ticker", F.col("bar_ts").alias("ts"), F.col("close").alias("price"))
    both_end = _heartbeat(preds, "timestamp").fillna({"row_id": "~end"})
    asked, priced = _Feed(both_end, "timestamp", "preds"), _Feed(_heartbeat(prices, "ts"), "ts", "prices")
    done = _drain(live.stream_resolve(asked.stream, priced.stream), "stream-resolve", asked, priced).filter(F.col("ticker") != "~end")
    return _outcomes(done)


@query
def stream_resolve_ticks(spark, d):
    """Predictions 97 seconds after their bar against the single trades, not on the grid of the price slots."""
    preds = src.pending_ledger(spark, d).select("row_id", "timestamp", "ticker", "close", "prediction_direction")
    preds = preds.withColumn("timestamp", F.col("timestamp") + F.make_dt_interval(secs=F.lit(97)))
    both_end = _heartbeat(preds, "timestamp").fillna({"row_id": "~end"})
    prices = _heartbeat(src.ticks(spark, d).select("ticker", "ts", "price"), "ts").fillna({"price": 0.0})
    asked, priced = _Feed(both_end, "timestamp", "preds"), _Feed(prices, "ts", "ticks")
    done = _drain(live.stream_resolve(asked.stream, priced.stream), "stream-resolve", asked, priced).filter(F.col("ticker") != "~end")
    return _outcomes(done)


@query
def stream_dedupe(spark, d):
    """Every ledger row delivered twice, kept once."""
    preds = src.predictions(spark, d).select("row_id", "timestamp", "ticker", "close")
    feed = _Feed(preds.unionByName(preds), "timestamp", "twice")
    return shown(_drain(live.stream_dedupe(feed.stream, ["row_id"], "timestamp"), "stream-dedupe", feed))


@query
def stream_upsert(spark, d):
    ticks = _heartbeat(src.ticks(spark, d), "ts")
    feed = _Feed(ticks, "ts", "upserts")
    rows = _drain(live.stream_upsert(feed.stream, ["ticker"], "ts", "event_id"), "stream-upsert", feed)
    return shown(rows.filter(F.col("ticker") != "~end"))


@query
def stream_latest(spark, d):
    """Bars fed in three parts; each part's changed tickers are written under its batch."""
    base = staged_folder(spark, "latest")
    day = F.dayofmonth("bar_ts")
    _append_parts(src.bars(spark, d), f"{base}/in", [day > 20, (day > 10) & (day <= 20), day <= 10])
    feed = spark.readStream.schema(BAR).option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    live.write_latest(live.stream_latest(feed), f"{base}/out", f"{base}/state").awaitTermination()
    return shown(live.read_latest(spark, f"{base}/out"))


@query
def stream_indicators(spark, d):
    """Bars fed in three parts by day; the parts must give what one table gives."""
    bars = src.bars(spark, d)
    base = staged_folder(spark, "feed")
    day = F.dayofmonth("bar_ts")
    for part, keep in enumerate([day <= 10, (day > 10) & (day <= 20), day > 20]):
        bars.filter(keep).write.mode("append").parquet(f"{base}/in")
        feed = spark.readStream.schema(BAR).parquet(f"{base}/in")
        live.stream_indicators(feed, f"{base}/out", f"{base}/state", f"{base}/progress").awaitTermination()
    rows = spark.read.parquet(f"{base}/out").drop("batch", "series_len")
    return shown(rows)


@query
def stream_indicators_late(spark, d):
    """Five-minute bars in three parts; one in 13 comes a part or two late, one in 11 wrong at first and revised later."""
    bars = src.bars(spark, d, "5 minutes")
    base, day = staged_folder(spark, "late-feed"), F.dayofmonth("bar_ts")
    pick = F.crc32(F.concat_ws("|", "ticker", F.unix_seconds("bar_ts").cast("string")))
    due = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    arrives = F.least(due + F.when(pick % 13 == 0, 1 + pick % 2).otherwise(0), F.lit(2))
    rows = stage(bars.withColumns({"_arrives": arrives, "_wrong": (pick % 11 == 0) & (due < 2)}), "late-bars")
    for part in range(3):
        right = rows.filter((F.col("_arrives") == part) & ~F.col("_wrong") | F.col("_wrong") & (F.col("_arrives") < 2) & (F.col("_arrives") + 1 == part))
        right = right.unionByName(rows.filter(F.col("_wrong") & (F.col("_arrives") == 2) & F.lit(part == 2)))
        early = rows.filter(F.col("_wrong") & (F.col("_arrives") < 2) & (F.col("_arrives") == part))
        early = early.withColumns({"close": F.col("close") * 1.02, "high": F.col("high") * 1.02, "volume": F.col("volume") + 5})
        right.unionByName(early).select(*BAR.names).write.mode("append").parquet(f"{base}/in")
        feed = spark.readStream.schema(BAR).parquet(f"{base}/in")
        restate.stream_restated(feed, f"{base}/out", f"{base}/state", f"{base}/progress", buckets=16).awaitTermination()
    return shown(restate.read_restated(spark, f"{base}/out").drop("batch", "correction"))


def _fed_states(rows: DataFrame, ts: str, label: str, states: list) -> None:
    """The rows in three parts, the newest first, each merged into ``states`` by a run of the stream."""
    base = staged_folder(rows.sparkSession, label)
    rows, at = stage(rows, f"{label}-rows"), F.col(ts)
    for part in (at >= OLD_TO, at < OLD_FROM, (at >= OLD_FROM) & (at < OLD_TO)):
        rows.filter(part).write.mode("append").parquet(f"{base}/in")
        feed = rows.sparkSession.readStream.schema(rows.schema).parquet(f"{base}/in")
        newest.stream_newest(feed, f"{base}/progress", *states).awaitTermination()


@query
def stream_snapshot(spark, d):
    """The latest state from states merged batch by batch."""
    base = staged_folder(spark, "newest")
    bars = src.bars(spark, d)
    preds = le.backtest(bars, latency=src.latency())
    kept_bars, kept = newest.newest_bars(spark, base, bars.schema), newest.newest_predictions(spark, base, preds.schema)
    _fed_states(bars, "bar_ts", "newest-bars", [kept_bars])
    _fed_states(preds, "timestamp", "newest-preds", [kept])
    last = kept_bars.read()
    rounded = last.withColumns({c: F.round(c, 2) for c in ("open", "high", "low", "close")})
    said = kept.read().withColumn("prediction_return_pct", F.round("prediction_return_pct", 2))
    return dashboard_snapshot(rounded, said, last.select("ticker"), {"mode": "INFERENCE_ONLY", "data_source": "events"})


@query
def stream_activity(spark, d):
    """What the agents said last and the latency of the newest cycle, from states merged batch by batch."""
    base = staged_folder(spark, "activity")
    preds = src.predictions(spark, d)
    kept, cycles = newest.newest_predictions(spark, base, preds.schema), newest.CycleLatency(spark, f"{base}/cycles")
    _fed_states(preds, "timestamp", "activity-preds", [kept, cycles])
    last = kept.read()
    return activity_snapshot(last, last.select("ticker"), cycles.newest())


@query
def stream_rolling_accuracy(spark, d):
    """Outcomes fed in two parts; positions and windows continue over the cut."""
    preds = src.predictions(spark, d).select("row_id", "timestamp", "prediction_accuracy")
    base = staged_folder(spark, "roll")
    for keep in (F.col("timestamp") < OLD_FROM, F.col("timestamp") >= OLD_FROM):
        preds.filter(keep).write.mode("append").parquet(f"{base}/in")
        feed = spark.readStream.schema(preds.schema).parquet(f"{base}/in")
        feed.writeStream.foreachBatch(live.rolling_sink(f"{base}/out", f"{base}/state")).option(
            "checkpointLocation", f"{base}/progress"
        ).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{base}/out")
    return shown(rows, "row_id", "series_idx", "rolling_accuracy_pct")


@query
def post_market(spark, d):
    """The end-of-day job; result is the replay table after it."""
    out = staged_folder(spark, "post")
    old, new = _two_versions(src.predictions(spark, d).drop(*src.ANALYST_COLUMNS))
    old = old.withColumn("used_in_training", F.lit(False))
    after = live.run_post_market(new, old, out, dt.date(2024, 1, 30), REPLAY_NOW, min_rows=1)
    return shown(after, "row_id", "timestamp", "prediction_accuracy", "used_in_training")
