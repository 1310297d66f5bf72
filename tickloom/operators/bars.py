"""Bars: roll-up from ticks, selections, checks and positional operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.market_time import SESSION_FROM
from tickloom.functions.scoring import bar_change_columns, bar_side as side_expr
from tickloom.plans.blocks import SeriesBlocks, index_series, usable
from tickloom.session import stage
from tickloom.schema import SAMPLE_START, SAMPLE_STEP, UNIVERSE


def build_bars(ticks: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Ticks (ticker, ts, price, volume) to one OHLCV bar per ticker and interval.

    One hash aggregation, combined on the map side, keyed on (ticker, interval): a busy ticker
    spreads over its intervals. Times of one ticker should be distinct, else the open or close of
    the shared instant is any of its prices. Ticks without ticker, time or price (null or NaN) make
    no bar; :func:`unusable_ticks` lists them.
    """
    per = F.window("ts", width)
    return (
        ticks.filter(usable(ticks, "ticker", "ts", "price"))
        .groupBy("ticker", per.alias("_w"))
        .agg(
            F.min_by("price", "ts").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "ts").alias("close"),
            F.sum("volume").cast("long").alias("volume"),
        )
        .select("ticker", F.col("_w.start").alias("bar_ts"), "open", "high", "low", "close", "volume")
    )


def unusable_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks that :func:`build_bars` leaves out, for a quarantine."""
    return ticks.filter(~usable(ticks, "ticker", "ts", "price"))


def validate_bars(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bars fit for indicators, and those set aside with a ``problem``.

    Set aside are bars without key or time, with a null or NaN price, and all but one of the bars of
    one ticker and time.
    """
    problem = F.when(~usable(bars, "ticker", "bar_ts"), "key").when(~usable(bars, "open", "high", "low", "close"), "price")
    marked = bars.withColumn("problem", problem)
    fine = marked.filter("problem IS NULL")
    nth = F.row_number().over(W.partitionBy("ticker", "bar_ts").orderBy("close", "volume"))
    fine = fine.withColumn("problem", F.when(nth > 1, "duplicate"))
    return fine.filter("problem IS NULL").drop("problem"), marked.filter("problem IS NOT NULL").unionByName(fine.filter("problem IS NOT NULL"))


def universe_table(spark, universe: Sequence[tuple[str, str]] = UNIVERSE) -> DataFrame:
    rows = [(i, t, s) for i, (t, s) in enumerate(universe)]
    return spark.createDataFrame(rows, "ord long, ticker string, sector string")


def active_universe(universe: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tickers of the configured order."""
    return universe.orderBy("ord", "ticker").limit(n)


def restrict_to(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("ticker"), "ticker", "left_semi")


def missing_sources(universe: DataFrame, bars: DataFrame) -> DataFrame:
    """Configured tickers without a single bar."""
    return universe.join(bars.select("ticker").distinct(), "ticker", "left_anti")


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def require_not_null(df: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all required values, and the rows to set aside."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return df.filter(~bad), df.filter(bad)


def bar_change(bars: DataFrame) -> DataFrame:
    return bars.withColumns(bar_change_columns())


def bar_side(bars: DataFrame) -> DataFrame:
    return bars.withColumn("side", side_expr())


def ohlc_violations(bars: DataFrame) -> DataFrame:
    body_high, body_low = F.greatest("open", "close"), F.least("open", "close")
    return bars.filter((F.col("high") < body_high) | (F.col("low") > body_low))


def series_index(bars: DataFrame) -> DataFrame:
    return index_series(bars)


def systematic_sample(bars: DataFrame, start: int = SAMPLE_START, step: int = SAMPLE_STEP) -> DataFrame:
    """Every ``step``-th row of each series from row ``start`` on."""
    idx = F.col("series_idx")
    return index_series(bars).filter((idx >= start) & (F.pmod(idx - start, F.lit(step)) == 0))


def bar_returns(bars: DataFrame) -> DataFrame:
    """Previous close and simple return of each bar."""
    b = SeriesBlocks(bars, back=1, needs=("close",))
    b.add(prev_close=b.over("lag(close)"))
    return b.add(simple_return="try_divide(close - prev_close, prev_close)").own()


def latest_per_key(df: DataFrame, key: str = "ticker", ts: str = "bar_ts") -> DataFrame:
    """The newest row of each key; only candidates leave each map task."""
    return last_n(df, [key], F.desc(ts), 1)


def last_n(df: DataFrame, keys: Sequence[str], order, n: int) -> DataFrame:
    """The first ``n`` rows per key by ``order``.

    Spark limits each group to ``n`` rows before the shuffle, so a large key costs no more than
    ``n`` rows per map task.
    """
    order = order if isinstance(order, (list, tuple)) else [order]
    ranked = df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_r") <= n).drop("_r")


def dedupe_last(df: DataFrame, keys: Sequence[str], ts: str, arrival: str) -> DataFrame:
    """One row per key and second: the one that arrived last."""
    second = df.withColumn("_sec", F.date_trunc("second", F.col(ts)))
    return last_n(second, [*keys, "_sec"], F.desc(arrival), 1).drop("_sec")


def assign_cycles(bars: DataFrame, step: int = 1, n_cycles: int = 1, loop: bool = True) -> DataFrame:
    """The rows a feed serves per ticker in cycles 0 .. n_cycles-1, ``step`` rows at a time.

    After the last (perhaps short) portion the feed starts over, or, without ``loop``, ends.
    """
    rows = index_series(bars)
    portion = F.floor(F.col("series_idx") / step)
    portions = F.ceil(F.col("series_len") / step)
    served = rows.withColumns({"_portion": portion, "_portions": portions}).filter(
        F.col("_portion") < n_cycles
    )
    if not loop:
        return served.withColumn("cycle", F.col("_portion")).drop("_portion", "_portions")
    cycles = F.sequence(F.col("_portion"), F.lit(n_cycles - 1).cast("bigint"), F.col("_portions"))
    return served.withColumn("cycle", F.explode(cycles)).drop("_portion", "_portions")


def session_grid(days: DataFrame, bars_per_day: int = 71, minutes: int = 5) -> DataFrame:
    """Expected bar times of each weekday in ``days`` (column ``date``, others are kept)."""
    opens = F.to_timestamp(
        F.concat_ws(" ", F.date_format("date", "yyyy-MM-dd"), F.lit(f"{SESSION_FROM}:00"))
    )
    last = opens + F.make_dt_interval(mins=F.lit((bars_per_day - 1) * minutes))
    times = F.sequence(opens, last, F.make_dt_interval(mins=F.lit(minutes)))
    return days.filter(F.weekday("date") < 5).withColumn("bar_ts", F.explode(times))


def missing_bars(bars: DataFrame, bars_per_day: int = 71, minutes: int = 5) -> DataFrame:
    """Session bars absent from each ticker, over the weekdays on which it has any bar."""
    bars = stage(bars.select("ticker", "bar_ts"), "bar-times")  # read twice
    days = bars.select("ticker", F.to_date("bar_ts").alias("date")).distinct()
    expected = session_grid(days, bars_per_day, minutes)
    return expected.join(bars.select("ticker", "bar_ts"), ["ticker", "bar_ts"], "left_anti")
