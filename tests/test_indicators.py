import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind, signals as sg
from tickloom.plans.blocks import SeriesBlocks, index_series
from tickloom.schema import INDICATOR_COLUMNS


def ema(v, n, first=0):
    out = np.full(len(v), np.nan)
    if len(v) >= first + n:
        y = out[first + n - 1] = v[first:first + n].mean()
        for i in range(first + n, len(v)):
            y = out[i] = y + 2 / (n + 1) * (v[i] - y)
    return out


def rma(v, n, first):
    out = np.full(len(v), np.nan)
    y = None
    for i in range(first, len(v)):
        y = v[i] if y is None else y + (v[i] - y) / n
        if i >= first + n - 1:
            out[i] = y
    return out


def expected(g):
    c, h, l = g.close.to_numpy(), g.high.to_numpy(), g.low.to_numpy()
    d = np.diff(c, prepend=np.nan)
    gain, loss = rma(np.maximum(d, 0), 14, 1), rma(np.maximum(-d, 0), 14, 1)
    pc = np.concatenate([[np.nan], c[:-1]])
    tr = np.maximum(h - l, np.maximum(abs(h - pc), abs(l - pc)))
    macd = ema(c, 12) - ema(c, 26)
    s = pd.Series(c)
    mid, dev = s.rolling(20).mean(), s.rolling(20).std()
    tp, vol = ((g.high + g.low + g.close) / 3 * g.volume), g.volume
    day = g.bar_ts.dt.date
    return {
        "rsi_14": 100 * gain / (gain + loss), "macd": macd, "macd_signal": ema(macd, 9, 25),
        "atr_14": rma(tr, 14, 1), "bb_upper": (mid + 2 * dev).to_numpy(), "bb_lower": (mid - 2 * dev).to_numpy(),
        "bb_middle": mid.to_numpy(), "sma_50": s.rolling(50).mean().to_numpy(), "sma_200": s.rolling(200).mean().to_numpy(),
        "vwap": (tp.groupby(day).cumsum() / vol.groupby(day).cumsum()).to_numpy(),
    }


@pytest.mark.parametrize("size", [None, 1100])
def test_indicators_match_sequential_loop(bars, size):
    """Whole series in one slice, and the long series cut into slices."""
    got = ind.compute_indicators(bars, size=size).toPandas()
    assert len(got) == 1500 + 260 + 45 + 10
    for ticker, g in got.groupby("ticker"):
        g = g.sort_values("series_idx")
        assert (g.series_idx.to_numpy() == np.arange(len(g))).all()
        if len(g) < 30:
            assert g[list(INDICATOR_COLUMNS)].isna().all().all()
            continue
        for name, want in expected(g).items():
            have = g[name].astype(float).to_numpy()
            np.testing.assert_allclose(have, want, rtol=1e-10, atol=1e-10, err_msg=f"{ticker} {name}")


def test_bounds_and_orders(bars):
    got = ind.compute_indicators(bars).toPandas().dropna(subset=["rsi_14", "bb_upper"])
    assert got.rsi_14.between(0, 100).all() and (got.atr_14 >= 0).all()
    assert ((got.bb_lower <= got.bb_middle) & (got.bb_middle <= got.bb_upper)).all()
    wide = got.groupby("ticker").agg(lo=("low", "min"), hi=("high", "max"))
    v = got.dropna(subset=["vwap"]).join(wide, on="ticker")
    assert ((v.vwap >= v.lo * 0.95) & (v.vwap <= v.hi * 1.05)).all()


@pytest.mark.parametrize("n", [1, 2, 5, 20])
def test_generic_averages_in_short_slices(bars, n):
    one = ind.ema(bars, "close", n).select("ticker", "series_idx", f"ema_{n}")
    alpha = ind.ema_alpha(n)
    from tickloom.plans.blocks import forget_rows
    size = forget_rows(alpha) + n + 3
    many = ind.ema(bars, "close", n, size=size).select("ticker", "series_idx", F.col(f"ema_{n}").alias("y"))
    both = one.join(many, ["ticker", "series_idx"]).toPandas()
    assert len(both) == 1815
    np.testing.assert_allclose(both[f"ema_{n}"].astype(float), both.y.astype(float), rtol=1e-12)


def test_slices_that_are_too_short_are_refused(bars):
    with pytest.raises(ValueError):
        ind.rsi(bars, size=100)


def test_display_rounds_to_two_places(bars):
    got = ind.compute_indicators(bars, display=True).where("rsi_14 IS NOT NULL").toPandas()
    assert (got.rsi_14.round(2) == got.rsi_14).all()


def test_zero_volume_session_has_no_vwap(spark):
    import datetime as dt

    from tickloom.schema import BAR
    rows = [("A", dt.datetime(2024, 1, 2, 10 + i), 1.0, 1.0, 1.0, 1.0, v) for i, v in enumerate([0, 0, 5])]
    got = [r.vwap for r in ind.vwap(spark.createDataFrame(rows, BAR)).orderBy("bar_ts").collect()]
    assert got == [None, None, 1.0]


@pytest.mark.parametrize("partitions", ["1", "200"])
def test_partition_count_does_not_change_results(spark, bars, partitions):
    def run():
        done = sg.ensemble(sg.analyse(bars)).select("ticker", "series_idx", "prediction_direction", "regime", "squeeze", "conviction")
        return sorted(tuple(r) for r in done.collect())

    want = run()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_no_slice_holds_a_whole_long_series(bars):
    b = SeriesBlocks(bars, back=30, ahead=5, size=100)
    sizes = [r["count"] for r in b.df.groupBy("ticker", "_blk").count().collect()]
    assert max(sizes) <= 135
    assert b.own().count() == 1815


def test_index_is_dense(bars):
    got = index_series(bars).groupBy("ticker", "series_len").agg(
        F.min("series_idx").alias("a"), F.max("series_idx").alias("b"), F.countDistinct("series_idx").alias("n")
    ).collect()
    assert all(r.a == 0 and r.b == r.n - 1 == r.series_len - 1 for r in got)


def test_plan_shuffles_by_day_and_slice_only(spark, bars):
    """No exchange is keyed on the ticker alone, but for the per-day counts."""
    from tickloom.session import stage
    plan = ind.compute_indicators(stage(bars, "plan"))._jdf.queryExecution().executedPlan().toString()
    alone = [line for line in plan.splitlines() if "Exchange hashpartitioning(ticker" in line and "_blk" not in line and "_day" not in line]
    assert len(alone) == 1


def test_short_series_take_one_shuffle(spark, bars):
    """Series that fit in a slice: one exchange of the rows, and the columns that slices give."""
    from tickloom.session import stage

    rows = stage(bars, "short-series")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    short, long = ind.compute_indicators(rows), ind.compute_indicators(rows, size=1000)
    assert exchanges(short) == 1 and exchanges(long) > 1
    assert exchanges(ind.rsi(rows)) == 1
    got, want = (df.orderBy("ticker", "bar_ts").toPandas() for df in (short, long))
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(got[list(want.columns)], want, rtol=1e-9, atol=1e-9)
    broken = rows.withColumn("close", F.when(F.minute("bar_ts") != 30, F.col("close"))).withColumn("ticker", F.when(F.col("ticker") != "NSE:B", F.col("ticker")))
    got, want = (df.select(*short.columns).orderBy(*bars.columns).toPandas() for df in (ind.compute_indicators(broken), ind.compute_indicators(broken, size=1000)))
    pd.testing.assert_frame_equal(got, want, rtol=1e-9, atol=1e-9)
