"""Technical indicators over many series at once.

Every function takes bars (ticker, bar_ts, open, high, low, close, volume) and returns them with
``series_idx``, ``series_len`` and the indicator columns. All windows of one call run on the same
slices (see ``plans.blocks``): one shuffle by day for the positions and the session VWAP, one by
slice for everything else, for any number of indicators. Where every series fits in one slice, one shuffle
by series does for all; the rows are counted first, so bars that are expensive to compute should be staged.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.plans.blocks import (
    BLOCK_ROWS, SeriesBlocks, block_size, fits_slice, forget_rows, index_series, index_whole, positioned, real, replace_columns,
    trailing, usable, with_day,
)
from tickloom.plans.recurrence import long_average
from tickloom.schema import INDICATOR_COLUMNS, MIN_HISTORY_ROWS

RSI_N = ATR_N = 14
MACD_FAST, MACD_SLOW, MACD_SIGNAL = 12, 26, 9
BB_N, BB_K = 20, 2.0
SMA_LENGTHS = (50, 200)


def ema_alpha(n: int) -> float:
    return 2.0 / (n + 1)


def rma_alpha(n: int) -> float:
    return 1.0 / n


def add_vwap(bars: DataFrame) -> DataFrame:
    """Session VWAP with a daily reset; null while no volume was traded. Keeps ``_day``."""
    bars = with_day(bars)
    session = W.partitionBy("ticker", "_day").orderBy("bar_ts").rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    traded = F.sum(typical * F.col("volume")).over(session)
    return bars.withColumn("vwap", F.try_divide(traded, F.sum("volume").over(session)))


def vwap(bars: DataFrame) -> DataFrame:
    return add_vwap(bars).drop("_day")


# Columns without which a bar takes no part; its indicators are null and the others skip it.
PRICES = ("close", "high", "low")


def _slices(bars: DataFrame, alphas: Sequence[float], rows: int, lead_in: int, size: int | None,
            needs: Sequence[str] = PRICES) -> SeriesBlocks:
    """Slices with enough earlier rows for the given smoothing factors on top of ``rows``."""
    back = rows + max([0, *[forget_rows(a) for a in alphas]])
    return SeriesBlocks(bars, back=back, size=size or block_size(list(alphas), back, lead_in), needs=needs)


_PREV = "lag(close)"
_TRUE_RANGE = (
    "CASE WHEN _pc IS NOT NULL THEN greatest(high - low, abs(high - _pc), abs(low - _pc)) END"
)
_RSI = "try_divide(_gain, _gain + _loss) * 100"


def _rsi_pair(b: SeriesBlocks, n: int) -> dict[str, str]:
    up, down = "greatest(close - _pc, 0)", "greatest(_pc - close, 0)"
    return {
        "_gain": b.smooth(up, rma_alpha(n), n, first=1, seed="first"),
        "_loss": b.smooth(down, rma_alpha(n), n, first=1, seed="first"),
    }


def _atr(b: SeriesBlocks, n: int) -> str:
    return b.smooth("true_range", rma_alpha(n), n, first=1, seed="first")


def _bollinger_pair(b: SeriesBlocks, n: int, ddof: int) -> dict[str, str]:
    std = "stddev_samp(close)" if ddof else "stddev_pop(close)"
    return {"_mid": b.over("avg(close)", trailing(n)), "_dev": b.over(std, trailing(n))}


def _bollinger_bands(n: int, k: float) -> dict[str, str]:
    full = f"CASE WHEN series_idx >= {n - 1} THEN"
    return {
        "bb_lower": f"{full} _mid - _dev * {real(k)} END",
        "bb_middle": f"{full} _mid END",
        "bb_upper": f"{full} _mid + _dev * {real(k)} END",
    }


def _sma(b: SeriesBlocks, n: int) -> str:
    return f"CASE WHEN series_idx >= {n - 1} THEN {b.mean_from_pair('close', n)} END"


def true_range(bars: DataFrame) -> DataFrame:
    b = SeriesBlocks(bars, back=1, needs=PRICES)
    return b.add(_pc=b.over(_PREV)).add(true_range=_TRUE_RANGE).own("_pc")


def rsi(bars: DataFrame, n: int = RSI_N, size: int | None = None) -> DataFrame:
    b = _slices(bars, [rma_alpha(n)], 1, n, size, ("close",))
    b.add(_pc=b.over(_PREV)).add(**_rsi_pair(b, n)).add(**{f"rsi_{n}": _RSI})
    return b.own("_pc", "_gain", "_loss")


def atr(bars: DataFrame, n: int = ATR_N, size: int | None = None) -> DataFrame:
    b = _slices(bars, [rma_alpha(n)], 1, n, size)
    b.add(_pc=b.over(_PREV)).add(true_range=_TRUE_RANGE).add(**{f"atr_{n}": _atr(b, n)})
    return b.own("_pc", "true_range")


def _macd_back(fast: int, slow: int, signal: int) -> int:
    """Rows for the slower average to settle, then for the signal line on top of it."""
    return max(forget_rows(ema_alpha(fast)), forget_rows(ema_alpha(slow))) + forget_rows(ema_alpha(signal))


def macd(bars: DataFrame, fast: int = MACD_FAST, slow: int = MACD_SLOW, signal: int = MACD_SIGNAL,
         size: int | None = None) -> DataFrame:
    alphas = [ema_alpha(n) for n in (fast, slow, signal)]
    back = _macd_back(fast, slow, signal)
    b = SeriesBlocks(bars, back=back, size=size or block_size(alphas, back, slow + signal), needs=("close",))
    b.add(_fast=b.smooth("close", alphas[0], fast), _slow=b.smooth("close", alphas[1], slow))
    b.add(macd="_fast - _slow")
    b.add(macd_signal=b.smooth("macd", alphas[2], signal, first=max(fast, slow) - 1))
    return b.add(macd_hist="macd - macd_signal").own("_fast", "_slow")


def bollinger(bars: DataFrame, n: int = BB_N, k: float = BB_K, ddof: int = 1) -> DataFrame:
    b = SeriesBlocks(bars, back=n - 1, needs=("close",))
    return b.add(**_bollinger_pair(b, n, ddof)).add(**_bollinger_bands(n, k)).own("_mid", "_dev")


def sma(bars: DataFrame, *lengths: int) -> DataFrame:
    lengths = lengths or SMA_LENGTHS
    back = max(lengths)
    b = SeriesBlocks(bars, back=back, size=block_size([], back), needs=("close",))
    b.add(**b.running_pair("close", "close")).add(**{f"sma_{n}": _sma(b, n) for n in lengths})
    return b.own("_close_s", "_close_c")


def ema(bars: DataFrame, col: str, n: int, size: int | None = None) -> DataFrame:
    """Exponential average of a column, started with the mean of the first n values; skips nulls."""
    if forget_rows(ema_alpha(n)) > BLOCK_ROWS:
        return long_average(bars.drop("series_idx", "series_len"), col, ema_alpha(n), n, f"ema_{n}", size=size or BLOCK_ROWS)
    b = _slices(bars.drop("series_idx", "series_len"), [ema_alpha(n)], 0, n, size, (col,))
    return b.add(**{f"ema_{n}": b.smooth(f"double(`{col}`)", ema_alpha(n), n)}).own()


def rma(bars: DataFrame, col: str, n: int, size: int | None = None) -> DataFrame:
    """Wilder average of a column, started with the first value; skips nulls."""
    if forget_rows(rma_alpha(n)) > BLOCK_ROWS:
        return long_average(bars.drop("series_idx", "series_len"), col, rma_alpha(n), n, f"rma_{n}", "first", size=size or BLOCK_ROWS)
    b = _slices(bars.drop("series_idx", "series_len"), [rma_alpha(n)], 0, n, size, (col,))
    return b.add(**{f"rma_{n}": b.smooth(f"double(`{col}`)", rma_alpha(n), n, seed="first")}).own()


def min_history_gate(df: DataFrame, rows: int = MIN_HISTORY_ROWS,
                     columns: Sequence[str] = INDICATOR_COLUMNS) -> DataFrame:
    """Nulls in all indicator columns of series shorter than ``rows``."""
    df = index_series(df)
    have = df.columns
    return replace_columns(
        df, {c: f"CASE WHEN series_len >= {rows} THEN `{c}` END" for c in columns if c in have}
    )


# Rows the indicator columns look back, in total.
INDICATOR_BACK = max(
    _macd_back(MACD_FAST, MACD_SLOW, MACD_SIGNAL), forget_rows(rma_alpha(RSI_N)) + 1, max(SMA_LENGTHS)
)
_ALPHAS = [rma_alpha(RSI_N), ema_alpha(MACD_FAST), ema_alpha(MACD_SLOW), ema_alpha(MACD_SIGNAL)]
HELPERS = (
    "_pc", "true_range", "_gain", "_loss", "_fast", "_slow", "_mid", "_dev", "_close_s", "_close_c"
)


def indicator_blocks(bars: DataFrame, extra_back: int = 0, ahead: int = 0,
                     size: int | None = None) -> SeriesBlocks:
    """Slices with every indicator column, before gating; copied rows still included.

    Bars without key, time or prices (null or NaN) are set aside and come back with null indicators.
    """
    back = INDICATOR_BACK + extra_back
    size = size or block_size(_ALPHAS, back, max(SMA_LENGTHS))
    good = usable(bars, "ticker", "bar_ts", *PRICES)
    rows = bars.filter(good)
    whole = not positioned(bars) and fits_slice(rows, size)
    rows = add_vwap(index_whole(rows)) if whole else index_series(add_vwap(rows))
    b = SeriesBlocks(rows, back=back, ahead=ahead, size=size, whole=whole)
    b.rest = bars.filter(~good)
    b.add(_pc=b.over(_PREV)).add(true_range=_TRUE_RANGE)
    b.add(
        **_rsi_pair(b, RSI_N),
        _fast=b.smooth("close", ema_alpha(MACD_FAST), MACD_FAST),
        _slow=b.smooth("close", ema_alpha(MACD_SLOW), MACD_SLOW),
        atr_14=_atr(b, ATR_N),
        **_bollinger_pair(b, BB_N, 1),
        **b.running_pair("close", "close"),
    )
    b.add(rsi_14=_RSI, macd="_fast - _slow", **_bollinger_bands(BB_N, BB_K))
    b.add(
        macd_signal=b.smooth("macd", ema_alpha(MACD_SIGNAL), MACD_SIGNAL, first=MACD_SLOW - 1),
        **{f"sma_{n}": _sma(b, n) for n in SMA_LENGTHS},
    )
    return b.add(macd_hist="macd - macd_signal")


def compute_indicators(bars: DataFrame, display: bool = False, min_rows: int = MIN_HISTORY_ROWS,
                       size: int | None = None) -> DataFrame:
    """All indicators; null for series shorter than ``min_rows``. ``display`` rounds to 2 places."""
    done = min_history_gate(indicator_blocks(bars, size=size).own(*HELPERS), min_rows)
    return replace_columns(done, {c: f"round({c}, 2)" for c in INDICATOR_COLUMNS}) if display else done


def drop_warmup(df: DataFrame) -> DataFrame:
    return df.where("rsi_14 IS NOT NULL")


def indicator(name: str) -> Callable[[DataFrame], DataFrame]:
    """The operator registered under ``name``."""
    try:
        return INDICATORS[name]
    except KeyError:
        raise ValueError(f"unknown indicator {name!r}; there are {', '.join(sorted(INDICATORS))}") from None


# Indicator registry: name to operator on bars.
INDICATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "vwap": vwap,
    "rsi": rsi,
    "macd": macd,
    "bollinger": bollinger,
    "atr": atr,
    "sma": sma,
    "true_range": true_range,
    "all": compute_indicators,
}
