"""Rule-based analysts on indicator rows, their ensemble and the baselines.

The three analysts need a few windows more (previous histogram, recent volatility and volume), so
they extend the indicator slices instead of sorting again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.operators.indicators import HELPERS, indicator_blocks, min_history_gate
from tickloom.plans.blocks import SeriesBlocks, trailing
from tickloom.plans.quota import hash_key

RSI_LOW, RSI_HIGH = 30.0, 70.0
REGIME_ROWS, REGIME_HIGH, REGIME_LOW = 100, 1.5, 0.5
SQUEEZE_ROWS = 20
VOLUME_ROWS, SPIKE_RATIO, THIN_RATIO = 20, 2.0, 0.5

TECHNICAL = ("trend", "rsi_signal", "macd_cross", "score", "technical_direction")
VOLATILITY = ("bb_width", "atr_pct", "regime", "squeeze")
VOLUME = ("volume_ratio", "spike", "divergence", "conviction")


def _sign(difference: str) -> str:
    """Sign of a price difference, where rounding noise counts as no difference."""
    return f"int(signum(round({difference}, 6)))"


def _label(sign: str) -> str:
    return f"CASE WHEN {sign} > 0 THEN 'UP' WHEN {sign} < 0 THEN 'DOWN' WHEN {sign} = 0 THEN 'SIDEWAYS' END"


def _analyst_columns(b: SeriesBlocks) -> SeriesBlocks:
    b.add(
        _prev_hist=b.over("lag(macd_hist)"),
        bb_width="try_divide(bb_upper - bb_lower, bb_middle)",
        atr_pct="try_divide(atr_14, close) * 100",
        volume_ratio=f"try_divide(double(volume), {b.over('avg(volume)', trailing(VOLUME_ROWS, skip=1))})",
        trend=f"coalesce({_sign('close - vwap')}, 0)",
        _body=_sign("close - open"),
        rsi_signal=f"CASE WHEN rsi_14 < {RSI_LOW} THEN 1 WHEN rsi_14 > {RSI_HIGH} THEN -1 ELSE 0 END",
    )
    b.add(
        **b.running_pair("atr_pct", "atr"),
        _tightest=b.over("min(bb_width)", trailing(SQUEEZE_ROWS)),
        macd_cross="CASE WHEN macd_hist > 0 AND _prev_hist <= 0 THEN 1 "
                   "WHEN macd_hist < 0 AND _prev_hist >= 0 THEN -1 ELSE 0 END",
        spike=f"coalesce(volume_ratio >= {SPIKE_RATIO}, false)",
        divergence="vwap IS NOT NULL AND coalesce(_body * trend = -1, false)",
    )
    b.add(_usual_atr=b.mean_from_pair("atr", REGIME_ROWS, skip=1), score="rsi_signal + macd_cross")
    return b.add(
        technical_direction=_label("score"),
        regime=f"CASE WHEN atr_pct > {REGIME_HIGH} * _usual_atr THEN 'HIGH' "
               f"WHEN atr_pct < {REGIME_LOW} * _usual_atr THEN 'LOW' ELSE 'MED' END",
        squeeze="coalesce(bb_width = _tightest, false)",
        conviction="CASE WHEN spike AND NOT divergence THEN 'STRONG' "
                   f"WHEN divergence OR volume_ratio < {THIN_RATIO} THEN 'WEAK' ELSE 'NEUTRAL' END",
    )


ANALYST_HELPERS = (*HELPERS, "_prev_hist", "_body", "_usual_atr", "_tightest", "_atr_s", "_atr_c")


def analysed_blocks(bars: DataFrame, ahead: int = 0, size: int | None = None) -> SeriesBlocks:
    extra = max(REGIME_ROWS + 1, SQUEEZE_ROWS, VOLUME_ROWS) + 1
    return _analyst_columns(indicator_blocks(bars, extra_back=extra, ahead=ahead, size=size))


def analyse(bars: DataFrame, size: int | None = None) -> DataFrame:
    """Indicators and the columns of all three analysts, in one pass over the slices."""
    return min_history_gate(analysed_blocks(bars, size=size).own(*ANALYST_HELPERS))


def _only(bars: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    return analyse(bars).select("ticker", "bar_ts", "series_idx", *wanted)


def technical_signal(bars: DataFrame) -> DataFrame:
    return _only(bars, TECHNICAL)


def volatility_signal(bars: DataFrame) -> DataFrame:
    return _only(bars, VOLATILITY)


def volume_signal(bars: DataFrame) -> DataFrame:
    return _only(bars, VOLUME)


def ensemble(analysed: DataFrame) -> DataFrame:
    """Direction, expected return and confidence from the three analysts, row by row."""
    voted = analysed.selectExpr("*", "score + CASE WHEN conviction = 'STRONG' THEN trend ELSE 0 END AS vote")
    return voted.selectExpr(
        "*",
        f"{_label('vote')} AS prediction_direction",
        "signum(vote) * coalesce(atr_pct, 0) AS prediction_return_pct",
        "CASE WHEN abs(vote) = 2 AND regime <> 'HIGH' THEN 'HIGH' WHEN abs(vote) >= 1 THEN 'MED' "
        "ELSE 'LOW' END AS prediction_confidence",
    )


# A predictor turns analysed rows into rows with the three prediction columns.
Predictor = Callable[[DataFrame], DataFrame]

METHODS = ("random", "rule", "single", "ensemble", "constant")


def baseline_column(method: str, id_col: str = "row_id", seed: int = 42) -> Column:
    """Predicted direction of one method.

    ``random`` is a repeatable draw from three classes, ``rule`` the thresholds on RSI and MACD, ``single``
    the price against VWAP.
    """
    if method == "random":
        h = hash_key(id_col, seed)
        return F.when(h < "5" * 32, "UP").when(h < "a" * 32, "DOWN").otherwise("SIDEWAYS")
    if method == "rule":
        return F.col("technical_direction")
    if method == "single":
        # One analyst alone: the side of the price that the volume analyst trusts.
        return F.expr(_label("trend"))
    if method == "ensemble":
        return F.col("prediction_direction")
    if method == "constant":
        return F.lit("UP")
    raise ValueError(f"unknown method {method!r}")


def baseline_predictions(df: DataFrame, methods=METHODS, id_col: str = "row_id", seed: int = 42) -> DataFrame:
    """One row per input row and method, with that method's direction, without rescanning."""
    options = [
        F.struct(F.lit(m).alias("method"), baseline_column(m, id_col, seed).alias("direction"))
        for m in methods
    ]
    return df.withColumn("_m", F.explode(F.array(*options))).select(
        *df.columns, F.col("_m.method").alias("method"), F.col("_m.direction").alias("method_direction")
    )
