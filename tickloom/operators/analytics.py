"""Accuracy, calibration, return and latency statistics over resolved predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.functions.scoring import resolved, short_ticker
from tickloom.operators.replay import scored
from tickloom.plans.blocks import SeriesBlocks, trailing
from tickloom.plans.ranking import number_rows
from tickloom.plans.selection import select_quantile
from tickloom.schema import CONFIDENCES, DIRECTIONS
from tickloom.session import stage

RANDOM_LEVEL_PCT = 100.0 / 3.0
_TOTAL_BLOCK = 65_536
_TOTAL_GROUP = 4096



def _accuracy() -> Column:
    return F.avg(F.col("prediction_accuracy").cast("double")) * 100


def _n() -> Column:
    return F.count(F.lit(1))


def _by_level(column: str) -> Column:
    levels = F.array(*[F.lit(c) for c in CONFIDENCES])
    return F.array_position(levels, F.col(column))


def overall_accuracy(df: DataFrame, include_expired: bool = False) -> DataFrame:
    return scored(df, include_expired).agg(_accuracy().alias("accuracy_pct"), _n().alias("n"))


def accuracy_by_confidence(df: DataFrame, include_expired: bool = False) -> DataFrame:
    """HIGH, MED, LOW in this order; levels without predictions are left out."""
    rows = scored(df, include_expired).filter(F.col("prediction_confidence").isin(list(CONFIDENCES)))
    stats = rows.groupBy("prediction_confidence").agg(_accuracy().alias("accuracy_pct"), _n().alias("n"))
    return stats.orderBy(_by_level("prediction_confidence"))


def calibration(df: DataFrame, include_expired: bool = False) -> DataFrame:
    """Accuracy with its standard error per confidence level; single predictions have none."""
    rows = scored(df, include_expired).filter(F.col("prediction_confidence").isin(list(CONFIDENCES)))
    good = F.col("prediction_accuracy").cast("double")
    stats = rows.groupBy("prediction_confidence").agg(
        _accuracy().alias("accuracy_pct"), _n().alias("n"), F.stddev_samp(good).alias("std")
    )
    return (
        stats.filter(F.col("std").isNotNull())
        .withColumn("stderr_pct", F.col("std") / F.sqrt("n") * 100)
        .orderBy(_by_level("prediction_confidence"))
    )


def accuracy_by_ticker(df: DataFrame, include_expired: bool = False) -> DataFrame:
    stats = scored(df, include_expired).groupBy(short_ticker("ticker").alias("ticker_short"))
    return stats.agg(_accuracy().alias("accuracy_pct"), _n().alias("n")).orderBy("accuracy_pct", "ticker_short")


def direction_distribution(df: DataFrame, column: str = "prediction_direction") -> DataFrame:
    """Predictions of each direction per ticker."""
    one = lambda d: F.count_if(F.col(column) == d).alias(f"n_{d.lower()}")
    return df.groupBy("ticker").agg(*[one(d) for d in DIRECTIONS], _n().alias("n"))


def return_correlation(df: DataFrame, include_expired: bool = False) -> DataFrame:
    """Pearson correlation of predicted and actual return; 0 for two pairs or fewer."""
    pairs = scored(df, include_expired).dropna(subset=["prediction_return_pct", "actual_return_pct"])
    stats = pairs.agg(F.corr("prediction_return_pct", "actual_return_pct").alias("_r"), _n().alias("n"))
    return stats.select(F.when(F.col("n") > 2, F.col("_r")).otherwise(F.lit(0.0)).alias("r"), "n")


def quantile(df: DataFrame, column: str, q: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """Exact interpolated quantile per group, found by narrowing ranges of values instead of a sort."""
    return select_quantile(df, column, q, by)


def latency_median(df: DataFrame) -> DataFrame:
    return quantile(df, "inference_latency_ms").withColumnRenamed("quantile", "median_ms")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal intervals from the least to the greatest value, the last closed.

    Empty intervals are listed. If all values are equal the range is half a unit to each side.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_x"))
    # One row: the ends, found in one pass before the counting pass.
    a, b = values.agg(F.min("_x"), F.max("_x")).first()
    low, high = (a, b) if a != b else (None, None) if a is None else (a - 0.5, b + 0.5)
    both = {"_a": F.lit(low).cast("double"), "_b": F.lit(high).cast("double")}
    binned = values.withColumns(both).select(
        F.least(F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * bins), F.lit(bins - 1)).alias("bin"),
    )
    counts = binned.groupBy("bin").agg(_n().alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumns(both)
    width = (F.col("_b") - F.col("_a")) / bins
    return (
        every.withColumn("bin", F.col("bin").cast("bigint"))
        .join(counts, "bin", "left")
        .select(
            "bin",
            (F.col("_a") + width * F.col("bin")).alias("lo"),
            (F.col("_a") + width * (F.col("bin") + 1)).alias("hi"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def run_summary(df: DataFrame) -> DataFrame:
    """Predictions, resolved ones, average latency, and predictions per minute of inference."""
    latency = F.coalesce(F.sum("inference_latency_ms"), F.lit(0.0))
    seconds = F.greatest(latency / 1000, F.lit(1.0))
    return df.agg(
        _n().alias("n_predictions"),
        F.count_if(resolved()).alias("n_resolved"),
        (latency / F.greatest(_n(), F.lit(1))).alias("avg_latency_ms"),
        (_n() / seconds * 60).alias("predictions_per_min"),
    )


def cycle_latency(df: DataFrame, n_active: int) -> DataFrame:
    """Inference latency per cycle, averaged over the active tickers, and in total."""
    total = F.sum("inference_latency_ms")
    return df.groupBy("cycle_id").agg(
        F.round(total / max(n_active, 1), 1).alias("inference_avg_ms"),
        F.round(total, 1).alias("inference_total_ms"),
    )


def compare_methods(df: DataFrame, baseline: str = "random", hit: str = "method_hit") -> DataFrame:
    """Accuracy per method and its difference to one of them."""
    stats = df.groupBy("method").agg((F.avg(F.col(hit).cast("double")) * 100).alias("accuracy_pct"), _n().alias("n"))
    # One row per method.
    base = F.max(F.when(F.col("method") == baseline, F.col("accuracy_pct"))).over(W.partitionBy(F.lit(0)))
    return stats.withColumn("delta_pct", F.col("accuracy_pct") - base)


# --- statistics along the order of predictions ---------------------------------------------------

_ORDER = ("timestamp", "row_id")


def order_predictions(df: DataFrame) -> DataFrame:
    return df.orderBy(*_ORDER)


def _narrow(df: DataFrame, by: str | None, *needed: str) -> DataFrame:
    """Only what identifies a prediction and what is computed on; the sort writes its rows out."""
    wanted = dict.fromkeys([*_ORDER, "ticker", *([by] if by else []), *needed])
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have])


def prediction_index(df: DataFrame, by: str | None = None, staged: list | None = None) -> DataFrame:
    """Add ``series_idx`` and ``series_len`` in order of time (all rows, or per ``by``).

    Rows are numbered by a range sort over the cluster; neither the whole table nor one ticker is
    ever sorted in a single task. ``staged`` gets the folder that the sort writes, for callers that remove it.
    """
    keys = [by] if by else []
    return number_rows(df, keys, _ORDER, out="series_idx", total="series_len", staged=staged)


def _keyed(df: DataFrame, by: str | None) -> tuple[DataFrame, str]:
    return (df, by) if by else (df.withColumn("_all", F.lit(0)), "_all")


def running_total(df: DataFrame, value: Column, out: str, by: str | None = None) -> DataFrame:
    """Running sum along ``series_idx``: inside fixed blocks, plus the totals of earlier blocks.

    The totals are summed up in two levels, blocks inside a group of blocks and groups, so that no task sees
    more than a square root of them.
    """
    helpers = () if by else ("_all",)
    df, key = _keyed(df, by)
    rows = df.withColumns({"_v": value, "_blk": F.floor(F.col("series_idx") / _TOTAL_BLOCK)})
    totals = rows.groupBy(key, "_blk").agg(F.sum("_v").alias("_t"))
    totals = totals.withColumn("_grp", F.floor(F.col("_blk") / _TOTAL_GROUP))
    groups = totals.groupBy(key, "_grp").agg(F.sum("_t").alias("_gt"))
    before = lambda what, order, *within: F.coalesce(
        F.sum(what).over(W.partitionBy(*within).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    groups = groups.select(key, "_grp", before("_gt", "_grp", key).alias("_gb"))
    totals = totals.withColumn("_tb", before("_t", "_blk", key, "_grp")).join(groups, [key, "_grp"])
    totals = totals.select(key, "_blk", (F.col("_gb") + F.col("_tb")).alias("_before"))
    inside = W.partitionBy(key, "_blk").orderBy("series_idx").rowsBetween(W.unboundedPreceding, 0)
    summed = rows.withColumn("_in", F.sum("_v").over(inside))
    joined = summed.join(totals.repartition(key, "_blk"), [key, "_blk"])
    return joined.withColumn(out, F.col("_before") + F.coalesce("_in", F.lit(0))).drop(
        "_v", "_blk", "_before", "_in", *helpers
    )


def rolling_accuracy(df: DataFrame, window: int | str = 20, min_periods: int = 1, by: str | None = None,
                     include_expired: bool = False, size: int | None = None) -> DataFrame:
    """Share of hits among the last ``window`` predictions, in percent, one narrow row each.

    ``window='auto'`` is a fifteenth of the predictions, at least 20. Such a frame grows with the
    data, so it is the difference of two running counts rather than a frame over rows.
    """
    rows = prediction_index(_narrow(scored(df, include_expired), by, "prediction_accuracy"), by)
    good = F.col("prediction_accuracy").cast("long")
    if window != "auto":
        helpers = () if by else ("_all",)
        rows, key = _keyed(rows, by)
        b = SeriesBlocks(rows, back=window - 1, size=size or max(4096, 4 * window), key=key, ts="timestamp")
        hits, frame = "bigint(prediction_accuracy)", trailing(window)
        b.add(_n=b.over(f"count({hits})", frame), _s=b.over(f"sum({hits})", frame))
        b.add(rolling_accuracy_pct=f"CASE WHEN _n >= {min_periods} THEN _s / _n * 100 END")
        return b.own("_n", "_s", *helpers)

    rows, key = _keyed(rows, by)
    width = F.greatest(F.lit(20), F.floor(F.col("series_len") / 15))
    counted = stage(running_total(rows, good, "_c", key).withColumn("window_rows", width), "running")
    past = counted.select(
        F.col(key).alias("_k"), (F.col("series_idx") + F.col("window_rows")).alias("_i"), F.col("_c").alias("_old")
    )
    joined = counted.join(past, (F.col(key) == F.col("_k")) & (F.col("series_idx") == F.col("_i")), "left")
    n = F.least(F.col("series_idx") + 1, F.col("window_rows"))
    share = (F.col("_c") - F.coalesce("_old", F.lit(0))) / n * 100
    return joined.withColumns(
        {"rolling_accuracy_pct": F.when(n >= min_periods, share), "random_level_pct": F.lit(RANDOM_LEVEL_PCT)}
    ).drop("_c", "_old", "_k", "_i", "_all")


def cumulative_return(df: DataFrame, by: str | None = None, include_expired: bool = False) -> DataFrame:
    rows = prediction_index(_narrow(scored(df, include_expired), by, "actual_return_pct"), by)
    return running_total(rows, F.col("actual_return_pct"), "cumulative_return_pct", by)


def centered_ma(df: DataFrame, column: str, size: int, by: str | None = None) -> DataFrame:
    """Mean of ``size`` rows around each row of an indexed table; frames are cut at the ends.

    An even size reaches one row further back than ahead.
    """
    behind, ahead = size // 2, size - size // 2 - 1
    rows, key = _keyed(df, by)
    b = SeriesBlocks(rows, back=behind, ahead=ahead, size=max(4096, 4 * size), key=key, ts="timestamp")
    around = f"ROWS BETWEEN {behind} PRECEDING AND {ahead} FOLLOWING"
    helpers = () if by else ("_all",)
    return b.add(centered_ma=b.over(f"avg(`{column}`)", around)).own(*helpers)
