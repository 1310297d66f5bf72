"""Recursive averages of any length by an associative scan over blocks of a series.

A block of a series acts on the average before it as one pair: the factor by which it decays, and the sum its
own rows leave behind. Pairs of neighbouring blocks combine to a pair of the same kind, so the value carried into each block is
the same recurrence over one row per block. No earlier rows are copied, however long the average remembers.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.plans.blocks import _FORGET_LOGS, _RANGE_LOGS, BLOCK_ROWS, _index_placed, usable
from tickloom.session import stage


def _block_rows(logs: float, size: int) -> int:
    """Rows of a block whose scaled sums stay in the range of a double."""
    return max(2, min(size, int(2 * _RANGE_LOGS / logs)))


def recurrence(rows: DataFrame, key: str, at: str, x: str, logs: float, out: str, size: int = BLOCK_ROWS) -> DataFrame:
    """Add ``out``: y[at] = exp(-logs) * y[at - 1] + x[at], started from 0.

    ``at`` numbers the rows of each ``key`` from 0 without gaps and ``x`` is non-null. Blocks are summed on the
    map side; the carried values are found by the same function over the blocks, until a block
    is so long that nothing passes through it, which is known from ``logs`` and ``size`` alone.
    """
    length = _block_rows(logs, size)
    first = F.col("_blk") * length
    rows = rows.withColumn("_blk", F.floor(F.col(at) / F.lit(length)))
    left = F.sum(F.col(x) * F.exp((F.col(at) - first - (length - 1)) * logs))
    ends = rows.groupBy(key, "_blk").agg(left.alias("_left"))
    ends = ends.select(key, F.col("_blk").alias("_at"), "_left")
    if logs * length >= _FORGET_LOGS:
        left_by = ends.withColumn("_sum", F.col("_left"))
    else:
        left_by = recurrence(ends, key, "_at", "_left", logs * length, "_sum", size)
    # What leaves a block enters the next one. Laid out like the rows, so that these are not moved again.
    carried = left_by.select(key, (F.col("_at") + 1).alias("_blk"), F.col("_sum").alias("_carry")).repartition(key, "_blk")
    middle = first + length // 2
    inside = F.sum(F.col(x) * F.exp((F.col(at) - middle) * logs)).over(W.partitionBy(key, "_blk").orderBy(at))
    local = rows.withColumn("_local", inside * F.exp((middle - F.col(at)) * logs))
    whole = F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * F.exp((first - 1 - F.col(at)) * logs)
    return local.join(carried, [key, "_blk"], "left").withColumn(out, whole).drop("_local", "_carry", "_blk")


def long_average(df: DataFrame, col: str, alpha: float, n: int, out: str, seed: str = "sma", key: str = "ticker",
                 ts: str = "bar_ts", size: int = BLOCK_ROWS) -> DataFrame:
    """y[t] = alpha*x[t] + (1-alpha)*y[t-1] for averages that remember more rows than a slice holds.

    ``seed='sma'`` starts with the mean of the first ``n`` values, ``seed='first'`` with the first; the result is null
    before ``n`` values were seen. Rows with null or NaN in key, time or ``col`` take no part and come
    back with nulls. The numbered rows are written once, as they are read for the start, the blocks and the result.
    """
    if not 0 < alpha < 1:
        raise ValueError("the smoothing factor must lie between 0 and 1")
    logs = -math.log1p(-alpha)
    good = usable(df, key, ts, col)
    placed = stage(_index_placed(df.filter(good), key, ts), "long-average")
    x, start = F.col(col).cast("double"), n - 1
    if seed == "sma":
        means = placed.filter(F.col("series_idx") < n).groupBy(key).agg(F.avg(x).alias("_mean"), F.count(F.lit(1)).alias("_n"))
        length = _block_rows(logs, size)
        # One row per series, laid out by block like the rows: a long series is not gathered under its key.
        means = means.filter(F.col("_n") == n).select(key, F.lit(start // length).cast("long").alias("_blk"), "_mean").repartition(key, "_blk")
        rows = placed.withColumn("_blk", F.floor(F.col("series_idx") / F.lit(length))).join(means, [key, "_blk"], "left").drop("_blk")
        begins: Column = F.when(F.col("series_idx") == start, F.col("_mean")).otherwise(F.lit(0.0))
        enters = F.when(F.col("series_idx") > start, x * alpha).otherwise(begins)
    else:
        rows = placed.withColumn("_mean", F.lit(None).cast("double"))
        enters = F.when(F.col("series_idx") > 0, x * alpha).otherwise(x)
    done = recurrence(rows.withColumn("_in", enters), key, "series_idx", "_in", logs, "_y", size)
    done = done.withColumn(out, F.when(F.col("series_idx") >= start, F.col("_y"))).drop("_in", "_y", "_mean")
    return done.unionByName(df.filter(~good), allowMissingColumns=True)
