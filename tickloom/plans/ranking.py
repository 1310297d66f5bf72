"""Exact row numbers without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.session import stage

_LOCAL_BITS = 33


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "row_idx", total: str | None = None,
    staged: list | None = None,
) -> DataFrame:
    """0-based position of each row within ``keys`` by ``order``, for groups of any size.

    The rows are range-sorted over the cluster (the order columns split even one huge group),
    written once, and numbered inside their partition. One row per (group, partition) gives the
    count of earlier rows, and rows meet it under (group, partition): no task ever holds more
    than a sort partition. ``order`` must be total within the group. ``total`` adds group sizes.
    """
    keys = list(keys)
    ranged = df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    rows = stage(ranged, "ranked", staged).withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    rows = rows.withColumn("_pos", pos).drop("_mid")
    segments = rows.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_from")
    )
    # One row per sort partition in each group.
    parts = W.partitionBy(*keys).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cols = {"_shift": before - F.col("_from")}
    if total:
        cols[total] = F.sum("_n").over(W.partitionBy(*keys))
    segments = segments.withColumns(cols).drop("_n", "_from")
    match = [rows[k].eqNullSafe(segments[k]) for k in keys] + [rows["_part"] == segments["_part"]]
    # Without keys there is one row per sort partition: the optimizer sees its size and broadcasts it.
    small = segments.repartition(*keys, "_part") if keys else segments
    joined = rows.join(small, match)
    for k in [*keys, "_part"]:
        joined = joined.drop(segments[k])
    return joined.withColumn(out, F.col("_shift") + F.col("_pos")).drop("_shift", "_pos", "_part")
