"""Forward as-of join: the first right row at or after a left row's time plus a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Windows up to this length are searched in buckets as long as they are.
SHORT_WINDOW_S = 7200


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_ts: str,
    right_ts: str,
    value: str,
    min_gap_s: float = 0.0,
    max_gap_s: float | None = None,
    bucket_s: int = 300,
) -> DataFrame:
    """Add ``matched_ts`` and ``matched_value`` to ``left``; null where nothing qualifies.

    What a row finds depends on its key and time alone. Distinct (key, time) pairs of both sides are
    merged and sorted inside (key, time bucket) slices, as narrow rows; what they find is joined to the
    rows afterwards, so no wide row is sorted and a burst of rows at one time counts once. No pairs
    are formed. A time without a match inside its bucket takes the
    first right row of the next filled bucket, found from one row per bucket (within a day) and
    one row per day (across days). A window of up to ``SHORT_WINDOW_S`` gets buckets of its own length: only the
    first row of the next bucket can lie in it. Where several right rows share a time the lowest value wins.
    """
    gap = int(round(min_gap_s * 1e6))
    short = max_gap_s is not None and max_gap_s - min_gap_s <= SHORT_WINDOW_S
    width = max(bucket_s * 1_000_000, int(round(max_gap_s * 1e6)) - gap) if short else bucket_s * 1_000_000

    def floor_to(column: str, unit: int) -> Column:
        return F.expr(f"({column} - pmod({column}, {unit}L)) DIV {unit}L")

    usable = F.col(key).isNotNull() & F.col(left_ts).isNotNull()
    offers = (
        right.filter(F.col(key).isNotNull() & F.col(right_ts).isNotNull() & F.col(value).isNotNull())
        .select(F.col(key), F.unix_micros(right_ts).alias("_at"), F.col(value).alias("_v"))
        .groupBy(key, "_at")
        .agg(F.min("_v").alias("_v"))
    )
    asks = left.filter(usable).select(F.col(key), (F.unix_micros(left_ts) + F.lit(gap)).alias("_at")).distinct()
    asks = asks.withColumn("_v", F.lit(None).cast(offers.schema["_v"].dataType))
    merged = asks.unionByName(offers).withColumn("_bucket", floor_to("_at", width))
    is_offer = F.col("_v").isNotNull()

    # Latest first; at equal times offers come before asks, so an ask sees an offer of its own
    # instant. The last offer seen is then the nearest one ahead.
    latest_first = (
        W.partitionBy(key, "_bucket")
        .orderBy(F.desc("_at"), F.col("_v").isNull())
        .rowsBetween(W.unboundedPreceding, 0)
    )
    inside = merged.withColumns(
        {
            "_hit_at": F.last(F.when(is_offer, F.col("_at")), ignorenulls=True).over(latest_first),
            "_hit_v": F.last("_v", ignorenulls=True).over(latest_first),
        }
    ).filter(~is_offer)

    offer_at = F.when(is_offer, F.col("_at"))
    firsts = merged.groupBy(key, "_bucket").agg(F.min(offer_at).alias("_f_at"), F.min_by("_v", offer_at).alias("_f_v"))
    if short:
        successor = firsts.filter(F.col("_f_at").isNotNull()).select(
            key, (F.col("_bucket") - 1).alias("_bucket"), F.struct("_f_at", "_f_v").alias("_next")
        )
    else:
        successor = _next_filled(firsts.withColumn("_day", floor_to(f"(_bucket * {width}L)", 86_400_000_000)), key)

    found = inside.join(successor.repartition(key, "_bucket"), [key, "_bucket"], "left")
    at = F.coalesce("_hit_at", "_next._f_at")
    matched = found.withColumns({"_m_at": at, "_m_v": F.coalesce("_hit_v", "_next._f_v")})
    in_time = F.lit(True)
    if max_gap_s is not None:
        in_time = F.col("_m_at") <= F.col("_at") + F.lit(int(round(max_gap_s * 1e6)) - gap)
    answers = matched.filter(in_time & F.col("_m_at").isNotNull()).select(
        F.col(key).alias("_key"),
        (F.col("_at") - F.lit(gap)).alias("_asked"),
        F.timestamp_micros("_m_at").alias("matched_ts"),
        F.col("_m_v").alias("matched_value"),
    )
    asked = left.filter(usable).withColumn("_t", F.unix_micros(left_ts))
    result = asked.join(answers, (F.col(key) == F.col("_key")) & (F.col("_t") == F.col("_asked")), "left")
    # Rows without key or time match nothing; they skip the join instead of meeting in one task.
    return result.drop("_t", "_key", "_asked").unionByName(left.filter(~usable), allowMissingColumns=True)


def _next_filled(buckets: DataFrame, key: str) -> DataFrame:
    """The first offer (``_next``) of the next bucket with offers, of each bucket that has offers or asks."""
    days = buckets.groupBy(key, "_day").agg(
        F.min("_f_at").alias("_f_at"), F.min_by("_f_v", "_f_at").alias("_f_v")
    )

    def later(order: str, *within: str) -> Column:
        ahead = W.partitionBy(*within).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
        first = F.when(F.col("_f_at").isNotNull(), F.struct("_f_at", "_f_v"))
        return F.last(first, ignorenulls=True).over(ahead)

    next_day = days.select(key, "_day", later("_day", key).alias("_other_day")).repartition(key, "_day")
    return (
        buckets.withColumn("_same_day", later("_bucket", key, "_day"))
        .join(next_day, [key, "_day"], "left")
        .select(key, "_bucket", F.coalesce("_same_day", "_other_day").alias("_next"))
    )
