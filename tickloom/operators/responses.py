"""Model responses to predictions: parsing, retries, defaults and latency."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.text import clamp_enum, parse_prediction
from tickloom.schema import CONFIDENCES, DIRECTIONS

_MAX_ATTEMPTS = 2


def normalize_responses(df: DataFrame, key: str = "row_id", attempt: str = "attempt",
                        response: str = "response") -> DataFrame:
    """One prediction per key from up to two attempts.

    The second attempt counts only if the first is not JSON at all. JSON without usable fields,
    or no JSON in either attempt, gives SIDEWAYS / 0.0 / LOW. Labels outside their set fall back
    to the same defaults.
    """
    parsed = df.filter(F.col(attempt) <= _MAX_ATTEMPTS).withColumn("_p", parse_prediction(response))
    usable = F.coalesce(F.col("_p.usable"), F.lit(False))
    pick = lambda field, default: F.when(usable, F.col(f"_p.{field}")).otherwise(F.lit(default))
    place = lambda label, labels: (F.array_position(F.array(*[F.lit(x) for x in labels]), label) - 1).cast("int")
    is_json = F.col("_p.is_json")
    coded = parsed.select(
        key, F.when(is_json, F.col(attempt)).alias("_n"),
        place(clamp_enum(pick("direction", "SIDEWAYS"), DIRECTIONS, "SIDEWAYS"), DIRECTIONS).alias("_d"),
        pick("target_return_pct", 0.0).cast("double").alias("_t"),
        place(clamp_enum(pick("confidence", "LOW"), CONFIDENCES, "LOW"), CONFIDENCES).alias("_c"),
    )
    # Labels travel as their place in the list: fixed-width values keep this a hash aggregation.
    first = lambda c: F.min_by(F.when(F.col("_n").isNotNull(), F.col(c)), "_n").alias(c)
    chosen = coded.groupBy(key).agg(first("_d"), first("_t"), first("_c"))
    name = lambda c, labels, default: F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), F.col(c)), F.lit(default))
    return chosen.select(
        key,
        name("_d", DIRECTIONS, "SIDEWAYS").alias("direction"),
        F.coalesce("_t", F.lit(0.0)).alias("target_return_pct"),
        name("_c", CONFIDENCES, "LOW").alias("confidence"),
    )


def prediction_latency(calls: DataFrame, key: str = "row_id", count_failed: bool = False) -> DataFrame:
    """Total latency per prediction over calls (key, attempt, ok, latency_ms).

    Retries are not counted; failed calls only with ``count_failed`` (as a backtest does).
    """
    counted = F.col("attempt") == 1
    if not count_failed:
        counted = counted & F.col("ok")
    total = F.coalesce(F.sum(F.when(counted, F.col("latency_ms"))), F.lit(0.0))
    return calls.groupBy(key).agg(F.round(total, 1).alias("inference_latency_ms"))
