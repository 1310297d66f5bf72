"""Latest market and prediction state as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scoring import short_ticker
from tickloom.functions.text import decode_messages
from tickloom.operators.bars import latest_per_key


def _as_map(df: DataFrame, fields: list[str]) -> DataFrame:
    """Map of ticker to fields in ticker order. One row per ticker of the universe goes in."""
    entries = F.array_sort(F.collect_list(F.struct(short_ticker("ticker").alias("k"), F.struct(*fields).alias("v"))))
    return df.agg(F.map_from_entries(entries).alias("_map"))


def dashboard_snapshot(bars: DataFrame, predictions: DataFrame, active: DataFrame, status: dict[str, str]) -> DataFrame:
    """One row, one column ``snapshot``: market and predictions of the active tickers, status.

    ``active`` is the cut of the universe (see ``active_universe``) and bounds the document.
    """
    names = active.select("ticker")
    market = _as_map(
        latest_per_key(bars.join(names, "ticker", "left_semi")), ["open", "high", "low", "close", "volume"]
    )
    newest = latest_per_key(predictions.join(names, "ticker", "left_semi"), ts="timestamp").select(
        "ticker",
        F.col("prediction_direction").alias("direction"),
        F.col("prediction_return_pct").alias("target_return_pct"),
        F.col("prediction_confidence").alias("confidence"),
    )
    preds = _as_map(newest, ["direction", "target_return_pct", "confidence"])
    state = F.create_map(*[F.lit(x) for kv in status.items() for x in kv])
    return market.select(
        F.to_json(
            F.struct(F.col("_map").alias("market"), preds.scalar().alias("predictions"), state.alias("status"))
        ).alias("snapshot")
    )


def activity_snapshot(predictions: DataFrame, active: DataFrame, cycle: DataFrame | None = None) -> DataFrame:
    """One row, one column ``snapshot``: what the agents said last about each active ticker, and the latency of the newest cycle.

    ``active`` bounds the document, as in :func:`dashboard_snapshot`. ``cycle`` is the newest cycle with its ``latency_ms``, where
    that is kept as a state; else it is found among all predictions.
    """
    names = active.select("ticker")
    newest = latest_per_key(predictions.join(names, "ticker", "left_semi"), ts="timestamp")
    said = F.transform(decode_messages("agent_contributions"), lambda m: F.struct(m["sender"].alias("sender"), m["text"].alias("text")))
    entries = F.array_sort(F.collect_list(F.struct(short_ticker("ticker").alias("k"), "v")))
    activity = newest.withColumn("v", said).agg(F.map_from_entries(entries).alias("_map"))
    if cycle is None:
        last = predictions.agg(F.max_by("cycle_id", F.struct("timestamp", "row_id"))).scalar()
        total = predictions.withColumn("_last", last).filter("cycle_id = _last").agg(F.sum("inference_latency_ms").alias("t"))
    else:
        total = cycle.agg(F.sum("latency_ms").alias("t"))
    tickers = names.distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    latency = total.select(F.struct(
        F.round(F.col("t") / tickers, 1).alias("inference_avg_ms"), F.round("t", 1).alias("inference_total_ms")
    ).alias("l")).scalar()
    return activity.select(F.to_json(F.struct(F.col("_map").alias("agent_activity"), latency.alias("latency"))).alias("snapshot"))


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.select(F.col("snapshot").alias("value")).coalesce(1).write.mode("overwrite").text(path)
