"""The two-phase prediction ledger: predictions first, outcomes once prices are known."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.scoring import direction_label, elapsed_s, hit, pending, return_pct, reward
from tickloom.functions.text import ROW_KEY_SQL
from tickloom.operators.indicators import drop_warmup, min_history_gate
from tickloom.operators.prompts import ROLES, SYNTHESIZER
from tickloom.operators.signals import ANALYST_HELPERS, Predictor, analysed_blocks, ensemble
from tickloom.plans.asof import asof_forward
from tickloom.plans.blocks import WHOLE, SeriesBlocks
from tickloom.schema import (
    BAR_SECONDS, EXPIRED, EXPIRY_SECONDS, LEDGER_INDICATORS, PHASE1, PHASE2, SAMPLE_START, SAMPLE_STEP,
)

PHASE2_COLUMNS = [f.name for f in PHASE2]


def fill_indicator_nulls(df: DataFrame) -> DataFrame:
    return df.fillna(0.0, [c for c in LEDGER_INDICATORS if c in df.columns])


def _message(i: int, sender: str, text: str, kind: str) -> str:
    return f"named_struct('sender', '{sender}', 'text', {text}, 'type', '{kind}', 'turn', {i})"


# What the three analysts and the synthesis said about a row, as ledger messages.
_SAID = (
    "concat(technical_direction, ' score=', score)",
    "concat(regime, ' squeeze=', squeeze)",
    "concat(conviction, ' divergence=', divergence)",
    "concat(prediction_direction, ' ', prediction_confidence)",
)
_ANALYST_MESSAGES = "array({})".format(
    ", ".join(
        _message(i, sender, text, "synthesis" if sender == SYNTHESIZER else "contribution")
        for i, (sender, text) in enumerate(zip([*(r.name for r in ROLES), SYNTHESIZER], _SAID))
    )
)


def empty_phase2() -> dict[str, Column]:
    return {f.name: F.lit(None).cast(f.dataType) for f in PHASE2}


def phase1_rows(df: DataFrame, mode: str = "inference_only", model_version: str = "rules",
                data_source: str = "bars", keep: Sequence[str] = ()) -> DataFrame:
    """Ledger rows of new predictions: key, context, prediction and empty outcome columns.

    Needs the indicator and prediction columns, carries ``keep`` along; ``cycle_id``, ``band_room_id``,
    ``agent_contributions`` and ``inference_latency_ms`` are filled in when absent.
    """
    have = set(df.columns)
    derived = {"timestamp": "bar_ts"}
    if "cycle_id" not in have:
        derived["cycle_id"] = "concat('cycle_', unix_seconds(bar_ts))"
    if "inference_latency_ms" not in have:
        derived["inference_latency_ms"] = "0"
    if "agent_contributions" not in have:
        derived["agent_contributions"] = f"to_json({_ANALYST_MESSAGES})"
    df = fill_indicator_nulls(df).selectExpr("*", *[f"{e} AS `{c}`" for c, e in derived.items()])
    keys = {
        "row_id": ROW_KEY_SQL,
        "model_version": f"'{model_version}'",
        "mode": f"'{mode}'",
        "data_source": f"'{data_source}'",
    }
    if "band_room_id" not in have:
        keys["band_room_id"] = "concat_ws('_', cycle_id, ticker)"
    phase1 = [f"CAST({keys.get(f.name, f'`{f.name}`')} AS {f.dataType.simpleString()}) AS `{f.name}`" for f in PHASE1]
    phase2 = [f"CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`" for f in PHASE2]
    return df.selectExpr(*phase1, *phase2, *[f"`{c}`" for c in keep])


def outcome_columns(price: Column, at: Column) -> dict[str, Column]:
    """The outcome of a prediction at ``price``: labels use the exact return, storage rounds it."""
    ret = return_pct("close", price)
    actual = direction_label(ret)
    good = hit("prediction_direction", actual)
    return {
        "actual_direction": actual,
        "actual_return_pct": F.round(ret, 4),
        "resolution_timestamp": at,
        "prediction_accuracy": good,
        "resolution_price": F.round(price, 2),
        "reward": reward(good),
        "used_in_training": F.lit(False),
    }


def _set_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def attach_current_price(preds: DataFrame, prices: DataFrame) -> DataFrame:
    """Current price per ticker (one row each in ``prices``), or the entry price without one."""
    current = prices.select("ticker", F.col("price").alias("_price"))
    joined = preds.join(current, "ticker", "left")
    return joined.withColumn("current_price", F.coalesce("_price", "close")).drop("_price")


def resolve_at_current(ledger: DataFrame, prices: DataFrame, now: dt.datetime,
                       min_gap_s: int = BAR_SECONDS) -> DataFrame:
    """Resolve pending rows old enough at one set of current prices, as one live cycle does."""
    at = F.lit(now).cast("timestamp")
    due = pending() & (elapsed_s("timestamp", at) >= min_gap_s)
    priced = attach_current_price(ledger, prices)
    return _set_where(priced, due, outcome_columns(F.col("current_price"), at)).drop("current_price")


def resolve_forward(preds: DataFrame, prices: DataFrame, min_gap_s: float = BAR_SECONDS,
                    max_gap_s: float | None = EXPIRY_SECONDS) -> DataFrame:
    """The first price of the ticker at least ``min_gap_s`` after each prediction."""
    return asof_forward(preds, prices, "ticker", "timestamp", "ts", "price", min_gap_s, max_gap_s)


def expired_columns(at: Column) -> dict[str, Column]:
    return {
        "actual_direction": F.lit(EXPIRED),
        "actual_return_pct": F.lit(0.0),
        "resolution_timestamp": at,
        "prediction_accuracy": F.lit(False),
        "resolution_price": F.lit(0.0),
        "reward": F.lit(0.0),
        "used_in_training": F.lit(False),
    }


def resolve_phase2(ledger: DataFrame, prices: DataFrame, asof: dt.datetime,
                   min_gap_s: float = BAR_SECONDS, max_gap_s: float = EXPIRY_SECONDS) -> DataFrame:
    """Outcomes as known at ``asof``: pending rows take the first price in their window, expire
    once the window has passed without one, and wait otherwise.

    Only pending rows are joined, with the prices between the first and the last of their windows; all other
    rows pass through untouched. ``prices`` has ``ticker``, ``ts`` and ``price``; stored with :func:`sources.bars.write_prices` it also
    has the ``day`` of each folder, and only the days of the windows are read.
    """
    at = F.lit(asof).cast("timestamp")
    waiting = pending()
    open_rows = ledger.filter(waiting)
    # Bounds on the columns themselves, so that the reader can skip row groups and, with prices by day, folders.
    edge = lambda end, gap: open_rows.agg(F.timestamp_micros(F.unix_micros(end("timestamp")) + int(gap * 1e6)).alias("t")).scalar()
    low, high = edge(F.min, min_gap_s), edge(F.max, max_gap_s)
    known = prices.filter((F.col("ts") <= at) & (F.col("ts") >= low) & (F.col("ts") <= high))
    if "day" in prices.columns:
        known = known.filter((F.col("day") >= F.to_date(low)) & (F.col("day") <= F.to_date(high)))
    matched = resolve_forward(open_rows, known, min_gap_s, max_gap_s)
    late = waiting & F.col("matched_ts").isNull() & (elapsed_s("timestamp", at) > max_gap_s)
    found = waiting & F.col("matched_ts").isNotNull()
    hits = outcome_columns(F.col("matched_value"), F.col("matched_ts"))
    gone = expired_columns(F.timestamp_micros(F.unix_micros("timestamp") + int(max_gap_s * 1e6)))
    merged = {
        c: F.when(found, hits[c]).when(late, gone[c]).otherwise(F.col(c)) for c in PHASE2_COLUMNS
    }
    done = matched.withColumns(merged).drop("matched_ts", "matched_value")
    return ledger.filter(~waiting).unionByName(done)


def sweep_orphans(ledger: DataFrame, now: dt.datetime | Column, wait_s: float = BAR_SECONDS,
                  expire_s: float = EXPIRY_SECONDS) -> DataFrame:
    """Close rows left pending: expired after an hour, otherwise flat at the entry price.

    A row closed flat counts as a miss even where SIDEWAYS was predicted.
    """
    at = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    age = elapsed_s("timestamp", at)
    gone = expired_columns(at)
    flat = {**gone, "actual_direction": F.lit("SIDEWAYS"), "resolution_price": F.col("close")}
    old = pending() & (age > expire_s)
    due = pending() & (age > wait_s)
    return ledger.withColumns(
        {c: F.when(old, gone[c]).when(due, flat[c]).otherwise(F.col(c)) for c in PHASE2_COLUMNS}
    )


def resolve_by_offset(bars: DataFrame, offset: int = SAMPLE_STEP) -> DataFrame:
    """Close ``offset`` bars later, or the last close of the series."""
    b = SeriesBlocks(bars, back=0, ahead=offset, needs=("close",))
    return b.add(resolution_price=_close_ahead(b, offset)).own()


def _close_ahead(b: SeriesBlocks, offset: int) -> str:
    # The slice holds ``offset`` later rows, so only the end of the series can be missing, and
    # then the last row of the slice is the last row of the series.
    return f"coalesce({b.over(f'lead(close, {offset})')}, {b.over('last(close)', WHOLE)})"


def backtest(bars: DataFrame, start: int = SAMPLE_START, step: int = SAMPLE_STEP,
             offset: int = SAMPLE_STEP, predictor: Predictor = ensemble, latency: Column | None = None,
             keep: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """Predictions on sampled bars with their outcomes ``offset`` bars later, in one plan.

    Indicators, analysts and the later close share the slices of the series; sampling and
    prediction are row-wise on top.
    """
    b = analysed_blocks(bars, ahead=offset, size=size)
    b.add(_later=_close_ahead(b, offset))
    rows = min_history_gate(b.own(*ANALYST_HELPERS))
    sampled = drop_warmup(rows.where(f"series_idx >= {start} AND (series_idx - {start}) % {step} = 0"))
    named = predictor(sampled).withColumns(
        {
            "cycle_id": F.concat(F.lit("backtest_"), F.col("series_idx").cast("string")),
            "inference_latency_ms": F.lit(0.0) if latency is None else latency,
        }
    )
    ledger = phase1_rows(named, mode="backtest", keep=("_later", *keep))
    return ledger.withColumns(outcome_columns(F.col("_later"), F.col("timestamp"))).drop("_later")
