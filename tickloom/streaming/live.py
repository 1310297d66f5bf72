"""The live path as Structured Streaming queries.

Ticks become bars, bars become indicator rows with their history (in time order here, in any order in
``restate``), predictions wait for their price or expire. State is bounded by watermarks or by the fixed look-back of the indicators.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.operators.analytics import prediction_index, rolling_accuracy
from tickloom.operators.bars import build_bars, last_n
from tickloom.operators.curation import balance_classes, eligible, training_pairs
from tickloom.operators.indicators import HELPERS, INDICATOR_BACK, PRICES, indicator_blocks, min_history_gate
from tickloom.operators.ledger import expired_columns, outcome_columns
from tickloom.operators.replay import completed, mark_trained, update_replay
from tickloom.plans.blocks import SeriesBlocks, index_series, trailing, usable
from tickloom.schema import BAR, BAR_SECONDS, EXPIRY_SECONDS
from tickloom.session import drop_path, stage
from tickloom.streaming.state import KeyedState


def _seconds(n: int) -> Column:
    """An interval literal, which the watermark rules of stream joins can read."""
    return F.expr(f"INTERVAL '{int(n)}' SECOND")


def stream_build_bars(ticks: DataFrame, width: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Tumbling bars, emitted once the watermark has passed their interval."""
    return build_bars(ticks.withWatermark("ts", delay), width)


def stream_resolve(preds: DataFrame, prices: DataFrame, min_gap_s: int = BAR_SECONDS,
                   max_gap_s: int = EXPIRY_SECONDS, delay: str = "1 minute", salts: int = 4, slot_s: int = BAR_SECONDS) -> DataFrame:
    """Outcome of each prediction: its first price in the window, or EXPIRED without one.

    ``prices`` (ticker, ts, price) may be bars or ticks. A watermark-bounded aggregate keeps the earliest price of each
    ticker and ``slot_s`` seconds by event time, whatever comes first; a prediction meets the slots of its window,
    and these decide unless its window begins inside a slot. Only such predictions also meet the single prices of
    that one slot. Of prices at one time the lowest counts. Predictions are salted and the few slots copied to all
    salts, which spreads a busy ticker over several tasks; prices inside slots are spread by (ticker, slot).
    """
    key = ["row_id", "timestamp", "ticker", "close", "prediction_direction"]
    p = preds.select(*key).withWatermark("timestamp", delay)
    # Rows without a price are left out after the joins: a filter here would move ahead of the watermark, and they tell the time.
    q = prices.select("ticker", "ts", "price").withWatermark("ts", delay)
    priced = F.when(F.col("price").isNotNull(), F.struct("ts", "price"))
    begins, ends = F.col("timestamp") + _seconds(min_gap_s), F.col("timestamp") + _seconds(max_gap_s)

    slots = q.groupBy("ticker", F.window("ts", f"{slot_s} seconds")).agg(F.min(priced).alias("_first"))
    slots = slots.select(
        F.col("ticker").alias("_pt"), F.window_time("window").alias("_closes"), "_first",
        F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(salts)])).alias("_ps"),
    )
    salted = p.withColumn("_salt", F.pmod(F.crc32("row_id"), F.lit(salts)))
    reach = (
        (F.col("ticker") == F.col("_pt"))
        & (F.col("_salt") == F.col("_ps"))
        & (F.col("_closes") >= begins)
        & (F.col("_closes") <= ends + _seconds(slot_s))
        & (F.col("_first.ts") >= begins)
        & (F.col("_first.ts") <= ends)
    )
    met = salted.join(slots, reach, "left_outer").select(*key, "_first")

    width = slot_s * 1_000_000
    micros = F.unix_micros("timestamp") + min_gap_s * 1_000_000
    inside = p.filter(F.pmod(micros, F.lit(width)) != 0).withColumn("_slot", F.floor(micros / width))
    single = q.select(
        F.col("ticker").alias("_pt"), F.col("ts").alias("_at"), F.floor(F.unix_micros("ts") / width).alias("_ps"),
        priced.alias("_first"),
    )
    same_slot = (
        (F.col("ticker") == F.col("_pt"))
        & (F.col("_slot") == F.col("_ps"))
        & (F.col("_at") >= begins)
        & (F.col("_at") <= F.col("timestamp") + _seconds(min(max_gap_s, min_gap_s + slot_s)))
    )
    met = met.unionByName(inside.join(single, same_slot).select(*key, "_first"))
    first = met.groupBy(*key).agg(F.min(F.when(F.col("_first.ts").isNotNull(), F.col("_first"))).alias("_first"))
    hits = outcome_columns(F.col("_first.price"), F.col("_first.ts"))
    gone = expired_columns(ends)
    found = F.col("_first").isNotNull()
    return first.withColumns({c: F.when(found, hits[c]).otherwise(gone[c]) for c in hits}).drop("_first")


def stream_dedupe(df: DataFrame, keys: list[str], ts: str, delay: str = "10 minutes") -> DataFrame:
    """First arrival per key within the watermark, for rows that never change once written."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def stream_upsert(df: DataFrame, keys: list[str], ts: str, arrival: str, delay: str = "10 minutes") -> DataFrame:
    """Last arrival per key and second, emitted when the second can no longer change."""
    rows = df.withWatermark(ts, delay)
    last = F.max_by(F.struct(*[c for c in df.columns if c not in keys]), arrival)
    return rows.groupBy(*keys, F.window(ts, "1 second").alias("_w")).agg(last.alias("_row")).select(
        *keys, "_row.*"
    )


def stream_latest(df: DataFrame, ts: str = "bar_ts", key: str = "ticker") -> DataFrame:
    """Latest row per key, for the update or complete output mode."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), ts).alias("_row")).select(key, "_row.*")


def write_latest(latest: DataFrame, out_path: str, checkpoint: str, key: str = "ticker", ts: str = "bar_ts"):
    """Start :func:`stream_latest` in update mode: the keys each batch changed go to a folder of their own."""

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_version(out_path, batch_id))

    writer = latest.writeStream.outputMode("update").foreachBatch(run)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_latest(spark: SparkSession, out_path: str, key: str = "ticker", ts: str = "bar_ts") -> DataFrame:
    """The newest row per key of what :func:`write_latest` has written so far."""
    return last_n(spark.read.parquet(out_path), [key], [F.desc(ts), F.desc("batch")], 1).drop("batch")


# --- state carried between batches in versioned tables ---------------------------------------------


def _version(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id}"


def _read_version(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """The state left by an earlier batch; a batch that is run again finds the same one.

    Only the first batch starts from nothing, and only in an empty folder: state that is missing, or
    state of a later batch left by another checkpoint, is an error and not a fresh start.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = [str(s.getPath().getName()) for s in fs.listStatus(folder)] if fs.exists(folder) else []
    found = sorted(int(name[6:]) for name in there if name.startswith("batch="))
    if batch_id < 0:
        if any(b > 0 for b in found):
            raise ValueError(f"{path} holds the state of batch {found[-1]}; a new checkpoint needs a new state folder")
        return None
    if batch_id not in found:
        raise ValueError(f"the state of batch {batch_id} is missing in {path}; it holds {found or 'nothing'}")
    return spark.read.parquet(_version(path, batch_id))


def _drop_version(spark: SparkSession, path: str, batch_id: int) -> None:
    if batch_id >= 0:
        drop_path(spark, _version(path, batch_id))


_HISTORY = T.StructType([*BAR.fields, T.StructField("series_idx", T.LongType()), T.StructField("series_len", T.LongType())])


def indicator_batch(new: DataFrame, history: DataFrame | None, size: int | None = None):
    """Indicator rows of ``new`` bars, the history for the next batch, and bars that came too late.

    The history holds, per ticker, as many rows as the indicators look back and the running
    session; only that of the batch's own tickers takes part in the work, all other rows of it pass on as they
    are. A bar that is not newer than its ticker's history cannot be placed any more and is returned
    separately, and so is one without key, time or prices.
    """
    new = new.select(*BAR.names)
    good = usable(new, "ticker", "bar_ts", *PRICES)
    unfit, new = new.filter(~good), new.filter(good)
    idle = None
    if history is None:
        rows, late = index_series(new).withColumn("_new", F.lit(True)), unfit
    else:
        tickers = new.select("ticker").distinct()
        idle = history.join(tickers, "ticker", "left_anti")
        history = history.join(tickers, "ticker", "left_semi")
        ends = history.groupBy("ticker").agg(
            F.max("bar_ts").alias("_end"), F.max("series_idx").alias("_last")
        )
        seen = new.join(ends, "ticker", "left")
        fresh = F.col("_end").isNull() | (F.col("bar_ts") > F.col("_end"))
        late = seen.filter(~fresh).drop("_end", "_last").unionByName(unfit)
        placed = index_series(seen.filter(fresh))
        start = F.coalesce(F.col("_last") + 1, F.lit(0))
        placed = placed.withColumns(
            {"series_idx": start + F.col("series_idx"), "series_len": start + F.col("series_len")}
        ).drop("_end", "_last").withColumn("_new", F.lit(True))
        lengths = placed.groupBy("ticker").agg(F.max("series_len").alias("_len"))
        old = history.join(lengths, "ticker", "left").withColumn(
            "series_len", F.coalesce("_len", "series_len")
        ).drop("_len").withColumn("_new", F.lit(False))
        rows = placed.unionByName(old)

    done = min_history_gate(indicator_blocks(rows, size=size).own(*HELPERS))
    result = done.filter("_new").drop("_new")

    ends = rows.groupBy("ticker").agg(
        F.max("series_idx").alias("_last"), F.to_date(F.max("bar_ts")).alias("_day")
    )
    needed = (F.col("series_idx") > F.col("_last") - INDICATOR_BACK) | (F.to_date("bar_ts") == F.col("_day"))
    keep = rows.drop("_new").join(ends, "ticker").filter(needed).drop("_last", "_day")
    return result, keep if idle is None else keep.unionByName(idle), late


def indicator_sink(out_path: str, state_path: str, buckets: int = 64):
    """``foreachBatch`` function: indicators on new bars using their history.

    Output is written under the batch id and the history by ticker buckets (:class:`KeyedState`), so a repeated batch
    replaces its own rows, and a batch rewrites the history of the buckets of its tickers only.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, []
        state = indicator_state(spark, state_path, buckets)
        batch = stage(batch, "indicator-batch", staged)
        touched = state.touched(batch)
        history = state.read(batch_id - 1, touched) if state.manifest(batch_id - 1) else None
        result, keep, late = indicator_batch(batch, history)
        result.write.mode("overwrite").parquet(_version(out_path, batch_id))
        late.write.mode("overwrite").parquet(_version(f"{out_path}-late", batch_id))
        state.write(keep, batch_id, touched)
        for path in staged:
            drop_path(spark, path)

    return run


def indicator_state(spark: SparkSession, state_path: str, buckets: int = 64) -> KeyedState:
    """The history that :func:`indicator_sink` keeps."""
    return KeyedState(spark, state_path, _HISTORY, buckets=buckets)


def stream_indicators(bars: DataFrame, out_path: str, state_path: str, checkpoint: str, trigger: dict | None = None):
    """Start the indicator query on a stream of bars that arrive in time order per ticker."""
    writer = bars.writeStream.foreachBatch(indicator_sink(out_path, state_path))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rolling_sink(out_path: str, state_path: str, window: int = 20, min_periods: int = 1):
    """``foreachBatch`` function: rolling accuracy over outcomes in order of arrival.

    The state is the last ``window - 1`` outcomes with their positions.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark, written = batch.sparkSession, []
        cols = ["row_id", "timestamp", "prediction_accuracy"]
        batch = batch.filter(F.col("prediction_accuracy").isNotNull()).select(*cols)
        new = prediction_index(batch, staged=written).drop("series_len")
        old = _read_version(spark, state_path, batch_id - 1)
        if old is None:
            rows = new.withColumn("_new", F.lit(True))
        else:
            start = F.coalesce(old.agg(F.max("series_idx").alias("m")).scalar() + 1, F.lit(0))
            rows = new.withColumn("series_idx", F.col("series_idx") + start).withColumn("_new", F.lit(True))
            rows = rows.unionByName(old.withColumn("_new", F.lit(False)))
        total = rows.agg((F.max("series_idx") + 1).alias("n")).scalar()
        b = SeriesBlocks(
            rows.withColumns({"series_len": total, "_all": F.lit(0)}), back=window - 1, key="_all", ts="timestamp"
        )
        hits, frame = "double(prediction_accuracy)", trailing(window)
        b.add(_n=b.over(f"count({hits})", frame), _acc=f"{b.over(f'avg({hits})', frame)} * 100")
        b.add(rolling_accuracy_pct=f"CASE WHEN _n >= {min_periods} THEN _acc END")
        done = b.own("_n", "_acc", "_all", "series_len")
        done.filter("_new").drop("_new").write.mode("overwrite").parquet(_version(out_path, batch_id))
        keep = rows.filter(F.col("series_idx") > total - window).drop("_new")
        keep.write.mode("overwrite").parquet(_version(state_path, batch_id))
        _drop_version(spark, state_path, batch_id - 3)
        for path in written:
            drop_path(spark, path)

    return run


def run_post_market(ledger: DataFrame, replay: DataFrame, out_path: str, date: dt.date, now: dt.datetime,
                    min_rows: int) -> DataFrame:
    """End-of-day batch: accuracy report, training pairs if there are enough, new replay rows.

    Report, pairs and the replay rows are written under the date, so running a day again replaces its own
    results; the rows written are returned, to be put in place with ``write_replay``.
    """
    day = f"{out_path}/date={date.isoformat()}"
    rolling_accuracy(replay).select("row_id", "timestamp", "rolling_accuracy_pct").write.mode(
        "overwrite"
    ).parquet(f"{day}/accuracy")
    done = completed(ledger)
    usable = eligible(replay)
    ready = done.limit(min_rows).count() >= min_rows and usable.limit(min_rows).count() >= min_rows
    if ready:
        training_pairs(balance_classes(usable)).write.mode("overwrite").parquet(f"{day}/pairs")
        pairs = replay.sparkSession.read.parquet(f"{day}/pairs")
        replay = mark_trained(replay, pairs)
    update_replay(replay, done, now).write.mode("overwrite").parquet(f"{day}/replay")
    return replay.sparkSession.read.parquet(f"{day}/replay")
