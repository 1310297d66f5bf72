"""Indicators on a stream whose bars may come late or revised: what they change is worked out again.

Every bar goes to a history by (ticker bucket, day). Beside it each ticker has a tail of its newest bars in a
:class:`KeyedState`, long enough for new bars and for changes near the end. A change further back reads the days around
it from the history. In both cases the indicators are recomputed from the change to where all averages have
forgotten it, and the rows are written again under the batch; the newest of a bar's rows counts.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tickloom.operators.indicators import HELPERS, INDICATOR_BACK, PRICES, indicator_blocks, min_history_gate
from tickloom.plans.blocks import index_series, usable
from tickloom.schema import BAR, INDICATOR_COLUMNS, MIN_HISTORY_ROWS
from tickloom.session import stage, drop_path
from tickloom.streaming.state import KeyedState

#: A tail holds twice the look-back, and whole days: the newer half may change without a look into the history.
TAIL_ROWS = 2 * INDICATOR_BACK
TAIL = T.StructType([*BAR.fields, T.StructField("whole", T.BooleanType())])
OUTPUT = [*BAR.names, *INDICATOR_COLUMNS]


def last_versions(bars: DataFrame, *order: Column) -> DataFrame:
    """One row per (ticker, bar_ts): the one with the greatest ``order``; ties go to the greatest values."""
    rest = [c for c in bars.columns if c not in ("ticker", "bar_ts")]
    rank = F.struct(*order, *rest) if order else F.struct(*rest)
    return bars.groupBy("ticker", "bar_ts").agg(F.max_by(F.struct(*rest), rank).alias("_row")).select("ticker", "bar_ts", "_row.*")


def _indicators(rows: DataFrame, size: int | None) -> DataFrame:
    """Indicators of slices of series. Of a slice that is not ``whole`` the first ``INDICATOR_BACK`` rows only lead in."""
    placed = index_series(rows)
    ahead = F.when(F.col("whole"), 0).otherwise(INDICATOR_BACK)
    placed = placed.withColumns({"series_idx": F.col("series_idx") + ahead, "series_len": F.col("series_len") + ahead})
    return min_history_gate(indicator_blocks(placed, size=size).own(*HELPERS))


class RestatingIndicators:
    """``foreachBatch`` function of :func:`stream_restated`; ``version`` names a column that orders revisions."""

    def __init__(self, out_path: str, state_path: str, version: str | None = None, buckets: int = 64, size: int | None = None):
        self.out_path, self.state_path, self.version, self.buckets, self.size = out_path, state_path, version, buckets, size

    def state(self, spark: SparkSession) -> KeyedState:
        return KeyedState(spark, f"{self.state_path}/tails", TAIL, buckets=self.buckets)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, staged = batch.sparkSession, []
        state = self.state(spark)
        order = [F.col(self.version)] if self.version else []
        # One reading of the source: what follows must survive the loss of executors with the same rows.
        batch = stage(batch, "restate-batch", staged)
        good = usable(batch, "ticker", "bar_ts", *PRICES)
        unfit = batch.filter(~good).select(*BAR.names)
        new = stage(last_versions(batch.filter(good).select(*BAR.names, *([self.version] if self.version else [])), *order).select(*BAR.names), "restate-new", staged)
        touched = state.touched(new)
        # Kept first, so that a look into the history sees this batch; a repeated batch adds equal rows.
        kept = new.select("*", F.lit(batch_id).cast("long").alias("batch"), state.bucket().alias("bucket"), F.to_date("bar_ts").alias("day"))
        kept.hint("rebalance", "bucket", "day").write.mode("append").partitionBy("bucket", "day").parquet(f"{self.state_path}/history")

        tails = state.read(batch_id - 1, touched)
        tickers = new.select("ticker").distinct()
        idle, own = tails.join(tickers, "ticker", "left_anti"), tails.join(tickers, "ticker", "left_semi")
        marked = stage(new.join(self._bounds(own), "ticker", "left").withColumns({
            # A ticker seen first has no tail: all of its bars are known.
            "whole": F.coalesce("whole", F.lit(True)),
            "_near": F.coalesce("whole", F.lit(True)) | F.col("_old").isNull() | (F.col("bar_ts") > F.col("_old")),
        }), "restate-marked", staged)
        near = self._near(own, marked, staged)
        far = marked.filter("NOT _near")
        result = near["result"]
        if not far.isEmpty():
            result = result.unionByName(self._far(spark, state, far, near["from"], batch_id))
        result.write.mode("overwrite").parquet(f"{self.out_path}/batch={batch_id}")
        unfit.write.mode("overwrite").parquet(f"{self.out_path}-unfit/batch={batch_id}")
        state.write(near["tails"].unionByName(idle), batch_id, touched)
        for path in staged:
            drop_path(spark, path)

    @staticmethod
    def _bounds(tails: DataFrame) -> DataFrame:
        """Per ticker: its newest bar, its oldest in the tail, and the newest that is too old to change there."""
        ranked = tails.withColumn("_rank", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc("bar_ts"))))
        return ranked.groupBy("ticker").agg(
            F.first("whole").alias("whole"), F.count(F.lit(1)).alias("_n"), F.min("bar_ts").alias("_start"), F.max("bar_ts").alias("_end"),
            F.max(F.when(F.col("_rank") > INDICATOR_BACK, F.col("bar_ts"))).alias("_old"),
        )

    def _near(self, own: DataFrame, marked: DataFrame, staged: list) -> dict[str, DataFrame]:
        """Rows from the first change inside each tail on, and the tails after it."""
        inside = F.col("whole") | F.col("_start").isNull() | (F.col("bar_ts") >= F.col("_start"))
        rows = own.withColumn("_new", F.lit(0)).unionByName(marked.filter(inside).select(*TAIL.names, F.lit(1).alias("_new")))
        rows = stage(last_versions(rows, F.col("_new")).select(*TAIL.names), "restate-tails", staged)
        # A series too short for indicators so far has nulls to correct.
        young = F.col("_n").isNull() | (F.col("whole") & (F.col("_n") < MIN_HISTORY_ROWS))
        first = F.min(F.when(young, F.lit(dt.datetime(1, 1, 1))).when(F.col("_near"), F.col("bar_ts")))
        since = marked.groupBy("ticker").agg(first.alias("_from"), F.max("_end").alias("_end"))
        done = _indicators(rows, self.size).join(since, "ticker").filter(F.col("bar_ts") >= F.col("_from"))
        result = done.select(*OUTPUT, (F.col("_end").isNotNull() & (F.col("bar_ts") <= F.col("_end"))).alias("correction"))

        back = W.partitionBy("ticker").orderBy(F.desc("bar_ts"))
        ranked = rows.withColumn("_rank", F.row_number().over(back))
        cut = ranked.groupBy("ticker").agg(
            F.max(F.when(F.col("_rank") == TAIL_ROWS, F.to_date("bar_ts"))).alias("_day"), F.to_date(F.min("bar_ts")).alias("_first")
        )
        stays = F.col("_day").isNull() | (F.to_date("bar_ts") >= F.col("_day"))
        whole = F.col("whole") & (F.col("_day").isNull() | (F.col("_first") >= F.col("_day")))
        tails = rows.join(cut, "ticker").filter(stays).withColumn("whole", whole).select(*TAIL.names)
        return {"result": result, "tails": tails, "from": since.select("ticker", "_from")}

    def _far(self, spark: SparkSession, state: KeyedState, far: DataFrame, near_from: DataFrame, batch_id: int) -> DataFrame:
        """Rows from changes older than the tails to where they are forgotten, read from the history."""
        spans = far.groupBy("ticker").agg(F.min("bar_ts").alias("_a"), F.max("bar_ts").alias("_b"))
        buckets = state.touched(far)
        root = f"{self.state_path}/history"
        days = sorted({dt.date.fromisoformat(n[4:]) for b in buckets for n in state._names(f"{root}/bucket={b}") if n.startswith("day=")})
        history = spark.read.schema(T.StructType([*BAR.fields, T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("day", T.DateType())]))
        history = history.option("basePath", root).parquet(*[f"{root}/bucket={b}" for b in buckets]).filter(F.col("batch") <= batch_id)
        first, last = far.agg(F.to_date(F.min("bar_ts")), F.to_date(F.max("bar_ts"))).first()
        low, high, step = days.index(first), days.index(last), 1
        while True:
            within = history.filter(F.col("day").between(F.lit(days[low]), F.lit(days[high]))).drop("day", "bucket").join(spans, "ticker")
            # Days are added on either side until each ticker has its look-back and its horizon, or no more bars.
            before, after = within.groupBy("ticker").agg(
                F.countDistinct(F.when(F.col("bar_ts") < F.col("_a"), F.col("bar_ts"))).alias("x"),
                F.countDistinct(F.when(F.col("bar_ts") > F.col("_b"), F.col("bar_ts"))).alias("y"),
            ).agg(F.min("x"), F.min("y")).first()
            short, ends = low > 0 and before < INDICATOR_BACK, high < len(days) - 1 and after < INDICATOR_BACK
            if not short and not ends:
                break
            low, high, step = max(0, low - step) if short else low, min(len(days) - 1, high + step) if ends else high, step * 2
        rows = last_versions(within.select(*BAR.names, "batch"), F.col("batch")).select(*BAR.names).join(spans, "ticker")
        early = rows.groupBy("ticker").agg(F.count(F.when(F.col("bar_ts") < F.col("_a"), 1)).alias("_lead"))
        rows = rows.join(early, "ticker").withColumn("whole", F.col("_lead") < INDICATOR_BACK).drop("_lead")
        done = _indicators(rows, self.size)
        at = done.filter(F.col("bar_ts") <= F.col("_b")).groupBy("ticker").agg(F.max("series_idx").alias("_at"))
        reached = (F.col("series_idx") <= F.col("_at") + INDICATOR_BACK) | (F.to_date("bar_ts") <= F.to_date("_b"))
        other = F.col("_from").isNull() | (F.col("bar_ts") < F.col("_from"))
        done = done.join(at, "ticker").join(near_from, "ticker", "left").filter(reached & other & (F.col("bar_ts") >= F.col("_a")))
        return done.select(*OUTPUT, F.lit(True).alias("correction"))


def stream_restated(bars: DataFrame, out_path: str, state_path: str, checkpoint: str, version: str | None = None,
                    trigger: dict | None = None, buckets: int = 64, size: int | None = None):
    """Start the indicator query on a stream of bars in any order, late and revised ones included.

    A bar that comes again for the same (ticker, bar_ts) replaces the one before it: later batches win, inside a batch the
    greatest ``version``, else the greatest values. Rows go to ``batch=N`` folders with ``correction`` set where an earlier
    batch had passed the bar's time; :func:`read_restated` gives the newest row of each bar. Bars without key, time or
    prices are set aside under ``<out_path>-unfit``. A batch that is run again replaces its own rows.
    """
    sink = RestatingIndicators(out_path, state_path, version, buckets, size)
    writer = bars.writeStream.foreachBatch(sink)
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_restated(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest row of each (ticker, bar_ts), with the ``batch`` that wrote it."""
    rows = spark.read.parquet(out_path)
    return last_versions(rows, F.col("batch"))
