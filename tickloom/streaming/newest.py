"""The snapshot kept up to date batch by batch, from states that can be merged.

A batch is reduced to the newest bar and prediction of each ticker and to the latency of each cycle; these small rows are merged
with what the batches before left for the same keys. A snapshot reads the states alone, never the history.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.session import drop_path, stage
from tickloom.streaming.state import KeyedState

BAR_FIELDS = ("open", "high", "low", "close", "volume")
PREDICTION_FIELDS = ("cycle_id", "prediction_direction", "prediction_return_pct", "prediction_confidence", "agent_contributions")
#: Days for which a cycle may still get predictions.
CYCLE_DAYS = 1


class NewestRows:
    """The newest row of each ticker: the latest time, and of equal times what came last (then the larger tie breaker)."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, ts: str, fields: Sequence[str], tie: str | None = None,
                 buckets: int = 64):
        self.ts, self.tie, self.fields = ts, tie, [f for f in fields if f in schema.names]
        names = ["ticker", ts, *([tie] if tie else []), *self.fields]
        kept = T.StructType([schema[n] for n in names]).add("_batch", "long")
        self.names, self.state = names, KeyedState(spark, path, kept, buckets=buckets)

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        """Take in the rows of a batch; only the buckets of its tickers are read and written."""
        staged: list = []
        new = self._newest(rows.filter(F.col("ticker").isNotNull() & F.col(self.ts).isNotNull()).select(*self.names, F.lit(batch_id).cast("long").alias("_batch")))
        new = stage(new, "newest", staged)
        touched = self.state.touched(new)
        old = self.state.read(batch_id - 1, touched)
        self.state.write(self._newest(old.unionByName(new)), batch_id, touched)
        for path in staged:
            drop_path(rows.sparkSession, path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        order = [self.ts, "_batch", *([self.tie] if self.tie else [])]
        best = F.max_by(F.struct(*[c for c in rows.columns if c != "ticker"]), F.struct(*order)).alias("_v")
        return rows.groupBy("ticker").agg(best).select("ticker", "_v.*")

    def read(self, batch_id: int | None = None) -> DataFrame:
        """One row per ticker, as the last batch (or ``batch_id``) left it."""
        return self.state.read(self.state.latest() if batch_id is None else batch_id).select(*self.names)


class CycleLatency:
    """Total inference latency and newest row of each cycle of the last :data:`CYCLE_DAYS` days."""

    SCHEMA = (
        T.StructType().add("cycle_id", "string").add("timestamp", "timestamp").add("row_id", "string").add("latency_ms", "double")
    )

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.state = KeyedState(spark, path, self.SCHEMA, key="cycle_id", buckets=buckets)

    def merge(self, rows: DataFrame, batch_id: int) -> None:
        staged: list = []
        new = self._sum(rows.filter("cycle_id IS NOT NULL").select(
            "cycle_id", "timestamp", "row_id", F.col("inference_latency_ms").cast("double").alias("latency_ms")))
        new = stage(new, "cycles", staged)
        touched = self.state.touched(new)
        both = self._sum(self.state.read(batch_id - 1, touched).unionByName(new))
        # A cycle this far behind gets no more rows and cannot become the newest one.
        last = new.agg((F.max("timestamp") - F.make_dt_interval(days=F.lit(CYCLE_DAYS))).alias("m")).scalar()
        self.state.write(both.filter(F.col("timestamp").isNull() | (F.col("timestamp") >= last)), batch_id, touched)
        for path in staged:
            drop_path(rows.sparkSession, path)

    def _sum(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("timestamp", "row_id")).alias("_last")
        sums = rows.groupBy("cycle_id").agg(last, F.sum("latency_ms").alias("latency_ms"))
        return sums.select("cycle_id", "_last.*", "latency_ms")

    def newest(self, batch_id: int | None = None) -> DataFrame:
        """The newest cycle: at most one row."""
        rows = self.state.read(self.state.latest() if batch_id is None else batch_id)
        whole = F.max_by(F.struct("cycle_id", "latency_ms"), F.struct("timestamp", "row_id")).alias("_v")
        return rows.agg(whole).filter("_v IS NOT NULL").select("_v.*")


def newest_bars(spark: SparkSession, path: str, schema: T.StructType) -> NewestRows:
    return NewestRows(spark, f"{path}/bars", schema, "bar_ts", BAR_FIELDS)


def newest_predictions(spark: SparkSession, path: str, schema: T.StructType) -> NewestRows:
    return NewestRows(spark, f"{path}/predictions", schema, "timestamp", PREDICTION_FIELDS, "row_id")


def merging_sink(*states: NewestRows | CycleLatency) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: every state takes in the batch; a repeated batch replaces what it left."""

    def run(batch: DataFrame, batch_id: int) -> None:
        staged: list = []
        rows = stage(batch, "snapshot-batch", staged)
        for state in states:
            state.merge(rows, batch_id)
        for path in staged:
            drop_path(batch.sparkSession, path)

    return run


def stream_newest(rows: DataFrame, checkpoint: str, *states: NewestRows | CycleLatency, trigger: dict | None = None):
    """Start the query that keeps ``states`` up to date with a stream of bars or of predictions."""
    writer = rows.writeStream.foreachBatch(merging_sink(*states)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
