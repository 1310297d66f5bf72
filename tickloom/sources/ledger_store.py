"""Ledger and replay tables on shared storage.

Plain folders serve one writer at a time. ``ledger_table`` and ``replay_table`` keep the same rows under a commit log:
for several writers, compaction, look-up by ``row_id`` and merges that rewrite only the days they change.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tickloom.operators.bars import last_n
from tickloom.operators.replay import update_replay
from tickloom.schema import LEDGER, PHASE2, REPLAY_DAYS
from tickloom.sources.commit_log import CommittedTable

_POINTER = "_current"


def append_predictions(df: DataFrame, path: str) -> None:
    """Append ledger rows, in one folder per ticker. Appends never rewrite earlier rows.

    Rebalancing keeps the number of files low without sending a busy ticker to a single task.
    """
    df.hint("rebalance", "ticker").write.mode("append").partitionBy("ticker").parquet(path)


def _outcome_path(path: str) -> str:
    return f"{path.rstrip('/')}-outcomes"


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop_path(spark, path)
    return fs.exists(p)


def _stored_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The first outcome stored of each row; an outcome once known does not change."""
    schema = T.StructType([LEDGER["row_id"], LEDGER["ticker"], *PHASE2.fields, T.StructField("_seq", T.LongType())])
    if not _exists(spark, _outcome_path(path)):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(_outcome_path(path))
    return last_n(rows, ["row_id"], [F.asc("_seq"), F.asc("resolution_timestamp")], 1)


def append_outcomes(df: DataFrame, path: str) -> None:
    """Store the outcomes of resolved rows that have none yet, beside the ledger at ``path``.

    Predictions are never rewritten: outcomes form a table of their own, keyed by ``row_id``. Storing the
    same outcomes again changes nothing.
    """
    spark = df.sparkSession
    done = df.filter(F.col("actual_direction").isNotNull() & F.col("row_id").isNotNull())
    done = done.select("row_id", "ticker", *PHASE2.names).dropDuplicates(["row_id"])
    known = _stored_outcomes(spark, path).select("row_id")
    fresh = done.join(known, "row_id", "left_anti").withColumn("_seq", F.unix_micros(F.current_timestamp()))
    fresh.hint("rebalance", "ticker").write.mode("append").partitionBy("ticker").parquet(_outcome_path(path))


def read_ledger(spark: SparkSession, path: str, tickers: Sequence[str] | None = None) -> DataFrame:
    """Ledger rows with their outcomes as far as known; with ``tickers`` only their folders are read."""
    rows = spark.read.schema(LEDGER).parquet(path)
    outcomes = _stored_outcomes(spark, path)
    if tickers is not None:
        rows = rows.filter(F.col("ticker").isin(list(tickers)))
        outcomes = outcomes.filter(F.col("ticker").isin(list(tickers)))
    named = outcomes.select(F.col("row_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in PHASE2.names])
    joined = rows.join(named, F.col("row_id") == F.col("_id"), "left")
    merged = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in PHASE2.names}
    return joined.withColumns(merged).select(*LEDGER.names)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_replay(df: DataFrame, path: str, keep: int = 2) -> str:
    """Replace the replay table, which ``df`` may itself read from.

    The rows go to a new version folder, by date; then a one-row pointer table is added. Readers see the
    old version until the pointer is complete, and a failed write leaves it in place. Of the
    versions the last ``keep`` stay, so that running readers finish; older ones are removed.
    """
    spark = df.sparkSession
    version = uuid.uuid4().hex
    dated = df.withColumn("_date", F.to_date("timestamp")).hint("rebalance", "_date")
    dated.write.partitionBy("_date").parquet(f"{path}/v-{version}")
    seq = F.unix_micros(F.current_timestamp())
    pointer = spark.range(1).select(seq.alias("seq"), F.lit(version).alias("version"))
    pointer.write.mode("append").parquet(f"{path}/{_POINTER}")
    # One row per write of the table.
    versions = [r["version"] for r in spark.read.parquet(f"{path}/{_POINTER}").orderBy(F.desc("seq")).limit(keep + 8).collect()]
    for old in versions[keep:]:
        p, fs = _hadoop_path(spark, f"{path}/v-{old}")
        fs.delete(p, True)
    return version


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """The version written last."""
    if not _exists(spark, f"{path}/{_POINTER}"):
        return spark.createDataFrame([], LEDGER)
    newest = spark.read.parquet(f"{path}/{_POINTER}").agg(F.max_by("version", "seq")).first()[0]
    return spark.read.parquet(f"{path}/v-{newest}").drop("_date")


def ledger_table(spark: SparkSession, path: str) -> CommittedTable:
    """A ledger under a commit log: ``append`` from any number of writers, ``compact``, ``read`` and ``lookup``."""
    return CommittedTable(spark, path, LEDGER)


def replay_table(spark: SparkSession, path: str) -> CommittedTable:
    """A replay table under a commit log, with files by day."""
    return CommittedTable(spark, path, LEDGER, by_day=True)


def merge_replay_days(table: CommittedTable, done: DataFrame, now: dt.datetime, days: int = REPLAY_DAYS) -> int:
    """:func:`operators.replay.update_replay` on the days of ``done`` alone; files of other days stay, old ones go.

    A row keeps its timestamp, so a newer version of it lies on the same day. ``done`` is read several times: give it stored.
    """
    oldest = now - dt.timedelta(days=days)
    done = done.filter(F.col("timestamp") >= F.lit(oldest).cast("timestamp"))
    return table.merge_days(done, lambda old, new: update_replay(old, new, now, days), drop_before=oldest)
