"""Completed predictions and the replay table."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.scoring import resolved
from tickloom.operators.bars import last_n
from tickloom.plans.quota import keep_first
from tickloom.schema import EXPIRED, REPLAY_DAYS, STATIC_SHARE


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_last(df: DataFrame, key: str, order) -> DataFrame:
    """One row per key, the last by ``order`` (a column name)."""
    return last_n(df, [key], F.desc_nulls_last(order), 1)


def merge_latest(old: DataFrame, new: DataFrame, key: str, order: str = "timestamp") -> DataFrame:
    """Union by key where a row of ``new`` replaces that of ``old``.

    ``old`` is read through once without the keys of ``new`` (broadcast when those are few, so that
    ``old`` is not shuffled). Of rows that share a key in ``new`` the last by ``order`` counts;
    ``old``, which such merges made, has each key once.
    """
    rows = distinct_last(new, key, order)
    return union_all(old.join(new.select(key).distinct(), key, "left_anti"), rows).select(*old.columns, *[c for c in new.columns if c not in old.columns])


def completed(ledger: DataFrame) -> DataFrame:
    """Resolved rows, expired ones included."""
    return ledger.filter(resolved())


def scored(ledger: DataFrame, include_expired: bool = False) -> DataFrame:
    """Resolved rows for statistics; expired rows have no outcome and are left out by default."""
    done = completed(ledger)
    return done if include_expired else done.filter(F.col("actual_direction") != EXPIRED)


def update_replay(replay: DataFrame, done: DataFrame, now: dt.datetime, days: int = REPLAY_DAYS) -> DataFrame:
    """Replay rows plus newly completed ones, the newer version of each row, last ``days`` days.

    A row once used in training stays marked, whichever version wins. Only the new rows and the ids
    of marked old ones are shuffled when the new ones are few.
    """
    cutoff = F.col("timestamp") >= F.lit(now - dt.timedelta(days=days)).cast("timestamp")
    old, new = replay.filter(cutoff), done.filter(cutoff)
    used = old.filter("used_in_training").select(F.col("row_id").alias("_id")).distinct()
    last = distinct_last(new, "row_id", "resolution_timestamp").join(used, F.col("row_id") == F.col("_id"), "left")
    flag = F.coalesce(F.col("used_in_training"), F.lit(False)) | F.col("_id").isNotNull()
    last = last.withColumn("used_in_training", flag).drop("_id")
    kept = old.join(new.select("row_id").distinct(), "row_id", "left_anti")
    kept = kept.withColumn("used_in_training", F.coalesce("used_in_training", F.lit(False)))
    return union_all(kept, last).select(*replay.columns)


def mark_trained(replay: DataFrame, used_ids: DataFrame) -> DataFrame:
    used = used_ids.select("row_id").distinct().withColumn("_used", F.lit(True))
    flag = F.coalesce(F.col("_used"), F.col("used_in_training"))
    return replay.join(used, "row_id", "left").withColumn("used_in_training", flag).drop("_used")


def mix_replay(rolling: DataFrame, static: DataFrame, share: float = STATIC_SHARE, seed: int = 42) -> DataFrame:
    """All rolling rows, and as many static rows as make up ``share`` of the result.

    The static rows are a repeatable hash sample; fewer are taken only if there are not enough.
    """
    wanted = F.floor(F.count(F.lit(1)) * F.lit(share / (1 - share)) + F.lit(1e-9))
    sample = keep_first(static, "row_id", seed, rolling.agg(wanted.alias("quota")).scalar())
    return union_all(
        rolling.withColumn("source", F.lit("rolling")), sample.withColumn("source", F.lit("static"))
    )
