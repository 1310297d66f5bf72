"""Training pairs from correct, resolved predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tickloom.functions.scoring import resolved
from tickloom.functions.text import completion_json, truncate_text
from tickloom.operators.prompts import market_text_column
from tickloom.plans.quota import hash_key, keep_quota
from tickloom.schema import DIRECTIONS, LEDGER_INDICATORS, MIN_TRAINING_ROWS, VALIDATION_SHARE

PAIR_REQUEST = "\n\nGive the direction, the return in percent and the confidence."
PAIR_CHARS = 512


def eligible(replay: DataFrame) -> DataFrame:
    """Correct, resolved and not yet used rows."""
    unused = ~F.coalesce(F.col("used_in_training"), F.lit(False))
    return replay.filter(F.coalesce(F.col("prediction_accuracy"), F.lit(False)) & unused & resolved())


def training_ready(df: DataFrame, n: int = MIN_TRAINING_ROWS) -> DataFrame:
    """One row: how many rows there are and whether they suffice."""
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("ready", F.col("n") >= n)


def class_counts(df: DataFrame) -> DataFrame:
    """Rows per direction, and the size of the smallest class that has any."""
    known = df.filter(F.col("actual_direction").isin(list(DIRECTIONS)))
    counts = known.groupBy("actual_direction").agg(F.count(F.lit(1)).alias("n"))
    # At most three rows.
    return counts.withColumn("min_count", F.min("n").over(W.partitionBy(F.lit(0))))


def balance_classes(df: DataFrame, seed: int = 42) -> DataFrame:
    """As many rows of each direction as the smallest non-empty class has; others are dropped."""
    quotas = class_counts(df).select("actual_direction", F.col("min_count").alias("quota"))
    return keep_quota(df, "actual_direction", "row_id", seed, quotas)


def training_pairs(df: DataFrame) -> DataFrame:
    """Prompt and JSON answer per row; missing numbers count as zero."""
    zero = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in ("open", "high", "low", "close", "volume", *LEDGER_INDICATORS)}
    full = df.withColumns(zero)
    return full.select(
        F.concat(market_text_column(), F.lit(PAIR_REQUEST)).alias("prompt"),
        completion_json("actual_direction", "actual_return_pct", "prediction_confidence").alias("completion"),
        "row_id",
    )


def split(df: DataFrame, share: float = VALIDATION_SHARE, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Add ``part``: 'validation' for a repeatable ``share`` of the rows, else 'train'."""
    limit = format(min(int(share * 16**16), 16**16 - 1), "016x")
    chosen = F.substring(hash_key(id_col, seed), 1, 16) < limit
    return df.withColumn("part", F.when(chosen, "validation").otherwise("train"))


def pair_text(pairs: DataFrame, max_chars: int = PAIR_CHARS) -> DataFrame:
    """Prompt and answer as one text, its length, and the text cut to the longest allowed."""
    text = F.concat("prompt", F.lit("\n"), "completion")
    return pairs.withColumn("text", text).withColumns(
        {"n_chars": F.length("text"), "cut_text": truncate_text("text", max_chars)}
    )
