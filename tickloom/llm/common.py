"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.session import stage

#: A word is a run of anything but space and the ASCII control blanks.
WORD = r"[^\x20\x09-\x0D]+"

_LOCAL_BITS = 33


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def count_words(col: str | Column) -> Column:
    """Number of words of a text as a long; 0 for null."""
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A reproducible number in (0, 1) from the md5 of the columns' text; nulls count as a word."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def fresh(name: str, columns: Sequence[str]) -> str:
    """``name``, lengthened until it is no prefix of a column."""
    while any(c.lower().startswith(name.lower()) for c in columns):
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with two columns that tell its rows apart, and their names: hash of the file and place in it.

    They are the same however often a stored table is read; one that is not read from files is stored first.
    """
    keys = [f"{name}_file", f"{name}_place"]
    place = [F.xxhash64("_metadata.file_path").alias(keys[0]), F.col("_metadata.row_index").alias(keys[1])]
    try:
        return docs.select("*", *place), keys
    except AnalysisException:
        return stage(docs, "keyed").select("*", *place), keys


def _running(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str, how: Callable, merge: Callable) -> DataFrame:
    """``how`` of ``value`` over the earlier rows of the same keys, in and before the row's sort partition."""
    keys = list(keys)
    ranged = df.orderBy(*keys, *order).withColumn("_mid", F.monotonically_increasing_id())
    rows = stage(ranged, "sorted").withColumn("_part", F.shiftright("_mid", _LOCAL_BITS))
    before = W.partitionBy("_part", *keys).orderBy("_mid").rowsBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_in", how(value).over(before))
    parts = rows.groupBy(*keys, "_part").agg(how(value).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("_from", how("_n").over(earlier)).drop("_n")
    parts = parts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"), "_from")
    match = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_part") == F.col("_p")]
    joined = local.join(parts, match, "left")
    return joined.withColumn(out, merge(F.col("_from"), F.col("_in"))).drop(
        "_mid", "_part", "_in", "_from", "_p", *[f"_k_{k}" for k in keys]
    )


def prefix_sum(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same keys, for groups of any size.

    Rows are range-sorted over the cluster, summed inside their sort partition, and shifted by the
    total of the group's earlier partitions (one row per group and partition). ``df`` is read
    twice by the sort, so it should be a stored, narrow table.
    """
    return _running(df, keys, order, value, out, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def prefix_max(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, out: str) -> DataFrame:
    """Largest ``value`` of the earlier rows of the same keys (null: none), as :func:`prefix_sum` does it."""
    return _running(df, keys, order, value, out, F.max, F.greatest)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (``a``, ``b``, both longs): ``node`` and its smallest ``root``.

    Alternates the large star (every larger neighbour of a node moves to the node's smallest
    neighbour) and the small star (likewise for the smaller ones) until a round changes nothing;
    the rounds grow with the logarithm of a component's size. Each round is a written table.
    A node with very many neighbours is aggregated before the shuffle and met by a join that the
    adaptive plan may split.
    """
    now = stage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).withColumnRenamed("a", "u")
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(large.where("a != b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, F.col("a") == F.col("u")).select(
            F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")
        ).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        now = stage(small.where("a != b").distinct(), "small-star")


def whole_groups(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[pa.Table]:
    """Tables of sorted batches cut where ``column`` (a long) changes, so that no group is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(column).to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))
        goes_on = bool(held) and held[-1].column(column)[0].as_py() == keys[0]
        if held and (last or not goes_on):
            done = [*held, batch.slice(0, last)] if last else held
            held = []
            yield pa.Table.from_batches(done)
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
