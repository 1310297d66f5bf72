"""Keep the first rows of each class in a fixed random order, for classes of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickloom.plans.ranking import number_rows


def hash_key(id_col: str, seed: int) -> Column:
    """Repeatable pseudo-random order: the md5 text of id and seed."""
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.lit(str(seed))))


def keep_quota(df: DataFrame, group: str, id_col: str, seed: int, quotas: DataFrame) -> DataFrame:
    """The ``quota`` rows of each ``group`` with the lowest hash.

    ``quotas`` has one row (``group``, ``quota``) per class. The first pass sorts narrow rows (class,
    hash, id) over the cluster and finds where each quota ends; the second keeps the rows up to
    there. A class of any size is cut exactly and never sorted in one task.
    """
    narrow = df.select(F.col(group).alias("_c"), hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_i"))
    wanted = quotas.filter(F.col("quota") > 0).select(F.col(group).alias("_g"), "quota")
    ranked = number_rows(narrow, ["_c"], ["_h", "_i"], out="_r").join(wanted, F.col("_c") == F.col("_g"))
    taken = ranked.filter(F.col("_r") < F.col("quota")).groupBy("_c", "_h", "_i").agg(F.count(F.lit(1)).alias("_n"))
    cut = taken.groupBy("_c").agg(F.max(F.struct("_h", "_i", "_n")).alias("_last"))
    rows = df.withColumn("_h", hash_key(id_col, seed)).join(cut, F.col(group) == F.col("_c"))
    return _up_to(rows, id_col, [group]).drop("_c")


def keep_first(df: DataFrame, id_col: str, seed: int, quota: Column) -> DataFrame:
    """The ``quota`` rows (a scalar) with the lowest hash, as :func:`keep_quota` does for a single class."""
    narrow = df.select(hash_key(id_col, seed).alias("_h"), F.col(id_col).alias("_i"))
    ranked = number_rows(narrow, [], ["_h", "_i"], out="_r").filter(F.col("_r") < quota)
    taken = ranked.groupBy("_h", "_i").agg(F.count(F.lit(1)).alias("_n"))
    last = taken.agg(F.max(F.struct("_h", "_i", "_n")).alias("_last")).scalar()
    return _up_to(df.withColumns({"_h": hash_key(id_col, seed), "_last": last}), id_col, [])


def _up_to(rows: DataFrame, id_col: str, keys: list[str]) -> DataFrame:
    """Rows before the last hash and id, and as many copies of the last id as ``_last`` has left room for."""
    at, last = F.struct("_h", F.col(id_col).alias("_i")), F.struct("_last._h", "_last._i")
    nth = F.row_number().over(W.partitionBy(*keys, "_h", id_col).orderBy(F.lit(0)))
    copies = rows.filter(at == last).withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_last._n")).drop("_nth")
    return rows.filter(at < last).unionByName(copies).drop("_h", "_last")
