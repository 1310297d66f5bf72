"""Row positions and bounded slices of very long series.

A series may hold a large share of all rows, so nothing here sorts a whole series in one task.
Positions come from two levels (rank inside a day, plus the counts of earlier days: one row per
series and calendar day). Window work then runs on slices of a fixed number of rows, each
carrying as many rows of its neighbours as the windows look back or ahead. Where no series is longer
than one slice, as a count of the rows tells, each series is its own slice: one shuffle by series then does for
positions and windows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BLOCK_ROWS = 4096

# A recursive average started from nothing is off by r**n after n rows. At this many natural
# logarithms (1e-20) the difference is far below the resolution of a double.
_FORGET_LOGS = 46.0
# Largest exponent, in natural logarithms, that scaled sums may use on either side of zero.
_RANGE_LOGS = 600.0


def with_day(df: DataFrame, ts: str = "bar_ts") -> DataFrame:
    return df if "_day" in df.columns else df.withColumn("_day", F.to_date(ts))


def usable(df: DataFrame, *columns: str) -> Column:
    """True where none of the columns (those that exist) is null or NaN."""
    ok = F.lit(True)
    for f in df.schema:
        if f.name in columns:
            ok = ok & F.col(f.name).isNotNull()
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                ok = ok & ~F.isnan(f.name)
    return ok


def index_series(df: DataFrame, key: str = "ticker", ts: str = "bar_ts") -> DataFrame:
    """Add ``series_idx`` (0-based position) and ``series_len`` to each row of a series.

    ``(key, ts)`` must be unique. Rows without key or time stay, with null positions. The input is
    read twice, the first time for two columns only; stage it first if it is expensive to compute.
    """
    if {"series_idx", "series_len"} <= set(df.columns):
        return df.drop("_day")
    lost = df.filter(F.col(key).isNull() | F.col(ts).isNull()).drop("_day")
    placed = _index_placed(df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()), key, ts)
    return placed.unionByName(lost, allowMissingColumns=True)


def _index_placed(df: DataFrame, key: str, ts: str) -> DataFrame:
    df = with_day(df, ts)
    per_day = df.groupBy(key, "_day").agg(F.count(F.lit(1)).alias("_n"))
    days = W.partitionBy(key).orderBy("_day")
    earlier = F.sum("_n").over(days.rowsBetween(W.unboundedPreceding, -1))
    offsets = per_day.select(
        key,
        "_day",
        F.coalesce(earlier, F.lit(0)).alias("_before"),
        F.sum("_n").over(W.partitionBy(key)).alias("series_len"),
    )
    # Hash the small side on both columns, so that the join keeps the (key, day) layout of the
    # rows instead of gathering each series under its key alone.
    offsets = offsets.repartition(key, "_day")
    in_day = W.partitionBy(key, "_day").orderBy(ts)
    ranked = df.withColumn("_seq", F.row_number().over(in_day) - 1)
    return (
        ranked.join(offsets, [key, "_day"])
        .withColumn("series_idx", F.col("_before") + F.col("_seq"))
        .drop("_day", "_seq", "_before")
    )


def positioned(df: DataFrame) -> bool:
    return {"series_idx", "series_len"} <= set(df.columns)


def fits_slice(df: DataFrame, size: int, key: str = "ticker") -> bool:
    """Whether no series of ``df`` has more than ``size`` rows. Counts them, so ``df`` is read for it."""
    longest = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (longest or 0) <= size


def index_whole(df: DataFrame, key: str = "ticker", ts: str = "bar_ts") -> DataFrame:
    """Positions as :func:`index_series` adds them, for short series: each is sorted in one task. Keeps ``_day``.

    Rows without key or time must be set aside. Later windows by series and day find the rows laid out and sorted.
    """
    series = W.partitionBy(key).orderBy("_day", ts)
    everything = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return with_day(df, ts).withColumns({
        "series_idx": F.row_number().over(series).cast("long") - 1,
        "series_len": F.count(F.lit(1)).over(everything),
    })


def forget_rows(alpha: float) -> int:
    """Rows after which the starting value of a recursive average no longer matters."""
    return 1 if alpha >= 1 else math.ceil(_FORGET_LOGS / -math.log1p(-alpha))


def _longest_frame(alpha: float) -> int:
    return 1 << 30 if alpha >= 1 else int(2 * _RANGE_LOGS / -math.log1p(-alpha))


def block_size(alphas: list[float], back: int, lead_in: int = 0) -> int:
    """Slice length for the given smoothing factors: few copied rows, exponents in range."""
    wanted = max(BLOCK_ROWS, 4 * back, back + lead_in + 1)
    return min([wanted, *[_longest_frame(a) - back for a in alphas]])


RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def trailing(rows: int, skip: int = 0) -> str:
    """Frame of ``rows`` rows that ends ``skip`` rows before the current one."""
    end = f"{skip} PRECEDING" if skip else "CURRENT ROW"
    return f"ROWS BETWEEN {rows + skip - 1} PRECEDING AND {end}"


def real(x: float) -> str:
    """A double literal; plain decimals would be read as DECIMAL."""
    return f"double('{x!r}')"


def replace_columns(df: DataFrame, exprs: dict[str, str]) -> DataFrame:
    """Replace or append columns given as SQL expressions, in one projection."""
    kept = [f"{exprs[c]} AS `{c}`" if c in exprs else f"`{c}`" for c in df.columns]
    return df.selectExpr(*kept, *[f"{e} AS `{c}`" for c, e in exprs.items() if c not in df.columns])


class SeriesBlocks:
    """Slices of ``size`` consecutive rows with ``back`` earlier and ``ahead`` later rows.

    Columns are added as SQL expressions. All of them use one partitioning and order (see
    :meth:`over`), so the slices are shuffled and sorted once however many columns there are.
    """

    def __init__(
        self,
        df: DataFrame,
        back: int,
        ahead: int = 0,
        size: int = BLOCK_ROWS,
        key: str = "ticker",
        ts: str = "bar_ts",
        needs: Sequence[str] = (),
        whole: bool = False,
    ):
        """Rows with null or NaN in key, time or ``needs`` take no part: positions, averages and
        frames skip them, and :meth:`own` returns them with nulls in all added columns. ``whole``: positions are
        given by :func:`index_whole` and no series is longer than a slice."""
        if size <= 0 or back < 0 or ahead < 0:
            raise ValueError("block sizes must be positive")
        self.size, self.back, self.ahead, self.key = size, back, ahead, key
        first = f"greatest(series_idx - {ahead}, 0) DIV {size}"
        last = f"least(series_idx + {back}, series_len - 1) DIV {size}"
        self.rest: DataFrame | None = None
        self.order = f"`{key}`, _blk ORDER BY series_idx"
        if positioned(df) and not whole:
            # Positions given by the caller; rows without one were set aside before.
            placed, self.rest = df.drop("_day").filter("series_idx IS NOT NULL"), df.drop("_day").filter("series_idx IS NULL")
        elif not whole:
            good = usable(df, key, ts, *needs)
            self.rest = df.filter(~good).drop("_day")
            df = df.filter(good)
            whole = fits_slice(df, size, key)
            placed = index_whole(df, key, ts) if whole else _index_placed(df, key, ts)
        else:
            placed = df
        if whole:
            self.df = placed.withColumn("_blk", F.lit(0).cast("long"))
            self.order = f"`{key}` ORDER BY _day, `{ts}`"
            return
        # The slices that want a row: its own, and neighbours that look back or ahead to it.
        self.df = placed.selectExpr("*", f"explode(sequence({first}, {last})) AS _blk")

    def over(self, expr: str, frame: str = "") -> str:
        return f"{expr} OVER (PARTITION BY {self.order} {frame})"

    def add(self, **columns: str) -> "SeriesBlocks":
        self.df = self.df.selectExpr("*", *[f"{e} AS `{c}`" for c, e in columns.items()])
        return self

    def own(self, *helpers: str) -> DataFrame:
        """The rows each slice owns, without copies and helper columns, and the rows set aside."""
        rows = self.df.where(f"series_idx DIV {self.size} = _blk").drop("_blk", "_day", *helpers)
        return rows if self.rest is None else rows.unionByName(self.rest, allowMissingColumns=True)

    def smooth(self, x: str, alpha: float, n: int, first: int = 0, seed: str = "sma") -> str:
        """y[t] = alpha*x[t] + (1-alpha)*y[t-1] as one running sum per slice.

        ``x`` must be non-null from position ``first`` on. ``seed='sma'`` starts with the mean of
        the first ``n`` inputs, ``seed='first'`` with the first input; either way the result is
        null before ``n`` inputs were seen. Each input enters with weight r**(middle - position)
        and the sum is scaled back per row, with positions counted from the middle of the slice
        to stay in the range of a double.
        """
        start = first + n - 1
        if alpha >= 1:
            return f"CASE WHEN series_idx >= {start} THEN {x} END"
        if self.size < self.back + start + 1:
            raise ValueError("block too short for the start of the recurrence")
        if self.back < forget_rows(alpha):
            raise ValueError("block copies too few earlier rows for this smoothing factor")
        if self.size + self.back > _longest_frame(alpha):
            raise ValueError("block too long for this smoothing factor")
        middle = f"(_blk * {self.size} + {(self.size - self.back) // 2})"
        if seed == "sma":
            enters_at, early, share = f"greatest(series_idx, {start})", start, 1.0 / n
        else:
            enters_at, early, share = "series_idx", first, 1.0
        weight = f"CASE WHEN series_idx <= {early} THEN {real(share)} ELSE {real(alpha)} END"
        keep = real(1.0 - alpha)
        term = f"CASE WHEN series_idx >= {first} THEN {weight} * ({x}) * pow({keep}, {middle} - {enters_at}) END"
        level = self.over(f"sum({term})", RUNNING)
        return f"CASE WHEN series_idx >= {start} THEN {level} * pow({keep}, series_idx - {middle}) END"

    def running_pair(self, x: str, name: str) -> dict[str, str]:
        """Running sum and count of ``x`` in the slice, for :meth:`mean_from_pair`."""
        return {
            f"_{name}_s": f"coalesce({self.over(f'sum({x})', RUNNING)}, 0)",
            f"_{name}_c": self.over(f"count({x})", RUNNING),
        }

    def mean_from_pair(self, name: str, rows: int, skip: int = 0) -> str:
        """Mean over ``rows`` rows ending ``skip`` rows ago, from the running sum and count.

        Costs the same for any frame length, where a sliding frame adds up every row again.
        """
        def cut(col: str) -> str:
            new = self.over(f"lag({col}, {skip})") if skip else col
            return f"(coalesce({new}, 0) - coalesce({self.over(f'lag({col}, {skip + rows})')}, 0))"

        return f"try_divide({cut(f'_{name}_s')}, {cut(f'_{name}_c')})"
