"""Returns, direction labels and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickloom.schema import DIRECTIONS, SIDEWAYS_THRESHOLD_PCT


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_ticker(ticker: Column | str) -> Column:
    """Symbol without its exchange prefix (``NSE:X`` becomes ``X``)."""
    return F.regexp_replace(_col(ticker), "NSE:", "")


def return_pct(entry: Column | str, price: Column | str) -> Column:
    entry, price = _col(entry), _col(price)
    return F.when(entry > 0, (price - entry) / entry * 100).otherwise(F.lit(0.0))


def direction_label(ret: Column | str, thr: float = SIDEWAYS_THRESHOLD_PCT) -> Column:
    ret = _col(ret)
    up, down, flat = DIRECTIONS
    return F.when(ret.isNull(), F.lit(None)).when(ret > thr, up).when(ret < -thr, down).otherwise(flat)


def hit(predicted: Column | str, actual: Column | str) -> Column:
    """Whether the predicted direction came true; a missing prediction is a miss."""
    actual = _col(actual)
    return F.when(actual.isNotNull(), F.coalesce(_col(predicted) == actual, F.lit(False)))


def reward(hit_flag: Column | str) -> Column:
    return _col(hit_flag).cast("double")


def sign_agree(a: Column | str, b: Column | str) -> Column:
    """Same sign of both numbers; zero agrees only with zero."""
    return F.signum(_col(a)) == F.signum(_col(b))


def bar_change_columns() -> dict[str, Column]:
    """Change over a bar, and its share of the *closing* price."""
    change = F.col("close") - F.col("open")
    return {"change": change, "change_pct": F.try_divide(change, F.col("close")) * 100}


def bar_side() -> Column:
    return F.when(F.col("close") >= F.col("open"), F.lit("up")).otherwise(F.lit("down"))


def resolved() -> Column:
    return F.col("actual_direction").isNotNull()


def pending() -> Column:
    return F.col("actual_direction").isNull()


def elapsed_s(since: Column | str, until: Column | str) -> Column:
    """Seconds between two instants, with fractions."""
    return (F.unix_micros(_col(until)) - F.unix_micros(_col(since))) / F.lit(1e6)


def round_n(x: Column | str, n: int) -> Column:
    return F.round(_col(x), n)
