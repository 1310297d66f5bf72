"""Exchange calendar predicates. Timestamps hold IST wall-clock time."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

MARKET_ZONE = "Asia/Kolkata"

# Session limits, HH:mm.
PREMARKET_FROM = "09:15"
SESSION_FROM = "09:25"
SESSION_TO = "15:15"
FRIDAY_TO = "15:00"
POSTMARKET_FROM = "15:30"

# National holidays with a fixed date, month and day. Movable feasts differ by
# year and are passed in by the caller.
NATIONAL_HOLIDAYS = ((1, 26), (8, 15), (10, 2), (12, 25))


def is_national_holiday(ts: Column) -> Column:
    """One of the fixed dates, in any year."""
    return F.date_format(ts, "MM-dd").isin([f"{m:02d}-{d:02d}" for m, d in NATIONAL_HOLIDAYS])


def with_closed(df: DataFrame, holidays: DataFrame, ts: str = "bar_ts", out: str = "closed") -> DataFrame:
    """Flag ``out``: a fixed national holiday or a date of the table ``holidays`` (column ``date``).

    The table holds the movable feasts; pass ``F.col(out)`` to the predicates below.
    """
    dates = holidays.select(F.col("date").alias("_closed")).where("_closed IS NOT NULL").distinct()
    joined = df.join(dates, F.to_date(ts) == F.col("_closed"), "left")
    flag = F.coalesce(F.col("_closed").isNotNull() | is_national_holiday(F.col(ts)), F.lit(False))
    return joined.withColumn(out, flag).drop("_closed")


def to_ist(ts: Column) -> Column:
    """Wall-clock time at the exchange of an instant held in UTC (zone-aware input only)."""
    return F.from_utc_timestamp(ts, MARKET_ZONE)


def hhmm(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


Holidays = Iterable[dt.date] | Column | None


def is_trading_day(ts: Column, holidays: Holidays = None) -> Column:
    """Monday to Friday and not a holiday.

    Holidays are the fixed dates of every year unless given: as a short list of dates, or as a flag
    column (see :func:`with_closed`).
    """
    weekday = F.weekday(ts) < 5
    if holidays is None:
        return weekday & ~is_national_holiday(ts)
    if isinstance(holidays, Column):
        return weekday & ~holidays
    closed = list(holidays)
    return weekday & ~F.to_date(ts).isin(closed) if closed else weekday


def trading_days(df: DataFrame, holidays: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """Rows on trading days, with the holidays given as a table with one column ``date``.

    The optimizer broadcasts the table when its size is known to be small.
    """
    working = df.filter(F.weekday(ts) < 5)
    closed = holidays.select(F.col("date").alias("_closed")).distinct()
    return working.join(closed, F.to_date(ts) == F.col("_closed"), "left_anti")


def within_trading_hours(ts: Column, holidays: Holidays = None) -> Column:
    close = F.when(F.weekday(ts) == 4, FRIDAY_TO).otherwise(SESSION_TO)
    at = hhmm(ts)
    return is_trading_day(ts, holidays) & (at >= SESSION_FROM) & (at < close)


def is_premarket(ts: Column, holidays: Holidays = None) -> Column:
    at = hhmm(ts)
    return is_trading_day(ts, holidays) & (at >= PREMARKET_FROM) & (at < SESSION_FROM)


def is_postmarket(ts: Column, holidays: Holidays = None) -> Column:
    return is_trading_day(ts, holidays) & (hhmm(ts) >= POSTMARKET_FROM)
