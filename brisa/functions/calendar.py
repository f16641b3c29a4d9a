"""Calendar fields of a UTC timestamp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day names in week order, Monday first.
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def hour_floor(time: Column) -> Column:
    return F.date_trunc("hour", time)


def day_of_week(time: Column) -> Column:
    """Monday is 0 and Sunday is 6."""
    return F.weekday(time)


def weekend_flag(time: Column) -> Column:
    return day_of_week(time).isin(5, 6).cast("int")


def day_name(time: Column) -> Column:
    return F.date_format(time, "EEEE")


def epoch_hour(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / 3600).cast("bigint")


def calendar_fields(time: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(time),
        "day": F.dayofmonth(time),
        "day_of_week": day_of_week(time),
        "month": F.month(time),
        "is_weekend": weekend_flag(time),
    }


def season(month: Column) -> Column:
    """Winter is November to February, summer is June to September."""
    return (
        F.when(month.isin(11, 12, 1, 2), "winter")
        .when(month.isin(6, 7, 8, 9), "summer")
        .otherwise("transition")
    )
