"""Calendar columns of a timestamp as plain column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlog.functions.seq import SeqSpec, attach, seconds, sequence_stats


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "day_of_month": F.dayofmonth(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "week_of_year": F.weekofyear(ts),
    }


def weekend_business_flags(ts: Column) -> dict[str, Column]:
    hour = F.hour(ts)
    return {
        "is_weekend": (F.weekday(ts) >= 5).cast("int"),
        "is_business_hour": ((hour >= 9) & (hour <= 17)).cast("int"),
    }


def time_of_day(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when(hour <= 6, "night").when(hour <= 12, "morning").when(hour <= 18, "afternoon").otherwise("evening")
    )


def cyclical(ts: Column) -> dict[str, Column]:
    turn = 2 * math.pi
    parts = {"hour": (F.hour(ts), 24), "day": (F.weekday(ts), 7), "month": (F.month(ts), 12)}
    out = {}
    for name, (value, period) in parts.items():
        angle = value * F.lit(turn) / F.lit(float(period))
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def temporal_context(ts: Column, now: Column) -> dict[str, Column]:
    """Seconds since midnight, Monday and the first of the month (all truncated), and age at ``now``."""
    return {
        "time_since_midnight": seconds(ts, F.date_trunc("day", ts)),
        "time_since_week_start": seconds(ts, F.date_trunc("week", ts)),
        "time_since_month_start": seconds(ts, F.date_trunc("month", ts)),
        "event_age": seconds(now, ts),
    }


def normalize_timestamps(df: DataFrame, spec: SeqSpec, fmt: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Formatted timestamp, time since the first event of the sequence, and position in day and year."""
    ts = F.col(spec.ts)
    first = sequence_stats(df, spec, F.min(ts).alias("_t0"))
    out = attach(df, first, spec)
    since = seconds(ts, F.col("_t0"))
    return out.withColumns(
        {
            "timestamp_normalized": F.date_format(ts, fmt),
            "seconds_since_first": since,
            "minutes_since_first": since / 60,
            "hours_since_first": since / 3600,
            "seconds_of_day": F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts),
            "day_of_year": F.dayofyear(ts),
        }
    ).drop("_t0")
