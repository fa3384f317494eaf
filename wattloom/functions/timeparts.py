"""Calendar and clock columns. Stored time is UTC; the local clock is used for features only."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: clock windows, season bounds and severity labels of the feature definitions
WINDOWS = ("night", "morning", "day", "evening")
SEVERITY = ("warm", "mild", "cold", "extreme")
SEASONS = {1: "winter", 2: "spring", 3: "summer", 4: "autumn"}


def to_local(ts: Column, tz: str) -> Column:
    return F.from_utc_timestamp(ts, tz)


def to_utc(ts: Column, tz: str) -> Column:
    """Local clock to UTC; a local time that does not exist, or exists twice, gives NULL."""
    u = F.to_utc_timestamp(ts, tz)
    gone = F.from_utc_timestamp(u, tz) != ts
    h = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(u + h, tz) == ts) | (F.from_utc_timestamp(u - h, tz) == ts)
    return F.when(~gone & ~twice, u)


def clock_window(ts: Column) -> Column:
    h = F.hour(ts)
    return F.when(h < 6, "night").when(h < 10, "morning").when(h < 16, "day").otherwise("evening")


def severity_bin(degree_hours: Column, mild: float = 10.0, cold: float = 25.0) -> Column:
    return (F.when(degree_hours.isNull(), None).when(degree_hours <= 0, "warm").when(degree_hours <= mild, "mild")
            .when(degree_hours <= cold, "cold").otherwise("extreme"))


def hour_group(ts: Column) -> Column:
    """Four groups of six hours."""
    return F.floor(F.hour(ts) / 6).cast("int")


def working_day_flags(day: Column, holiday: Column) -> Column:
    """True on Saturdays, Sundays and holidays."""
    return (F.weekday(day) >= 5) | holiday


def cyclic(x: Column, scale: float, name: str) -> list[Column]:
    a = 2 * F.pi() * x / scale
    return [F.sin(a).alias(f"{name}_sin"), F.cos(a).alias(f"{name}_cos")]


def season(ts: Column) -> Column:
    """1 winter (Dec-Feb) .. 4 autumn."""
    return (F.floor((F.month(ts) % 12) / 3) + 1).cast("int")
