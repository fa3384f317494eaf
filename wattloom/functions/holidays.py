"""Public holidays by rule: fixed dates plus offsets from Easter Sunday, as column expressions."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: month-day dates and days after Easter per calendar
FIXED = {"CH-ZH": ("01-01", "05-01", "08-01", "12-25", "12-26"), "CH-ZH+2": ("01-01", "01-02", "05-01", "08-01", "12-25", "12-26"),
         "GB-ENG": ("01-01", "12-25", "12-26")}
EASTER = {"CH-ZH": (-2, 1, 39, 50), "CH-ZH+2": (-2, 1, 39, 50), "GB-ENG": (-2, 1)}


# fixed values: one-off bank holidays of the British calendar, and Mondays that were moved away
GB_EXTRA = ("2011-04-29", "2012-06-04", "2012-06-05", "2020-05-08", "2022-06-02", "2022-06-03", "2022-09-19", "2023-05-08")
GB_MOVED = ("2012-05-28", "2020-05-04", "2022-05-30")


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter (Butcher's rule)."""
    y = year.cast("int")
    d = lambda a, b: F.floor(a / b).cast("int")
    a, b, c = y % 19, d(y, 100), y % 100
    h = (19 * a + b - d(b, 4) - d(b - d(b + 8, 25) + 1, 3) + 15) % 30
    l = (32 + 2 * (b % 4) + 2 * d(c, 4) - h - c % 4) % 7
    m = d(a + 11 * h + 22 * l, 451)
    n = h + l - 7 * m + 114
    return F.make_date(y, d(n, 31), (n % 31 + 1).cast("int"))


def is_holiday(day: Column, calendar: str = "CH-ZH") -> Column:
    off = F.datediff(day, easter_sunday(F.year(day)))
    hit = F.date_format(day, "MM-dd").isin(*FIXED[calendar]) | off.isin(*EASTER[calendar])
    if calendar == "GB-ENG":      # Monday holidays, substitutes of weekend holidays, one-off days
        dom, mo, wd, iso = F.dayofmonth(day), F.month(day), F.weekday(day), F.date_format(day, "yyyy-MM-dd")
        monday = (wd == 0) & (((mo == 5) & ((dom <= 7) | (dom >= 25))) | ((mo == 8) & (dom >= 25)) | ((mo == 1) & dom.isin(2, 3)))
        hit = ((hit | monday | ((mo == 12) & dom.isin(27, 28) & wd.isin(0, 1))) & ~iso.isin(*GB_MOVED)) | iso.isin(*GB_EXTRA)
    return hit


def weekend_or_holiday(day: Column, calendar: str = "CH-ZH") -> Column:
    return (F.weekday(day) >= 5) | is_holiday(day, calendar)
