"""Calendar and clock columns. The clock is always an argument, so a run can be repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jalali(day: Column) -> Column:
    """struct<year, month, day> of the solar Hijri calendar, in the form where 8 of 33 years are leap years.

    With days counted so that year y begins on day floor(((33 * 365 + 8) y + 21) / 33) of the count, the year of day n is the
    largest y whose beginning is not after n, which is floor((33 n + 11) / (33 * 365 + 8)). Months begin at fixed days of a year:
    six of 31 days, then 30 each.
    """
    begins = lambda y: F.floor(((33 * 365 + 8) * y + 21) / 33)
    known = (33 * 365 + 8) * 1400 + 21
    n = F.datediff(day, F.lit("2021-03-21").cast("date")) + known // 33  # the first day of 1400
    year = F.floor((33 * n + 11) / (33 * 365 + 8))
    inside = n - begins(year)
    starts = [31 * m for m in range(7)] + [186 + 30 * m for m in range(1, 6)]
    started = F.filter(F.array(*[F.lit(s).cast("long") for s in starts]), lambda s: s <= inside)
    return F.struct(year.cast("int").alias("year"), F.size(started).alias("month"), (inside - F.array_max(started) + 1).cast("int").alias("day"))


# Month names of the solar Hijri calendar.
MONTHS = ["فروردین", "اردیبهشت", "خرداد", "تیر", "مرداد", "شهریور", "مهر", "آبان", "آذر", "دی", "بهمن", "اسفند"]


def says_today(label: Column, today: Column) -> Column:
    """Whether a text like '۱۲ مهر ۱۴۰۳' names the given day."""
    from newsloom.functions.text import western_digits

    text = western_digits(label)
    months = F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(i))])
    names = "|".join(MONTHS)
    found = lambda k: F.regexp_extract(text, rf"([0-9]{{1,2}})\s+({names})\s+([0-9]{{4}})", k)
    j = jalali(today)
    same = (found(1).try_cast("int") == j.day) & (F.element_at(months, found(2)) == j.month) & (found(3).try_cast("int") == j.year)
    return F.coalesce(same, F.lit(False))


def age_seconds(at: Column, asof: Column) -> Column:
    return F.unix_timestamp(asof) - F.unix_timestamp(at)


def local_day(at: Column, zone: str = "Asia/Tehran") -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def local_time(at: Column, zone: str = "Asia/Tehran") -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "HH:mm")


def parsed_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
