"""Date functions as columns; days are dates, "today" is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days_between(a: Column, b: Column) -> Column:
    """Days from a to b, never below zero."""
    return F.greatest(F.datediff(b, a), F.lit(0))


def week_start(day: Column) -> Column:
    """The Monday on or before a day."""
    return F.date_trunc("WEEK", day).cast("date")


def days_advertised(first_seen: Column, last_seen: Column) -> Column:
    return F.datediff(last_seen, first_seen)


def days_since_posted(posted: Column, last_seen: Column) -> Column:
    """Days from an ISO posting date to the last sighting; null if it isn't one, or lies later."""
    day = F.when(posted.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(posted, 1, 10), "yyyy-MM-dd"))
    return F.when(day <= last_seen, F.datediff(last_seen, day))


_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _month(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(name, 1, 3))).cast("int")


def loose_date(text: Column) -> Column:
    """A date in free text, day first: ISO, d/m/y, "3 March 2026", "Mar 3, 2026"; labels before it are
    ignored; years of two digits turn at 70; years outside 1990-2100 and days that don't exist give null."""
    numbers = r"\b(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})\b"
    day_first = r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9})\.?,?\s+(\d{4})\b"
    month_first = r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b"
    iso = r"\b(\d{4})-(\d{2})-(\d{2})"
    part = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    number = lambda p, i: part(p, i).cast("int")
    short = number(numbers, 3)
    year = F.when(short >= 100, short).when(short < 70, short + 2000).otherwise(short + 1900)

    def made(y: Column, m: Column, d: Column) -> Column:
        fits = (y >= 1990) & (y <= 2100) & (m >= 1) & (m <= 12)
        return F.when(fits, F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))

    return F.coalesce(
        made(number(iso, 1), number(iso, 2), number(iso, 3)),
        made(year, number(numbers, 2), number(numbers, 1)),
        made(number(day_first, 3), _month(part(day_first, 2)), number(day_first, 1)),
        made(number(month_first, 3), _month(part(month_first, 1)), number(month_first, 2)),
    )


def relative_date(text: Column, as_of: Column) -> Column:
    """The day of "Posted 5 Days Ago", "yesterday", "30+ days ago", "today"."""
    low = F.lower(text)
    n = F.nullif(F.regexp_extract(low, r"(\d+)\+?\s*(day|week|month|hour|minute)s?\s+ago", 1), F.lit("")).cast("int")
    unit = F.regexp_extract(low, r"(\d+)\+?\s*(day|week|month|hour|minute)s?\s+ago", 2)
    days = F.when(unit == "day", n).when(unit == "week", 7 * n).when(unit == "month", 30 * n).when(unit.isin("hour", "minute"), 0)
    days = F.coalesce(days, F.when(low.contains("yesterday"), 1), F.when(low.rlike("today|just posted"), 0))
    return F.date_sub(as_of, days)


def stamp_day(text: Column) -> Column:
    """The UTC day of epoch seconds or milliseconds, of /Date(ms)/, or of yyyyMMdd[...]."""
    digits = F.nullif(F.regexp_extract(text, r"^(?:/Date\()?(\d{9,13})(?:[+-]\d{4})?(?:\)/)?$", 1), F.lit("")).cast("long")
    seconds = F.when(digits >= 100_000_000_000, (digits / 1000).cast("long")).otherwise(digits)
    compact = F.when(text.rlike(r"^(19|20)\d{6}(T|$)"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    return F.coalesce(compact, F.to_date(F.timestamp_seconds(seconds)))


def quarter_of(month: Column, end_labelled: bool = False) -> Column:
    """The quarter key of a month: its first month, or its last."""
    start = F.date_trunc("QUARTER", month).cast("date")
    return F.add_months(start, 2) if end_labelled else start


def lag_months(earlier: Column, later: Column) -> Column:
    return F.months_between(later, earlier).cast("int")
