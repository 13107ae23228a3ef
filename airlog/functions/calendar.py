"""Calendar tests and dates: weekdays, day parts, holidays, ranges and broadcast weeks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from airlog.functions.values import col

# Names used by rules, in calendar order.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# The broadcast day starts at 06:00.
BROADCAST_START = 6
# Default day parts as hours of the day.
DAY_PARTS: dict[str, Sequence[int]] = {
    "morning": range(6, 10),
    "daytime": range(10, 18),
    "prime": range(18, 23),
    "late": (23, 0, 1, 2),
    "overnight": range(2, 6),
}

_MONTH_NAMES = "|".join(MONTHS)
RANGE_PATTERN = rf"(?i)^ *({_MONTH_NAMES}) *([0-3]?[0-9]) *-? *({_MONTH_NAMES}) *([0-3]?[0-9]) *$"
_FIXED_HOLIDAY = re.compile(rf"^ *({_MONTH_NAMES}) *([0-3]?[0-9])$", re.IGNORECASE)
_NTH_HOLIDAY = re.compile(rf"^(1st|2nd|3rd|4th|last) ({'|'.join(DAYS)}) ({_MONTH_NAMES})$", re.IGNORECASE)


def _numbers(names: Sequence[str], first: int) -> Column:
    return F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n.lower()), F.lit(i + first))])


def month_number(name: Column | str) -> Column:
    """1..12 for an English month name in any case; null otherwise."""
    return F.try_element_at(_numbers(MONTHS, 1), F.lower(col(name)))


def weekday_number(name: Column | str) -> Column:
    """0 for monday .. 6 for sunday, by lower-cased name; null otherwise."""
    return F.try_element_at(_numbers(DAYS, 0), F.lower(col(name)))


def weekday_name(ts: Column | str) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAYS]), F.weekday(col(ts)) + 1)


def on_weekday(ts: Column | str, name: Column | str) -> Column:
    return F.weekday(col(ts)) == weekday_number(F.lit(name) if isinstance(name, str) else name)


def on_month(ts: Column | str, name: Column | str) -> Column:
    return F.month(col(ts)) == month_number(F.lit(name) if isinstance(name, str) else name)


def on_quarter(ts: Column | str, quarter: Column | str) -> Column:
    """Quarter given as q1..q4 in either case."""
    return F.quarter(col(ts)) == quarter_of(F.lit(quarter) if isinstance(quarter, str) else quarter)


def quarter_of(text: Column) -> Column:
    return F.regexp_extract(text, r"^[qQ]([1-4])$", 1).try_cast("int")


def week_of(text: Column) -> Column:
    """Week number of '20' or 'week number 20'; null when out of range."""
    digits = F.regexp_extract(F.trim(text), r"(?i)^(?:week number )?([1-9]|[1-4][0-9]|5[0-3])$", 1)
    return digits.try_cast("int")


def on_week(ts: Column | str, week: Column | str | int) -> Column:
    """ISO week of the year."""
    wanted = week if isinstance(week, Column) else F.lit(str(week))
    return F.weekofyear(col(ts)) == week_of(wanted)


def day_part_hours(parts: Mapping[str, tuple[int, int]]) -> dict[str, list[int]]:
    """Hours of (start, end) day parts: the end is left out, but kept when the part wraps midnight."""
    return {
        name: list(range(start, end)) if end > start else list(range(start, 24)) + list(range(0, end + 1))
        for name, (start, end) in parts.items()
    }


def in_day_part(ts: Column | str, part: Column | str, parts: Mapping[str, Sequence[int]] = DAY_PARTS) -> Column:
    hours = hours_of(F.lit(part) if isinstance(part, str) else part, parts)
    return F.coalesce(F.array_contains(hours, F.hour(col(ts))), F.lit(False))


def hours_of(part: Column, parts: Mapping[str, Sequence[int]] = DAY_PARTS) -> Column:
    """Hours of a named day part; null for a name that is not known."""
    table = F.create_map(*[x for name, hours in parts.items()
                           for x in (F.lit(name), F.array(*[F.lit(int(h)) for h in hours]))])
    return F.try_element_at(table, part)


def nth_weekday(year: Column, month: int, weekday: int, n: int) -> Column:
    """Date of the n-th weekday of a month; n = -1 is the last one."""
    first = F.make_date(year, F.lit(month), F.lit(1))
    if n < 0:
        final = F.last_day(first)
        return F.date_sub(final, F.pmod(F.weekday(final) - F.lit(weekday), F.lit(7)))
    return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + F.lit((n - 1) * 7))


def holiday_date(year: Column | str, rule: str) -> Column:
    """Date in a year of 'December 25', '4th thursday november' or 'last monday may'."""
    y = col(year)
    fixed, nth = _FIXED_HOLIDAY.match(rule), _NTH_HOLIDAY.match(rule)
    if fixed:
        return _try_date(y, F.lit(MONTHS.index(fixed[1].capitalize()) + 1), F.lit(int(fixed[2])))
    if not nth:
        raise ValueError(f"holiday rule not valid: {rule!r}")
    n = int(nth[1][0]) if nth[1][0].isdigit() else -1
    return nth_weekday(y, MONTHS.index(nth[3].capitalize()) + 1, DAYS.index(nth[2].lower()), n)


def _try_date(year: Column, month: Column, day: Column) -> Column:
    """make_date that gives null for a day the month does not have."""
    first = F.make_date(year, month, F.lit(1))
    return F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def on_holiday(ts: Column | str, name: Column | str, holidays: Mapping[str, str]) -> Column:
    """Whether a time falls on a named holiday; names are matched exactly."""
    when, wanted = col(ts), F.lit(name) if isinstance(name, str) else name
    test = F.lit(False)
    for known, rule in holidays.items():
        test = F.when(wanted == known, F.to_date(when) == holiday_date(F.year(when), rule)).otherwise(test)
    return F.coalesce(test, F.lit(False))


# Days of each month in a year that is not a leap year.
_MONTH_LENGTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def _month_day(month: Column, day: Column) -> Column:
    """month * 100 + day, null for a day the month never has. 29 February is no valid rule date."""
    lengths = F.array(*[F.lit(n) for n in _MONTH_LENGTHS])
    return F.when((day >= 1) & (day <= F.get(lengths, month - 1)), month * 100 + day)


def range_bounds(text: Column | str) -> Column:
    """Struct (lo, hi) as month * 100 + day of 'December 1 - December 25'; null when not a valid range."""
    t = F.lit(text) if isinstance(text, str) else text

    def part(i: int) -> Column:
        return F.regexp_extract(t, RANGE_PATTERN, i)

    lo = _month_day(month_number(part(1)), part(2).try_cast("int"))
    hi = _month_day(month_number(part(3)), part(4).try_cast("int"))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def in_month_day_range(ts: Column | str, text: Column | str, inclusive: bool = False) -> Column:
    """Whether a time is within a month-day range, which may wrap the year.

    By default the range ends at midnight at the start of its last day, so most of that day is
    outside. inclusive=True compares calendar days and keeps the whole last day.
    """
    return in_range_bounds(ts, range_bounds(text), inclusive)


def in_range_bounds(ts: Column | str, bounds: Column, inclusive: bool = False) -> Column:
    """in_month_day_range with the range parsed already."""
    when, first, last = col(ts), bounds["lo"], bounds["hi"]
    today = F.month(when) * 100 + F.dayofmonth(when)
    after = today >= first
    if inclusive:
        before = today <= last
    else:
        at_midnight = when.cast("timestamp_ntz") == F.date_trunc("day", when).cast("timestamp_ntz")
        before = (today < last) | ((today == last) & at_midnight)
    return F.coalesce(F.when(first <= last, after & before).otherwise(after | before), F.lit(False))


def key_bounds(key: Column) -> Column:
    """Struct (lo, hi) of a calendar key, 'April 23' or 'December 24 - January 2'; null when invalid."""
    pattern = rf"(?i)^\s*({_MONTH_NAMES})\s+([0-9]{{1,2}})\s*$"
    sides = F.split(key, " - ")

    def value(i: int) -> Column:
        side = F.get(sides, F.lit(i))
        month = month_number(F.regexp_extract(side, pattern, 1))
        return _month_day(month, F.regexp_extract(side, pattern, 2).try_cast("int"))

    lo = value(0)
    hi = F.when(F.size(sides) == 1, lo).when(F.size(sides) == 2, value(1))
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def in_key_bounds(ts: Column | str, bounds: Column) -> Column:
    """Whether a day lies in calendar-key bounds, both ends included; a range may wrap the year."""
    when = col(ts)
    today = F.month(when) * 100 + F.dayofmonth(when)
    after, before = today >= bounds["lo"], today <= bounds["hi"]
    return F.coalesce(F.when(bounds["lo"] <= bounds["hi"], after & before).otherwise(after | before), F.lit(False))


def days_in_bounds(bounds: Column, first: Column, last: Column) -> Column:
    """The days from first to last that lie in calendar-key bounds, made from the bounds of each year; null bounds give none."""
    def day(year: Column, at: Column, last_of_month: bool) -> Column:
        month = F.make_date(year, F.floor(at / 100).cast("int"), F.lit(1))
        found = F.date_add(month, (at % 100 - 1).cast("int"))
        # 29 February of a plain year: a range begins on the day after it, or ends on the day before
        return F.least(found, F.last_day(month)) if last_of_month else found

    wraps = (bounds["lo"] > bounds["hi"]).cast("int")
    spans = F.transform(F.sequence(F.year(first) - 1, F.year(last)), lambda y: F.struct(
        F.greatest(day(y, bounds["lo"], False), first).alias("lo"), F.least(day(y + wraps, bounds["hi"], True), last).alias("hi")))
    inside = F.filter(spans, lambda s: s["lo"] <= s["hi"])
    return F.when(bounds.isNotNull(), F.flatten(F.transform(inside, lambda s: F.sequence(s["lo"], s["hi"]))))


def matches_date_key(ts: Column | str, key: Column) -> Column:
    return in_key_bounds(ts, key_bounds(key))


def broadcast_week(day: Column | str) -> Column:
    """Struct of the bounds of the broadcast week of a date: Monday 06:00, seven days."""
    start = F.date_trunc("week", col(day)).cast("timestamp_ntz") + F.expr(f"INTERVAL {BROADCAST_START} HOURS")
    return F.struct(start.alias("week_start"), (start + F.expr("INTERVAL 7 DAYS")).alias("week_end"))


def next_week(ts: Column | str) -> Column:
    """06:00 on the Monday after a time."""
    monday = F.date_trunc("week", col(ts)).cast("timestamp_ntz")
    return monday + F.expr(f"INTERVAL '7 {BROADCAST_START:02d}' DAY TO HOUR")


def next_month(ts: Column | str) -> Column:
    """06:00 on the first day of the next month."""
    first = F.date_add(F.last_day(col(ts)), 1).cast("timestamp_ntz")
    return first + F.expr(f"INTERVAL {BROADCAST_START} HOURS")


def tag_of_hour(tags: Column | str, ts: Column | str) -> Column:
    """The tag of the hour's segment: the hour is split evenly over the list."""
    t = col(tags)
    n = F.size(t)
    width = F.nullif(F.floor(F.lit(60) / F.nullif(n, F.lit(0))), F.lit(0))
    at = F.least(F.floor(F.minute(col(ts)) / width), n - 1)
    return F.get(t, at.cast("int"))
