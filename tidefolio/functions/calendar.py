"""Calendar windows: closed on the right, labelled with the right edge (pure date arithmetic, no session zone)."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

# Unit names accepted in a frequency string, and how each is counted.
MONTHS_PER_UNIT = {"mo": 1, "q": 3, "y": 12}
DAYS_PER_UNIT = {"d": 1, "w": 7}
EPOCH = "1970-01-01"
EPOCH_MONDAY = "1970-01-05"
MICROS_PER_DAY = 86_400_000_000


def parse_every(every: str) -> tuple[int, str]:
    match = re.fullmatch(r"\s*(\d+)\s*(mo|d|w|q|y)\s*", every)
    if not match or int(match.group(1)) < 1:
        raise ValueError(f"frequency {every!r} is not of the form '1d', '1w', '1mo', '3mo', '1q', '1y'")
    return int(match.group(1)), match.group(2)


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def month_number(ts: Column) -> Column:
    return _month_number(F.to_date(ts))


def _window_start(day: Column, every: str) -> Column:
    n, unit = parse_every(every)
    if unit in DAYS_PER_UNIT:
        origin = F.lit(EPOCH_MONDAY if unit == "w" else EPOCH).cast("date")
        width = n * DAYS_PER_UNIT[unit]
        return F.date_add(origin, (F.floor(F.datediff(day, origin) / width) * width).cast("int"))
    width = n * MONTHS_PER_UNIT[unit]
    month = F.floor(_month_number(day) / width) * width
    return F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


def _window_end(start: Column, every: str) -> Column:
    n, unit = parse_every(every)
    if unit in DAYS_PER_UNIT:
        return F.date_add(start, n * DAYS_PER_UNIT[unit])
    return F.add_months(start, n * MONTHS_PER_UNIT[unit])


def bucket_label(ts: Column, every: str) -> Column:
    """Right edge of the window (left, right] that holds ``ts``."""
    just_before = F.to_date(ts - F.expr("INTERVAL 1 MICROSECOND"))
    return _window_end(_window_start(just_before, every), every).cast("timestamp_ntz")


def period_end(ts: Column, every: str) -> Column:
    """Last calendar day of the period that holds ``ts`` (whole days, e.g. the month end)."""
    day = F.to_date(ts)
    return F.date_sub(_window_end(_window_start(day, every), every), 1).cast("timestamp_ntz")


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days between two instants."""
    return F.extract(F.lit("DAY"), later - earlier).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch on the stamp's own clock (the same in every session zone)."""
    second = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    clock = F.hour(ts).cast("bigint") * 3_600_000_000 + F.minute(ts).cast("bigint") * 60_000_000 + second
    return F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date")).cast("bigint") * MICROS_PER_DAY + clock


def arrival_order(ts: Column, seq: Column) -> Column:
    """One number that orders by time and then by ``seq``.

    A decimal keeps hash aggregation (its buffer has a fixed width), where a struct key would force sorting.
    """
    shift = F.lit("18446744073709551616").cast("decimal(20,0)")  # 2^64, above the span of any seq
    return micros(ts).cast("decimal(18,0)") * shift + seq.cast("decimal(20,0)")
