"""Weekday masks, local clock minutes and distances as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weekday letter -> bit.
DAY_BITS = {"M": 1, "T": 2, "W": 4, "R": 8, "F": 16, "S": 32, "U": 64}

CLOCK_ZONE = "America/Chicago"
EARTH_RADIUS_METRES = 6371000
FAR_AWAY = 2147483647


def days_mask(days: Column) -> Column:
    """OR of the weekday bits named in the text; NULL when there is none."""
    text = F.upper(days)
    bits = [F.when(text.contains(letter), bit).otherwise(0) for letter, bit in DAY_BITS.items()]
    return F.nullif(reduce(lambda a, b: a.bitwiseOR(b), bits), F.lit(0))


def mask_size(mask: Column) -> Column:
    return F.bit_count(F.coalesce(mask, F.lit(0)))


def mask_bits(mask: Column) -> Column:
    """Array of the single-day bits set in a mask (empty for NULL)."""
    week = F.array(*[F.lit(bit) for bit in DAY_BITS.values()])
    return F.filter(week, lambda bit: F.coalesce(mask, F.lit(0)).bitwiseAND(bit) != 0)


def day_letters(days: Column) -> Column:
    """Distinct weekday letters in order of first appearance."""
    known = F.array(*[F.lit(letter) for letter in DAY_BITS])
    letters = F.split(F.upper(F.coalesce(days, F.lit(""))), "")
    return F.array_distinct(F.filter(letters, lambda x: F.array_contains(known, x)))


def _local_clock(epoch_ms: Column, zone: str) -> Column:
    # Built from the epoch without touching the session time zone.
    utc = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")) + F.make_dt_interval(
        secs=(epoch_ms / 1000).cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def local_minute(epoch_ms: Column, zone: str = CLOCK_ZONE) -> Column:
    """Minute of the local day for an epoch-millisecond clock value (midnight is 0)."""
    # The local clock as if it were UTC, so the session time zone has no part in it.
    clock = F.from_utc_timestamp(F.timestamp_millis(epoch_ms.cast("bigint")), zone)
    return F.pmod(F.floor(F.unix_millis(clock) / 60000), F.lit(1440)).cast("int")


def local_minute_or_pass(value: Column, zone: str = CLOCK_ZONE) -> Column:
    """Values already in 0..1440 are minutes; anything else is epoch milliseconds."""
    return F.when(value.between(0, 1440), value.cast("int")).otherwise(local_minute(value, zone))


def local_month_day(epoch_ms: Column, zone: str = CLOCK_ZONE) -> Column:
    return F.date_format(_local_clock(epoch_ms, zone), "MMM d")


def clock_text_to_minutes(text: Column) -> Column:
    """``HH:MM`` to minutes; anything malformed or out of range is NULL."""
    hour = F.regexp_extract(text, r"^(\d{2}):(\d{2})$", 1).try_cast("int")
    minute = F.regexp_extract(text, r"^(\d{2}):(\d{2})$", 2).try_cast("int")
    return F.when((hour <= 23) & (minute <= 59), hour * 60 + minute)


def duration(start: Column, end: Column) -> Column:
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(end - start, F.lit(0)))


def minutes_text(minutes: Column) -> Column:
    """``h:mm AM/PM`` of a minute count, modulo one day."""
    m = F.pmod(minutes, F.lit(1440))
    hour24 = F.floor(m / 60).cast("int")
    hour12 = F.when(hour24 % 12 == 0, 12).otherwise(hour24 % 12)
    suffix = F.when(hour24 >= 12, "PM").otherwise("AM")
    return F.when(
        minutes.isNotNull(),
        F.concat(hour12.cast("string"), F.lit(":"), F.lpad((m % 60).cast("string"), 2, "0"), F.lit(" "), suffix),
    )


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance rounded half up; NULL when a coordinate is missing."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.floor(F.lit(EARTH_RADIUS_METRES) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)) + 0.5).cast("bigint")


def dates_touch(s1: Column, e1: Column, x1: Column, s2: Column, e2: Column, x2: Column) -> Column:
    """Whether two date ranges share a day (open start = -inf, open end falls back to the exam date)."""
    end1, end2 = F.coalesce(e1, x1), F.coalesce(e2, x2)
    return (s1.isNull() | end2.isNull() | (s1 <= end2)) & (s2.isNull() | end1.isNull() | (s2 <= end1))
