"""Tri-state seat flags and the labels shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def positive_flag(count: Column) -> Column:
    """1 / 0, NULL staying unknown."""
    return F.when(count.isNotNull(), (count > 0).cast("int"))


def full_flag(open_seats: Column) -> Column:
    return F.when(open_seats.isNotNull(), (open_seats <= 0).cast("int"))


def truthy_flag(value: Column) -> Column:
    return F.coalesce(value.cast("boolean").cast("int"), F.lit(0))


def seat_state(has_open: Column, has_waitlist: Column, is_full: Column) -> Column:
    return F.when(has_open == 1, "Open").when(has_waitlist == 1, "Waitlist").when(is_full == 1, "Full").otherwise("Unknown")


def course_seat_text(any_open: Column, any_full: Column) -> Column:
    return (
        F.when(any_open == 1, "Open seats available")
        .when(any_full == 1, "Some sections are full")
        .otherwise("Seat status unavailable")
    )


def bundle_seat_text(is_full: Column, open_seats: Column) -> Column:
    return (
        F.when(is_full == 1, "Full")
        .when(open_seats.isNotNull(), F.concat(open_seats.cast("string"), F.lit(" open seats")))
        .otherwise("Seat availability unavailable")
    )


def _plain_number(x: Column) -> Column:
    # 3.0 is shown as 3, 1.5 as 1.5
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def credit_text(minimum: Column, maximum: Column) -> Column:
    low, high = _plain_number(minimum), _plain_number(maximum)
    return (
        F.when(minimum.isNull() | maximum.isNull(), "Credits unavailable")
        .when(minimum == maximum, F.concat(low, F.lit(" credits")))
        .otherwise(F.concat(low, F.lit("-"), high, F.lit(" credits")))
    )


def online_mode(mode: Column) -> Column:
    return F.coalesce(mode.rlike("(?i)online|asynchronous|distance"), F.lit(False)).cast("int")


# Fixed value: wording that announces a restriction which will be lifted.
TEMPORARY_RESTRICTION = (
    r"(?i)restriction(?:s)?[^.\n]*(?:will be|to be)?\s*(?:removed|lifted)"
    r"|(?:removed|lifted)[^.\n]*restriction(?:s)?"
    r"|\bon\s+[A-Z][a-z]+\s+\d{1,2}[^.\n]*(?:removed|lifted|open to all)"
)


def temporary_restriction(note: Column) -> Column:
    return F.coalesce(note.rlike(TEMPORARY_RESTRICTION), F.lit(False)).cast("int")


def age_text(seconds: Column) -> Column:
    """Age bucket of the last refresh."""
    s = F.greatest(F.floor(seconds), F.lit(0))
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)

    def ago(n: Column, unit: str) -> Column:
        noun = F.when(n == 1, unit).otherwise(unit + "s")
        return F.concat(F.lit("Updated "), n.cast("string"), F.lit(" "), noun, F.lit(" ago"))

    return (
        F.when(s < 60, "Updated just now")
        .when(minutes < 60, ago(minutes, "minute"))
        .when(hours < 24, ago(hours, "hour"))
        .otherwise(ago(days, "day"))
    )


def parse_confidence(status: Column) -> Column:
    return F.when(status == "parsed", 1.0).when(status == "partial", 0.5).otherwise(0.0)
