"""Rounding and number formatting that give one result on every engine."""

from pyspark.sql import Column, functions as F

# Holds the digits of a double of 16 digits before the point, so it is rounded once only.
EXACT = "decimal(38,20)"


def round_half_up(value: Column, places: int = 0) -> Column:
    """Round a double by its decimal digits, halves away from zero."""
    return F.round(value.cast(EXACT), places).cast("double")


def fixed_point(value: Column, places: int) -> Column:
    """Number as text with a fixed count of decimals, e.g. ``12.3``."""
    return F.round(value.cast(EXACT), places).cast(f"decimal(38,{places})").cast("string")


def minute_boundaries(start: Column, end: Column) -> Column:
    """Minutes between two timestamps, counted by minute boundaries crossed."""

    def minute_of_day(ts: Column) -> Column:
        return F.hour(ts) * 60 + F.minute(ts)

    days = F.datediff(end, start).cast("long")
    return days * 1440 + minute_of_day(end) - minute_of_day(start)
