"""Time arithmetic on columns.

Differences go through the day-time interval between the two values, so timestamps without a zone
never pass through the session time zone.
"""

from pyspark.sql import Column, functions as F

from clinfeat.codes.values import DAYS_PER_YEAR, DAYS_PER_YEAR_AT_DEATH
from clinfeat.functions.numbers import round_half_away


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds with microseconds. 18 digits hold any two timestamps and still fit a long."""
    return (later - earlier).cast("decimal(18,6)")


def days_exact(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier).cast("double") / F.lit(86400.0)


def days_between(later: Column, earlier: Column) -> Column:
    """Days with four decimals."""
    return round_half_away(days_exact(later, earlier), 4)


def hours_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier).cast("double") / F.lit(3600.0)


def age_years(at: Column, birth: Column) -> Column:
    """Age in years of 365.242 days, four decimals."""
    return round_half_away(
        seconds_between(at, birth).cast("double") / F.lit(86400.0 * DAYS_PER_YEAR), 4
    )


def age_from_parts(at: Column, birth: Column) -> Column:
    """Age from the whole days, hours and minutes of the interval, in years of 365.25 days."""
    span = at - birth
    days = F.extract(F.lit("DAY"), span).cast("double")
    hours = F.extract(F.lit("HOUR"), span).cast("double")
    minutes = F.extract(F.lit("MINUTE"), span).cast("double")
    return (days + hours / F.lit(24.0) + minutes / F.lit(24.0) / F.lit(60.0)) / F.lit(365.25)


def age_at_death(death: Column, birth: Column) -> Column:
    return seconds_between(death, birth).cast("double") / F.lit(86400.0 * DAYS_PER_YEAR_AT_DEATH)


def years_since(ref_date: Column, birth_year: Column) -> Column:
    """Calendar-year difference; the reference date is an argument, so runs are repeatable."""
    return F.year(ref_date) - birth_year


def relative_day(start: Column, admitted: Column) -> Column:
    """Day of a date within a stay; the day of admission is day 1, earlier days are <= 0."""
    return (F.round(days_exact(start, F.to_date(admitted).cast("timestamp_ntz"))) + 1).cast("int")


def date_lag(start: Column, admitted: Column) -> Column:
    """Whole days from the date of admission."""
    return F.datediff(F.to_date(start), F.to_date(admitted))


def clock_hours(t: Column) -> Column:
    """Time of day in hours; seconds are ignored."""
    return F.hour(t) + F.minute(t) / F.lit(60.0)


def hours_after_six(clock: Column) -> Column:
    """Clock hours shifted so that the day starts at 06:00."""
    return F.when(clock < 6, clock + 18).otherwise(clock - 6)


def is_morning(clock: Column) -> Column:
    return F.when((clock >= 7) & (clock < 9), 1).otherwise(0)


def hour_number(t: Column) -> Column:
    """Whole hours since year 1, for time buckets."""
    return F.floor(hours_between(t, F.expr("timestamp_ntz'0001-01-01 00:00:00'")))


def hours_interval(hours: int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(hours))
