"""Numeric column expressions."""

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

from clinfeat.codes.values import AGE_BANDS, AGE_FLOOR, NORMAL_QUANTILE


def round_half_away(x: Column, digits: int) -> Column:
    """Decimal rounding, half away from zero."""
    return F.round(x.cast("decimal(30,12)"), digits)


def within(x: Column, lo: float, hi: float) -> Column:
    """The value inside [lo, hi], NULL outside."""
    return F.when(x.between(lo, hi), x)


def body_mass_index(weight: Column, height_cm: Column) -> Column:
    metres = height_cm / F.lit(100.0)
    return F.try_divide(weight, metres * metres)


def cap_age(age: Column) -> Column:
    """Ages above 200 stand for people past 89 and become 90."""
    return F.when(age > 200, 90.0).otherwise(age)


def natural_log(x: Column) -> Column:
    """NULL for values at or below zero."""
    return F.ln(x)


def age_band(age: Column) -> Column:
    """Right-closed bands, NULL outside all of them."""
    band = F.when(age <= AGE_FLOOR, None)
    for upper, label in AGE_BANDS:
        band = band.when(age <= upper, label)
    return band


def percent(p: Column) -> Column:
    return F.format_string("%.1f%%", p * 100)


def non_null_count(columns: list[str]) -> Column:
    return reduce(add, [F.col(f"`{c}`").isNotNull().cast("int") for c in columns])


def capped_sum(columns: list[str]) -> Column:
    """Sum of 0/1 flags, at most 1."""
    return F.least(F.lit(1), reduce(add, [F.col(f"`{c}`") for c in columns]))


def combined_label(outcome: Column, expire: Column) -> Column:
    """0 neither, 1 outcome, 2 died, 3 both."""
    return outcome + expire * 2


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin 1..bins; the last bin includes ``hi``; NULL outside [lo, hi]."""
    inside = F.when(x == hi, F.lit(bins).cast("bigint")).otherwise(
        F.width_bucket(x.cast("double"), lo.cast("double"), hi.cast("double"), F.lit(bins))
    )
    return F.when((x >= lo) & (x <= hi), inside)


def _ratio(kind: str, r: Column) -> Column:
    sides = []
    for coefficients in NORMAL_QUANTILE[kind]:
        total = F.lit(coefficients[0])
        for c in coefficients[1:]:
            total = total * r + F.lit(c)
        sides.append(total)
    return sides[0] / sides[1]


def normal_quantile(p: Column) -> Column:
    """Quantile of the standard normal distribution to about 16 digits; null outside (0, 1)."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(tail <= 5.0, _ratio("near", tail - 1.6)).otherwise(_ratio("far", tail - 5.0))
    inner = _ratio("central", F.lit(0.180625) - q * q) * q
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, inner).otherwise(F.signum(q) * outer))
