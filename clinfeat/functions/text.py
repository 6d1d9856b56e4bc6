"""Text, code and flag column expressions."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from clinfeat.codes.values import (
    CONDENSE_PATTERNS, CONDENSE_TAIL, INFECTION_PREFIXES, UNKNOWN_CATEGORIES,
)


def has_prefix(code: Column, prefixes: dict[int, list[str]] = INFECTION_PREFIXES) -> Column:
    """1 when the code starts with one of the listed prefixes, else 0."""
    hit = F.lit(False)
    for length, codes in prefixes.items():
        hit = hit | F.substring(code, 1, length).isin(codes)
    return F.when(hit, 1).otherwise(0)


def numeric_prefix(code: Column, length: int = 3) -> Column:
    """The first characters as a number; NULL for codes that start with E or V."""
    plain = ~F.substring(code, 1, 1).isin("E", "V")
    return F.when(plain, F.substring(code, 1, length).try_cast("int"))


def condense(c: Column) -> Column:
    """Fold free-text categories; the patterns are unanchored and the order matters.

    A text is only put through patterns whose word it holds: a text search costs far less than a replacement. No earlier replacement
    brings in the word of a later step.
    """
    def held(patterns):
        return reduce(or_, [c.contains(pattern.replace(".*", "")) for pattern, _ in patterns])

    def head(text):
        for pattern, value in CONDENSE_PATTERNS:
            text = F.regexp_replace(text, pattern, value)
        return F.when(text.isin(UNKNOWN_CATEGORIES), "UNKNOWN").otherwise(text)

    def tail(text):
        for pattern, value in CONDENSE_TAIL:
            text = F.regexp_replace(text, pattern, value)
        return text

    first, last = held(CONDENSE_PATTERNS) | c.isin(UNKNOWN_CATEGORIES), held(CONDENSE_TAIL)
    return F.when(first & last, tail(head(c))).when(first, head(c)).when(last, tail(c)).otherwise(c)


def is_value(c: Column, value) -> Column:
    """0/1 flag; NULL gives 0."""
    return F.when(c == value, 1).otherwise(0)


def yes_no(condition: Column) -> Column:
    return F.when(condition, "Y").otherwise("N")


def lag_group(lag_days: Column, limit: float = 3) -> Column:
    return F.when(lag_days.isNull(), "none").when(lag_days > limit, "late").otherwise("early")


def not_marked(error: Column) -> Column:
    """Rows that are not marked as errors; NULL counts as not marked."""
    return ~error.eqNullSafe(1)


def list_text(items: Column, quote: bool = False) -> Column:
    """An array as the text "[1, 2]" or "['a', 'b']"."""
    cell = items.cast("array<string>")
    if quote:
        cell = F.transform(cell, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(cell, ", "), F.lit("]"))


def parse_list(text: Column, element: str = "string") -> Column:
    """The text of a list back to an array."""
    return F.from_json(F.regexp_replace(text, "'", '"'), f"array<{element}>")
