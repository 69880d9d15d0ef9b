"""Value maps, dates and number helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated a single time.

    Spark inlines a repeated expression; a lambda variable holds its result.
    """
    return F.transform(F.array(value), body)[0]


def map_values(col: Column, mapping: Mapping[str, str]) -> Column:
    """Replace mapped values; any other value, null too, passes through."""
    if not mapping:
        return col
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.coalesce(F.create_map(*pairs)[col], col)


def replace_patterns(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply (pattern, replacement) rules in order, unanchored.

    Each rule replaces its first match only: what follows is matched with it and
    put back. That group comes last, so a rule's own groups keep their numbers.
    """
    for pattern, replacement in rules:
        col = F.regexp_replace(col, rf"(?:{pattern})(?s:(?<rest>.*))\z", replacement + "${rest}")
    return col


def parse_month_first(col: Column, strict: bool = True) -> Column:
    """``m/d/yyyy`` text to a date; junk fails the job, or is null if lenient."""
    parsed = F.try_to_date(col, "M/d/yyyy")
    if not strict:
        return parsed
    # An error of its own: whether ``to_date`` fails depends on a session setting.
    junk = F.raise_error(F.concat(F.lit("not a m/d/yyyy date: "), col)).cast("date")
    return F.when(col.isNull() | parsed.isNotNull(), parsed).otherwise(junk)


def submitted_timestamp(df: DataFrame, name: str, strict: bool = True) -> Column:
    """A submission time from a column of text or of real dates."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.StringType):
        col = parse_month_first(col, strict)
    return col.cast("timestamp_ntz")


def in_date_range(col: Column, date_range: Sequence | None, end_inclusive_day: bool = False) -> Column:
    """Closed range test; no test at all unless exactly two dates are given.

    Both ends are midnights, so later hours of the last day fall out. Set
    ``end_inclusive_day`` to keep that whole day.
    """
    if not date_range or len(date_range) != 2:
        return F.lit(True)
    low, high = (F.lit(str(value)).cast("timestamp_ntz") for value in date_range)
    if end_inclusive_day:
        day_after = F.date_add(high.cast("date"), 1).cast("timestamp_ntz")
        return (col >= low) & (col < day_after)
    return col.between(low, high)


def percentage(part: Column, whole: Column) -> Column:
    return part / whole * 100


def percent_label(col: Column) -> Column:
    """``12.3%``; null stays null.

    Rounds the exact binary value, ties to the even digit, where Spark's own
    formatting rounds its decimal print-out half up. The whole part is split
    off, and what is left, scaled by a power of two, becomes whole without
    losing a bit that matters.
    """
    unit = F.lit(2**62).cast("decimal(19,0)")

    def exact(value: Column) -> Column:
        size = F.abs(value)
        # From 2^53 on a number is whole; below, the remainder is exact.
        part = size % 1
        whole = (size - part).cast("bigint")
        tenfold = (part * F.lit(2.0**62)).cast("bigint").cast("decimal(19,0)") * 10

        def rounded(down: Column) -> Column:
            rest = (tenfold - down * unit) * 2
            up = (rest > unit) | ((rest == unit) & (down % 2 == 1))
            return once(down.cast("int") + up.cast("int"), write)

        def write(tenths: Column) -> Column:
            sign = F.when(value < 0, "-").otherwise("")
            return F.concat(sign, (whole + (tenths == 10).cast("bigint")).cast("string"), F.lit("."), tenths % 10, F.lit("%"))

        return once(F.floor(tenfold / unit).cast("decimal(19,0)"), rounded)

    # Beyond 2^62 there are no decimals to round, only digits to print.
    return once(
        col,
        lambda value: F.when(F.isnan(value) | (F.abs(value) >= 2.0**62), F.format_string("%.1f%%", value)).when(
            value.isNotNull(), exact(value)
        ),
    )
