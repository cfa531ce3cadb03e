"""Column expressions of measurement lines and statistics; all are evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugework.schema import LINE_FORM, NUMBER, SEPARATOR


def without_cr(line: Column) -> Column:
    """The line without one carriage return at its end."""
    return F.when(line.endswith("\r"), F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def station_of(line: Column) -> Column:
    """What stands before the first separator."""
    return F.substring_index(line, SEPARATOR, 1)


def number_of(line: Column) -> Column:
    """The number of a measurement line; empty for any other line. Station, separator and number are told by one expression."""
    return F.regexp_extract(line, LINE_FORM, 1)


def is_blank(line: Column) -> Column:
    """Nothing, or a carriage return alone."""
    return line.isin("", "\r")


def is_measurement(line: Column) -> Column:
    """A station of one byte or more, a separator, and a number of the one valid form."""
    return line.rlike(LINE_FORM)


def tenths_of(number: Column) -> Column:
    """The number in tenths, exactly, and null for any other text."""
    return F.when(number.rlike(rf"\A{NUMBER}\z"), tenths_of_valid(number))


def tenths_of_valid(number: Column) -> Column:
    """The tenths of what number_of() gives: without its point a number is an integer."""
    return F.replace(number, F.lit("."), F.lit("")).cast("int")


def floor_div(a: Column, b: Column) -> Column:
    """floor(a / b) of integers, b > 0, exactly."""
    return _div(a - F.pmod(a, b), b)


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def mean_tenths(total: Column, n: Column) -> Column:
    """The mean in tenths, half rounded towards plus infinity, from the exact sum and count."""
    return floor_div(2 * total + n, 2 * n)


def mean_degrees(total: Column, n: Column) -> Column:
    """The mean in degrees in floating point: sum by count, then by ten, in that order."""
    return total.cast("double") / n.cast("double") / F.lit(10.0)


def degrees(tenths: Column) -> Column:
    return tenths.cast("double") / F.lit(10.0)


def format_tenths(tenths: Column) -> Column:
    """-12.3 for -123; zero is 0.0, never -0.0."""
    size = F.abs(tenths.cast("bigint"))
    return F.concat(F.when(tenths < 0, F.lit("-")).otherwise(F.lit("")), _div(size, F.lit(10)).cast("string"), F.lit("."), (size % 10).cast("string"))


def format_degrees(value: Column) -> Column:
    """One decimal of a floating-point number, rounded from its exact binary value."""
    return F.format_number(value, 1)


def format_line(station: Column, tenths: Column) -> Column:
    return F.concat(station, F.lit(SEPARATOR), format_tenths(tenths))
