"""Column expressions shared by the operators and plans. All run in the JVM."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

_LOW_BITS = 20


def money(column: Column | str) -> Column:
    """A two-decimal amount as a decimal, for windows and row-wise arithmetic."""
    return _col(column).cast("decimal(12,2)")


def cents(column: Column | str) -> Column:
    """A two-decimal amount or rate in whole hundredths. Products of cents are
    exact too: multiply the values and add up their decimals."""
    return F.rint(_col(column) * 100).cast("bigint")


def exact_sum(units: Column, decimals: int, low_bits: int = _LOW_BITS) -> Column:
    """The sum of whole units as a decimal, whatever the order of rows.

    High and low bits are summed apart as longs: as fast as summing doubles. A group
    has room for ``2 ** (63 - low_bits)`` rows, and for as many of values below
    ``2 ** (2 * low_bits)``: 2**43 rows of values below 2**40 by default, 2**37 of
    values below 2**52 with 26 bits.
    """
    high = F.sum(F.shiftright(units, low_bits)).cast("decimal(19,0)")
    low = F.sum(units.bitwiseAND((1 << low_bits) - 1)).cast("decimal(19,0)")
    whole = high * F.lit(Decimal(1 << low_bits)) + low
    return whole * F.lit(Decimal(1).scaleb(-decimals))


def total(units: Column, decimals: int, low_bits: int = _LOW_BITS) -> Column:
    """``exact_sum`` as a double."""
    return exact_sum(units, decimals, low_bits).cast("double")


def mean(units: Column, decimals: int) -> Column:
    """The mean of whole units: one exact sum and one division."""
    return total(units, decimals) / F.count(units)


def epoch_micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, _col(column))


def time_bucket(column: Column | str, seconds: float) -> Column:
    """The number of the fixed-width time bucket a timestamp falls in."""
    micros, width = epoch_micros(column), F.lit(int(seconds * 1_000_000))
    return ((micros - F.pmod(micros, width)) / width).cast("bigint")


def same(pairs) -> Column:
    """Null-safe equality over ``(left, right)`` column pairs."""
    return reduce(and_, (left.eqNullSafe(right) for left, right in pairs), F.lit(True))


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
