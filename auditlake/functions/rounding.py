"""Rounding of doubles by their exact binary value, half to even, in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double of 53 bits into halves whose products are exact.
SPLIT = float((1 << 27) + 1)


def halves(x: Column) -> tuple[Column, Column]:
    c = x * SPLIT
    high = c - (c - x)
    return high, x - high


def round_exact(x: Column, digits: int) -> Column:
    """x to so many digits (0 to 6): the nearest decimal to what the double is exactly, not to how it prints.

    The product with the power of ten is taken as a double and the exact error of that double.
    Only where the double lies half way does the error, or else the even neighbour, decide.
    Null, not-a-number and infinities stay.
    """
    ten = float(10**digits)
    high, low = halves(x)
    ten_high = (ten * SPLIT) - ((ten * SPLIT) - ten)
    ten_low = ten - ten_high
    product = x * ten
    error = ((high * ten_high - product) + high * ten_low + low * ten_high) + low * ten_low
    near = F.rint(product)
    off = product - near
    # rint has taken the even neighbour of a half; the error may say otherwise
    up, down = (off == 0.5) & (error > 0), (off == -0.5) & (error < 0)
    tie = (off == 0.0) & (F.abs(error) == 0.5) & (F.pmod(near, F.lit(2.0)) == 1.0)
    whole = F.when(up, near + 1).when(down, near - 1).when(tie, near + 2 * error).otherwise(near)
    # beyond this, doubles lie further apart than the digits
    return F.when(F.abs(product) < float(1 << 53), whole / ten).otherwise(x)


def shown(x: Column, digits: int) -> Column:
    """x with so many digits, rounded as above."""
    return F.format_string(f"%.{digits}f", round_exact(x, digits))
