"""Mean and deviation of doubles that are the same in any order of the rows, in column functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the first piece counts in, and the bits of the others: products of pieces have at most 18 digits.
UNIT, BITS = 2.0**-23, 29


def pieces(x: Column) -> tuple[Column, Column, Column]:
    """x, from 0 to 100, in whole numbers: multiples of 2^-23, of 2^-52 and of 2^-81.

    Together they are what the double is exactly, but for what it has below 2^-81.  Null for other numbers.
    """
    rest = F.when(x.between(0, 100), x) / UNIT
    out = []
    for _ in range(3):
        out.append(F.floor(rest))
        rest = (rest - out[-1]) * float(1 << BITS)
    return tuple(out)


def mean_and_deviation(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Aggregates over columns of pieces: mean and deviation of a sample, null for none and for one number.

    Sums of whole numbers have no order, unlike those of doubles.  They are exact, up to ten
    thousand million rows; so are those of products, for numbers without bits below 2^-52.
    """
    n = F.count(a)
    whole = lambda x: F.sum(x).cast("decimal(20,0)")
    step = lambda k: F.lit(Decimal(1 << (BITS * k)))
    total = whole(a) * step(2) + whole(b) * step(1) + whole(c)
    mean = total.cast("double") * (UNIT * 2.0 ** (-2 * BITS)) / n
    # n times the sum of squared deviations, the smaller parts first
    apart = lambda x, y: (n * F.sum((x * y).cast("decimal(18,0)")) - whole(x) * whole(y)).cast("double")
    squares = apart(b, b) * 2.0 ** (-2 * BITS) + apart(a, b) * 2.0 ** (1 - BITS) + apart(a, a)
    variance = F.greatest(F.lit(0.0), squares) * UNIT**2 / n / (n - 1)
    return F.when(n > 0, mean), F.when(n > 1, F.sqrt(variance))
