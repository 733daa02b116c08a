"""Numeric building blocks shared by every operator.

``round2`` is the engine's money rounding: half-to-even on the binary value
scaled by 100 (``rint``), reproducible in DuckDB as ``round_even(x*100,0)/100``.
``fixed_sum`` sums doubles exactly and order-independently: ``rint(x * 10^scale)``
is summed as two BIGINTs, its low 20 bits and the rest, which overflow only beyond
8 * 10^12 rows or a total of 9 * 10^24 units, so partial aggregates can combine in
any order on any number of executors and still give the same last digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW_BITS = 20
SUM_SCALE = 10_000  # four decimals: money products like price*(1-discount)


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nz(x) -> Column:
    """NULL -> 0 (the reference's ``x or 0``)."""
    return F.coalesce(c(x), F.lit(0.0))


def truthy(x) -> Column:
    """Python truthiness of a number: not NULL and not zero."""
    x = c(x)
    return x.isNotNull() & (x != 0)


def round2(x) -> Column:
    return F.rint(c(x) * 100.0) / 100.0


def round_n(x, n: int) -> Column:
    s = float(10 ** n)
    return F.rint(c(x) * s) / s


def div(a, b) -> Column:
    """a / b, NULL when b is zero or NULL (never raises under ANSI)."""
    return F.try_divide(c(a), c(b))


def fixed_sum(x, scale: int = SUM_SCALE) -> Column:
    """Exact, order-free sum of a double column (as double)."""
    units = F.rint(c(x) * float(scale)).cast("long")
    low = F.sum(units.bitwiseAND((1 << _LOW_BITS) - 1)).cast("decimal(38,0)")
    high = F.sum(F.shiftright(units, _LOW_BITS)).cast("decimal(20,0)")
    return (high * F.lit(1 << _LOW_BITS).cast("decimal(8,0)") + low).cast("double") / float(scale)


def fixed_avg(x, scale: int = SUM_SCALE) -> Column:
    """Exact mean over non-NULL values."""
    return div(fixed_sum(x, scale), F.count(c(x)))


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("long")
