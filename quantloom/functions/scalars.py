"""Column functions that more than one operator uses. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(left: Column, right: Column) -> Column:
    """True division; by zero it is null."""
    return F.when(right == 0, F.lit(None)).otherwise(left.cast("double") / right.cast("double"))


def arithmetic(name: str, operands: list[Column]) -> Column:
    """Fold operands from the left with add, sub, mul or div."""
    step = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": divide}[name]
    return reduce(step, operands)


def clock_ms(hhmmssmmm: Column) -> Column:
    """Milliseconds since midnight of an HHMMSSmmm integer."""
    t = hhmmssmmm.cast("long")
    part = lambda d, m: F.pmod(F.floor(t / d), F.lit(m))
    return F.floor(t / 10_000_000) * 3_600_000 + part(100_000, 100) * 60_000 + part(1_000, 100) * 1_000 + F.pmod(t, F.lit(1000))


def session_wait(later: Column, earlier: Column) -> Column:
    """Seconds between two HHMMSSmmm times without the 90 minutes of lunch; null if negative."""
    noon = (11 * 60 + 31) * 60_000
    a, b = clock_ms(earlier), clock_ms(later)
    ms = b - a - F.when((b > noon) & (a <= noon), F.lit(5_400_000)).otherwise(F.lit(0))
    return F.when(ms >= 0, ms / 1000.0)


def bar_minute(t: Column) -> Column:
    """The minute bar of an HHMMSSmmm time: auctions are 925 and 1500, lunch belongs to 1129."""
    minute = lambda x: F.floor(x / 100_000)
    return (
        F.when(t < 93_000_000, 925).when(t >= 145_700_000, 1500)
        .when(t < 130_000_000, minute(F.least(t, F.lit(112_959_999)))).otherwise(minute(t)).cast("long")
    )


def empty_zero_sum(x: Column) -> Column:
    """A sum that is 0 where nothing counts."""
    return F.coalesce(F.sum(x), F.lit(0.0))
