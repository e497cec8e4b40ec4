"""Columns over arrays of doubles, all null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return F.try_divide(total(a), F.size(a))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def spread(a: Column, ddof: int = 0) -> Column:
    """Standard deviation."""
    m = mean(a)
    squares = F.aggregate(a, F.struct(F.lit(0.0).alias("s"), m.alias("m")), lambda acc, x: F.struct((acc["s"] + (x - acc["m"]) * (x - acc["m"])).alias("s"), acc["m"].alias("m")), lambda acc: acc["s"])
    return F.sqrt(F.try_divide(squares, F.size(a) - ddof))


def diff(a: Column) -> Column:
    n = F.size(a)
    return F.zip_with(F.slice(a, 2, F.greatest(n - 1, F.lit(0))), F.slice(a, 1, F.greatest(n - 1, F.lit(0))), lambda y, x: y - x)


def at(a: Column, i: Column | int) -> Column:
    """Element i from 0, null outside."""
    return F.get(a, F.lit(i) if isinstance(i, int) else i)


def last(a: Column) -> Column:
    return F.try_element_at(a, F.lit(-1))


def ratio(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """a / b, 0 where b is nothing."""
    return F.when(F.abs(b) < floor, 0.0).otherwise(F.try_divide(a, b))


def drawdown(a: Column) -> Column:
    """Largest fall from the highest value so far."""
    start = F.struct(at(a, 0).alias("top"), F.lit(0.0).alias("out"))
    step = lambda s, x: F.struct(F.greatest(s["top"], x).alias("top"), F.greatest(s["out"], F.greatest(s["top"], x) - x).alias("out"))
    return F.aggregate(a, start, step, lambda s: s["out"])


def runup(a: Column) -> Column:
    return drawdown(F.transform(a, lambda x: -x))


def resample(a: Column, points: int, method: str = "linear") -> Column:
    """`points` values at even places of the path: linear between neighbours, or the previous value; the ends stay."""
    n = F.size(a)
    place = lambda i: i.cast("double") * (n - 1) / (points - 1)

    def value(i: Column) -> Column:
        k = F.least(F.floor(place(i) + (1e-9 if method == "previous" else 0)).cast("int"), n - 1)
        if method == "previous":
            return F.when(i == points - 1, last(a)).otherwise(at(a, k))
        x, y = at(a, k), F.coalesce(at(a, k + 1), at(a, k))
        out = x + (y - x) * (place(i) - k)
        return F.when(i == points - 1, last(a)).when(F.abs(out) <= 1e-15, 0.0).otherwise(out)

    return F.when(a.isNull() | (n < 2), F.lit(None)).when(n == points, a).otherwise(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), value))
