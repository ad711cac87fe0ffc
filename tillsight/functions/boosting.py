"""Boosted regression trees over a short series, as an expression of its array.

The series is a count per month, so its length is bounded by the calendar.  A
tree over positions is a list of bounds: each of its levels cuts every part
where the squared error falls most, which prefix sums of the residuals tell.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Model settings that the forecast is defined by.
ROUNDS = 100
LEARNING_RATE = 0.1
DEPTH = 3


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positions(size: Column) -> Column:
    return F.sequence(F.lit(0), size - 1)


def _prefix_sums(values: Column) -> Column:
    def extended(sums: Column, value: Column) -> Column:
        return F.concat(sums, F.array(F.get(sums, F.size(sums) - 1) + value))

    return F.aggregate(values, F.array(F.lit(0.0)), extended)


def _best_cut(sums: Column, start: Column, end: Column) -> Column:
    """The cut of a part with the least squared error, the first of equal ones; NULL for a single position."""

    def gain(cut: Column) -> Column:
        left, right = (cut - start).cast("double"), (end - cut).cast("double")
        gap = (F.get(sums, cut) - F.get(sums, start)) / left - (F.get(sums, end) - F.get(sums, cut)) / right
        return F.struct((left * right * gap * gap).alias("gain"), (-cut).alias("cut"))

    return F.when(end - start > 1, -F.array_max(F.transform(F.sequence(start + 1, end - 1), gain))["cut"])


def _cut_further(bounds: Column, sums: Column) -> Column:
    inner = F.transform(
        F.sequence(F.lit(1), F.size(bounds) - 1), lambda i: _best_cut(sums, F.get(bounds, i - 1), F.get(bounds, i))
    )
    return F.array_sort(F.concat(bounds, F.filter(inner, lambda cut: cut.isNotNull())))


def _leaf_mean(bounds: Column, sums: Column, at: Column) -> Column:
    """The mean of the part that holds a position."""
    start = F.array_max(F.filter(bounds, lambda b: b <= at))
    end = F.array_min(F.filter(bounds, lambda b: b > at))
    return _let(start, lambda a: _let(end, lambda b: (F.get(sums, b) - F.get(sums, a)) / (b - a).cast("double")))


def _round(series: Column, fitted: Column) -> Column:
    residuals = F.zip_with(series, fitted, lambda y, f: y - f)

    def grown(sums: Column, bounds: Column, depth: int) -> Column:
        if depth:
            return _let(_cut_further(bounds, sums), lambda finer: grown(sums, finer, depth - 1))
        return F.transform(fitted, lambda f, i: f + LEARNING_RATE * _leaf_mean(bounds, sums, i))

    whole = F.array(F.lit(0), F.size(series))
    return _let(_prefix_sums(residuals), lambda sums: grown(sums, whole, DEPTH))


def boosted_next(series: Column) -> Column:
    """Prediction for the position after the last one of an array of doubles; NULL for an empty one.

    Trees do not extrapolate: the next position lands in the rightmost leaf
    of every tree and so gets the fitted value of the last position.
    """
    total = F.aggregate(series, F.lit(0.0), lambda acc, y: acc + y)
    start = F.transform(series, lambda y: total / F.size(series).cast("double"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda held, _: _round(series, held))
    return F.when(F.size(series) > 0, F.get(fitted, F.size(fitted) - 1))
