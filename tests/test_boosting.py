from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.functions.boosting import DEPTH, LEARNING_RATE, ROUNDS, boosted_next


def best_split(y):
    """The cut with the least squared error, by trying every one."""
    errors = [((y[:k] - y[:k].mean()) ** 2).sum() + ((y[k:] - y[k:].mean()) ** 2).sum() for k in range(1, len(y))]
    return int(np.argmin(errors)) + 1


def tree(y, depth):
    if depth == 0 or len(y) < 2 or np.ptp(y) < 1e-9:
        return [y.mean()] * len(y)
    k = best_split(y)
    return tree(y[:k], depth - 1) + tree(y[k:], depth - 1)


def reference(y):
    y = np.asarray(y, float)
    fitted = np.full(len(y), y.mean())
    for _ in range(ROUNDS):
        fitted = fitted + LEARNING_RATE * np.array(tree(y - fitted, DEPTH))
    return fitted[-1]


def boosted(spark, *series):
    rows = spark.createDataFrame([([float(v) for v in y],) for y in series], "y array<double>")
    return [r[0] for r in rows.select(boosted_next(F.col("y"))).collect()]


def test_equals_exhaustive_trees(spark):
    series = [np.random.default_rng(seed).normal(30, 9, size=int(3 + 9 * seed)) for seed in range(6)]
    assert boosted(spark, *series) == pytest.approx([reference(y) for y in series], rel=1e-6)


def test_counts_with_equal_neighbours(spark):
    """Cuts that are equally good may be chosen differently, by the last digit of a sum."""
    series = [np.random.default_rng(seed).integers(1, 4, size=30) for seed in range(6)]
    assert boosted(spark, *series) == pytest.approx([reference(y) for y in series], rel=1e-4)


def test_constant_history_gives_the_constant(spark):
    assert boosted(spark, [7, 7, 7, 7]) == [pytest.approx(7)]


def test_fits_a_short_series_and_does_not_extrapolate(spark):
    assert boosted(spark, [10, 20, 30, 40]) == [pytest.approx(40, abs=0.01)]


def test_no_history_gives_no_prediction(spark):
    assert boosted(spark, []) == [None]
