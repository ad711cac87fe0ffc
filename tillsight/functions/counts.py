"""Distinct counts, exact unless an error bound is accepted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def distinct(column: str, rsd: float | None = None) -> Column:
    """Exact count of distinct values, or a sketch with that relative error.

    The exact count shuffles every distinct value once; the sketch shuffles
    a few kilobytes per task.
    """
    return F.count_distinct(column) if rsd is None else F.approx_count_distinct(column, rsd)
