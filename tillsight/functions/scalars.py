"""One-row results next to every row of a frame, without a join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add the single row of ``one_row`` to ``df`` as struct column ``name``.

    The value is a scalar subquery.  Passing it through a one-element
    explode keeps the optimizer from copying the subquery into every
    expression that reads a field of it.
    """
    value = one_row.select(F.struct("*")).scalar()
    return df.withColumn(name, F.explode(F.array(value)))
