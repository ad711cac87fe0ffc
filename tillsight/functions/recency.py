"""Time windows on sales that prune a stored fact table to its date folders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.schemas import SALE_DATE


def latest_sale(sales: DataFrame, last_day: dt.date | None = None) -> DataFrame:
    """One row with the time of the latest sale.

    ``last_day`` is the latest day of a fact stored by days, as ``Star.last_day``
    knows it from the folder names; only that folder is read then.  Without it
    the times of all sales are.
    """
    if last_day is not None and SALE_DATE in sales.columns:
        sales = sales.filter(F.col(SALE_DATE) == F.lit(last_day))
    return sales.agg(F.max("timestamp").alias("latest"))


def days_before_latest(
    sales: DataFrame, days: int, as_of: dt.datetime | None = None, last_day: dt.date | None = None
) -> Column:
    """The time ``days`` days before ``as_of``, by default before the latest sale.

    The latest sale is a scalar subquery.  The subtraction is inside it, so that
    the comparison with the time column is one the Parquet scan can take over.
    """
    if as_of is not None:
        return F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")
    latest = latest_sale(sales, last_day)
    return latest.select(F.col("latest") - F.expr(f"INTERVAL {int(days)} DAYS")).scalar()


def sold_since(sales: DataFrame, start: Column) -> DataFrame:
    """Lines from ``start`` on."""
    recent = sales.filter(F.col("timestamp") >= start)
    if SALE_DATE in sales.columns:
        recent = recent.filter(F.col(SALE_DATE) >= F.to_date(start))
    return recent


def sold_before(sales: DataFrame, end: Column) -> DataFrame:
    """Lines before ``end``."""
    earlier = sales.filter(F.col("timestamp") < end)
    if SALE_DATE in sales.columns:
        earlier = earlier.filter(F.col(SALE_DATE) <= F.to_date(end))
    return earlier
