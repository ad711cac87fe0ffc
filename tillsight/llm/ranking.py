"""Ranks over whole tables without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .storage import Scratch

# Partition numbers stand above this many bits of monotonically_increasing_id.
_PLACE_BITS = 33


def ranked(rows: DataFrame, by: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``rank`` long, from 0, in ascending order of the columns ``by``, nulls first.

    The rows are dealt to ranges, sorted within each and written; a row's rank
    is its place there plus the sizes of the ranges before.  Rows that are equal
    in ``by`` get ranks in an order of their own, and may fill several ranges.
    """
    placed = (
        rows.withColumn("_salt", F.monotonically_increasing_id())
        .repartitionByRange(*by, "_salt")
        .sortWithinPartitions(*by, "_salt")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
        .drop("_salt")
    )
    stored = scratch.table(placed, name)
    # One row for each range, however many rows the table has.
    sizes = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    numbered = stored.join(starts, "_part").withColumn("rank", F.col("_start") + F.col("_place"))
    return numbered.select(*rows.columns, "rank")
