"""Exact interpolated quantiles without gathering the values in one task.

The built-in exact percentile keeps one value-to-count map of the whole
column in a single task, which does not fit once there is a value per
customer and customers number in the billions.  Here a mergeable sketch
only proposes cut points; exact counts at the cut points decide which two
of them enclose each wanted rank, and only the values between those two
are looked at one by one.  A poor proposal costs time, never exactness,
because the minimum and the maximum are always among the cut points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

DEFAULT_ACCURACY = 10_000
SKETCH_SIZE = 200


def _around(fraction: float, slack: float) -> list[float]:
    return [max(0.0, fraction - slack), min(1.0, fraction + slack)]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Sequence[float],
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """One row with, per column, the array of linearly interpolated quantiles.

    Nulls are skipped; a column without values gets a NULL array.
    """
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    proposals = sorted({p for f in fractions for p in _around(f, 2.0 / accuracy)})
    cut_points = [
        F.struct(
            F.lit(c).alias("measure"),
            F.array_sort(
                F.array_distinct(
                    F.concat(
                        F.array(F.min(c), F.max(c)), F.percentile_approx(c, proposals, accuracy)
                    )
                )
            ).alias("cuts"),
        )
        for c in columns
    ]
    cuts = values.agg(F.array(*cut_points).alias("all")).select(F.inline("all"))
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in columns])

    # The slot of a value is the number of cut points below it, so slots are
    # ordered like the values: a value equal to a cut point belongs to the
    # slot that ends there.  The broadcast side has one row per measure.
    below = [
        F.when(F.get("cuts", F.lit(k)) < F.col("value"), 1).otherwise(0)
        for k in range(len(proposals) + 2)
    ]
    slotted = (
        values.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .join(F.broadcast(cuts), "measure")
        .select("measure", "value", sum(below, F.lit(0)).alias("slot"))
    )

    # At most one row per cut point and measure from here on.  A rank that
    # falls between two rows needs both neighbours.
    by_measure = W.partitionBy("measure")
    upto = by_measure.orderBy("slot").rowsBetween(W.unboundedPreceding, 0)
    slots = (
        slotted.groupBy("measure", "slot")
        .agg(F.count("*").alias("slot_rows"))
        .withColumns({"end": F.sum("slot_rows").over(upto), "n": F.sum("slot_rows").over(by_measure)})
        .withColumn("before", F.col("end") - F.col("slot_rows"))
    )
    enclosing = slots.filter(F.size(_ranks_between("before", "end", fractions)) > 0).select(
        "measure", "slot", "before", "n"
    )

    # Values of the enclosing slots only, ties folded into one row.
    in_slot = W.partitionBy("measure", "slot").orderBy("value")
    placed = (
        slotted.join(F.broadcast(enclosing), ["measure", "slot"])
        .groupBy("measure", "slot", "value")
        .agg(F.count("*").alias("value_rows"), F.max("before").alias("before"), F.max("n").alias("n"))
        .withColumn("end", F.col("before") + F.sum("value_rows").over(in_slot))
        .withColumn("first_rank", F.col("end") - F.col("value_rows"))
        .select(
            "measure",
            "value",
            "first_rank",
            (F.col("end") - 1).alias("last_rank"),
            F.inline(_ranks_between("first_rank", "end", fractions)),
        )
    )
    low, high = _value_at(F.floor("rank")), _value_at(F.ceil("rank"))
    step = F.col("rank") - F.floor("rank")
    ends = (
        placed.groupBy("measure", "i", "rank")
        .agg(F.max(low).alias("low"), F.max(high).alias("high"))
        .select("measure", "i", (F.col("low") + (F.col("high") - F.col("low")) * step).alias("q"))
    )
    return ends.agg(*[_edges_of(c).alias(c) for c in columns])


def sketched_quantiles(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], accuracy: int) -> DataFrame:
    """Like ``exact_quantiles``, from a sketch: values whose rank is off by at most rows / ``accuracy``.

    The least and the largest value are exact.
    """
    inner = [min(max(f, 0.0), 1.0) for f in fractions]
    found = [F.percentile_approx(F.col(c).cast("double"), inner, accuracy).alias(c) for c in columns]
    return df.agg(*found)


def quantiles_of(df: DataFrame, columns: Sequence[str], fractions: Sequence[float], accuracy: int | None) -> DataFrame:
    """Exact quantiles, or sketched ones if an accuracy is given."""
    if accuracy is None:
        return exact_quantiles(df, columns, fractions)
    return sketched_quantiles(df, columns, fractions, accuracy)


def daily_quantile_sketches(df: DataFrame, column: str, day: str = "day", size: int = SKETCH_SIZE) -> DataFrame:
    """day and sketch: what is needed for the quantiles of a column over any set of days.

    A sketch of ``size`` k has a rank error of about 2.3 / k^0.9 of the rows, 1.3
    percent at 200, however many days are merged.  Its draws are random, so
    two runs may differ within that.
    """
    values = df.filter(F.col(column).isNotNull()).select(day, F.col(column).cast("double").alias("value"))
    return values.groupBy(day).agg(F.kll_sketch_agg_double("value", F.lit(size)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """One row with the array of quantiles of all given days together; NULL without any."""
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    merged = sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.count("*").alias("days"))
    return merged.select(F.when(F.col("days") > 0, F.kll_sketch_get_quantile_double("sketch", wanted)).alias("quantiles"))


def _ranks_between(first: str, end: str, fractions: Sequence[float]) -> Column:
    """The wanted ranks (index, rank) with a neighbour in the ranks [first, end)."""
    ranks = [F.lit(float(f)) * (F.col("n") - 1) for f in fractions]
    return F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(first) <= F.ceil(rank)) & (F.floor(rank) < F.col(end)),
                    F.struct(F.lit(i).alias("i"), rank.alias("rank")),
                )
                for i, rank in enumerate(ranks)
            ]
        )
    )


def _edges_of(measure: str) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(F.col("measure") == measure, F.struct("i", "q"))))
    return F.when(F.size(pairs) > 0, F.transform(pairs, lambda pair: pair["q"]))


def _value_at(rank: Column) -> Column:
    return F.when(rank.between(F.col("first_rank"), F.col("last_rank")), F.col("value"))


def quartile_score(value: Column, edges: Column, reverse: bool = False) -> Column:
    """Score 1-4 by quartile (4-1 when reversed), 2 for everyone if edges repeat.

    Ranks with repeated edges cannot carry four labels, so the whole measure
    falls back to the neutral score.
    """
    ordinal = (
        F.when(value <= edges[1], 1).when(value <= edges[2], 2).when(value <= edges[3], 3).otherwise(4)
    )
    if reverse:
        ordinal = F.lit(5) - ordinal
    distinct = F.size(F.array_distinct(edges)) == 5
    return F.when(distinct, ordinal.cast("double")).otherwise(F.lit(2.0))
