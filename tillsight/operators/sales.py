"""Enriched sales, KPIs, discount sensitivity and daily targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import segments
from ..functions.counts import distinct

MAX_DISCOUNT_RATE = 50
# Month labels.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def sales_enriched(
    sales: DataFrame, products: DataFrame, sections: DataFrame, branches: DataFrame
) -> DataFrame:
    """Sale lines with dimension names, calendar columns, cost and margin.

    Left joins keep every line.  Margin is NULL where the net amount is 0.
    """
    catalog = products.join(sections, "section_id", "left")
    lines = sales.join(catalog, "product_id", "left").join(branches, "branch_id", "left")
    total_cost = F.col("quantity") * F.col("cost_jod")
    gross_profit = F.col("net_amount") - total_cost
    return lines.withColumns(
        {
            "date": F.to_date("timestamp"),
            "month": F.get(F.array(*map(F.lit, MONTHS)), F.month("timestamp") - 1),
            "month_num": F.month("timestamp"),
            "total_cost": total_cost,
            "gross_profit": gross_profit,
            "margin_pct": margin_pct(),
        }
    )


def margin_pct() -> Column:
    """Profit over net amount of a line; a ratio needs no decimal arithmetic."""
    net = F.col("net_amount").cast("double")
    return F.try_divide(net - F.col("quantity") * F.col("cost_jod").cast("double"), net) * 100


def overview_kpis(sales: DataFrame, products: DataFrame, rsd: float | None = None) -> DataFrame:
    """Net revenue, unweighted mean line margin and number of invoices.

    With ``rsd`` the invoices are counted by a sketch of that error.
    """
    return sales.join(products.select("product_id", "cost_jod"), "product_id", "left").agg(
        F.coalesce(F.sum("net_amount"), F.lit(0)).alias("total_revenue"),
        F.avg(margin_pct()).alias("avg_margin_pct"),
        distinct("transaction_id", rsd).alias("transactions"),
    )


def branch_revenue(sales: DataFrame, branches: DataFrame) -> DataFrame:
    """Net revenue by branch name, lowest first."""
    per_branch = sales.groupBy("branch_id").agg(F.sum("net_amount").alias("net_amount"))
    return (
        per_branch.join(branches.filter(F.col("branch_name").isNotNull()), "branch_id")
        .groupBy("branch_name")
        .agg(F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net_amount"))
        .orderBy("net_amount", "branch_name")
    )


def discount_sensitivity(
    sales: DataFrame, max_rate: int = MAX_DISCOUNT_RATE, rates: Sequence[float] | None = None
) -> DataFrame:
    """Net revenue at each whole discount rate, or at the given ``rates``, volume held constant."""
    steps = F.sequence(F.lit(0), F.lit(max_rate)) if rates is None else F.array(*[F.lit(float(r)) for r in rates])
    totals = sales.agg(
        F.coalesce(F.sum("gross_amount"), F.lit(0)).cast("double").alias("gross"),
        F.coalesce(F.sum("discount_amount"), F.lit(0)).cast("double").alias("discount"),
        F.coalesce(F.sum("net_amount"), F.lit(0)).cast("double").alias("actual_net"),
    )
    curve = totals.withColumn("rate", F.explode(steps))
    simulated = F.col("gross") * (1 - F.col("rate") / 100)
    return curve.select(
        "rate",
        simulated.alias("simulated_net"),
        (simulated - F.col("actual_net")).alias("delta"),
        "actual_net",
        (F.try_divide("discount", "gross") * 100).alias("current_rate"),
    )


def daily_target_attainment(sales: DataFrame, target: float) -> DataFrame:
    """Gross sales per day against a target, with the moment it was reached.

    The running total is built in two levels.  Amounts are first folded per
    time stamp; a second then holds at most a million stamps and a day at
    most 86,400 seconds, so no window group grows with the data, whatever
    share of all rows falls on one day.
    """
    clock = F.col("timestamp")
    second_of_day = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)
    stamps = (
        sales.filter(clock.isNotNull())
        .groupBy("timestamp")
        .agg(F.coalesce(F.sum("gross_amount"), F.lit(0)).alias("amount"))
        .withColumns({"day": F.to_date(clock), "second": second_of_day})
    )
    so_far = W.partitionBy("day", "second").orderBy("timestamp").rowsBetween(W.unboundedPreceding, 0)
    within = stamps.withColumn("within", F.sum("amount").over(so_far))
    # Each second keeps where its stamps stood; at most a million of them.
    seconds = within.groupBy("day", "second").agg(
        F.sum("amount").alias("amount"),
        F.max("within").alias("peak"),
        F.collect_list(F.struct("timestamp", "within")).alias("stamps"),
    )
    earlier = W.partitionBy("day").orderBy("second").rowsBetween(W.unboundedPreceding, -1)
    reached = F.col("before") + F.col("peak") >= target
    before = F.coalesce(F.sum("amount").over(earlier), F.lit(0))
    crossing = F.filter("stamps", lambda s: F.col("before") + s["within"] >= target)
    return (
        seconds.withColumn("before", before)
        .select("day", "amount", F.when(reached, F.array_min(F.transform(crossing, lambda s: s["timestamp"]))).alias("moment"))
        .groupBy("day")
        .agg(F.sum("amount").alias("gross_amount"), F.min("moment").alias("first_reached"))
        .select(
            "day",
            "gross_amount",
            F.lit(float(target)).alias("target"),
            (F.col("gross_amount") >= target).alias("reached"),
            "first_reached",
        )
    )


def trading_band_sales(sales: DataFrame) -> DataFrame:
    """Lines, gross sales and mean line price per day and trading band."""
    return (
        sales.filter(F.col("timestamp").isNotNull())
        .groupBy(
            F.to_date("timestamp").alias("day"),
            segments.trading_band(F.col("timestamp")).alias("band"),
        )
        .agg(
            F.count("*").alias("lines"),
            F.coalesce(F.sum("gross_amount"), F.lit(0)).alias("gross_amount"),
            F.try_divide(
                F.sum("gross_amount").cast("double"), F.count("gross_amount").cast("double")
            ).alias("mean_price"),
        )
    )
