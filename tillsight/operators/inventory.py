"""Days to stockout of every item, and what is refilled first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import segments

TOP_ITEMS = 12


def stockout_days(
    sales: DataFrame, inventory: DataFrame, products: DataFrame, days: Column | None = None
) -> DataFrame:
    """Every stocked item with its mean daily sales and the days its stock lasts.

    Days are counted over all sales (or given), so an item sold on few of them
    burns slowly.  Items without sales have no days left and the level "OK".
    """
    if days is None:
        days = sales.agg(F.count_distinct(F.to_date("timestamp"))).scalar()
    sold = (
        sales.groupBy("branch_id", "product_id")
        .agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("sold"))
        .filter(F.col("branch_id").isNotNull() & F.col("product_id").isNotNull())
    )
    burn = F.col("sold") / F.greatest(days, F.lit(1))
    return (
        inventory.select("branch_id", "product_id", "total_qty")
        .join(sold, ["branch_id", "product_id"], "left")
        .join(products.select("product_id", "product_name_en"), "product_id")
        .withColumn("daily_burn", burn)
        .withColumn("days_left", F.try_divide("total_qty", "daily_burn"))
        .select(
            "branch_id",
            "product_id",
            "product_name_en",
            "total_qty",
            "daily_burn",
            "days_left",
            segments.stockout_level(F.col("days_left")).alias("risk_level"),
        )
    )


def stockout_risk(items: DataFrame, top: int = TOP_ITEMS) -> DataFrame:
    """The ``top`` items of ``stockout_days`` that run out first."""
    soonest = items.filter(F.col("days_left").isNotNull())
    return soonest.orderBy("days_left", "branch_id", "product_id").limit(top)


def stockout_kpis(items: DataFrame) -> DataFrame:
    """Counts below the two limits (the second includes the first) and mean days, over all items."""
    days = F.col("days_left")
    return items.agg(
        F.count_if(days < segments.CRITICAL_BELOW_DAYS).alias("critical_items"),
        F.count_if(days < segments.WARNING_BELOW_DAYS).alias("warning_items"),
        F.avg(days).alias("avg_days_left"),
    )


def replenishment_trigger(items: DataFrame, alerts: DataFrame) -> DataFrame:
    """Items that run out within the critical limit or that sell unusually fast.

    ``alerts`` is ``velocity_alert``; an item counts as fast if its product's
    latest alert falls on the latest day that any product was alerted.
    """
    latest = alerts.agg(F.max("day")).scalar()
    fast = alerts.groupBy("product_id").agg(F.max("day").alias("last_alert"))
    soon = F.coalesce(F.col("days_left") < segments.CRITICAL_BELOW_DAYS, F.lit(False))
    judged = items.join(fast, "product_id", "left").select(
        "branch_id",
        "product_id",
        "days_left",
        soon.alias("runs_out"),
        F.coalesce(F.col("last_alert") == latest, F.lit(False)).alias("sells_fast"),
    )
    return judged.filter(F.col("runs_out") | F.col("sells_fast"))
