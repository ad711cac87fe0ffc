"""Sales by age band, price tier, season and holiday."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import segments
from ..sources.schemas import HOLIDAY_CALENDAR

REGULAR_DAYS = "Regular Days"


def _banded(customers: DataFrame, ref_year: int, with_range: bool = True) -> DataFrame:
    """Customers that fall in one of the age bands."""
    return customers.select(
        "customer_id", segments.age_band(F.col("birth_date"), ref_year, with_range).alias("age_segment")
    ).filter(F.col("age_segment").isNotNull())


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0)).alias(column)


def age_segment_quantity(sales: DataFrame, customers: DataFrame, ref_year: int) -> DataFrame:
    per_customer = sales.groupBy("customer_id").agg(F.sum("quantity").alias("quantity"))
    return (
        per_customer.join(_banded(customers, ref_year), "customer_id")
        .groupBy("age_segment")
        .agg(_total("quantity"))
        .orderBy(F.desc("quantity"), "age_segment")
    )


def price_tier_revenue(sales: DataFrame, products: DataFrame) -> DataFrame:
    """Units and list-price revenue by price tier, with the revenue share."""
    per_product = sales.groupBy("product_id").agg(F.sum("quantity").alias("quantity"))
    priced = products.filter(F.col("price_jod").isNotNull()).select(
        "product_id", "price_jod", segments.price_tier(F.col("price_jod")).alias("price_tier")
    )
    tiers = (
        per_product.join(priced, "product_id")
        .groupBy("price_tier")
        .agg(
            _total("quantity"),
            F.coalesce(F.sum(F.col("quantity") * F.col("price_jod")), F.lit(0)).alias("revenue"),
        )
    )
    # At most five rows reach this window.
    everything = W.partitionBy(F.lit(0))
    share = F.try_divide(F.col("revenue").cast("double"), F.sum("revenue").over(everything).cast("double"))
    return tiers.withColumn("revenue_share_pct", share * 100)


def season_volume(sales: DataFrame) -> DataFrame:
    """Units and lines by season."""
    return (
        sales.filter(F.col("timestamp").isNotNull())
        .groupBy(segments.season(F.col("timestamp")).alias("season"))
        .agg(_total("quantity"), F.count("*").alias("transactions"))
        .orderBy(segments.position(F.col("season"), segments.SEASONS))
    )


def season_age_hotspots(sales: DataFrame, customers: DataFrame, ref_year: int) -> DataFrame:
    per_customer = sales.groupBy(
        "customer_id", segments.season(F.col("timestamp")).alias("season")
    ).agg(F.sum("quantity").alias("quantity"), F.sum("net_amount").alias("net_amount"))
    return (
        per_customer.join(_banded(customers, ref_year), "customer_id")
        .groupBy("season", "age_segment")
        .agg(_total("quantity"), _total("net_amount"))
    )


def age_price_affinity(
    sales: DataFrame, customers: DataFrame, products: DataFrame, ref_year: int
) -> DataFrame:
    """Units as a price tier by age band matrix.

    An unpriced product counts as the highest tier.
    """
    tiers = products.select("product_id", segments.price_tier(F.col("price_jod")).alias("price_tier"))
    per_customer = (
        sales.join(tiers, "product_id")
        .groupBy("customer_id", "price_tier")
        .agg(F.sum("quantity").alias("quantity"))
    )
    names = [name for name, _, _ in segments.AGE_BANDS]
    return (
        per_customer.join(_banded(customers, ref_year, with_range=False), "customer_id")
        .groupBy("price_tier")
        .pivot("age_segment", names)
        .agg(F.sum("quantity"))
        .fillna(0, names)
        .orderBy(segments.position(F.col("price_tier"), segments.PRICE_TIERS))
    )


def season_age_revenue(sales: DataFrame, customers: DataFrame, ref_year: int) -> DataFrame:
    """Net revenue as a season by age band matrix."""
    per_customer = sales.groupBy(
        "customer_id", segments.season(F.col("timestamp")).alias("season")
    ).agg(F.sum("net_amount").alias("net_amount"))
    names = [name for name, _, _ in segments.AGE_BANDS]
    matrix = (
        per_customer.join(_banded(customers, ref_year, with_range=False), "customer_id")
        .groupBy("season")
        .pivot("age_segment", names)
        .agg(F.sum("net_amount"))
    )
    return matrix.select("season", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]).orderBy(
        segments.position(F.col("season"), segments.SEASONS)
    )


def holiday_calendar(
    spark: SparkSession, events: Sequence[tuple[str, Sequence[tuple[str, str]]]]
) -> DataFrame:
    """A calendar from (event, ranges) pairs; a later event has priority."""
    rows = [
        {"priority": priority, "event": event, "start_date": start, "end_date": end}
        for priority, (event, ranges) in enumerate(events, start=1)
        for start, end in ranges
    ]
    # An Arrow table becomes a local relation, whose size the planner knows.
    listed = spark.createDataFrame(pa.Table.from_pylist(rows))
    return listed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in HOLIDAY_CALENDAR.fields])


def holiday_performance(sales: DataFrame, calendar: DataFrame) -> DataFrame:
    """Units and net revenue by year and holiday, all else as regular days.

    A range covers its days, the last one only at midnight exactly.  Where
    ranges overlap, the higher priority names the day.  Sales are first
    folded to days, and the calendar is spread to days, so the range join
    becomes an equality join of two frames bounded by the calendar.
    """
    days = (
        sales.filter(F.col("timestamp").isNotNull())
        .groupBy(
            F.to_date("timestamp").alias("day"),
            (F.to_date("timestamp").cast("timestamp_ntz") == F.col("timestamp")).alias("at_midnight"),
        )
        .agg(F.sum("quantity").alias("quantity"), F.sum("net_amount").alias("net_amount"))
    )
    covered = (
        calendar.select(
            "priority",
            "event",
            "end_date",
            F.explode(F.sequence("start_date", "end_date")).alias("day"),
        )
        .select(
            "priority",
            "event",
            "day",
            F.explode(
                F.when(F.col("day") < F.col("end_date"), F.array(F.lit(True), F.lit(False))).otherwise(
                    F.array(F.lit(True))
                )
            ).alias("at_midnight"),
        )
        .groupBy("day", "at_midnight")
        .agg(F.max_by("event", "priority").alias("event"))
    )
    return (
        days.join(covered, ["day", "at_midnight"], "left")
        .groupBy(
            F.year("day").alias("year"),
            F.coalesce("event", F.lit(REGULAR_DAYS)).alias("event"),
        )
        .agg(_total("quantity"), _total("net_amount"))
        .orderBy(F.desc("year"), F.desc("net_amount"), "event")
    )
