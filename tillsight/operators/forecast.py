"""Sales, holiday and customer forecasts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import segments
from ..functions.boosting import boosted_next
from ..sources.readers import resolve_forecast_columns

HORIZON_DAYS = 7
# Forecast events in report order, the default for an event
# without earlier years, the growth rate and the floors per age band.
FORECAST_EVENTS = ("Eid Al-Fitr Season", "Eid Al-Adha Season", "Christmas Season")
DEFAULT_EVENT_REVENUE = 550000.0
ANNUAL_GROWTH = 0.15
GROWTH_FLOORS = (("Adult (41-55)", 122), ("Middle (28-40)", 122), ("Young (19-27)", 91))
FLOOR_BELOW = 10
CURRENT_MONTH = 4
MIN_HISTORY_MONTHS = 3


def _line(y: Column, x: Column, at: Column) -> Column:
    """Least-squares value at ``at``; the mean when the slope is undefined."""
    slope = F.coalesce(F.regr_slope(y, x), F.lit(0.0))
    return F.regr_avgy(y, x) + slope * (at - F.regr_avgx(y, x))


def quoted(name: str) -> Column:
    """A column by its whole name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def daily_sales_forecast(table: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Linear trend of daily sales, continued for the next days.

    ``table`` may be any frame with a date-like and a sales-like column.
    Fewer than two days give no forecast; NaN and what is no number are skipped.
    """
    date_column, sales_column = resolve_forecast_columns(table.columns)
    daily = (
        table.select(
            F.to_date(quoted(date_column)).alias("day"), quoted(sales_column).try_cast("double").alias("sales")
        )
        .filter(F.col("day").isNotNull())
        .withColumn("sales", F.nanvl("sales", F.lit(None)))
        .groupBy("day")
        .agg(F.coalesce(F.sum("sales"), F.lit(0)).cast("double").alias("sales"))
    )
    x = F.unix_date("day").cast("double")
    fit = daily.agg(
        F.count("*").alias("days"),
        F.max("day").alias("last_day"),
        F.regr_slope("sales", x).alias("slope"),
        F.regr_avgx("sales", x).alias("mean_x"),
        F.regr_avgy("sales", x).alias("mean_y"),
    ).filter(F.col("days") >= 2)
    ahead = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn(
        "date", F.date_add("last_day", F.col("step"))
    )
    return ahead.select(
        "date",
        (F.col("mean_y") + F.col("slope") * (F.unix_date("date") - F.col("mean_x"))).alias(
            "predicted_sales"
        ),
    )


def holiday_forecast(performance: DataFrame, target_year: int) -> DataFrame:
    """Holiday revenue by year with a linear forecast for the target year.

    Actual rows of the target year stay next to the forecast.
    """
    net, year = F.col("net_amount").cast("double"), F.col("year").cast("double")
    fits = []
    for order, event in enumerate(FORECAST_EVENTS, start=1):
        past = (F.col("event") == event) & (F.col("year") < target_year)
        predicted = _line(F.when(past, net), F.when(past, year), F.lit(float(target_year)))
        fits.append(
            F.struct(
                F.lit(target_year).alias("year"),
                F.lit(event).alias("event"),
                F.coalesce(predicted, F.lit(DEFAULT_EVENT_REVENUE)).alias("net_amount"),
                F.lit("forecast").alias("kind"),
                F.lit(order).alias("event_order"),
            )
        )
    # One filter for both readers, so that they share the aggregated sales.
    performance = performance.filter(F.col("event").isin(*FORECAST_EVENTS))
    forecast = performance.agg(F.array(*fits).alias("fits")).select(F.inline("fits"))
    actual = performance.select(
        "year",
        "event",
        net.alias("net_amount"),
        F.lit("actual").alias("kind"),
        segments.position(F.col("event"), FORECAST_EVENTS).cast("int").alias("event_order"),
    )
    return actual.unionByName(forecast).orderBy("event_order", "year", "kind")


def monthly_new_customers(customers: DataFrame, ref_year: int) -> DataFrame:
    """New customers per age band and month, the series that the growth forecast continues."""
    return (
        customers.filter(F.col("join_date").isNotNull())
        .select(
            segments.age_band(F.col("birth_date"), ref_year).alias("segment"),
            F.trunc("join_date", "month").alias("month"),
        )
        .filter(F.col("segment").isNotNull())
        .groupBy("segment", "month")
        .agg(F.count("*").alias("customers"))
    )


def customer_growth_forecast(customers: DataFrame, ref_year: int, current_month: int = CURRENT_MONTH) -> DataFrame:
    """Next month's new customers per age band, beside those of the current month.

    A band's series holds one count per month with customers, in order.
    ``fitted`` is what the trees say, NULL for a band without customers; the
    forecast is its whole part, or a floor if that is small.
    """
    point = F.struct("month", "customers")
    series = (
        monthly_new_customers(customers, ref_year)
        .groupBy("segment")
        .agg(
            F.sum(F.when(F.month("month") == current_month, F.col("customers"))).alias("actual"),
            F.sort_array(F.collect_list(point)).alias("months"),
        )
        .select("segment", "actual", F.transform("months", lambda m: m["customers"].cast("double")).alias("series"))
    )
    total = F.aggregate("series", F.lit(0.0), lambda acc, y: acc + y)
    next_value = F.when(F.size("series") >= MIN_HISTORY_MONTHS, boosted_next(F.col("series"))).otherwise(
        F.try_divide(total, F.size("series").cast("double"))
    )
    forecast = series.select("segment", "actual", next_value.alias("fitted"))
    floors = customers.sparkSession.createDataFrame(
        pa.Table.from_pylist([{"segment": name, "floor": floor} for name, floor in GROWTH_FLOORS])
    )
    raw = F.coalesce(F.col("fitted").cast("bigint"), F.lit(0))
    return floors.join(forecast, "segment", "left").select(
        "segment",
        F.coalesce("actual", F.lit(0)).alias("actual"),
        F.when(raw < FLOOR_BELOW, F.col("floor")).otherwise(raw).alias("forecast"),
        "fitted",
    )


def customer_base_projection(
    customers: DataFrame, target_year: int, growth: float = ANNUAL_GROWTH
) -> DataFrame:
    """New and total customers by join year, and the compounded projection."""
    yearly = (
        customers.filter(F.col("join_date").isNotNull())
        .groupBy(F.year("join_date").alias("join_year"))
        .agg(F.count("*").alias("new_customers"))
    )
    # One row per calendar year, so one window group is enough.
    years = W.partitionBy(F.lit(0))
    running = years.orderBy("join_year").rowsBetween(W.unboundedPreceding, 0)
    last_year, base = F.max("join_year").over(years), F.sum("new_customers").over(years)
    projected = base * F.pow(F.lit(1 + growth), F.lit(target_year) - last_year)
    return yearly.select(
        "join_year",
        "new_customers",
        F.sum("new_customers").over(running).alias("total_customers"),
        F.lit(target_year).alias("target_year"),
        projected.cast("bigint").alias("projected_customers"),
    ).orderBy("join_year")
