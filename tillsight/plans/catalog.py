"""Every analysis by name, run over the test tables.

Outputs are prepared for comparison with a second engine: money becomes
double and ratios are rounded, as doubles differ in the last digits by the
order of addition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import monitoring
from ..session import new_shared_path
from ..sources import tpch_star as tpch
from ..streaming import daily_revenue, first_reach, late_rows
from .analyses import ANALYSES, Settings, scenario_impact

DAILY_TARGET = 600.0
SETTINGS = Settings(
    projection_year=2003,
    forecast_year=tpch.HOLIDAY_FORECAST_YEAR,
    holidays=tpch.HOLIDAYS,
    monitored_sections=tpch.MONITORED_SECTIONS,
    daily_target=DAILY_TARGET,
)
REF_YEAR = SETTINGS.ref_year

# Analyses that need a time of day run over the purchase events, whose star
# has the same dimensions.
BY_TIME_OF_DAY = ("daily_target_attainment", "trading_band_sales", "hourly_staffing", "staff_reallocation")

RATIO_PLACES = 6
# Amounts computed in doubles keep fewer decimals than ratios do.
LARGE_PLACES = 2
LARGE = ("daily_sales_forecast", "holiday_forecast", "discount_sensitivity")

Query = Callable[[SparkSession, str], DataFrame]


def comparable(df: DataFrame, places: int = RATIO_PLACES) -> DataFrame:
    """Money to double, other doubles rounded."""

    def output(field: T.StructField):
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.DoubleType):
            value = F.round(value, places)
        return value.alias(field.name)

    return df.select(*[output(f) for f in df.schema.fields])


def _query(name: str, build: Callable = tpch.tpch_star) -> Query:
    places = LARGE_PLACES if name in LARGE else RATIO_PLACES
    return lambda spark, sf_dir: comparable(ANALYSES[name](build(spark, sf_dir), SETTINGS), places)


def _scenario_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scenario_impact(tpch.tpch_star(spark, sf_dir), tpch.scenarios(spark, sf_dir), SETTINGS)
    return comparable(found, LARGE_PLACES)


def _price_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(monitoring.price_string_clean(tpch.price_strings(spark, sf_dir)))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = spark.readStream.schema(tpch.table_schema("events"))
    return source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the purchase events as a stream until all are taken in."""
    daily = daily_revenue.stream_daily_revenue(tpch.purchases(_event_stream(spark, sf_dir)), DAILY_TARGET)
    path = new_shared_path(spark, "daily-revenue")
    daily_revenue.start_daily_revenue(
        daily, f"{path}/table", f"{path}/checkpoint", available_now=True
    ).awaitTermination()
    return comparable(daily_revenue.read_daily_revenue(spark, f"{path}/table"))


def _first_reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the purchase events as a stream; the days that its watermark has closed."""
    alerts = first_reach.first_reached(tpch.purchases(_event_stream(spark, sf_dir)), DAILY_TARGET)
    path = new_shared_path(spark, "first-reached")
    first_reach.start_first_reached(alerts, f"{path}/table", f"{path}/checkpoint", available_now=True).awaitTermination()
    return comparable(first_reach.read_closed_days(spark, f"{path}/table"))


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads the purchase events as a stream that adds up its batches."""
    path = new_shared_path(spark, "counted-revenue")
    lines = tpch.purchases(_event_stream(spark, sf_dir))
    late_rows.start_counted_revenue(lines, f"{path}/table", f"{path}/checkpoint", available_now=True).awaitTermination()
    return comparable(late_rows.read_counted_revenue(spark, f"{path}/table", DAILY_TARGET))


QUERIES: dict[str, Query] = {
    name: _query(name, tpch.purchase_star if name in BY_TIME_OF_DAY else tpch.tpch_star)
    for name in ANALYSES
} | {
    "rfm_scores_purchases": _query("rfm_scores", tpch.purchase_star),
    "scenario_impact": _scenario_impact,
    "stream_daily_revenue": _stream,
    "stream_first_reached": _first_reached,
    "stream_counted_revenue": _counted,
    "price_string_clean": _price_strings,
}
