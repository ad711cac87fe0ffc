"""Classification rules as native Column expressions.

Every rule compiles to one CASE WHEN, so it stays inside code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Segment names, limits and report order.
AGE_BANDS = (("Young", 19, 27), ("Middle", 28, 40), ("Adult", 41, 55))
PRICE_TIERS = ("Budget", "Standard", "Upper", "Premium", "Luxury")
BUDGET_BELOW = 25
STANDARD_UP_TO = 45
UPPER_UP_TO = 80
PREMIUM_UP_TO = 150
SEASONS = ("Winter", "Spring", "Summer", "Fall")
PEAK_HOURS = (20, 22)
OFF_PEAK_HOURS = (11, 19)
RFM_SEGMENTS = ("Champions", "Loyal", "At-Risk", "Lost")
CHAMPIONS_FROM = 10
LOYAL_FROM = 7
AT_RISK_FROM = 5
CRITICAL_BELOW_DAYS = 7
WARNING_BELOW_DAYS = 14


def age_band(birth_date: Column, ref_year: int, with_range: bool = True) -> Column:
    """Band by calendar-year age; NULL outside 19-55 or without a birth date."""
    age = F.lit(ref_year) - F.year(birth_date)
    band = F.lit(None).cast("string")
    for name, low, high in AGE_BANDS:
        label = f"{name} ({low}-{high})" if with_range else name
        band = F.when(age.between(low, high), label).otherwise(band)
    return band


def price_tier(price: Column) -> Column:
    """Tier of a list price.  A missing price falls through to the last tier."""
    return (
        F.when(price < BUDGET_BELOW, PRICE_TIERS[0])
        .when(price <= STANDARD_UP_TO, PRICE_TIERS[1])
        .when(price <= UPPER_UP_TO, PRICE_TIERS[2])
        .when(price <= PREMIUM_UP_TO, PRICE_TIERS[3])
        .otherwise(PRICE_TIERS[4])
    )


def season(ts: Column) -> Column:
    """Calendar quarter under its season name, January to March being winter.

    A missing time falls through to the last season.
    """
    quarter = F.quarter(ts)
    return (
        F.when(quarter == 1, SEASONS[0])
        .when(quarter == 2, SEASONS[1])
        .when(quarter == 3, SEASONS[2])
        .otherwise(SEASONS[3])
    )


def trading_band(ts: Column) -> Column:
    hour = F.hour(ts)
    return (
        F.when(hour.between(*PEAK_HOURS), "peak")
        .when(hour.between(*OFF_PEAK_HOURS), "off_peak")
        .otherwise("closed")
    )


def rfm_segment(score: Column) -> Column:
    return (
        F.when(score >= CHAMPIONS_FROM, RFM_SEGMENTS[0])
        .when(score >= LOYAL_FROM, RFM_SEGMENTS[1])
        .when(score >= AT_RISK_FROM, RFM_SEGMENTS[2])
        .otherwise(RFM_SEGMENTS[3])
    )


def stockout_level(days_left: Column) -> Column:
    return (
        F.when(days_left < CRITICAL_BELOW_DAYS, "Critical")
        .when(days_left < WARNING_BELOW_DAYS, "Warning")
        .otherwise("OK")
    )


def position(value: Column, order: tuple[str, ...]) -> Column:
    """1-based place of ``value`` in a report order, for sorting."""
    return F.array_position(F.array(*map(F.lit, order)), value)
