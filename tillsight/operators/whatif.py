"""Baseline metrics and the closed-form projection of what-if scenarios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.counts import distinct
from ..functions.recency import days_before_latest, sold_since
from ..functions.scalars import attach

BASELINE_DAYS = 90
# Effects per percent of price (p), discount (d), inventory (i),
# workforce (w) and reallocation (r), their limits and the risk weights.
VOLUME_EFFECT = {"p": -1.5, "d": 1.8, "i": 0.3}
VOLUME_LIMITS = (-0.80, 0.80)
CUSTOMER_EFFECT = {"p": -0.5, "d": 0.7, "w": 0.25}
CUSTOMER_LIMITS = (-0.80, 1.00)
WORKFORCE_EFFECT = 0.0008
REALLOCATION_EFFECT = 0.0001
PRICE_RISK = 0.50
DISCOUNT_RISK = 0.35
SUPPLY_RISK = 0.15
MARGIN_RISK = 25
HIGH_RISK_ABOVE = 40
MEDIUM_RISK_ABOVE = 20
OPTIMIZED_ABOVE = 15
IMPROVING_ABOVE = 5
BUSY_DISCOUNT_ABOVE = 20
BUSY_WORKFORCE_ABOVE = 15


def baseline_metrics(
    sales: DataFrame,
    products: DataFrame,
    as_of: Column | None = None,
    days: int = BASELINE_DAYS,
    start: Column | None = None,
    by: Sequence[str] = (),
    rsd: float | None = None,
) -> DataFrame:
    """Totals and line means of the last ``days`` days before ``as_of``.

    ``as_of`` defaults to the latest sale; ``start`` gives the first time itself.  With ``by`` there is a row per
    group, else exactly one row.  With ``rsd`` invoices and customers are
    counted by sketches of that error.
    """
    if start is not None:
        pass
    elif as_of is None:
        start = days_before_latest(sales, days)
    else:
        start = as_of - F.expr(f"INTERVAL {int(days)} DAYS")
    lines = sold_since(sales, start).join(
        products.select("product_id", "price_jod", "cost_jod"), "product_id"
    )
    price, cost = _line_mean("price_jod"), _line_mean("cost_jod")
    margin = F.col("price_jod") - F.col("cost_jod")
    metrics = lines.groupBy(*by).agg(
        F.coalesce(F.sum("net_amount"), F.lit(0)).alias("total_revenue"),
        price.alias("avg_price"),
        cost.alias("avg_cost"),
        _line_mean(margin).alias("avg_margin"),
        distinct("transaction_id", rsd).alias("total_transactions"),
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("total_units"),
        distinct("customer_id", rsd).alias("total_customers"),
    )
    share = F.when(F.col("avg_price") > 0, F.col("avg_margin") / F.col("avg_price")).otherwise(0.0)
    return metrics.withColumn("margin_pct", share)


def _line_mean(value: Column | str) -> Column:
    mean = F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
    return F.coalesce(mean, F.lit(0.0))


def _clamped(effects: dict[str, float], limits: tuple[float, float]) -> Column:
    total = sum((F.col(name) * weight for name, weight in effects.items()), F.lit(0.0)) / 100
    return F.greatest(F.lit(limits[0]), F.least(F.lit(limits[1]), total))


def scenario_impact(scenarios: DataFrame, baseline: DataFrame, on: str | None = None) -> DataFrame:
    """Project every scenario from the baseline.

    A one-row baseline reaches the scenarios as a scalar subquery.  With
    ``on``, scenarios name a group (for example ``branch_id``) and join the
    baseline row of that group.
    """
    if on is None:
        based = attach(scenarios, baseline, "base")
    else:
        groups = baseline.select(on, F.struct(*[c for c in baseline.columns if c != on]).alias("base"))
        based = scenarios.join(groups, on)
    base = {
        name: F.col(f"base.{name}").cast("double")
        for name in ("total_revenue", "total_units", "total_customers", "avg_price", "avg_cost")
    }
    p, d, w, r = (F.col(name) for name in "pdwr")
    projected = based.withColumns(
        {
            "net_price": base["avg_price"] * (1 + p / 100) * (1 - d / 100),
            "volume_delta": _clamped(VOLUME_EFFECT, VOLUME_LIMITS),
            "customer_delta": _clamped(CUSTOMER_EFFECT, CUSTOMER_LIMITS),
            "effective_cost": base["avg_cost"] * (1 - w * WORKFORCE_EFFECT),
        }
    ).withColumns(
        {
            "units": (base["total_units"] * (1 + F.col("volume_delta"))).cast("bigint"),
            "customers": (base["total_customers"] * (1 + F.col("customer_delta"))).cast("bigint"),
            "margin_alert": F.col("net_price") < F.col("effective_cost"),
        }
    )
    uplift = (1 + w * WORKFORCE_EFFECT) * (1 + r * REALLOCATION_EFFECT)
    base_profit = (base["avg_price"] - base["avg_cost"]) * base["total_units"]
    margin_risk = F.when(F.col("margin_alert"), F.lit(MARGIN_RISK)).otherwise(F.lit(0))
    scored = projected.withColumns(
        {
            "revenue": F.col("net_price") * F.col("units") * uplift,
            "profit_delta": (F.col("net_price") - F.col("effective_cost")) * F.col("units") - base_profit,
            "risk_score": p * PRICE_RISK + d * DISCOUNT_RISK + (100 - r) * SUPPLY_RISK + margin_risk,
        }
    )
    revenue = base["total_revenue"]
    change = F.when(revenue > 0, (F.col("revenue") - revenue) / revenue * 100).otherwise(0.0)
    keys = ["scenario_id"] + ([on] if on else [])
    return scored.select(
        *keys,
        "net_price",
        "units",
        "customers",
        base["total_customers"].cast("bigint").alias("base_customers"),
        "revenue",
        "profit_delta",
        "margin_alert",
        F.when(w > OPTIMIZED_ABOVE, "Optimized")
        .when(w > IMPROVING_ABOVE, "Improving")
        .otherwise("Baseline")
        .alias("efficiency"),
        F.when((d > BUSY_DISCOUNT_ABOVE) | (w > BUSY_WORKFORCE_ABOVE), "High Traffic")
        .otherwise("Normal")
        .alias("traffic"),
        "risk_score",
        F.when(F.col("risk_score") > HIGH_RISK_ABOVE, "High")
        .when(F.col("risk_score") > MEDIUM_RISK_ABOVE, "Medium")
        .otherwise("Low")
        .alias("risk"),
        change.alias("revenue_change_pct"),
    )
