"""Every named analysis over any star: ``ANALYSES[name](star, settings)``.

Each entry asks the star for the fact columns it needs and nothing else.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.recency import days_before_latest
from ..operators import customers, forecast, inventory, monitoring, sales, segmentation, whatif
from ..operators import root_cause as rca
from ..session import drop_path, new_shared_path
from ..sources.holidays import HOLIDAYS
from ..sources.readers import Star
from ..sources.schemas import SALE_DATE
from .root_cause import RootCauseRun


@dataclass(frozen=True)
class Settings:
    """Years, targets and lists that the analyses depend on."""

    ref_year: int = 2026
    projection_year: int = 2026
    forecast_year: int = 2026
    current_month: int = forecast.CURRENT_MONTH
    holidays: Sequence[tuple[str, Sequence[tuple[str, str]]]] = HOLIDAYS
    monitored_sections: Sequence[str] = rca.MONITORED_SECTIONS
    judged_days: tuple[dt.date, dt.date] | None = None
    daily_target: float = 70_000.0
    refill_days: int = 7
    ledger_days: int = 365
    moved_staff_pct: int = monitoring.MOVED_PCT
    # Quartiles by sketch with a rank error of 1 / this; exact by default.
    quartile_accuracy: int | None = None
    # The time that recent windows end at; by default that of the latest sale.
    as_of: dt.datetime | None = None


Analysis = Callable[[Star, Settings], DataFrame]


def _enriched(star: Star) -> DataFrame:
    lines = star.sales(
        "transaction_id",
        "timestamp",
        "branch_id",
        "product_id",
        "employee_id",
        "customer_id",
        "quantity",
        "gross_amount",
        "discount_amount",
        "net_amount",
    )
    return sales.sales_enriched(lines, star.products, star.sections, star.branches)


def _overview(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("product_id", "quantity", "net_amount", "transaction_id")
    return sales.overview_kpis(lines, star.products)


def _daily_net(star: Star) -> DataFrame:
    return (
        star.sales("timestamp", "net_amount")
        .groupBy(F.to_date("timestamp").alias("order_date"))
        .agg(F.sum("net_amount").alias("total_net"))
    )


def _holidays(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("timestamp", "quantity", "net_amount")
    calendar = segmentation.holiday_calendar(lines.sparkSession, settings.holidays)
    return segmentation.holiday_performance(lines, calendar)


def _holiday_forecast(star: Star, settings: Settings) -> DataFrame:
    return forecast.holiday_forecast(_holidays(star, settings), settings.forecast_year)


def activity(star: Star, settings: Settings = Settings()) -> DataFrame:
    """The activity per customer, for scores, reports and churn alike."""
    lines = star.dated_sales("customer_id", "timestamp", "net_amount")
    return customers.recent_activity(lines, as_of=settings.as_of, last_day=star.last_day())


class CustomerReports:
    """Scores, segment reports and churn over one activity per customer.

    The activity is written to the shared folder when the first of them is asked
    for, and they all read it from there; ``close`` drops it.  Results read after
    that, or of later sales, need reports of their own.
    """

    def __init__(self, star: Star, settings: Settings = Settings()) -> None:
        self.star = star
        self.settings = settings
        self._path: str | None = None

    @cached_property
    def activity(self) -> DataFrame:
        live = activity(self.star, self.settings)
        self._path = new_shared_path(live.sparkSession, "customer-activity")
        live.write.parquet(self._path)
        return live.sparkSession.read.schema(live.schema).parquet(self._path)

    def scores(self) -> DataFrame:
        return customers.score_activity(self.activity, self.settings.quartile_accuracy)

    def segment_summary(self) -> DataFrame:
        return customers.rfm_segment_summary(self.scores())

    def segment_revenue(self) -> DataFrame:
        return customers.rfm_segment_revenue(self.scores())

    def churn_by_segment(self) -> DataFrame:
        return customers.churn_of_activity(self.activity, self.settings.quartile_accuracy)

    def close(self) -> None:
        if self._path is not None:
            drop_path(self.activity.sparkSession, self._path)
            self._path = None

    def __enter__(self) -> CustomerReports:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _scores(star: Star, settings: Settings) -> DataFrame:
    return customers.score_activity(activity(star, settings), settings.quartile_accuracy)


def _since(star: Star, settings: Settings, lines: DataFrame, days: int) -> Column:
    return days_before_latest(lines, days, settings.as_of, star.last_day())


def _stockout(star: Star) -> DataFrame:
    """Of a fact stored by days, the number of days comes from the folders' values."""
    lines = star.dated_sales("branch_id", "product_id", "quantity", "timestamp")
    days = None
    if SALE_DATE in lines.columns:
        days = lines.agg(F.count_distinct(SALE_DATE)).scalar()
    return inventory.stockout_days(lines, star.inventory, star.products, days)


def _refill(star: Star) -> DataFrame:
    """Two folds, by item and by product and day: a common one by all three hardly shrinks the lines."""
    alerts = monitoring.velocity_alert(star.sales("product_id", "timestamp", "quantity"))
    return inventory.replenishment_trigger(_stockout(star), alerts)


def _hotspots(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("customer_id", "timestamp", "quantity", "net_amount")
    return segmentation.season_age_hotspots(lines, star.customers, settings.ref_year)


def _affinity(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("customer_id", "product_id", "quantity")
    return segmentation.age_price_affinity(lines, star.customers, star.products, settings.ref_year)


def _age_quantity(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("customer_id", "quantity")
    return segmentation.age_segment_quantity(lines, star.customers, settings.ref_year)


def _season_age(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("customer_id", "timestamp", "net_amount")
    return segmentation.season_age_revenue(lines, star.customers, settings.ref_year)


def _trigger(star: Star, settings: Settings) -> DataFrame:
    """Needs only net sales per day, so it skips the root-cause rollup."""
    lines = star.sales("timestamp", "net_amount").filter(F.col("timestamp").isNotNull())
    daily = rca.daily_net(lines.withColumn("day", F.to_date("timestamp")))
    return rca.profit_trigger(daily).drop("history")


def _run(build: Callable[[RootCauseRun], DataFrame]) -> Analysis:
    return lambda star, settings: build(
        RootCauseRun(star, settings.monitored_sections, settings.judged_days)
    )


def baseline(star: Star, settings: Settings = Settings(), by: Sequence[str] = ()) -> DataFrame:
    lines = star.dated_sales(
        "product_id", "timestamp", "net_amount", "quantity", "transaction_id", "customer_id", *by
    )
    start = _since(star, settings, lines, whatif.BASELINE_DAYS)
    return whatif.baseline_metrics(lines, star.products, start=start, by=by)


def scenario_impact(star: Star, scenarios: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return whatif.scenario_impact(scenarios, baseline(star, settings))


def _sensitivity(star: Star, settings: Settings) -> DataFrame:
    return sales.discount_sensitivity(star.sales("gross_amount", "discount_amount", "net_amount"))


def _attainment(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("timestamp", "gross_amount")
    return sales.daily_target_attainment(lines, settings.daily_target)


def _hourly(star: Star, settings: Settings) -> DataFrame:
    return monitoring.hourly_staffing(star.sales("timestamp", "net_amount", "employee_id"))


def _velocity(star: Star, settings: Settings) -> DataFrame:
    return monitoring.velocity_alert(star.sales("product_id", "timestamp", "quantity"))


def _replenishment(star: Star, settings: Settings) -> DataFrame:
    lines = star.dated_sales("branch_id", "product_id", "timestamp", "quantity")
    snapshot = _since(star, settings, lines, settings.refill_days)
    return monitoring.replenishment_list(lines, star.inventory, snapshot)


def _ledger(star: Star, settings: Settings) -> DataFrame:
    lines = star.dated_sales("branch_id", "product_id", "timestamp", "quantity")
    snapshot = _since(star, settings, lines, settings.ledger_days)
    return monitoring.replenishment_events(lines, star.inventory, snapshot)


def _reallocation(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("branch_id", "timestamp", "employee_id", "net_amount")
    return monitoring.staff_reallocation(lines, settings.moved_staff_pct)


def _rolling(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("product_id", "timestamp", "quantity", "net_amount", "transaction_id")
    return monitoring.rolling_metrics(lines, star.products)


def _quiet_stock(star: Star, settings: Settings) -> DataFrame:
    lines = star.dated_sales("branch_id", "product_id", "timestamp")
    since = _since(star, settings, lines, monitoring.QUIET_DAYS)
    return monitoring.low_stock_zero_sales(lines, star.inventory, since)


def _low_margin(star: Star, settings: Settings) -> DataFrame:
    lines = star.sales("transaction_id", "product_id", "branch_id", "quantity", "net_amount")
    return monitoring.low_margin_flag(lines, star.products)


ANALYSES: dict[str, Analysis] = {
    "sales_enriched": lambda star, _: _enriched(star),
    "overview_kpis": _overview,
    "branch_revenue": lambda star, _: sales.branch_revenue(
        star.sales("branch_id", "net_amount"), star.branches
    ),
    "daily_sales_forecast": lambda star, _: forecast.daily_sales_forecast(_daily_net(star)),
    "holiday_forecast": _holiday_forecast,
    "monthly_new_customers": lambda star, s: forecast.monthly_new_customers(star.customers, s.ref_year),
    "customer_growth_forecast": lambda star, s: forecast.customer_growth_forecast(
        star.customers, s.ref_year, s.current_month
    ),
    "customer_base_projection": lambda star, s: forecast.customer_base_projection(
        star.customers, s.projection_year
    ),
    "age_segment_quantity": _age_quantity,
    "price_tier_revenue": lambda star, _: segmentation.price_tier_revenue(
        star.sales("product_id", "quantity"), star.products
    ),
    "season_volume": lambda star, _: segmentation.season_volume(star.sales("timestamp", "quantity")),
    "season_age_hotspots": _hotspots,
    "age_price_affinity": _affinity,
    "season_age_revenue": _season_age,
    "holiday_performance": _holidays,
    "stockout_days": lambda star, _: _stockout(star),
    "stockout_risk": lambda star, _: inventory.stockout_risk(_stockout(star)),
    "replenishment_trigger": lambda star, _: _refill(star),
    "stockout_kpis": lambda star, _: inventory.stockout_kpis(_stockout(star)),
    "rfm_scores": _scores,
    "rfm_segment_summary": lambda star, s: customers.rfm_segment_summary(_scores(star, s)),
    "rfm_segment_revenue": lambda star, s: customers.rfm_segment_revenue(_scores(star, s)),
    "churn_by_segment": lambda star, s: customers.churn_of_activity(activity(star, s), s.quartile_accuracy),
    "rca_profit_trigger": _trigger,
    "rca_worst_branch": _run(lambda run: run.worst_branch().drop("history")),
    "rca_worst_section": _run(
        lambda run: run.worst_section().select(
            "day",
            "branch_id",
            "section_name",
            "section_avg_same_day",
            "section_day_net",
            "section_drop",
        )
    ),
    "rca_floor_stock": _run(RootCauseRun.floor_stock),
    "rca_discount_ratio": _run(RootCauseRun.discount_ratio),
    "rca_staffing": _run(RootCauseRun.staffing),
    "rca_profit_diagnosis": _run(RootCauseRun.profit_diagnosis),
    "rca_section_contribution": _run(RootCauseRun.section_contribution),
    "rca_section_anomalies": _run(
        lambda run: run.section_anomalies().select(
            "branch_id",
            "branch_name",
            "section_name",
            "day",
            "contribution",
            "expected_contribution",
            "deviation",
        )
    ),
    "rca_section_diagnosis": _run(RootCauseRun.section_diagnosis),
    "baseline_metrics": baseline,
    "discount_sensitivity": _sensitivity,
    "daily_target_attainment": _attainment,
    "trading_band_sales": lambda star, _: sales.trading_band_sales(
        star.sales("timestamp", "gross_amount")
    ),
    "hourly_staffing": _hourly,
    "velocity_alert": _velocity,
    "replenishment_list": _replenishment,
    "replenishment_events": _ledger,
    "staff_reallocation": _reallocation,
    "rolling_metrics": _rolling,
    "low_stock_zero_sales": _quiet_stock,
    "low_margin_flag": _low_margin,
    "anomaly_scope": _run(RootCauseRun.anomaly_scope),
}
