"""The root-cause run: findings over one small table of daily sums.

Of a stored star that table is kept, see ``daily_rollup``: only days whose sales
have changed are folded.  Nothing is persisted in the session, so what others
add to the sales is seen by the next run.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from ..functions.recency import sold_before, sold_since
from ..operators import root_cause as rca
from ..sources.readers import Star
from .daily_rollup import COLUMNS, DailyRollup


class RootCauseRun:
    """Analyses over one rollup of ``star``, brought up to date when the run first needs it."""

    def __init__(
        self,
        star: Star,
        monitored: Sequence[str] = rca.MONITORED_SECTIONS,
        days: tuple[dt.date, dt.date] | None = None,
        rollup_path: str | None = None,
    ):
        """Judge every day, or only those from the first to the last of ``days``.

        A limited run reads only the sale lines its days and their history
        need.
        """
        self.star = star
        self.monitored = tuple(monitored)
        self.rollup_path = rollup_path
        self.days = days

    def _sales(self, *columns: str) -> DataFrame:
        sales = self.star.dated_sales(*columns)
        if self.days is None:
            return sales
        first, last = (dt.datetime.combine(day, dt.time()) for day in self.days)
        since = sold_since(sales, F.lit(first - dt.timedelta(days=rca.HISTORY_DAYS)))
        return sold_before(since, F.lit(last + dt.timedelta(days=1)))

    def _judged(self, found: DataFrame) -> DataFrame:
        return found if self.days is None else found.filter(F.col("day") >= F.lit(self.days[0]))

    @cached_property
    def rollup(self) -> DataFrame:
        """The sums per branch, section and day; of a star that isn't stored they are folded by each action."""
        if self.star.versions is None:
            return rca.section_days(self._sales(*COLUMNS), self.star.products, self.star.sections)
        kept = DailyRollup(self.star, self.rollup_path)
        if self.days is None:
            return kept.section_days()
        first, last = self.days
        window = first - dt.timedelta(days=rca.HISTORY_DAYS), last
        # Sales that aren't stored by dates are kept as one.
        found = kept.section_days(window if self.star.dated else None)
        return found.filter(F.col("day").between(*map(F.lit, window)))

    def trigger(self) -> DataFrame:
        return self._judged(rca.profit_trigger(rca.daily_net(self.rollup)))

    def branch_drops(self) -> DataFrame:
        return rca.branch_drops(self.trigger(), self.rollup, self.star.branches)

    def worst_branch(self) -> DataFrame:
        trigger = self.trigger()
        return rca.worst_branch(trigger, rca.branch_drops(trigger, self.rollup, self.star.branches))

    def worst_section(self) -> DataFrame:
        return rca.worst_section(self.worst_branch(), self.rollup)

    def section_floor(self) -> DataFrame:
        return rca.section_floor(self.star.inventory, self.star.products, self.star.sections)

    def floor_stock(self) -> DataFrame:
        return rca.floor_stock(self.worst_section(), self.section_floor())

    def discount_ratio(self) -> DataFrame:
        return rca.discount_ratio(self.worst_branch(), self.rollup)

    def _staffed_sales(self) -> DataFrame:
        return self._sales("branch_id", "timestamp", "employee_id")

    def staffing(self) -> DataFrame:
        return rca.staffing(self.worst_branch(), self._staffed_sales())

    def profit_diagnosis(self) -> DataFrame:
        return rca.profit_diagnosis(self.worst_section(), self.rollup, self._staffed_sales(), self.section_floor())

    def section_contribution(self) -> DataFrame:
        return rca.section_contribution(self.rollup, self.star.branches)

    def section_anomalies(self) -> DataFrame:
        return self._judged(rca.section_anomalies(self.section_contribution(), self.monitored))

    def section_diagnosis(self) -> DataFrame:
        sales = self._sales("branch_id", "product_id", "timestamp", "employee_id", "transaction_id")
        anomalies = self.section_anomalies()
        visits = rca.section_visits(anomalies, sales, self.star.products, self.star.sections)
        return rca.section_diagnosis(anomalies, self.section_floor(), visits)

    def anomaly_scope(self) -> DataFrame:
        return rca.anomaly_scope(self.branch_drops())

    def report(self) -> dict[str, DataFrame]:
        """Both tables of alerts, of days and of sections, over the same rollup."""
        return {"profit_alerts": self.profit_diagnosis(), "section_alerts": self.section_diagnosis()}
