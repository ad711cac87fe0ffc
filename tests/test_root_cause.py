from __future__ import annotations

import datetime as dt

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tillsight.operators import root_cause as rca
from tillsight.plans.root_cause import RootCauseRun
from tillsight.sources import tpch_star
from tillsight.sources.readers import Star

DAY = dt.date(2024, 3, 1)
PRODUCTS = [
    {"product_id": 1, "section_id": 10},
    {"product_id": 2, "section_id": 20},
]


def weeks_before(n: int) -> dt.date:
    return DAY - dt.timedelta(days=7 * n)


def stamp(day: dt.date) -> dt.datetime:
    return dt.datetime.combine(day, dt.time(12))


def run_over(sales, products, sections, branches, inventory) -> RootCauseRun:
    tables = {
        "dim_products": products,
        "dim_sections": sections,
        "dim_branches": branches,
        "central_inventory": inventory,
    }
    return RootCauseRun(Star(sales.select, tables.__getitem__))


@pytest.fixture(scope="module")
def judge(spark):
    def run(history: dict[int, float], today: float):
        days = [(weeks_before(n), float(v)) for n, v in history.items()] + [(DAY, float(today))]
        daily = spark.createDataFrame(days, "day date, net_amount double")
        return rca.profit_trigger(daily).filter(f"day = DATE'{DAY}'").first()

    return run


def test_only_the_last_five_same_weekdays_count(judge):
    row = judge({1: 10, 2: 10, 3: 10, 4: 10, 5: 10, 6: 1000}, 10)
    assert (row.history_days, row.mean_net, row.std_net) == (5, 10.0, 0.0)
    assert sorted(row.history) == [weeks_before(n) for n in (5, 4, 3, 2, 1)]
    assert not row.is_anomaly


def test_a_gap_lets_the_sixth_week_in(judge):
    row = judge({1: 10, 2: 10, 3: 10, 4: 10, 6: 60}, 10)
    assert (row.history_days, row.mean_net) == (5, 20.0)


def test_seven_weeks_back_is_too_old(judge):
    assert judge({7: 10}, 1).history_days == 0


def test_single_history_day_has_no_deviation(judge):
    row = judge({1: 10}, 9)
    assert row.std_net == 0.0 and row.is_anomaly  # 9 < 10 - 2 * 0


def test_no_history_gives_no_verdict(judge):
    row = judge({}, 1)
    assert (row.history_days, row.mean_net, row.drop_pct, row.is_anomaly) == (0, None, None, False)


def test_drop_limit(judge):
    wide = {1: 50, 2: 150}  # mean 100, deviation 50
    assert not judge(wide, 65).is_anomaly
    assert judge(wide, 64.9).is_anomaly


def test_negative_mean_has_no_drop(judge):
    row = judge({1: -10, 2: -30}, -25)
    assert row.drop_pct == 0.0 and not row.is_anomaly


@pytest.fixture(scope="module")
def alert(spark, frame):
    """The diagnosis of DAY for sale lines (day, branch, product, net, ...)."""

    def run(lines, stock=()):
        sales = frame(
            "fact_sales",
            [
                {
                    "timestamp": stamp(day),
                    "branch_id": branch,
                    "product_id": product,
                    "net_amount": net,
                    "employee_id": employee,
                    "discount_amount": discount,
                }
                for day, branch, product, net, employee, discount in lines
            ],
        )
        products = frame("dim_products", PRODUCTS)
        sections = frame(
            "dim_sections",
            [{"section_id": 10, "section_name": "Men"}, {"section_id": 20, "section_name": "Women"}],
        )
        branches = frame(
            "dim_branches",
            [{"branch_id": b, "branch_name": f"B{b}"} for b in (101, 102)],
        )
        inventory = frame(
            "central_inventory",
            [{"branch_id": b, "product_id": p, "floor_qty": q, "total_qty": 50} for b, p, q in stock],
        )
        run = run_over(sales, products, sections, branches, inventory)
        found = run.profit_diagnosis().filter(f"day = DATE'{DAY}'")
        scope = run.anomaly_scope().filter(f"day = DATE'{DAY}'")
        return found.first(), scope.first()

    return run


def test_ties_go_to_the_lowest_branch_and_first_section(alert):
    past = [(weeks_before(n), b, p, 100, 1, 0) for n in (1, 2) for b in (102, 101) for p in (2, 1)]
    found, scope = alert(past + [(DAY, 103, 1, 5, 1, 0)])
    assert (found.branch_id, found.section_name) == (101, "Men")
    assert found.section_drop_pct == 100.0
    assert (scope.branches, scope.fallen_share, scope.scope) == (2, 1.0, "systemic")


def test_missing_history_day_counts_as_zero_for_the_branch(alert):
    past = [(weeks_before(1), 101, 1, 100, 1, 0), (weeks_before(2), 102, 1, 300, 1, 0)]
    found, scope = alert(past + [(DAY, 101, 1, 40, 1, 0), (DAY, 102, 1, 60, 1, 0)])
    # Branch 101: mean 50, fall 0.2; branch 102: mean 150, fall 0.6.
    assert found.branch_id == 102 and found.section_drop_pct == pytest.approx(60.0)
    assert scope.scope == "systemic" and scope.fallen_share == 0.5


def test_low_floor_stock_comes_first(alert):
    past = [(weeks_before(n), 101, 1, 100, e, 30) for n in (1, 2) for e in (1, 2)]
    found, _ = alert(past + [(DAY, 101, 1, 10, 1, None)], stock=[(101, 1, 3), (101, 2, 90)])
    assert found.avg_floor == 3.0 and found.stock_issue and found.discount_issue
    assert found.primary_reason == rca.LOW_FLOOR


def test_discount_before_staffing_and_unknown_stock_is_ample(alert):
    past = [(weeks_before(n), 101, 1, 100, e, 30) for n in (1, 2) for e in (1, 2)]
    found, _ = alert(past + [(DAY, 101, 1, 10, 1, None)])
    assert found.avg_floor is None and not found.stock_issue
    assert found.discount_ratio == pytest.approx(120 / 410)
    assert found.staffing_status == rca.UNDERSTAFFED
    assert found.primary_reason == rca.HIGH_DISCOUNT


def test_staffing_then_mixed(alert):
    past = [(weeks_before(n), 101, 1, 100, e, 0) for n in (1, 2) for e in (1, 2)]
    found, _ = alert(past + [(DAY, 101, 1, 10, 1, 0)], stock=[(101, 1, 9)])
    assert found.primary_reason == rca.STAFF_SHORTAGE
    found, _ = alert(past + [(DAY, 101, 1, 10, e, 0) for e in (1, 2)], stock=[(101, 1, 9)])
    assert found.primary_reason == rca.MIXED


def test_staffing_mean_skips_days_without_sales(alert):
    past = [(weeks_before(1), 101, 1, 100, e, 0) for e in (1, 2)]
    past += [(weeks_before(2), 102, 1, 90, 1, 0)]
    found, _ = alert(past + [(DAY, 101, 1, 1, 1, 0), (DAY, 102, 1, 45, 1, 0)])
    assert found.branch_id == 101 and found.staffing_status == rca.UNDERSTAFFED


def test_discount_ratio_without_sales(alert):
    """Zero sales divide by one, negative sales give zero."""
    past = [(weeks_before(1), 101, 1, 100, 1, 10)]
    assert alert(past + [(DAY, 101, 1, -100, 1, 5)])[0].discount_ratio == 15.0
    assert alert(past + [(DAY, 101, 1, -200, 1, 5)])[0].discount_ratio == 0.0


def test_day_without_a_known_branch_still_gets_a_reason(alert):
    past = [(weeks_before(1), 999, 1, 100, 1, 0)]
    found, _ = alert(past + [(DAY, 999, 1, 1, 1, 0)])
    assert (found.branch_id, found.section_name, found.primary_reason) == (None, None, rca.MIXED)


@pytest.fixture(scope="module")
def section_alerts(spark, frame):
    def run(lines, stock=()):
        sales = frame(
            "fact_sales",
            [
                {
                    "timestamp": stamp(DAY - dt.timedelta(days=ago)),
                    "branch_id": 101,
                    "product_id": product,
                    "net_amount": net,
                    "employee_id": employee,
                    "transaction_id": transaction,
                }
                for ago, product, net, employee, transaction in lines
            ],
        )
        products = frame("dim_products", PRODUCTS)
        sections = frame(
            "dim_sections",
            [{"section_id": 10, "section_name": "Men"}, {"section_id": 20, "section_name": "Home"}],
        )
        branches = frame("dim_branches", [{"branch_id": 101, "branch_name": "B101"}])
        inventory = frame(
            "central_inventory",
            [{"branch_id": 101, "product_id": p, "floor_qty": q} for p, q in stock],
        )
        run = run_over(sales, products, sections, branches, inventory)
        share = run.section_contribution()
        found = run.section_diagnosis().filter(f"day = DATE'{DAY}'").collect()
        return share.filter(f"day = DATE'{DAY}'").collect(), found

    return run


def test_contributions_sum_to_hundred(section_alerts):
    share, _ = section_alerts([(0, 1, 30, 1, 1), (0, 2, 70, 1, 1)])
    assert {r.section_name: r.contribution for r in share} == {"Men": 30.0, "Home": 70.0}


def test_one_history_day_has_zero_deviation_and_other_sections_are_ignored(section_alerts):
    lines = [(3, 1, 50, 1, 1), (3, 2, 50, 1, 1), (0, 1, 49, 1, 2), (0, 2, 51, 1, 2)]
    _, found = section_alerts(lines)
    assert [(r.section_name, r.expected_contribution, r.bottleneck) for r in found] == [
        ("Men", 50.0, rca.PRODUCT_MIX)
    ]
    assert found[0].details == "Inventory, Staffing, and Traffic appear normal."


def test_sixteen_days_back_is_no_history(section_alerts):
    _, found = section_alerts([(16, 1, 50, 1, 1), (16, 2, 50, 1, 1), (0, 1, 1, 1, 2), (0, 2, 99, 1, 2)])
    assert found == []


def test_bottleneck_order(section_alerts):
    past = [(1, 1, 50, 1, 1), (1, 1, 50, 2, 2), (1, 2, 100, 1, 3)]
    few = past + [(0, 1, 10, 1, 4), (0, 2, 90, 1, 4)]
    _, found = section_alerts(few, stock=[(1, 3)])
    assert found[0].bottleneck == rca.LOW_STOCK
    assert found[0].details == "Average Floor Quantity for Men is 3.0 (Threshold: < 4)."
    _, found = section_alerts(few, stock=[(1, 4)])
    assert found[0].bottleneck == rca.STAFF_INADEQUATE
    assert found[0].details == "Active staff for Men was 1 (15-day average: 2.0)."
    quiet = past + [(0, 1, 5, 1, 4), (0, 1, 5, 2, 4), (0, 2, 90, 1, 4)]
    _, found = section_alerts(quiet, stock=[(1, 4)])
    assert found[0].bottleneck == rca.LOW_TRAFFIC
    assert found[0].details == "Section traffic was 1 transactions (15-day average: 2.0)."


def test_limited_run_finds_the_same(spark):
    star = tpch_star.tpch_star(spark, f"{TESTDATA}/sf0.001")
    first, last = dt.date(1997, 3, 1), dt.date(1997, 3, 20)
    everything = RootCauseRun(star, tpch_star.MONITORED_SECTIONS)
    limited = RootCauseRun(star, tpch_star.MONITORED_SECTIONS, days=(first, last))
    for name in ("profit_diagnosis", "section_diagnosis"):
        expected = getattr(everything, name)().filter(F.col("day").between(first, last)).collect()
        found = getattr(limited, name)().collect()
        assert len(found) > 0 and sorted(found, key=str) == sorted(expected, key=str)
