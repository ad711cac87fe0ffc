"""Hand-made edge frames for the other analyses."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillsight.operators import customers, forecast, inventory, monitoring, sales, segmentation, whatif


def lines(frame, rows):
    return frame("fact_sales", rows)


# --- sales -----------------------------------------------------------------


def test_margin_of_a_free_line_is_unknown_and_no_line_is_lost(frame, at):
    fact = lines(
        frame,
        [
            {"product_id": 1, "branch_id": 101, "quantity": 2, "net_amount": 0, "timestamp": at("2024-03-05")},
            {"product_id": 1, "branch_id": 101, "quantity": 2, "net_amount": 100, "timestamp": at("2024-03-05")},
            {"product_id": 9, "branch_id": 999, "quantity": 1, "net_amount": 5, "timestamp": at("2024-03-05")},
            {"product_id": None, "branch_id": None, "quantity": 1, "net_amount": 5},
        ],
    )
    products = frame("dim_products", [{"product_id": 1, "section_id": 7, "cost_jod": 10}])
    sections = frame("dim_sections", [{"section_id": 7, "section_name": "Men"}])
    branches = frame("dim_branches", [{"branch_id": 101, "branch_name": "A"}])
    rows = sales.sales_enriched(fact, products, sections, branches).collect()
    assert len(rows) == 4
    assert sorted((r.margin_pct for r in rows), key=lambda m: m or 0) == [None, None, None, 80.0]
    assert {(r.month, r.month_num) for r in rows} == {("Mar", 3), (None, None)}
    kpis = sales.overview_kpis(fact, products).first()
    assert (kpis.total_revenue, kpis.avg_margin_pct, kpis.transactions) == (Decimal("110.0000"), 80.0, 0)
    assert [tuple(r) for r in sales.branch_revenue(fact, branches).collect()] == [("A", Decimal("100"))]


def test_discount_curve_falls_and_ends_at_half(frame):
    fact = lines(frame, [{"gross_amount": 100, "discount_amount": None, "net_amount": 100},
                         {"gross_amount": 100, "discount_amount": 20, "net_amount": 80}])
    rows = sales.discount_sensitivity(fact).orderBy("rate").collect()
    curve = [r.simulated_net for r in rows]
    assert len(rows) == 51 and curve[0] == 200.0 and curve[-1] == 100.0
    assert all(a > b for a, b in zip(curve, curve[1:]))
    assert rows[10].delta == pytest.approx(0.0) and rows[0].current_rate == 10.0


def test_target_moment_with_a_return_and_shared_stamps(frame, at):
    day = "2024-01-02T"
    amounts = [("10:00:00.100", 60), ("10:00:00.500", 45), ("10:00:00.900", -30), ("11:00:00", 20),
               ("11:00:00", 5), ("23:59:59.999999", 1)]
    fact = lines(frame, [{"timestamp": at(day + t), "gross_amount": a} for t, a in amounts]
                 + [{"timestamp": at("2024-01-03"), "gross_amount": 99}])
    rows = {r.day.day: r for r in sales.daily_target_attainment(fact, 100).collect()}
    # The peak inside the first second counts although the second ends below it.
    assert rows[2].first_reached == at(day + "10:00:00.500000")
    assert (rows[2].reached, rows[2].gross_amount) == (True, Decimal("101"))
    assert (rows[3].reached, rows[3].first_reached) == (False, None)
    late = {r.day.day: r for r in sales.daily_target_attainment(fact, 101).collect()}
    assert late[2].first_reached == at(day + "10:00:00.500000")
    never = {r.day.day: r for r in sales.daily_target_attainment(fact, 106).collect()}
    assert never[2].first_reached is None


# --- segmentation ----------------------------------------------------------


def test_unpriced_products(frame):
    fact = lines(frame, [{"product_id": p, "customer_id": 1, "quantity": 1} for p in (1, 2, 2)])
    products = frame("dim_products", [{"product_id": 1, "price_jod": 30}, {"product_id": 2}])
    people = frame("dim_customers", [{"customer_id": 1, "birth_date": dt.date(2000, 5, 5)}])
    tiers = segmentation.price_tier_revenue(fact, products).collect()
    assert [(r.price_tier, r.quantity, r.revenue_share_pct) for r in tiers] == [("Standard", 1, 100.0)]
    matrix = segmentation.age_price_affinity(fact, people, products, 2026).collect()
    assert [tuple(r) for r in matrix] == [("Standard", 1, 0, 0), ("Luxury", 2, 0, 0)]


def test_holiday_bounds_and_overlap(spark, frame, at):
    calendar = segmentation.holiday_calendar(
        spark,
        [("First", [("2026-03-15", "2026-03-30")]), ("Second", [("2026-03-10", "2026-03-22")])],
    )
    stamps = ["2026-03-09T23:59:59", "2026-03-10", "2026-03-14T12:00", "2026-03-22", "2026-03-22T00:00:01",
              "2026-03-30", "2026-03-30T00:00:01"]
    fact = lines(frame, [{"timestamp": at(s), "quantity": 10**i, "net_amount": 1} for i, s in enumerate(stamps)])
    found = {r.event: r.quantity for r in segmentation.holiday_performance(fact, calendar).collect()}
    assert found == {"Regular Days": 1000001, "Second": 1110, "First": 110000}


@pytest.mark.parametrize(
    "years,expected", [({}, 550000.0), ({2024: 10.0}, 10.0), ({2024: 10.0, 2025: 30.0}, 50.0)]
)
def test_holiday_forecast_by_years_known(spark, years, expected):
    event = "Christmas Season"
    rows = [(y, event, v) for y, v in years.items()] + [(2026, event, 7.0)]
    performance = spark.createDataFrame(rows, "year int, event string, net_amount double")
    found = forecast.holiday_forecast(performance, 2026).filter(F.col("event") == event).collect()
    assert [(r.year, r.kind) for r in found][-2:] == [(2026, "actual"), (2026, "forecast")]
    assert found[-1].net_amount == pytest.approx(expected)


# --- forecasts -------------------------------------------------------------


def test_daily_forecast_follows_a_line_over_gaps(spark):
    rows = [("2024-01-01", 10.0), ("2024-01-01", 0.0), ("2024-01-03", 30.0), (None, 9.0)]
    table = spark.createDataFrame(rows, "OrderDate string, TotalSales double")
    found = forecast.daily_sales_forecast(table).collect()
    assert [r.date for r in found] == [dt.date(2024, 1, d) for d in range(4, 11)]
    assert [r.predicted_sales for r in found] == pytest.approx([40 + 10 * i for i in range(7)])
    assert forecast.daily_sales_forecast(table.limit(2)).collect() == []


def joined(frame, rows):
    return frame("dim_customers", [{"customer_id": i, "birth_date": b, "join_date": j} for i, (b, j) in enumerate(rows)])


def test_growth_fallbacks(frame):
    young, middle = dt.date(2003, 1, 1), dt.date(1990, 1, 1)
    rows = [(young, dt.date(2024, 4, 1))] * 30 + [(young, dt.date(2025, 4, 2))] * 21
    rows += [(middle, dt.date(2024, m, 3)) for m in (1, 2, 3, 6) for _ in range(15)]
    rows += [(None, dt.date(2024, 4, 1)), (middle, None)]
    found = {r.segment: (r.actual, r.forecast) for r in forecast.customer_growth_forecast(joined(frame, rows), 2026).collect()}
    # Two months: truncated mean.  Constant history: the constant.  None: the floor.
    assert found == {"Young (19-27)": (51, 25), "Middle (28-40)": (0, 15), "Adult (41-55)": (0, 122)}


def test_base_projection(frame):
    rows = [(None, dt.date(2023, 5, 1))] * 3 + [(None, dt.date(2025, 1, 1))] * 7
    found = forecast.customer_base_projection(joined(frame, rows), 2026).collect()
    assert [(r.join_year, r.new_customers, r.total_customers, r.projected_customers) for r in found] == [
        (2023, 3, 3, 11), (2025, 7, 10, 11)
    ]


# --- customers -------------------------------------------------------------


def test_equal_frequency_gives_neutral_score(frame, at):
    fact = lines(frame, [{"customer_id": c, "timestamp": at(f"2024-01-{20 + c:02d}"), "net_amount": c * 10}
                         for c in range(1, 6)])
    rows = {r.customer_id: r for r in customers.rfm_scores(fact).collect()}
    assert {r.frequency_score for r in rows.values()} == {2.0}
    assert (rows[5].recency, rows[5].recency_score, rows[5].monetary_score, rows[5].segment) == (0, 4.0, 4.0, "Champions")
    assert (rows[1].recency, rows[1].recency_score, rows[1].monetary_score, rows[1].segment) == (4, 1.0, 1.0, "Lost")
    summary = customers.rfm_segment_summary(customers.rfm_scores(fact)).collect()
    assert sum(r.customer_count for r in summary) == 5 and len(summary) == 4


def test_single_customer_and_elapsed_days(frame, at):
    fact = lines(frame, [
        {"customer_id": 1, "timestamp": at("2024-01-30T23:00"), "net_amount": 5},
        {"customer_id": 1, "timestamp": at("2023-12-01"), "net_amount": 99},
        {"customer_id": None, "timestamp": at("2024-01-31T12:00"), "net_amount": 9},
        {"customer_id": 2, "timestamp": at("2024-01-29T01:00"), "net_amount": None},
    ])
    rows = {r.customer_id: r for r in customers.rfm_scores(fact).collect()}
    assert (rows[1].frequency, rows[1].monetary, rows[1].recency) == (1, Decimal("5"), 0)
    # 46 elapsed hours are one whole day, though two midnights lie between.
    assert (rows[2].recency, rows[2].monetary) == (1, Decimal("0"))
    alone = customers.churn_by_segment(fact.filter("customer_id = 1")).collect()
    assert [(r.segment, r.churn_probability) for r in alone] == [("At-Risk", 0.0)]


def test_churn_probability_rises(spark):
    rows = spark.range(0, 31).select(customers.churn_probability(F.col("id")).alias("p")).collect()
    p = [r.p for r in rows]
    assert p[0] == 0.0 and all(a < b < 1 for a, b in zip(p, p[1:]))


# --- inventory -------------------------------------------------------------


def test_stockout_skips_items_without_burn(frame, at):
    fact = lines(frame, [
        {"branch_id": 1, "product_id": 1, "quantity": 4, "timestamp": at("2024-01-01")},
        {"branch_id": 1, "product_id": 2, "quantity": 0, "timestamp": at("2024-01-02T09:00")},
        {"branch_id": 2, "product_id": 1, "quantity": 1, "timestamp": at("2024-01-02")},
        {"branch_id": None, "product_id": 1, "quantity": 50, "timestamp": at("2024-01-02")},
    ])
    stock = frame("central_inventory", [{"branch_id": b, "product_id": p, "total_qty": 13, "floor_qty": 1}
                                        for b in (1, 2) for p in (1, 2, 3)])
    products = frame("dim_products", [{"product_id": 1, "product_name_en": "a"}, {"product_id": 2, "product_name_en": "b"}])
    items = inventory.stockout_days(fact, stock, products)
    assert {(r.branch_id, r.product_id, r.days_left) for r in items.collect()} == {
        (1, 1, 6.5), (2, 1, 26.0), (1, 2, None), (2, 2, None)
    }
    risk = inventory.stockout_risk(items)
    assert [(r.branch_id, r.product_id, r.days_left, r.risk_level) for r in risk.collect()] == [
        (1, 1, 6.5, "Critical"), (2, 1, 26.0, "OK")
    ]
    assert inventory.stockout_risk(items, top=1).count() == 1
    kpis = inventory.stockout_kpis(items).first()
    assert tuple(kpis) == (1, 1, 16.25)
    alerts = fact.sparkSession.createDataFrame([(2, 3), (2, 5), (1, 3)], "product_id long, day int")
    alerts = alerts.select("product_id", F.date_from_unix_date("day").alias("day"))
    wanted = inventory.replenishment_trigger(items, alerts).collect()
    assert sorted((r.branch_id, r.product_id, r.runs_out, r.sells_fast) for r in wanted) == [
        (1, 1, True, False), (1, 2, False, True), (2, 2, False, True)
    ]
    refill = monitoring.replenishment_list(fact, stock, F.lit(at("2024-01-01")))
    assert {(r.floor_now, r.backstock, r.refill) for r in refill.collect()} == {(0, 12, 8), (1, 12, 7)}
    quiet = monitoring.low_stock_zero_sales(fact, stock).collect()
    assert sorted((r.branch_id, r.product_id) for r in quiet) == [(1, 3), (2, 2), (2, 3)]


def test_price_strings(spark):
    expected = {
        "JOD 1,234.50": "1234.5",
        "12 JOD": "12",
        "on request": None,
        None: None,
        "1.2.3": None,
        "2 pcs 12.50": "12.5",
        "12.50 (was 20)": "12.5",
        "-5.00": "-5",
        "JD. 12.50": "12.5",
        "12.50.": "12.5",
        "1.234,50 JOD": None,
        "10.00 - 20.00": None,
        "1,23 JOD": None,
    }
    texts = spark.createDataFrame([(t,) for t in expected], "price_text string")
    found = monitoring.price_string_clean(texts).collect()
    assert {r.price_text: r.price for r in found} == {t: p and Decimal(p) for t, p in expected.items()}
    comma = monitoring.price_string_clean(texts.filter("price_text like '1.234%'"), decimal_comma=True)
    assert comma.first().price == Decimal("1234.5")


def test_margin_of_giveaways_and_returns(frame):
    fact = lines(frame, [
        {"transaction_id": n, "product_id": 1, "quantity": q, "net_amount": net}
        for n, q, net in ((1, 1, 0), (2, 1, 100), (3, 1, 10.2), (4, -1, -100), (5, 1, None))
    ])
    products = frame("dim_products", [{"product_id": 1, "cost_jod": 10}])
    flagged = monitoring.low_margin_flag(fact, products).collect()
    assert sorted(r.transaction_id for r in flagged) == [1, 3, 4]


def test_chosen_discount_rates(frame):
    fact = lines(frame, [{"gross_amount": 200, "discount_amount": 0, "net_amount": 200}])
    found = sales.discount_sensitivity(fact, rates=[0.5, 2.5]).collect()
    assert [(r.rate, r.simulated_net) for r in found] == [(0.5, 199.0), (2.5, 195.0)]


# --- what-if ---------------------------------------------------------------


@pytest.fixture(scope="module")
def baseline(spark):
    return spark.createDataFrame(
        [(1000.0, 100, 50, 10.0, 6.0)],
        "total_revenue double, total_units bigint, total_customers bigint, avg_price double, avg_cost double",
    )


def impact(spark, baseline, rows):
    scenarios = spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(rows)],
        "scenario_id bigint, p double, d double, i double, w double, r double",
    )
    return whatif.scenario_impact(scenarios, baseline).orderBy("scenario_id").collect()


def test_scenarios_at_the_ends(spark, baseline):
    zero, steep, cheap, calm = impact(
        spark, baseline, [(0, 0, 0, 0, 0), (40, 0, 0, 0, 0), (0, 60, 50, 30, 100), (0, 0, 0, 16, 100)]
    )
    assert (zero.revenue, zero.units, zero.customers, zero.profit_delta, zero.risk) == (1000.0, 100, 50, 0.0, "Low")
    assert zero.risk_score == pytest.approx(15.0) and zero.revenue_change_pct == 0.0
    assert (steep.units, steep.customers, steep.risk) == (40, 40, "Medium")
    assert (cheap.units, cheap.margin_alert, cheap.traffic, cheap.efficiency) == (180, True, "High Traffic", "Optimized")
    assert cheap.risk_score == pytest.approx(46.0) and cheap.risk == "High"
    assert (calm.efficiency, calm.traffic, calm.risk) == ("Optimized", "High Traffic", "Low")


def test_units_move_with_price_and_discount(spark, baseline):
    by_price = [r.units for r in impact(spark, baseline, [(p, 0, 0, 0, 0) for p in range(0, 41, 8)])]
    by_discount = [r.units for r in impact(spark, baseline, [(0, d, 0, 0, 0) for d in range(0, 61, 12)])]
    assert by_price == sorted(by_price, reverse=True) and by_discount == sorted(by_discount)


def test_baseline_and_scenarios_by_branch(spark, frame, at):
    fact = lines(frame, [
        {"branch_id": 1, "product_id": 1, "quantity": 2, "net_amount": 10, "transaction_id": 5, "customer_id": 1, "timestamp": at("2024-05-01")},
        {"branch_id": 1, "product_id": 2, "quantity": 1, "net_amount": 20, "transaction_id": 5, "customer_id": 1, "timestamp": at("2024-05-01")},
        {"branch_id": 2, "product_id": 3, "quantity": 1, "net_amount": 7, "transaction_id": 6, "customer_id": None, "timestamp": at("2024-05-01")},
        {"branch_id": 2, "product_id": 1, "quantity": 9, "net_amount": 9, "transaction_id": 7, "customer_id": 2, "timestamp": at("2023-01-01")},
    ])
    products = frame("dim_products", [{"product_id": 1, "price_jod": 10, "cost_jod": 4}, {"product_id": 2, "price_jod": 30}])
    row = whatif.baseline_metrics(fact, products).first()
    assert (row.total_revenue, row.total_units, row.total_transactions, row.total_customers) == (Decimal("30"), 3, 1, 1)
    assert (row.avg_price, row.avg_cost, row.avg_margin, row.margin_pct) == (20.0, 4.0, 6.0, 0.3)
    empty = whatif.baseline_metrics(fact, products, as_of=F.lit(at("2030-01-01"))).first()
    assert (empty.total_revenue, empty.avg_price, empty.margin_pct) == (Decimal("0"), 0.0, 0.0)
    by_branch = whatif.baseline_metrics(fact, products, by=["branch_id"])
    scenarios = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0, 0.0, 0.0)], "scenario_id bigint, branch_id int, p double, d double, i double, w double, r double")
    found = whatif.scenario_impact(scenarios, by_branch, on="branch_id").collect()
    assert [(r.branch_id, r.revenue) for r in found] == [(1, 60.0)]


# --- session zone ----------------------------------------------------------


def test_wall_clock_times_ignore_the_session_zone(spark, frame, at):
    """In this zone the clock skips from midnight to one o'clock that day."""
    day = "2022-02-25T"
    fact = lines(frame, [{"timestamp": at(day + t), "gross_amount": 10, "quantity": q, "net_amount": 1}
                         for t, q in (("00:00", 1), ("00:30", 10), ("01:00", 100), ("01:30", 1000))])
    calendar = segmentation.holiday_calendar(spark, [("Event", [("2022-02-20", "2022-02-25")])])
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Amman")
    try:
        found = {r.event: r.quantity for r in segmentation.holiday_performance(fact, calendar).collect()}
        reached = sales.daily_target_attainment(fact, 15).first().first_reached
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert found == {"Event": 1, "Regular Days": 1110}
    assert reached == at(day + "00:30")
