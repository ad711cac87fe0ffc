from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from tillsight.operators import customers, forecast
from tillsight.functions import recency
from tillsight.session import shared_folder, stage
from tillsight.sources import readers, schemas, writers


def test_conform_fills_renames_and_cleans(spark):
    raw = spark.createDataFrame(
        [("7", 1.5, float("nan"), 2.0), ("x", float("nan"), 3.0, 2.5)],
        "Product_ID string, PRICE_JOD double, Cost_JOD double, section_id double",
    )
    found = readers.conform(raw, schemas.DIM_PRODUCTS)
    assert found.schema.fieldNames() == schemas.DIM_PRODUCTS.fieldNames()
    rows = [(r.product_id, r.price_jod, r.cost_jod, r.category, r.section_id) for r in found.collect()]
    assert rows == [(7, Decimal("1.5"), None, None, 2), (None, None, Decimal("3"), None, None)]


def test_missing_amounts_are_refused(spark):
    with pytest.raises(ValueError, match="net_amount"):
        readers.conform(spark.createDataFrame([(1,)], "transaction_id long"), schemas.FACT_SALES)


def test_unsplit_fact_scan_is_refused(spark):
    star = readers.jdbc_star(spark, lambda table: readers.jdbc_options("jdbc:x://h/d", table))
    with pytest.raises(ValueError, match="partition"):
        star.sales("net_amount")


def test_malformed_dates_become_null(spark):
    raw = spark.createDataFrame([(1, "2020-02-30", "2024-04-01")], "customer_id bigint, birth_date string, join_date string")
    row = readers.conform(raw, schemas.DIM_CUSTOMERS).first()
    assert (row.birth_date, row.join_date) == (None, dt.date(2024, 4, 1))


@pytest.mark.parametrize(
    "columns,expected",
    [
        (["OrderDate", "TotalSales"], ("OrderDate", "TotalSales")),
        (["total", "n", "date"], ("date", "total")),
        (["a", "b", "c"], ("a", "b")),
    ],
)
def test_forecast_columns(columns, expected):
    assert readers.resolve_forecast_columns(columns) == expected


def test_forecast_csv(spark, tmp_path):
    path = tmp_path / "ready.csv"
    path.write_text("OrderDate,TotalSales\n2024-01-01,10\n2024-01-02,20\n")
    table = readers.read_forecast_csv(spark, str(path))
    assert forecast.daily_sales_forecast(table).first().predicted_sales == pytest.approx(30.0)
    path.write_text("order.date,total.sales\n2024-01-01,10\n2024-01-02,20\n2024-01-02,NaN\n2024-01-01,NA\n")
    table = readers.read_forecast_csv(spark, str(path))
    assert forecast.daily_sales_forecast(table).first().predicted_sales == pytest.approx(30.0)
    path.write_text("OrderDate,TotalSales\n2024-01-01,10\n")
    assert forecast.daily_sales_forecast(readers.read_forecast_csv(spark, str(path))).collect() == []


def test_missing_csv_is_empty(spark, tmp_path):
    table = readers.read_forecast_csv(spark, str(tmp_path / "absent.csv"))
    assert table.collect() == [] and forecast.daily_sales_forecast(table).collect() == []


def test_jdbc_options():
    options = readers.jdbc_options(
        "jdbc:x://host/db", "fact_sales", "timestamp", "2024-01-01", "2025-01-01", 64, extra={"user": "u"}
    )
    assert options["numPartitions"] == "64" and options["partitionColumn"] == "timestamp"
    assert options["user"] == "u" and options["dbtable"] == "fact_sales"
    assert "partitionColumn" not in readers.jdbc_options("jdbc:x://host/db", "dim_sections")
    with pytest.raises(ValueError):
        readers.jdbc_options("jdbc:x://host/db", "fact_sales", "timestamp")


def test_appended_sales_read_back_and_prune(spark, frame, at, tmp_path):
    path = str(tmp_path / "fact_sales")
    first = frame("fact_sales", [{"transaction_id": 1, "timestamp": at("2024-01-01T10:00"), "net_amount": 5}])
    second = frame("fact_sales", [{"transaction_id": 2, "timestamp": at("2024-01-02T10:00"), "net_amount": 6}])
    writers.append_sales(first, path)
    writers.append_sales(second, path)
    table = readers.read_parquet_table(spark, path, "fact_sales")
    assert {(r.transaction_id, r.timestamp, str(r.sale_date)) for r in table.collect()} == {
        (1, at("2024-01-01T10:00"), "2024-01-01"), (2, at("2024-01-02T10:00"), "2024-01-02")
    }
    plan = table.filter("sale_date = DATE'2024-01-02'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sale_date" in plan


def test_parquet_star(spark, frame, at, tmp_path):
    for table, schema in schemas.STAR.items():
        if table == "fact_sales":
            writers.append_sales(
                frame(table, [{"product_id": 3, "quantity": 2, "timestamp": at("2024-01-01")}]), str(tmp_path / table)
            )
        else:
            writers.write_result(frame(table, [{schema.fieldNames()[0]: 3}]), str(tmp_path / table))
    star = readers.parquet_star(spark, str(tmp_path))
    assert star.sales("product_id", "quantity").first() == (3, 2)
    for part in (star.products, star.sections, star.branches, star.customers, star.employees, star.inventory):
        assert part.count() == 1
    assert readers.dimension_keys(star.employees, "employee_id").first() == (3,)


def test_staged_table_keeps_rows_and_types(spark):
    kinds = T.StructType([T.StructField("d", T.DateType()), T.StructField("m", schemas.MONEY)])
    df = spark.createDataFrame([(dt.date(2024, 1, 1), Decimal("1.2345"))], kinds)
    again = stage(df, "sample")
    assert again.schema == df.schema and again.collect() == df.collect()
    folder = shared_folder(spark).removeprefix("file:").lstrip("/")
    assert folder in again.inputFiles()[0]


def test_recent_window_skips_old_folders(spark, frame, at, tmp_path):
    path = str(tmp_path / "fact_sales")
    rows = [
        {"customer_id": c, "timestamp": at(f"2024-0{m}-1{c}T10:00"), "net_amount": c * m}
        for m in (1, 5, 6)
        for c in (1, 2, 3)
    ]
    writers.append_sales(frame("fact_sales", rows), path)
    stored = readers.parquet_star(spark, str(tmp_path)).dated_sales("customer_id", "timestamp", "net_amount")
    recent = customers.recent_activity(stored, 31)
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(sale_date" in plan and "(sale_date#" in plan and ">= Subquery" in plan
    plain = customers.recent_activity(frame("fact_sales", rows), 31)
    assert sorted(recent.collect()) == sorted(plain.collect())
    assert {r.monetary for r in recent.collect()} == {Decimal(6), Decimal(12), Decimal(33)}


def rows_read(spark, df) -> int:
    """Input rows of the jobs that collect ``df``."""
    group = f"rows-{id(df)}"
    spark.sparkContext.setJobGroup(group, group)
    df.collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    total = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage_id in tracker.getJobInfo(job).stageIds:
            try:
                total += store.lastStageAttempt(stage_id).inputRecords()
            except Exception:  # a stage that was skipped
                continue
    return total


def test_latest_sale_reads_the_last_folder_only(spark, frame, at, tmp_path):
    rows = [
        {"customer_id": c, "timestamp": at(f"2024-0{m}-10T1{c}:00"), "net_amount": c * m}
        for m in (1, 5, 6)
        for c in range(9)
    ]
    writers.append_sales(frame("fact_sales", rows), str(tmp_path / "fact_sales"))
    star = readers.parquet_star(spark, str(tmp_path))
    assert star.last_day() == dt.date(2024, 6, 10)
    lines = star.dated_sales("customer_id", "timestamp", "net_amount")
    latest = recency.latest_sale(lines, star.last_day())
    assert latest.first()["latest"] == at("2024-06-10T18:00")
    assert rows_read(spark, recency.latest_sale(lines, star.last_day())) <= 9
    recent = customers.recent_activity(lines, 20, last_day=star.last_day())
    assert rows_read(spark, recent) <= 9 + 9
    assert {(r.customer_id, r.monetary) for r in recent.collect()} == {(c, Decimal(6 * c)) for c in range(9)}


def test_recent_activity_at_a_given_time(frame, at):
    rows = [{"customer_id": m, "timestamp": at(f"2024-0{m}-10"), "net_amount": m} for m in (1, 5, 6)]
    found = customers.recent_activity(frame("fact_sales", rows), 30, as_of=at("2024-05-20")).collect()
    assert [(r.customer_id, r.recency) for r in found] == [(5, 0)]
