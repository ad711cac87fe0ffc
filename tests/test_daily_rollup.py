"""The kept daily sums: current after others have written, folded only where sales changed."""

from __future__ import annotations

import datetime as dt
import glob
import os
import shutil
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import TESTDATA

from comparison import difference
from tillsight.operators import root_cause as rca
from tillsight.plans.analyses import ANALYSES, CustomerReports
from tillsight.plans.catalog import SETTINGS
from tillsight.plans.daily_rollup import DailyRollup
from tillsight.plans.root_cause import RootCauseRun
from tillsight.sources import readers, schemas, tpch_star, writers

SMALL = f"{TESTDATA}/sf0.001"
LAST = dt.date(1996, 5, 30)


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """A stored star of two months."""
    star = tpch_star.tpch_star(spark, SMALL)
    window = f"timestamp BETWEEN TIMESTAMP_NTZ'1996-04-01' AND TIMESTAMP_NTZ'{LAST}'"
    lines = star.sales(*schemas.FACT_SALES.fieldNames()).filter(window)
    root = str(tmp_path_factory.mktemp("star") / "star")
    writers.append_sales(lines, f"{root}/fact_sales")
    for name in ("products", "sections", "branches", "customers", "inventory"):
        table = "central_inventory" if name == "inventory" else f"dim_{name}"
        writers.write_result(getattr(star, name), f"{root}/{table}")
    return root


@pytest.fixture
def stored(written, tmp_path):
    """A copy of the star to change, and where its sums are kept."""
    root = str(tmp_path / "star")
    shutil.copytree(written, root)
    return root, str(tmp_path / "kept")


def add_outside(root: str, day: dt.date, net: float, customer: int = 1, lines: int = 3) -> None:
    """A file that no session knows of."""
    stamp = dt.datetime.combine(day, dt.time(10))
    money = pa.decimal128(18, 4)
    amount = [Decimal(f"{net / lines:.4f}")] * lines
    table = pa.table(
        {
            "transaction_id": pa.array(range(lines), pa.int64()),
            "timestamp": pa.array([stamp] * lines, pa.timestamp("us")),
            "branch_id": pa.array([101] * lines, pa.int32()),
            "product_id": pa.array([1] * lines, pa.int64()),
            "employee_id": pa.array([1] * lines, pa.int64()),
            "customer_id": pa.array([customer] * lines, pa.int64()),
            "quantity": pa.array([1] * lines, pa.int32()),
            "gross_amount": pa.array(amount, money),
            "discount_amount": pa.array([None] * lines, money),
            "net_amount": pa.array(amount, money),
        }
    )
    folder = f"{root}/fact_sales/sale_date={day}"
    os.makedirs(folder, exist_ok=True)
    pq.write_table(table, f"{folder}/added.parquet")


def live(star) -> tuple:
    sums = rca.section_days(star.sales("branch_id", "product_id", "timestamp", "net_amount", "discount_amount"), star.products, star.sections)
    return sums.columns, [tuple(r) for r in sums.collect()]


def rows(frame) -> tuple:
    return frame.columns, [tuple(r) for r in frame.collect()]


def same(found, expected) -> None:
    order = sorted(found[0])
    assert difference(found, expected) is None, order


def read_by(spark, label: str, action) -> int:
    """Rows that the jobs of an action have read from files."""
    spark.sparkContext.setJobGroup(label, label)
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, tracker, total = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker(), 0
    for job in tracker.getJobIdsForGroup(label):
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                total += store.lastStageAttempt(stage).inputRecords()
            except Exception:  # a stage that was skipped
                continue
    return total


def test_sums_equal_those_of_the_lines(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    rollup = DailyRollup(star, kept)
    same(rows(rollup.section_days()), live(star))
    assert rollup.refresh() == []


def test_a_folder_added_from_outside_is_seen_and_folded_alone(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    total = star.sales("timestamp").count()
    before = read_by(spark, "first", lambda: DailyRollup(star, kept).refresh())
    assert before >= total
    june = dt.date(1996, 6, 3)
    add_outside(root, june, 30.0)
    days = []
    after = read_by(spark, "second", lambda: days.extend(DailyRollup(star, kept).refresh()))
    assert days == [june]
    # The new lines, the products twice, the versions of the kept sums, and a row for each file listed.
    sums, files = spark.read.parquet(kept).count(), len(glob.glob(f"{root}/fact_sales/*/*.parquet"))
    assert after <= 3 + 2 * star.products.count() + sums + files
    assert before >= total + star.products.count() + files - 1
    found = ANALYSES["rca_section_contribution"](star, SETTINGS)
    assert found.agg({"day": "max"}).first()[0] == june


def test_the_same_star_and_session_see_changed_and_lost_folders(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    rollup = DailyRollup(star, kept)
    rollup.refresh()
    add_outside(root, LAST, 900.0)
    first = star.sales("timestamp").agg({"timestamp": "min"}).first()[0].date()
    shutil.rmtree(f"{root}/fact_sales/sale_date={first}")
    assert rollup.refresh() == [LAST]
    same(rows(rollup.section_days()), live(star))


def test_a_date_whose_lines_lose_their_times_leaves_no_sums(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    rollup = DailyRollup(star, kept)
    rollup.refresh()
    folder = f"{root}/fact_sales/sale_date={LAST}"
    shutil.rmtree(folder)
    os.makedirs(folder)
    pq.write_table(pa.table({"timestamp": pa.array([None], pa.timestamp("us")), "branch_id": pa.array([1], pa.int32())}), f"{folder}/x.parquet")
    assert rollup.refresh() == [LAST]
    same(rows(rollup.section_days()), live(star))


def test_products_that_change_their_section_are_folded_again(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    rollup = DailyRollup(star, kept)
    rollup.refresh()
    moved = star.products.selectExpr("* EXCEPT (section_id)", "IF(product_id % 2 = 0, 1, section_id) AS section_id").toPandas()
    shutil.rmtree(f"{root}/dim_products")
    spark.createDataFrame(moved).write.parquet(f"{root}/dim_products")
    again = readers.parquet_star(spark, root)
    assert DailyRollup(again, kept).refresh()
    same(rows(DailyRollup(again, kept).section_days()), live(again))


def test_a_limited_run_folds_only_its_days_and_history(spark, stored):
    root, kept = stored
    star = readers.parquet_star(spark, root)
    day = dt.date(1996, 5, 20)
    limited = RootCauseRun(star, tpch_star.MONITORED_SECTIONS, (day, day), kept)
    found = rows(limited.trigger())
    dates = [r[0] for r in spark.read.parquet(kept).select("sale_date").distinct().collect()]
    assert min(dates) >= day - dt.timedelta(days=rca.HISTORY_DAYS) and max(dates) <= day
    everything = RootCauseRun(star, tpch_star.MONITORED_SECTIONS, rollup_path=kept + "-all").trigger().filter(f"day = DATE'{day}'")
    same(found, rows(everything))


def test_sales_that_are_not_stored_by_dates_are_kept_as_one(spark, tmp_path):
    star = tpch_star.tpch_star(spark, SMALL)
    rollup = DailyRollup(star, str(tmp_path / "kept"))
    assert rollup.refresh() == [None] and rollup.refresh() == []
    same(rows(rollup.section_days()), live(star))


def test_no_report_is_served_from_the_session_cache(spark, stored):
    root, _ = stored
    star = readers.parquet_star(spark, root)

    def new_customers():
        return ANALYSES["rfm_scores"](star, SETTINGS).filter("customer_id = 9999999").count()

    assert new_customers() == 0
    add_outside(root, LAST, 5.0, customer=9_999_999)
    assert new_customers() == 1


def test_customer_reports_share_one_activity_and_free_it(spark, stored, tmp_path):
    root, _ = stored
    star = readers.parquet_star(spark, root)
    with CustomerReports(star, SETTINGS) as reports:
        for name, build in {
            "rfm_scores": reports.scores,
            "rfm_segment_summary": reports.segment_summary,
            "rfm_segment_revenue": reports.segment_revenue,
            "churn_by_segment": reports.churn_by_segment,
        }.items():
            found, expected = rows(build()), rows(ANALYSES[name](star, SETTINGS))
            assert difference(found, expected, relative=1e-12) is None
        path = reports._path
        assert spark.read.parquet(path).count() > 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
