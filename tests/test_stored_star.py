"""The same results when the star is stored as date-partitioned Parquet."""

from __future__ import annotations

import pytest
from conftest import TESTDATA

from comparison import difference
from tillsight.operators import sales, whatif
from tillsight.plans.analyses import ANALYSES
from tillsight.plans.catalog import SETTINGS
from tillsight.sources import readers, schemas, tpch_star, writers

SMALL = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def stars(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("star")
    star = tpch_star.tpch_star(spark, SMALL)
    # A year and a half of days; the test star is limited to the same ones.
    lines = star.sales(*schemas.FACT_SALES.fieldNames()).filter("timestamp < TIMESTAMP_NTZ'1996-07-01'")
    writers.append_sales(lines, str(root / "fact_sales"))
    tables = {
        "dim_products": star.products,
        "dim_sections": star.sections,
        "dim_branches": star.branches,
        "dim_customers": star.customers,
        "dim_employees": star.employees,
        "central_inventory": star.inventory,
    }
    for name, table in tables.items():
        writers.write_result(table, str(root / name))
    return readers.Star(lines.select, tables.__getitem__), readers.parquet_star(spark, str(root))


@pytest.mark.parametrize(
    "name",
    [
        "sales_enriched",
        "holiday_performance",
        "rfm_scores",
        "baseline_metrics",
        "low_stock_zero_sales",
        "replenishment_list",
        "rca_profit_diagnosis",
        "stockout_days",
    ],
)
def test_stored_star_gives_the_same(stars, name):
    live, stored = (ANALYSES[name](star, SETTINGS) for star in stars)
    expected = (live.columns, [tuple(r) for r in live.collect()])
    found = (stored.columns, [tuple(r) for r in stored.collect()])
    assert len(expected[1]) > 0
    assert difference(found, expected, relative=1e-12) is None


def test_sketched_counts_are_close(stars):
    live, _ = stars
    lines = live.sales(*schemas.FACT_SALES.fieldNames())
    exact = sales.overview_kpis(lines, live.products).first().transactions
    close = sales.overview_kpis(lines, live.products, rsd=0.02).first().transactions
    assert abs(close - exact) <= 0.1 * exact
    exact = whatif.baseline_metrics(lines, live.products).first().total_customers
    close = whatif.baseline_metrics(lines, live.products, rsd=0.02).first().total_customers
    assert abs(close - exact) <= 0.1 * exact
