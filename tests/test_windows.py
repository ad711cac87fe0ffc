"""Distinct counts over windows, exact and sketched, and sketched quantiles."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tillsight.functions.quantiles import daily_quantile_sketches, merged_quantiles, sketched_quantiles
from tillsight.operators import customers, monitoring
from tillsight.plans.analyses import ANALYSES, Settings
from tillsight.sources import tpch_star

START = dt.date(2024, 1, 1)


def lines(spark, pairs):
    rows = [(START + dt.timedelta(days=int(d)), None if k is None else int(k)) for d, k in pairs]
    return spark.createDataFrame(rows, "day date, key long")


def plain(pairs, lengths):
    days = sorted({d for d, _ in pairs})
    return [
        (START + dt.timedelta(days=int(d)), *[len({k for e, k in pairs if k is not None and d - n < e <= d}) for n in (1, *lengths)])
        for d in days
    ]


@pytest.mark.parametrize("seed", range(3))
def test_rolling_distinct_matches_sets(spark, seed):
    draw = np.random.default_rng(seed)
    pairs = [(int(d), int(k)) for d, k in zip(draw.choice(90, 400), draw.integers(0, 60, 400))] + [(3, None), (200, None), (400, 1)]
    found = monitoring.rolling_distinct(lines(spark, pairs), "key", "keys", (7, 30)).orderBy("day")
    assert found.columns == ["day", "keys", "keys_7d", "keys_30d"]
    assert [tuple(r) for r in found.collect()] == plain(pairs, (7, 30))


def test_rolling_distinct_of_nothing(spark):
    assert monitoring.rolling_distinct(lines(spark, []), "key", "keys").count() == 0


def test_an_invoice_on_two_days_counts_once(frame, at):
    sales = [
        {"transaction_id": t, "timestamp": at(f"2024-01-0{d}T10:00"), "product_id": 1, "quantity": 1, "net_amount": 2}
        for t, d in ((1, 1), (1, 3), (2, 3), (2, 3), (3, 4))
    ]
    products = frame("dim_products", [{"product_id": 1, "cost_jod": 1}])
    found = monitoring.rolling_metrics(frame("fact_sales", sales), products).orderBy("day").collect()
    assert [(r.transactions, r.transactions_7d) for r in found] == [(1, 1), (2, 2), (1, 3)]  # a sum of days would give 4
    assert [float(r.net_7d) for r in found] == [2.0, 8.0, 10.0]


def test_sketched_windows_stay_within_their_error(spark):
    draw = np.random.default_rng(5)
    pairs = [(int(d), int(k)) for d, k in zip(draw.choice(40, 40_000), draw.integers(0, 9000, 40_000))]
    rows = lines(spark, pairs)
    bits = 12
    exact = {r.day: r for r in monitoring.rolling_distinct(rows, "key", "keys").collect()}
    found = monitoring.merged_distinct(monitoring.daily_sketches(rows, "key", bits), "keys").collect()
    assert {r.day for r in found} == set(exact)
    error = 1.04 / 2 ** (bits / 2)
    for row in found:
        for name in ("keys", "keys_7d", "keys_30d"):
            assert abs(row[name] - exact[row.day][name]) <= 4 * error * exact[row.day][name] + 1


def test_kept_sketches_serve_any_window(spark, tmp_path):
    pairs = [(d, k) for d in range(20) for k in range(d, d + 50)]
    path = str(tmp_path / "sketches")
    monitoring.daily_sketches(lines(spark, pairs), "key", 14).write.parquet(path)
    some = spark.read.parquet(path).filter(F.col("day").between(START, START + dt.timedelta(days=9)))
    merged = some.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).first().n
    assert abs(merged - 59) <= 2


def ranks(values, found):
    return [(values < x).sum() / len(values) for x in found], [(values <= x).sum() / len(values) for x in found]


def test_sketched_quantiles_stay_within_their_rank_error(spark):
    values = np.sort(np.random.default_rng(2).lognormal(size=20_000))
    frame = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    fractions = (0.0, 0.25, 0.5, 0.75, 1.0)
    for accuracy in (50, 1000):
        found = sketched_quantiles(frame, ["v"], fractions, accuracy).first().v
        low, high = ranks(values, found)
        assert all(a - 1 / accuracy <= f <= b + 1 / accuracy for a, b, f in zip(low, high, fractions, strict=True))
        assert found[0] == values[0] and found[-1] == values[-1]


def test_daily_quantile_sketches_merge_to_any_window(spark):
    draw = np.random.default_rng(3)
    days, values = draw.integers(0, 30, 30_000), draw.normal(size=30_000)
    frame = spark.createDataFrame([(START + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, values)], "day date, v double")
    sketches = daily_quantile_sketches(frame, "v")
    assert sketches.count() == 30
    window = sketches.filter(F.col("day") < START + dt.timedelta(days=12))
    found = merged_quantiles(window, (0.25, 0.5, 0.75)).first().quantiles
    low, high = ranks(np.sort(values[days < 12]), found)
    assert all(a - 0.03 <= f <= b + 0.03 for a, b, f in zip(low, high, (0.25, 0.5, 0.75), strict=True))
    assert merged_quantiles(sketches.filter("false"), (0.5,)).first().quantiles is None


def test_quartiles_are_exact_unless_asked_otherwise(spark):
    star = tpch_star.tpch_star(spark, f"{TESTDATA}/sf0.01")
    exact = {r.customer_id: r.rfm_score for r in ANALYSES["rfm_scores"](star, Settings()).collect()}
    close = {r.customer_id: r.rfm_score for r in ANALYSES["rfm_scores"](star, Settings(quartile_accuracy=1000)).collect()}
    assert set(exact) == set(close)
    assert sum(exact[c] == close[c] for c in exact) >= 0.98 * len(exact)
    churn = ANALYSES["churn_by_segment"](star, Settings(quartile_accuracy=1000)).collect()
    assert {r.segment for r in churn} <= set(customers.segments.RFM_SEGMENTS)
