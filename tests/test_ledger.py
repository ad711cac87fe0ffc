"""The floor's ledger and the move of staff, against plain versions."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillsight.operators import monitoring
from tillsight.sources import tpch_star

SNAPSHOT = dt.datetime(2024, 1, 1)


def plain_ledger(sales, inventory, limit=4, target=8):
    sold = defaultdict(lambda: defaultdict(int))
    for sale in sales:
        if sale["timestamp"] is not None and sale["timestamp"] > SNAPSHOT:
            sold[sale["branch_id"], sale["product_id"]][sale["timestamp"].date()] += sale["quantity"] or 0
    out = []
    for item in inventory:
        floor, total = item["floor_qty"], item["total_qty"]
        if floor is None or total is None:
            continue
        backstock = max(total - floor, 0)
        for day, quantity in sorted(sold[item["branch_id"], item["product_id"]].items()):
            floor = max(floor - quantity, 0)
            if floor < limit:
                refill = min(backstock, target - floor)
                out.append((item["branch_id"], item["product_id"], day, floor, refill, backstock - refill))
                floor, backstock = floor + refill, backstock - refill
    return sorted(out)


def ledger(frame, sales, inventory):
    snapshot = F.lit(SNAPSHOT).cast("timestamp_ntz")
    found = monitoring.replenishment_events(frame("fact_sales", sales), frame("central_inventory", inventory), snapshot)
    assert found.columns == ["branch_id", "product_id", "day", "floor_before", "refill", "backstock_after"]
    return sorted(tuple(r) for r in found.collect())


def line(day, product, quantity, hour=9, branch=1):
    stamp = None if day is None else dt.datetime(2024, 1, day, hour)
    return {"branch_id": branch, "product_id": product, "timestamp": stamp, "quantity": quantity}


def item(product, floor, total, branch=1):
    return {"branch_id": branch, "product_id": product, "floor_qty": floor, "total_qty": total}


def test_refills_until_the_backstock_is_empty(frame):
    sales = [line(2, 7, 3), line(3, 7, 5), line(3, 7, 1, hour=20), line(5, 7, 6), line(6, 7, 2), line(9, 7, 1)]
    inventory = [item(7, 8, 15)]
    found = ledger(frame, sales, inventory)
    assert found == plain_ledger(sales, inventory)
    # 8-3=5 holds; 5-6 is 0 and takes 7; 7-6=1 and 1-2=0, 0-1=0 find nothing left.
    assert [r[3:] for r in found] == [(0, 7, 0), (1, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_returns_raise_the_floor_and_count_against_sales_of_the_day(frame):
    sales = [line(2, 7, -3), line(3, 7, 4), line(4, 7, 5), line(4, 7, -5, hour=10), line(5, 7, 2)]
    inventory = [item(7, 4, 20)]
    assert ledger(frame, sales, inventory) == plain_ledger(sales, inventory) == [(1, 7, dt.date(2024, 1, 3), 3, 5, 11)]


def test_edges(frame):
    sales = [
        line(1, 1, 9, hour=0),  # the moment of the snapshot
        line(None, 1, 9),
        line(2, 1, None),
        line(2, 2, 1),
        line(2, 3, 1),
        line(2, 4, 1),
        line(2, 5, 1),
        line(2, 9, 1),
    ]
    inventory = [item(1, 3, 5), item(2, None, 9), item(3, 5, None), item(4, 9, 2), item(5, 0, 100), item(6, 0, 9)]
    found = ledger(frame, sales, inventory)
    assert found == plain_ledger(sales, inventory)
    assert found == [(1, 1, dt.date(2024, 1, 2), 3, 2, 0), (1, 5, dt.date(2024, 1, 2), 0, 8, 92)]
    assert ledger(frame, [], inventory) == []


@pytest.mark.parametrize("seed", range(3))
def test_random_items(frame, seed):
    draw = np.random.default_rng(seed)
    sales = [
        line(int(draw.integers(1, 29)), int(draw.integers(6)), int(draw.integers(-2, 6)), int(draw.integers(24)), int(draw.integers(3)))
        for _ in range(600)
    ]
    inventory = [item(p, int(draw.integers(10)), int(draw.integers(60)), b) for p in range(6) for b in range(3)]
    assert ledger(frame, sales, inventory) == plain_ledger(sales, inventory)


def plain_moves(rows, pct=25):
    staff, net = defaultdict(set), defaultdict(Fraction)
    for branch, stamp, employee, amount in rows:
        if None not in (branch, stamp, employee):
            staff[branch, stamp.date(), stamp.hour].add(employee)
            net[branch, stamp.weekday(), stamp.hour] += Fraction(str(amount or 0))
    hours = defaultdict(int)
    for (branch, day, hour), who in staff.items():
        hours[branch, day.weekday(), hour] += len(who)
    for branch, weekday in {k[:2] for k in hours}:
        for hour in (16, 17, 18, 19):
            hours[branch, weekday, hour] += 0
    out = {}
    for key in {k[:2] for k in hours}:
        own = {h: n for (*k, h), n in hours.items() if tuple(k) == key}
        worth = {h: max(int(net[*key, h] * 100), 0) // n if n else 0 for h, n in own.items()}
        moving = sum(n for h, n in own.items() if h < 12) * pct // 100
        left, moved = moving, dict.fromkeys(own, 0)
        for hour in sorted((h for h in own if h < 12), key=lambda h: (worth[h], h)):
            gone = min(own[hour], left)
            moved[hour] -= gone
            left -= gone
        pull = {h: worth[h] for h in (16, 17, 18, 19)}
        if not any(pull.values()):
            pull = dict.fromkeys(pull, 1)
        for hour in pull:
            moved[hour] += moving * pull[hour] // sum(pull.values())
        spare = moving - sum(moving * p // sum(pull.values()) for p in pull.values())
        for hour in sorted(pull, key=lambda h: (-(moving * pull[h] % sum(pull.values())), h))[:spare]:
            moved[hour] += 1
        for hour in own:
            out[(*key, hour)] = (own[hour], moved[hour], own[hour] + moved[hour])
    return out


def moves(frame, rows, pct=25):
    names = ("branch_id", "timestamp", "employee_id", "net_amount")
    found = monitoring.staff_reallocation(frame("fact_sales", [dict(zip(names, r, strict=True)) for r in rows]), pct)
    return {(r.branch_id, r.weekday, r.hour): (r.staff_hours, r.moved, r.staff_hours_after) for r in found.collect()}


@pytest.mark.parametrize(("seed", "pct"), [(1, 25), (2, 20), (3, 100), (4, 0)])
def test_moved_hours_match_a_plain_apportionment(frame, seed, pct):
    draw = np.random.default_rng(seed)
    rows = [
        (int(draw.integers(1, 3)), dt.datetime(2024, 1, int(draw.integers(1, 15)), int(draw.integers(8, 22)), int(draw.integers(60))),
         int(draw.integers(12)), int(draw.integers(-500, 4000)) / 100)
        for _ in range(1500)
    ]
    found = moves(frame, rows, pct)
    assert found == plain_moves(rows, pct)
    for key in {k[:2] for k in found}:
        assert sum(v[1] for k, v in found.items() if k[:2] == key) == 0
    assert min(v[2] for v in found.values()) >= 0


def test_moves_at_the_edges(frame):
    monday = dt.datetime(2024, 1, 1)
    quiet = [(1, monday.replace(hour=9, minute=m), m, None) for m in range(10)]
    rows = quiet + [(None, monday, 1, 5), (1, None, 1, 5), (1, monday.replace(hour=17), None, 5)]
    found = moves(frame, rows)
    # Two of ten hours move; no rush hour earns anything, so the earliest two get one each.
    assert found == plain_moves(rows)
    assert {k[2]: v[1] for k, v in found.items()} == {9: -2, 16: 1, 17: 1, 18: 0, 19: 0}
    assert moves(frame, []) == {}


def test_inventory_of_many_branches_is_not_broadcast(spark, frame, tmp_path):
    parts, branches = 2_000, 100
    spark.range(parts).selectExpr("id AS p_partkey", "'STANDARD' AS p_type").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(branches).selectExpr("CAST(id AS int) AS r_regionkey", "'' AS r_name").write.parquet(str(tmp_path / "region.parquet"))
    inventory = tpch_star.tpch_star(spark, str(tmp_path)).inventory
    stock = [item(r.product_id, r.floor_qty, r.total_qty, r.branch_id) for r in inventory.filter("product_id < 3").collect()]
    sales = [line(day, product, 3, branch=101 + day) for day in range(2, 20) for product in range(3)]
    lines = frame("fact_sales", sales).repartition(2)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Less than the 200,000 rows take, more than 2,000 would.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        found = monitoring.replenishment_events(lines, inventory, F.lit(SNAPSHOT).cast("timestamp_ntz"))
        assert sorted(tuple(r) for r in found.collect()) == plain_ledger(sales, stock)
        plan = found._jdf.queryExecution().executedPlan().finalPhysicalPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    join = next(x for x in plan.splitlines() if "Join [branch_id" in x)
    assert "BuildLeft" not in join
