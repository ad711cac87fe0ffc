"""Operational monitors.

These are named by the reports they serve but were never given formulas;
the rules and limits below are this library's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.recency import days_before_latest, sold_since
from .sales import margin_pct

FLOOR_LIMIT = 4
FLOOR_TARGET = 8
MARGIN_LIMIT_PCT = 5.0
VELOCITY_DAYS = 7
VELOCITY_BASE_DAYS = 28
VELOCITY_SIGMAS = 2
QUIET_DAYS = 30
ROLLING_DAYS = (7, 30)
# Staff is moved from the hours before noon to those from 16:00 to 20:00.
NOON = 12
RUSH_HOURS = (16, 17, 18, 19)
MOVED_PCT = 25


def hourly_staffing(sales: DataFrame) -> DataFrame:
    """Lines, net sales and active employees by hour of day."""
    return (
        sales.filter(F.col("timestamp").isNotNull())
        .groupBy(F.hour("timestamp").alias("hour"))
        .agg(
            F.count("*").alias("lines"),
            F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net_amount"),
            F.count_distinct("employee_id").alias("employees"),
        )
        .withColumn(
            "net_per_employee",
            F.try_divide(F.col("net_amount").cast("double"), F.col("employees").cast("double")),
        )
        .orderBy("hour")
    )


def staff_reallocation(sales: DataFrame, moved_pct: int = MOVED_PCT) -> DataFrame:
    """Staff hours by branch, weekday and hour, before and after a share of the mornings' moves to the evening rush.

    An employee with sales in an hour of a date is one staff hour there.  Of the
    hours before noon ``moved_pct`` percent, rounded down, move within the branch
    and weekday: they leave the hours that earn least per staff hour first, and
    go to the rush hours in proportion to what these earn per staff hour, by
    largest remainder.  An hour that earns nothing attracts none, unless none of
    the rush hours earns anything; then all attract alike.  Ties go to the
    earlier hour.  The total of staff hours stays the same.  Lines without time,
    branch or employee don't count.
    """
    known = F.col("timestamp").isNotNull() & F.col("branch_id").isNotNull() & F.col("employee_id").isNotNull()
    by_date = (
        sales.filter(known)
        .groupBy("branch_id", F.to_date("timestamp").alias("day"), F.hour("timestamp").alias("hour"))
        .agg(F.count_distinct("employee_id").alias("staff_hours"), F.sum("net_amount").alias("net_amount"))
    )
    sold = by_date.groupBy("branch_id", F.weekday("day").alias("weekday"), "hour").agg(
        F.sum("staff_hours").alias("staff_hours"), F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net_amount")
    )
    rush = F.explode(F.array(*map(F.lit, RUSH_HOURS))).alias("hour")
    empty = sold.select("branch_id", "weekday").distinct().select(
        "branch_id", "weekday", rush, F.lit(0).alias("staff_hours"), F.lit(0).alias("net_amount")
    )
    hours = sold.unionByName(empty).groupBy("branch_id", "weekday", "hour").agg(
        F.sum("staff_hours").alias("staff_hours"), F.sum("net_amount").alias("net_amount")
    )
    # Whole cents per staff hour, so that shares and remainders are exact.  A
    # branch and weekday has 24 rows at most.
    cents = F.greatest((F.col("net_amount") * 100).cast("bigint"), F.lit(0))
    worth = F.when(F.col("staff_hours") > 0, F.expr("cents div staff_hours")).otherwise(0)
    one = W.partitionBy("branch_id", "weekday")
    morning, rushing = F.col("hour") < NOON, F.col("hour").isin(*RUSH_HOURS)
    weighed = (
        hours.withColumn("cents", cents)
        .withColumns({"worth": worth, "mornings": F.sum(F.when(morning, F.col("staff_hours")).otherwise(0)).over(one)})
        .withColumn("moving", F.expr(f"mornings * {int(moved_pct)} div 100"))
        .withColumn("attraction", F.sum(F.when(rushing, F.col("worth")).otherwise(0)).over(one))
    )
    poorest = W.partitionBy("branch_id", "weekday", morning).orderBy("worth", "hour").rowsBetween(W.unboundedPreceding, -1)
    gone_before = F.coalesce(F.sum("staff_hours").over(poorest), F.lit(0))
    pull = F.when(F.col("attraction") > 0, F.col("worth")).otherwise(1)
    pulls = F.when(F.col("attraction") > 0, F.col("attraction")).otherwise(len(RUSH_HOURS))
    shared = weighed.withColumns(
        {
            "leaving": F.when(morning, F.greatest(F.least(F.col("staff_hours"), F.col("moving") - gone_before), F.lit(0))).otherwise(0),
            "product": F.when(rushing, F.col("moving") * pull).otherwise(0),
            "pulls": pulls,
        }
    ).withColumns({"quota": F.expr("product div pulls"), "remainder": F.col("product") % F.col("pulls")})
    largest = W.partitionBy("branch_id", "weekday", rushing).orderBy(F.desc("remainder"), "hour")
    spare = F.col("moving") - F.sum("quota").over(one)
    extra = F.when(rushing & (F.row_number().over(largest) <= spare), 1).otherwise(0)
    arriving = F.col("quota") + extra
    return shared.select(
        "branch_id",
        "weekday",
        "hour",
        "staff_hours",
        (arriving - F.col("leaving")).alias("moved"),
        (F.col("staff_hours") + arriving - F.col("leaving")).alias("staff_hours_after"),
        F.try_divide(F.col("net_amount").cast("double"), F.col("staff_hours").cast("double")).alias("net_per_staff_hour"),
    )


def velocity_alert(sales: DataFrame) -> DataFrame:
    """Product days whose weekly mean quantity leaves its usual range.

    Means are over days with sales: the last 7 days against the 28 before.
    """
    daily = (
        sales.filter(F.col("product_id").isNotNull() & F.col("timestamp").isNotNull())
        .groupBy("product_id", F.to_date("timestamp").alias("day"))
        .agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("double").alias("quantity"))
    )
    order = W.partitionBy("product_id").orderBy(F.unix_date("day"))
    week = order.rangeBetween(1 - VELOCITY_DAYS, 0)
    base = order.rangeBetween(1 - VELOCITY_DAYS - VELOCITY_BASE_DAYS, -VELOCITY_DAYS)
    judged = daily.select(
        "product_id",
        "day",
        F.avg("quantity").over(week).alias("week_mean"),
        F.avg("quantity").over(base).alias("base_mean"),
        F.stddev_pop("quantity").over(base).alias("base_std"),
    )
    limit = F.col("base_mean") + VELOCITY_SIGMAS * F.col("base_std")
    return judged.filter(F.col("week_mean") > limit)


def replenishment_list(
    sales: DataFrame,
    inventory: DataFrame,
    snapshot: Column,
    limit: int = FLOOR_LIMIT,
    target: int = FLOOR_TARGET,
) -> DataFrame:
    """Items whose floor stock fell below the limit since the snapshot.

    The refill brings the floor up to the target as far as backstock lasts.
    """
    sold = (
        sold_since(sales, snapshot)
        .filter(F.col("timestamp") > snapshot)
        .groupBy("branch_id", "product_id")
        .agg(F.sum("quantity").alias("sold"))
    )
    floor_now = F.greatest(F.col("floor_qty") - F.coalesce("sold", F.lit(0)), F.lit(0))
    backstock = F.greatest(F.col("total_qty") - F.col("floor_qty"), F.lit(0))
    return (
        inventory.join(sold, ["branch_id", "product_id"], "left")
        .withColumns({"floor_now": floor_now, "backstock": backstock})
        .filter(F.col("floor_now") < limit)
        .select(
            "branch_id",
            "product_id",
            "floor_now",
            "backstock",
            F.least(F.col("backstock"), F.lit(target) - F.col("floor_now")).alias("refill"),
        )
    )


def replenishment_events(
    sales: DataFrame,
    inventory: DataFrame,
    snapshot: Column,
    limit: int = FLOOR_LIMIT,
    target: int = FLOOR_TARGET,
) -> DataFrame:
    """The ledger of an item's floor from the snapshot on: every day on which it fell below the limit.

    Day by day the floor falls by what was sold, to 0 at most, and rises by what
    came back.  If it then stands below the limit it is refilled up to the target
    as far as backstock lasts, and the next day starts from there.  A breach that
    nothing is left for is an event with a refill of 0.  Days without sales
    change nothing; lines after the snapshot count only, and items whose floor or
    total is unknown are left out.
    """
    days = (
        sold_since(sales, snapshot)
        .filter(F.col("timestamp") > snapshot)
        .groupBy("branch_id", "product_id", F.to_date("timestamp").alias("day"))
        .agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("sold"))
    )
    # One entry for each calendar day of the window at most.
    recorded = days.groupBy("branch_id", "product_id").agg(F.sort_array(F.collect_list(F.struct("day", "sold"))).alias("days"))
    event = "struct<day:date,floor_before:bigint,refill:bigint,backstock_after:bigint>"
    start = F.struct(
        F.col("floor_qty").cast("bigint").alias("floor"),
        F.greatest(F.col("total_qty") - F.col("floor_qty"), F.lit(0)).cast("bigint").alias("backstock"),
        F.array().cast(f"array<{event}>").alias("events"),
    )

    def next_state(state: Column, day: Column) -> Column:
        left = F.greatest(state["floor"] - day["sold"], F.lit(0).cast("bigint"))
        breach = left < limit
        refill = F.when(breach, F.least(state["backstock"], F.lit(target).cast("bigint") - left)).otherwise(F.lit(0).cast("bigint"))
        found = F.struct(
            day["day"].alias("day"), left.alias("floor_before"), refill.alias("refill"), (state["backstock"] - refill).alias("backstock_after")
        )
        return F.struct(
            (left + refill).alias("floor"),
            (state["backstock"] - refill).alias("backstock"),
            F.when(breach, F.concat(state["events"], F.array(found))).otherwise(state["events"]).alias("events"),
        )

    known = F.col("floor_qty").isNotNull() & F.col("total_qty").isNotNull()
    events = F.aggregate("days", start, next_state, lambda state: state["events"])
    return (
        inventory.filter(known)
        .join(recorded, ["branch_id", "product_id"])
        .select("branch_id", "product_id", F.inline(events))
    )


def price_string_clean(catalog: DataFrame, column: str = "price_text", decimal_comma: bool = False) -> DataFrame:
    """The price in a text such as "JOD 1,234.50"; NULL if there is none.

    Of several numbers the first with decimals counts, else the first.  A minus
    sign belongs to the number that follows it.  ``decimal_comma`` reads
    "1.234,50".  A range of two numbers is no price.
    """
    group, point = (r"\.", ",") if decimal_comma else (",", r"\.")
    whole = rf"(?:[0-9]{{1,3}}(?:{group}[0-9]{{3}})+|[0-9]+)"
    number = rf"(?<![0-9.,])-?{whole}(?:{point}[0-9]+)?(?![0-9]|[.,][0-9])"
    text = F.col(column)
    ranged = text.rlike(rf"[0-9]\s*(?:-|\u2013|to)\s*{whole}")
    found = F.regexp_extract_all(text, F.lit(number), F.lit(0))
    best = F.coalesce(F.get(F.filter(found, lambda n: n.rlike(rf"{point}[0-9]+$")), F.lit(0)), F.get(found, F.lit(0)))
    plain = F.regexp_replace(best, group, "")
    plain = F.regexp_replace(plain, ",", ".") if decimal_comma else plain
    return catalog.withColumn("price", F.when(~ranged, plain.try_cast("decimal(18,4)")))


def rolling_metrics(sales: DataFrame, products: DataFrame, sketch_bits: int | None = None) -> DataFrame:
    """Daily net, profit and invoices, and the same over the last 7 and 30 days.

    An invoice with lines on several days of a window counts once in it.  With
    ``sketch_bits`` (4 to 21) invoices are estimated from a mergeable sketch per
    day of 2 to that power registers, with a relative standard error of about
    1.04 / sqrt(registers); the sketches may be kept and merged for any window.
    """
    cost = F.col("quantity") * F.col("cost_jod")
    timed = sales.filter(F.col("timestamp").isNotNull()).withColumn("day", F.to_date("timestamp"))
    daily = (
        timed.join(products.select("product_id", "cost_jod"), "product_id", "left")
        .groupBy("day")
        .agg(
            F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net"),
            F.coalesce(F.sum(F.col("net_amount") - cost), F.lit(0)).alias("profit"),
        )
    )
    # One row per calendar day reaches the windows.
    days = W.partitionBy(F.lit(0)).orderBy(F.unix_date("day"))
    rolled = {
        f"{name}_{length}d": F.sum(name).over(days.rangeBetween(1 - length, 0))
        for length in ROLLING_DAYS
        for name in ("net", "profit")
    }
    if sketch_bits is None:
        counts = rolling_distinct(timed, "transaction_id", "transactions")
    else:
        counts = merged_distinct(daily_sketches(timed, "transaction_id", sketch_bits), "transactions")
    return daily.withColumns(rolled).join(counts, "day", "left")


def rolling_distinct(sales: DataFrame, key: str, name: str, lengths: Sequence[int] = ROLLING_DAYS) -> DataFrame:
    """Exact numbers of distinct keys per day and over the last days, for the days that have rows.

    A key counts in the windows that end on one of its days or less than a
    window's length after it.  So each of its days opens an interval that ends
    before the key's next day, or when the day leaves the window; a running total
    over the days of what opens and ends gives the numbers.
    """
    number = F.unix_date("day")
    seen = sales.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "day").agg(F.count("*").alias("rows"))
    following = F.lead(number).over(W.partitionBy("key").orderBy("day"))
    opened = seen.select("day", number.alias("at"), following.alias("next"))
    changes = []
    for length in (1, *lengths):
        end = F.least(F.col("at") + length, F.col("next"))
        changes.append(F.struct(F.lit(length).alias("length"), F.col("at").alias("at"), F.lit(1).alias("change")))
        changes.append(F.struct(F.lit(length).alias("length"), end.alias("at"), F.lit(-1).alias("change")))
    steps = opened.select(F.inline(F.array(*changes))).groupBy("length", "at").agg(F.sum("change").alias("change"))
    # Two rows per calendar day and length at most.
    running = W.partitionBy("length").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    held = steps.withColumn("held", F.sum("change").over(running))
    wanted = held.groupBy("at").pivot("length", [1, *lengths]).agg(F.max("held"))
    # On a day without a change the number is that of the last one with a change.
    days = sales.groupBy("day").agg(F.count("*").alias("rows")).select("day", number.alias("at"))
    line = W.partitionBy(F.lit(0)).orderBy("at")
    filled = days.join(wanted, "at", "full").select(
        "day", *[F.coalesce(F.last(str(n), ignorenulls=True).over(line), F.lit(0)).alias(f"held_{n}") for n in (1, *lengths)]
    )
    return filled.filter(F.col("day").isNotNull()).select(
        "day", F.col("held_1").alias(name), *[F.col(f"held_{n}").alias(f"{name}_{n}d") for n in lengths]
    )


def daily_sketches(sales: DataFrame, key: str, bits: int) -> DataFrame:
    """day and sketch: what is needed to count the distinct keys of any set of days."""
    return sales.groupBy("day").agg(F.hll_sketch_agg(key, F.lit(bits)).alias("sketch"))


def merged_distinct(sketches: DataFrame, name: str, lengths: Sequence[int] = ROLLING_DAYS) -> DataFrame:
    """Estimated numbers of distinct keys per day and over the last days, from the days' sketches."""
    reach = F.sequence(F.col("day"), F.date_add("day", max(lengths) - 1))
    spread = sketches.select(F.col("day").alias("own"), "sketch", F.explode(reach).alias("day"))
    age = F.datediff("day", "own")
    merged = {
        (name if length == 1 else f"{name}_{length}d"): F.hll_sketch_estimate(
            F.hll_union_agg(F.when(age < length, F.col("sketch")))
        )
        for length in (1, *lengths)
    }
    return spread.join(sketches.select("day"), "day", "left_semi").groupBy("day").agg(
        *[value.alias(column) for column, value in merged.items()]
    )


def low_stock_zero_sales(
    sales: DataFrame, inventory: DataFrame, since: Column | None = None, limit: int = FLOOR_LIMIT
) -> DataFrame:
    """Items low on the floor that nobody bought since ``since``, by default in the last 30 days."""
    recent = sold_since(sales, days_before_latest(sales, QUIET_DAYS) if since is None else since)
    sold = recent.select("branch_id", "product_id").distinct()
    return inventory.filter(F.col("floor_qty") < limit).join(
        sold, ["branch_id", "product_id"], "left_anti"
    )


def low_margin_flag(sales: DataFrame, products: DataFrame, limit_pct: float = MARGIN_LIMIT_PCT) -> DataFrame:
    """Sale lines whose profit is below the limit's share of their net amount.

    A line given away at a cost is flagged and has no margin; of a return, a
    line below zero, the loss is judged like any other.  Lines of unknown cost
    or amount are not judged.
    """
    net = F.col("net_amount")
    costed = sales.join(products.select("product_id", "cost_jod"), "product_id", "left")
    profit = net - F.col("quantity") * F.col("cost_jod")
    below = profit.cast("double") < F.abs(net).cast("double") * (limit_pct / 100)
    return costed.filter(below).select(
        "transaction_id",
        "product_id",
        "branch_id",
        "net_amount",
        profit.alias("gross_profit"),
        margin_pct().alias("margin_pct"),
    )
