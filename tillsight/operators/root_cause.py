"""Profit drops and section drops, and what lies behind them.

Every day of the history is judged in one job.  The operators read one
rollup, ``section_days``: sums per branch, section and day.  Employees and
invoices are counted apart from it, and only where a finding needs them: for
the branches and days that are compared, and for the monitored sections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Thresholds and the texts of the verdicts.
HISTORY_DAYS = 44
SAME_WEEKDAYS = 5
DROP_LIMIT = 0.35
SIGMAS = 2
FLOOR_LIMIT = 4
FLOOR_UNKNOWN = 99
DISCOUNT_LIMIT = 0.20
TREND_DAYS = 15
LOW_FLOOR = "Low Floor Stock Availability"
HIGH_DISCOUNT = "High Discount Impact"
STAFF_SHORTAGE = "Staffing Shortage"
MIXED = "Mixed Operational Factors"
UNDERSTAFFED = "Understaffed"
ADEQUATE = "Adequate"
LOW_STOCK = "Low Stock on Floor"
STAFF_INADEQUATE = "Staffing Inadequacy"
LOW_TRAFFIC = "Low Section Traffic"
PRODUCT_MIX = "Product Mix/Assortment Failure"
MONITORED_SECTIONS = ("Women", "Men", "Kids")


def section_sums(sales: DataFrame, products: DataFrame, *by: str) -> DataFrame:
    """Net and discount per branch, section, day and the columns ``by``; no line is lost."""
    return (
        sales.filter(F.col("timestamp").isNotNull())
        .join(products.select("product_id", "section_id"), "product_id", "left")
        .groupBy("branch_id", "section_id", F.to_date("timestamp").alias("day"), *by)
        .agg(
            F.coalesce(F.sum("net_amount"), F.lit(0)).alias("net_amount"),
            F.coalesce(F.sum("discount_amount"), F.lit(0)).alias("discount_amount"),
        )
    )


def with_section_names(sums: DataFrame, sections: DataFrame) -> DataFrame:
    return sums.join(sections, "section_id", "left").drop("section_id")


def section_days(sales: DataFrame, products: DataFrame, sections: DataFrame) -> DataFrame:
    """Net and discount per branch, section and day, with the sections' names.

    The names are joined to the sums, not to the lines.
    """
    return with_section_names(section_sums(sales, products), sections)


def _section_names(products: DataFrame, sections: DataFrame) -> DataFrame:
    return products.select("product_id", "section_id").join(sections, "section_id").select(
        "product_id", "section_name"
    )


def daily_net(rollup: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("net_amount"), F.lit(0))
    return rollup.groupBy("day").agg(total.cast("double").alias("net_amount"))


def branch_days(rollup: DataFrame) -> DataFrame:
    return rollup.groupBy("branch_id", "day").agg(
        F.sum("net_amount").alias("net_amount"),
        F.sum("discount_amount").alias("discount_amount"),
    )


def _day_number(day: str = "day") -> Column:
    return F.unix_date(day)


def profit_trigger(daily: DataFrame) -> DataFrame:
    """Each day against its last five same weekdays within 44 days.

    A day is anomalous if it lies more than 35 % below their mean or more
    than two population deviations below it.  A day without sales has no
    row and is never judged.  At most six same weekdays fit in the window,
    so the sixth is dropped by a slice of the collected days.
    """
    recent = W.partitionBy(F.weekday("day")).orderBy(_day_number()).rangeBetween(-HISTORY_DAYS, -1)
    collected = F.collect_list(F.struct("day", "net_amount")).over(recent)
    history = F.slice(
        collected, F.greatest(F.size(collected) - SAME_WEEKDAYS + 1, F.lit(1)), F.lit(SAME_WEEKDAYS)
    )
    judged = daily.withColumn("past", history).select(
        "day",
        "net_amount",
        F.transform("past", lambda d: d["day"]).alias("history"),
        F.transform("past", lambda d: d["net_amount"]).alias("values"),
    )
    size = F.size("history")
    total = F.aggregate("values", F.lit(0.0), lambda acc, v: acc + v)
    with_mean = judged.withColumns(
        {"history_days": size, "mean_net": F.try_divide(total, size.cast("double"))}
    )
    squares = F.aggregate(
        "values",
        F.lit(0.0),
        lambda acc, v: acc + (v - F.col("mean_net")) * (v - F.col("mean_net")),
    )
    with_std = with_mean.withColumn(
        "std_net", F.sqrt(F.try_divide(squares, F.col("history_days").cast("double")))
    )
    mean, std, net = F.col("mean_net"), F.col("std_net"), F.col("net_amount")
    drop = F.when(mean > 0, (mean - net) / mean).when(mean.isNotNull(), 0.0)
    return with_std.withColumn("drop_pct", drop).select(
        "day",
        "net_amount",
        "history_days",
        "mean_net",
        "std_net",
        "drop_pct",
        F.coalesce((F.col("drop_pct") > DROP_LIMIT) | (net < mean - SIGMAS * std), F.lit(False)).alias(
            "is_anomaly"
        ),
        "history",
    )


def _with_reference_days(days: DataFrame, *keep: str) -> DataFrame:
    """One row per judged day and reference day: its history and itself."""
    return days.select(
        "day", *keep, F.explode(F.concat("history", F.array("day"))).alias("ref_day")
    )


def _fall(amount: str, history_days: Column) -> tuple[Column, Column]:
    on_day = F.col("ref_day") == F.col("day")
    before = F.sum(F.when(~on_day, F.col(amount)).otherwise(0)).cast("double") / history_days
    now = F.sum(F.when(on_day, F.col(amount)).otherwise(0)).cast("double")
    return before, now


def branch_drops(trigger: DataFrame, rollup: DataFrame, branches: DataFrame) -> DataFrame:
    """Per anomalous day and branch, the fall against the branch's history.

    A history day without sales of the branch counts as 0.
    """
    reference = _with_reference_days(trigger.filter("is_anomaly"), "history_days")
    per_branch = branch_days(rollup).withColumnRenamed("day", "ref_day")
    before, now = _fall("net_amount", F.max("history_days"))
    return (
        reference.join(per_branch, "ref_day")
        .groupBy("day", "branch_id")
        .agg(before.alias("avg_same_day"), now.alias("day_net"))
        .filter(F.col("avg_same_day") > 0)
        .join(branches, "branch_id")
        .withColumn("branch_drop", (F.col("avg_same_day") - F.col("day_net")) / F.col("avg_same_day"))
    )


def worst_branch(trigger: DataFrame, drops: DataFrame) -> DataFrame:
    """The branch with the largest fall, the lowest id among equals."""
    worst = drops.groupBy("day").agg(
        F.min(
            F.struct(
                (-F.col("branch_drop")).alias("rank"),
                "branch_id",
                "branch_name",
                "avg_same_day",
                "day_net",
                "branch_drop",
            )
        ).alias("w")
    )
    return (
        trigger.filter("is_anomaly")
        .select("day", "history", "history_days", F.col("drop_pct").alias("total_drop"))
        .join(worst, "day", "left")
        .select("day", "history", "history_days", "total_drop", "w.*")
        .drop("rank")
    )


def worst_section(branch: DataFrame, rollup: DataFrame) -> DataFrame:
    """Inside the worst branch of a day, the section with the largest fall."""
    reference = _with_reference_days(branch, "branch_id", "history_days")
    per_section = (
        rollup.filter(F.col("section_name").isNotNull())
        .groupBy("branch_id", "section_name", F.col("day").alias("ref_day"))
        .agg(F.sum("net_amount").alias("net_amount"))
    )
    before, now = _fall("net_amount", F.max("history_days"))
    falls = (
        reference.join(per_section, ["branch_id", "ref_day"])
        .groupBy("day", "section_name")
        .agg(before.alias("section_avg_same_day"), now.alias("section_day_net"))
        .filter(F.col("section_avg_same_day") > 0)
        .withColumn(
            "section_drop",
            (F.col("section_avg_same_day") - F.col("section_day_net")) / F.col("section_avg_same_day"),
        )
    )
    worst = falls.groupBy("day").agg(
        F.min(
            F.struct(
                (-F.col("section_drop")).alias("rank"),
                "section_name",
                "section_avg_same_day",
                "section_day_net",
                "section_drop",
            )
        ).alias("w")
    )
    return branch.join(worst, "day", "left").select(*branch.columns, "w.*").drop("rank")


def section_floor(inventory: DataFrame, products: DataFrame, sections: DataFrame) -> DataFrame:
    """Mean floor quantity by branch and section."""
    return (
        inventory.join(_section_names(products, sections), "product_id")
        .groupBy("branch_id", "section_name")
        .agg(F.avg("floor_qty").alias("avg_floor"))
    )


def floor_stock(section: DataFrame, floor: DataFrame) -> DataFrame:
    """Floor stock of the worst section; unknown stock counts as ample."""
    return section.join(floor, ["branch_id", "section_name"], "left").select(
        "day",
        "branch_id",
        "section_name",
        "avg_floor",
        (F.coalesce("avg_floor", F.lit(FLOOR_UNKNOWN)) < FLOOR_LIMIT).alias("stock_issue"),
    )


def discount_ratio(branch: DataFrame, rollup: DataFrame) -> DataFrame:
    """Discounts over sales of the worst branch, on the day and its history."""
    per_branch = branch_days(rollup).withColumnRenamed("day", "ref_day")
    compared = _with_reference_days(branch, "branch_id").join(per_branch, ["branch_id", "ref_day"], "left")
    sums = compared.groupBy("day").agg(
        F.max("branch_id").alias("branch_id"),
        F.coalesce(F.sum("discount_amount"), F.lit(0)).cast("double").alias("total_discount"),
        F.sum("net_amount").cast("double").alias("total_sales"),
    )
    # Missing or zero sales divide by 1; negative sales give no ratio.
    divisor = F.coalesce(F.nullif(F.col("total_sales"), F.lit(0.0)), F.lit(1.0))
    ratio = F.when(divisor > 0, F.col("total_discount") / divisor).otherwise(0.0)
    return sums.select(
        "day",
        "branch_id",
        "total_discount",
        "total_sales",
        ratio.alias("discount_ratio"),
        (ratio > DISCOUNT_LIMIT).alias("discount_issue"),
    )


def staffing(branch: DataFrame, sales: DataFrame) -> DataFrame:
    """Employees with sales on the day against the mean of days with sales.

    Only the branches and days that are compared keep their lines.
    """
    compared = _with_reference_days(branch, "branch_id")
    lines = sales.filter(F.col("timestamp").isNotNull()).select(
        "branch_id", F.to_date("timestamp").alias("ref_day"), "employee_id"
    )
    heads = (
        lines.join(compared.select("branch_id", "ref_day").distinct(), ["branch_id", "ref_day"], "left_semi")
        .groupBy("branch_id", "ref_day")
        .agg(F.count_distinct("employee_id").alias("staff"))
    )
    on_day = F.col("ref_day") == F.col("day")
    counts = compared.join(heads, ["branch_id", "ref_day"], "left").groupBy("day").agg(
        F.max("branch_id").alias("branch_id"),
        F.coalesce(F.max(F.when(on_day, F.col("staff"))), F.lit(0)).alias("day_staff"),
        F.coalesce(F.avg(F.when(~on_day, F.col("staff"))), F.lit(0.0)).alias("avg_staff"),
    )
    short = F.col("day_staff") < F.col("avg_staff")
    return counts.select(
        "day",
        "branch_id",
        "day_staff",
        "avg_staff",
        F.when(short, UNDERSTAFFED).otherwise(ADEQUATE).alias("staffing_status"),
    )


def profit_diagnosis(section: DataFrame, rollup: DataFrame, sales: DataFrame, floor: DataFrame) -> DataFrame:
    """One alert per anomalous day with its primary reason."""
    stock = floor_stock(section, floor).select("day", "avg_floor", "stock_issue")
    discounts = discount_ratio(section, rollup).drop("branch_id")
    heads = staffing(section, sales).drop("branch_id")
    reason = (
        F.when(F.col("stock_issue"), LOW_FLOOR)
        .when(F.col("discount_issue"), HIGH_DISCOUNT)
        .when(F.col("staffing_status") == UNDERSTAFFED, STAFF_SHORTAGE)
        .otherwise(MIXED)
    )
    return (
        section.join(stock, "day")
        .join(discounts, "day")
        .join(heads, "day")
        .select(
            "day",
            "branch_id",
            "branch_name",
            "section_name",
            (F.col("total_drop") * 100).alias("total_drop_pct"),
            (F.col("section_drop") * 100).alias("section_drop_pct"),
            "avg_floor",
            "stock_issue",
            "discount_ratio",
            "discount_issue",
            "staffing_status",
            reason.alias("primary_reason"),
        )
    )


def section_contribution(rollup: DataFrame, branches: DataFrame) -> DataFrame:
    """Share of each section in its branch's net sales of the day, in percent."""
    per_section = (
        rollup.filter(F.col("section_name").isNotNull())
        .groupBy("branch_id", "section_name", "day")
        .agg(F.sum("net_amount").cast("double").alias("section_revenue"))
        .join(branches, "branch_id")
    )
    branch_day = W.partitionBy("branch_id", "day")
    total = F.sum("section_revenue").over(branch_day)
    return per_section.withColumn(
        "contribution", F.try_divide(F.col("section_revenue"), total) * 100
    )


def section_anomalies(
    contribution: DataFrame, monitored: Sequence[str] = MONITORED_SECTIONS
) -> DataFrame:
    """Sections whose share lies more than a deviation below the last 15 days."""
    trend = (
        W.partitionBy("branch_id", "section_name")
        .orderBy(_day_number())
        .rangeBetween(-TREND_DAYS, -1)
    )
    expected, deviation = F.avg("contribution"), F.stddev_samp("contribution")
    return (
        contribution.filter(F.col("section_name").isin(*monitored))
        .withColumns(
            {
                "expected_contribution": expected.over(trend),
                "deviation": F.coalesce(deviation.over(trend), F.lit(0.0)),
            }
        )
        .filter(F.col("contribution") < F.col("expected_contribution") - F.col("deviation"))
    )


def section_visits(
    anomalies: DataFrame, sales: DataFrame, products: DataFrame, sections: DataFrame
) -> DataFrame:
    """Employees and invoices of the flagged sections, and their means over the days with sales of the 15 before.

    Only the lines of flagged sections and of the days that are compared are counted.
    """
    key = ("branch_id", "section_name", "day")
    since = F.sequence(F.date_sub("day", TREND_DAYS), F.col("day"))
    compared = anomalies.select(*key).withColumn("ref_day", F.explode(since))
    names = _section_names(products, sections).join(anomalies.select("section_name").distinct(), "section_name", "left_semi")
    wanted = compared.select("branch_id", "section_name", "ref_day").distinct()
    visits = (
        sales.filter(F.col("timestamp").isNotNull())
        .join(names, "product_id")
        .select("branch_id", "section_name", F.to_date("timestamp").alias("ref_day"), "employee_id", "transaction_id")
        .join(wanted, ["branch_id", "section_name", "ref_day"], "left_semi")
        .groupBy("branch_id", "section_name", "ref_day")
        .agg(
            F.count_distinct("employee_id").alias("staff"),
            F.count_distinct("transaction_id").alias("traffic"),
        )
    )
    on_day = F.col("ref_day") == F.col("day")
    return (
        compared.join(visits, ["branch_id", "section_name", "ref_day"])
        .groupBy(*key)
        .agg(
            F.max(F.when(on_day, F.col("staff"))).alias("staff"),
            F.max(F.when(on_day, F.col("traffic"))).alias("traffic"),
            F.avg(F.when(~on_day, F.col("staff"))).alias("avg_staff"),
            F.avg(F.when(~on_day, F.col("traffic"))).alias("avg_traffic"),
        )
    )


def section_diagnosis(anomalies: DataFrame, floor: DataFrame, visits: DataFrame) -> DataFrame:
    """One alert per flagged section with its bottleneck and the evidence.

    Numbers in the evidence are rounded as decimal text, ties to the even digit.
    """
    checked = anomalies.join(floor, ["branch_id", "section_name"], "left").join(
        visits, ["branch_id", "section_name", "day"], "left"
    )
    low_stock = F.coalesce("avg_floor", F.lit(FLOOR_UNKNOWN)) < FLOOR_LIMIT
    few_staff = F.col("staff") < F.col("avg_staff")
    few_visits = F.coalesce("traffic", F.lit(0)) < F.coalesce("avg_traffic", F.lit(0.0))
    section = F.col("section_name")
    bottleneck = (
        F.when(low_stock, LOW_STOCK)
        .when(few_staff, STAFF_INADEQUATE)
        .when(few_visits, LOW_TRAFFIC)
        .otherwise(PRODUCT_MIX)
    )
    # Evidence texts.
    evidence = (
        F.when(
            low_stock,
            F.format_string(
                "Average Floor Quantity for %s is %.1f (Threshold: < 4).",
                section,
                F.bround("avg_floor", 1),
            ),
        )
        .when(
            few_staff,
            F.format_string(
                "Active staff for %s was %d (15-day average: %.1f).",
                section,
                F.col("staff"),
                F.bround("avg_staff", 1),
            ),
        )
        .when(
            few_visits,
            F.format_string(
                "Section traffic was %d transactions (15-day average: %.1f).",
                F.col("traffic"),
                F.bround("avg_traffic", 1),
            ),
        )
        .otherwise("Inventory, Staffing, and Traffic appear normal.")
    )
    return checked.select(
        "branch_id",
        "branch_name",
        "section_name",
        "day",
        "contribution",
        "expected_contribution",
        bottleneck.alias("bottleneck"),
        evidence.alias("details"),
    )


def anomaly_scope(drops: DataFrame) -> DataFrame:
    """Whether a profit drop is systemic: at least half the branches fell."""
    share = F.try_divide(
        F.count_if(F.col("branch_drop") > DROP_LIMIT).cast("double"), F.count("*").cast("double")
    )
    return (
        drops.groupBy("day")
        .agg(F.count("*").alias("branches"), share.alias("fallen_share"))
        .withColumn("scope", F.when(F.col("fallen_share") >= 0.5, "systemic").otherwise("localized"))
    )
