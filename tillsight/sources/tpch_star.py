"""The test tables seen as the retail star.

Each derived column follows the mapping in FIXTURES.md.  The fact columns
come from several source tables; ``sales`` joins only the sources that the
requested columns need, as the keys are complete and unique on the joined
side (checked in the tests), so a join left out changes no row.
"""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .readers import Star, file_versions
from .schemas import MONEY, SCENARIOS

MONITORED_SECTIONS = ("STANDARD", "ECONOMY", "MEDIUM")
FIRST_BRANCH = 101

_LINE_COLUMNS = {
    "transaction_id": lambda: F.col("l_orderkey"),
    "product_id": lambda: F.col("l_partkey"),
    "employee_id": lambda: F.col("l_suppkey"),
    "quantity": lambda: F.col("l_quantity").cast("int"),
    "gross_amount": lambda: F.col("l_extendedprice").cast(MONEY),
    "discount_amount": lambda: (F.col("l_extendedprice") * F.col("l_discount")).cast(MONEY),
    "net_amount": lambda: (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(MONEY),
}
_ORDER_COLUMNS = {
    "timestamp": lambda: F.col("o_orderdate"),
    "customer_id": lambda: F.col("o_custkey"),
}
_BRANCH_COLUMNS = {"branch_id": lambda: F.col("n_regionkey") + FIRST_BRANCH}
# Holiday ranges inside the years of the test orders, in
# priority order, a later event overriding an earlier one.
HOLIDAYS = (
    ("Eid Al-Fitr Season", (("1996-02-10", "1996-02-24"), ("1997-01-30", "1997-02-13"), ("1998-01-20", "1998-02-03"), ("1999-03-10", "1999-03-22"))),
    ("Eid Al-Adha Season", (("1996-04-18", "1996-05-02"), ("1997-04-08", "1997-04-22"), ("1998-03-28", "1998-04-11"))),
    ("Christmas Season", (("1995-12-11", "1995-12-25"), ("1996-12-15", "1996-12-30"), ("1997-12-15", "1997-12-30"), ("1998-12-15", "1998-12-30"))),
    ("Mother's Day Focus", (("1997-03-15", "1997-03-22"), ("1998-03-15", "1998-03-22"), ("1999-03-15", "1999-03-24"))),
)
HOLIDAY_FORECAST_YEAR = 2000


# Column types of the test tables that are read here.  Giving
# them saves the job that would read them from a file footer.
_TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_quantity double, "
    "l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "customer": "c_custkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def table_schema(name: str) -> str:
    return _TABLES[name]


def tpch_star(spark: SparkSession, sf_dir: str) -> Star:
    """A star over the test tables in ``sf_dir``."""
    fact = [f"{sf_dir}/{name}.parquet" for name in ("lineitem", "orders", "supplier", "nation")]
    return Star(
        partial(_sales, spark, sf_dir),
        partial(_dimension, spark, sf_dir),
        location=sf_dir,
        versions=partial(file_versions, spark, *fact),
    )


def purchase_star(spark: SparkSession, sf_dir: str) -> Star:
    """The same dimensions with purchase events as the fact."""
    return Star(purchase_sales(spark, sf_dir).select, partial(_dimension, spark, sf_dir))


def _dimension(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    tables = {
        "dim_products": _products,
        "dim_sections": _sections,
        "dim_branches": _branches,
        "dim_customers": _customers,
        "dim_employees": _employees,
        "central_inventory": _inventory,
    }
    return tables[table](spark, sf_dir)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("employee_id"))


def _sales(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    if any(c in _BRANCH_COLUMNS for c in columns):
        homes = _table(spark, sf_dir, "supplier").join(
            _table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
        )
        lines = lines.join(homes, F.col("l_suppkey") == F.col("s_suppkey"))
    if any(c in _ORDER_COLUMNS for c in columns):
        lines = lines.join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    derived = {**_LINE_COLUMNS, **_ORDER_COLUMNS, **_BRANCH_COLUMNS}
    return lines.select(*[derived[c]().alias(c) for c in columns])


def _section_id() -> Column:
    return (F.ascii("p_type") * 100 + F.length("p_type")).alias("section_id")


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = ((F.col("p_retailprice") - 900) * 2).cast(MONEY)
    rate = F.lit(4) + F.col("p_size") % 5
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name_en"),
        F.col("p_brand").alias("category"),
        _section_id(),
        (price * rate / 10).cast(MONEY).alias("cost_jod"),
        price.alias("price_jod"),
    )


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _table(spark, sf_dir, "part")
        .select(_section_id(), F.col("p_type").alias("section_name"))
        .distinct()
    )


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "region").select(
        (F.col("r_regionkey") + FIRST_BRANCH).alias("branch_id"), F.col("r_name").alias("branch_name")
    )


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.make_date((F.lit(1965) + key % 50).cast("int"), F.lit(1), F.lit(1)).alias("birth_date"),
        F.date_add(F.lit(dt.date(1995, 1, 1)), (key * 37 % 2400).cast("int")).alias("join_date"),
    )


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every branch stocks every product: one row per region and part.

    The planner takes the exploded regions for one row per part.  By that estimate
    it would broadcast an inventory many times as large, hence the hint.
    """
    regions = _table(spark, sf_dir, "region").agg(F.array_sort(F.collect_set("r_regionkey"))).scalar()
    stocked = _table(spark, sf_dir, "part").select(
        "p_partkey", "p_type", F.explode(regions).alias("r_regionkey")
    )
    return stocked.hint("merge").select(
        (F.col("r_regionkey") + FIRST_BRANCH).alias("branch_id"),
        F.col("p_partkey").alias("product_id"),
        ((F.col("r_regionkey") + F.length("p_type")) % 3 * 3 + F.col("p_partkey") % 3)
        .cast("int")
        .alias("floor_qty"),
        (1 + (F.col("p_partkey") * 13 + F.col("r_regionkey") * 5) % 200).cast("int").alias("total_qty"),
    )


def purchases(events: DataFrame) -> DataFrame:
    """Purchase events as sale lines with a time of day."""
    amount = F.col("value").cast(MONEY)
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("transaction_id"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 5 + FIRST_BRANCH).cast("int").alias("branch_id"),
        (F.col("user_id") % 25).alias("employee_id"),
        F.col("user_id").alias("customer_id"),
        F.lit(1).alias("quantity"),
        amount.alias("gross_amount"),
        amount.alias("net_amount"),
    )


def purchase_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchases(_table(spark, sf_dir, "events"))


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One what-if scenario per part, covering the input ranges."""
    key = F.col("p_partkey")
    rates = {"p": key % 41, "d": key * 7 % 61, "i": key * 11 % 51, "w": key * 13 % 31, "r": key * 17 % 101}
    return _table(spark, sf_dir, "part").select(
        key.alias("scenario_id"), *[rates[f.name].cast("double").alias(f.name) for f in SCENARIOS.fields[1:]]
    )


def price_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices the way a scraped catalog writes them."""
    price = F.format_string("%.2f", F.col("p_retailprice"))
    return _table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("JOD "), price))
        .when(F.col("p_partkey") % 4 == 1, F.concat(price, F.lit(" JOD")))
        .when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("JD 1,"), price))
        .otherwise("on request")
        .alias("price_text"),
    )
