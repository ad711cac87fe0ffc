"""The star schema: one fact at sale-line grain and six dimensions.

Names are lower case; Spark resolves columns without regard to case, so
tables that spell them differently load the same way.  Date-times carry no
zone, as in the databases these tables come from, which also lets filters
on them reach the Parquet scan without a cast.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 4)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


FACT_SALES = _schema(
    ("transaction_id", T.LongType()),
    ("timestamp", T.TimestampNTZType()),
    ("branch_id", T.IntegerType()),
    ("product_id", T.LongType()),
    ("employee_id", T.LongType()),
    ("customer_id", T.LongType()),
    ("quantity", T.IntegerType()),
    ("gross_amount", MONEY),
    ("discount_amount", MONEY),
    ("net_amount", MONEY),
)
DIM_PRODUCTS = _schema(
    ("product_id", T.LongType()),
    ("product_name_en", T.StringType()),
    ("category", T.StringType()),
    ("section_id", T.IntegerType()),
    ("cost_jod", MONEY),
    ("price_jod", MONEY),
)
DIM_SECTIONS = _schema(("section_id", T.IntegerType()), ("section_name", T.StringType()))
DIM_BRANCHES = _schema(("branch_id", T.IntegerType()), ("branch_name", T.StringType()))
DIM_CUSTOMERS = _schema(
    ("customer_id", T.LongType()),
    ("birth_date", T.DateType()),
    ("join_date", T.DateType()),
)
DIM_EMPLOYEES = _schema(("employee_id", T.LongType()))
CENTRAL_INVENTORY = _schema(
    ("branch_id", T.IntegerType()),
    ("product_id", T.LongType()),
    ("floor_qty", T.IntegerType()),
    ("total_qty", T.IntegerType()),
)
HOLIDAY_CALENDAR = _schema(
    ("priority", T.IntegerType()),
    ("event", T.StringType()),
    ("start_date", T.DateType()),
    ("end_date", T.DateType()),
)
SCENARIOS = _schema(
    ("scenario_id", T.LongType()),
    ("p", T.DoubleType()),
    ("d", T.DoubleType()),
    ("i", T.DoubleType()),
    ("w", T.DoubleType()),
    ("r", T.DoubleType()),
)

STAR = {
    "fact_sales": FACT_SALES,
    "dim_products": DIM_PRODUCTS,
    "dim_sections": DIM_SECTIONS,
    "dim_branches": DIM_BRANCHES,
    "dim_customers": DIM_CUSTOMERS,
    "dim_employees": DIM_EMPLOYEES,
    "central_inventory": CENTRAL_INVENTORY,
}

# Derived partition column of the stored fact table.
SALE_DATE = "sale_date"
# The folder of one load within a sale date, and the name of the folder of no date.
LOAD_BATCH = "load_batch"
NO_DATE = "__HIVE_DEFAULT_PARTITION__"
