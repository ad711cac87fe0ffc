"""Readers for Parquet, JDBC and CSV inputs."""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property, partial

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .schemas import SALE_DATE, STAR

# Columns that a source may lack.
OPTIONAL = {
    "discount_amount",
    "customer_id",
    "employee_id",
    "cost_jod",
    "price_jod",
    "category",
    "product_name_en",
    "birth_date",
    "join_date",
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in its types.

    Absent columns of ``OPTIONAL`` become NULL; an absent key, time or amount is
    an error, as sums over it would silently be 0.  Values that do not convert
    become NULL, as do NaN, which aggregates would otherwise propagate, and
    fractions where whole numbers are asked for.
    """
    named = {name.lower() for name in df.columns}
    missing = [f.name for f in schema.fields if f.name.lower() not in named | OPTIONAL]
    if missing:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    present = {name.lower(): field.dataType for name, field in zip(df.columns, df.schema.fields)}
    columns = []
    for field in schema.fields:
        source = present.get(field.name.lower())
        if source is None:
            value = F.lit(None).cast(field.dataType)
        elif source == field.dataType:
            value = F.col(field.name)
        else:
            value = _converted(F.col(field.name), source, field.dataType)
        columns.append(value.alias(field.name))
    if SALE_DATE in present and SALE_DATE not in schema.fieldNames():
        columns.append(F.col(SALE_DATE))
    return df.select(*columns)


def _converted(value: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(source, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value)
    if isinstance(target, T.IntegralType) and isinstance(source, (T.FractionalType, T.StringType)):
        number = value.try_cast("decimal(38,6)")
        value = F.when(number == F.floor(number), number)
    return value.try_cast(target)


def read_parquet_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return conform(spark.read.parquet(path), STAR[table])


def jdbc_options(
    url: str,
    table: str,
    partition_column: str | None = None,
    lower: str | None = None,
    upper: str | None = None,
    partitions: int | None = None,
    fetch_size: int = 10_000,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of a JDBC scan, split by ranges of ``partition_column``.

    Credentials come from the caller in ``extra``.  Bounds only place the
    splits; rows outside them are read by the first and last split.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    split = (partition_column, lower, upper, partitions)
    if any(part is not None for part in split):
        if any(part is None for part in split):
            raise ValueError("a partitioned scan needs column, both bounds and the number of partitions")
        options.update(
            partitionColumn=str(partition_column),
            lowerBound=str(lower),
            upperBound=str(upper),
            numPartitions=str(partitions),
        )
    options.update(extra or {})
    return options


def read_jdbc_table(spark: SparkSession, table: str, options: Mapping[str, str]) -> DataFrame:
    return conform(spark.read.format("jdbc").options(**options).load(), STAR[table])


def read_forecast_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; a missing path gives an empty frame."""
    try:
        return spark.read.csv(path, header=True, inferSchema=True, nullValue="NA", nanValue="NaN")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "date date, sales double")


MALFORMED = "malformed_row"
REASON = "reason"
_VALID = "valid"


@dataclass(frozen=True)
class CsvLoad:
    """What a CSV source held: ``rows`` in their types, and ``quarantine`` with each bad row's text and reason."""

    rows: DataFrame
    quarantine: DataFrame


def csv_header(spark: SparkSession, path: str, separator: str = ",") -> list[str]:
    """The names in the first line of a CSV, of which no more is read."""
    lines = spark.read.text(path).limit(1).collect()
    return next(csv.reader([line[0] for line in lines], delimiter=separator), [])


def load_forecast_csv(spark: SparkSession, path: str, target: str, separator: str = ",") -> CsvLoad:
    """Loads a CSV of dates and sales into ``target``, and sets its bad rows aside.

    The schema comes from the header: the date and the sales column are found by
    name (see ``resolve_forecast_columns``) and get their types, all others stay
    text.  A row is bad if it has more or fewer fields than the header, or a date
    or an amount that doesn't convert; missing ones (empty, ``NA``, ``NaN``) are
    NULL.  The files are read once, and good and bad rows are written to
    ``target`` in that pass, so the two always add up to what was read.
    """
    names = csv_header(spark, path, separator)
    if len(names) < 2 or len(set(map(str.lower, names))) < len(names):
        raise ValueError(f"a header with at least two different names is needed: {names}")
    date, sales = resolve_forecast_columns(names)
    kinds = {date: "date", sales: "double"}
    read = T.StructType([T.StructField(name, T.StringType()) for name in [*names, MALFORMED]])
    raw = spark.read.csv(
        path, schema=read, header=True, sep=separator, mode="PERMISSIVE", columnNameOfCorruptRecord=MALFORMED, enforceSchema=False
    )

    def cell(name: str) -> Column:
        value = F.trim(F.col(f"`{name}`"))
        return F.when(~F.lower(value).isin("", "na", "nan"), value)

    typed = {name: cell(name).try_cast(kinds[name]) if name in kinds else F.col(f"`{name}`") for name in names}
    reason = F.when(F.col(MALFORMED).isNotNull(), "fields")
    for name in (date, sales):
        reason = reason.when(cell(name).isNotNull() & typed[name].isNull(), f"{kinds[name]} {name}")
    text = F.coalesce(F.col(MALFORMED), F.to_csv(F.struct(*[F.col(f"`{n}`") for n in names]), {"sep": separator}))
    judged = raw.select(*[typed[n].alias(n) for n in names], text.alias(MALFORMED), reason.alias(REASON))
    bad = F.col(REASON).isNotNull()
    kept = [F.when(~bad, F.col(f"`{n}`")).alias(n) for n in names]
    judged.select(*kept, F.when(bad, F.col(MALFORMED)).alias(MALFORMED), REASON, (~bad).alias(_VALID)).write.mode(
        "overwrite"
    ).partitionBy(_VALID).parquet(target)
    schema = T.StructType([T.StructField(n, T.DateType() if n == date else T.DoubleType() if n == sales else T.StringType()) for n in names])
    schema = schema.add(MALFORMED, "string").add(REASON, "string").add(_VALID, "boolean")
    stored = spark.read.schema(schema).parquet(target)
    return CsvLoad(
        stored.filter(F.col(_VALID)).drop(MALFORMED, REASON, _VALID),
        stored.filter(~F.col(_VALID)).select(MALFORMED, REASON),
    )


def resolve_forecast_columns(columns: Sequence[str]) -> tuple[str, str]:
    """Names of the date and the sales column, guessed from the header.

    The first name holding "date" and the first holding "sale" or "total"
    win; without one, the first and the second column are taken.
    """
    dates = [c for c in columns if "date" in c.lower()]
    sales = [c for c in columns if "sale" in c.lower() or "total" in c.lower()]
    return (dates or list(columns))[0], sales[0] if sales else columns[1]


def dimension_keys(dimension: DataFrame, key: str) -> DataFrame:
    return dimension.select(key)


class Star:
    """One star schema.  Tables are read on first use.

    ``sales(*columns)`` projects the fact table; ``read`` gives one of the
    other tables by name; ``partitions`` are the fact's partition columns, and
    ``last_day`` gives the latest day of a fact stored by days, else None.
    ``location`` names a stored fact, and ``versions`` gives a frame with a row
    for each of its sale dates (NULL if it is not stored by dates) and a
    ``version`` that differs once the date's files do.
    """

    def __init__(
        self,
        sales: Callable[..., DataFrame],
        read: Callable[[str], DataFrame],
        partitions: Sequence[str] = (),
        last_day: Callable[[], dt.date | None] = lambda: None,
        location: str | None = None,
        versions: Callable[[], DataFrame] | None = None,
    ):
        self.sales = sales
        self.last_day = last_day
        self.location = location
        self.versions = versions
        self._read = read
        self._partitions = tuple(partitions)

    @property
    def dated(self) -> bool:
        """Whether the fact is stored by sale dates."""
        return SALE_DATE in self._partitions

    def dated_sales(self, *columns: str) -> DataFrame:
        """The columns and the partition columns, by which time windows skip whole folders."""
        return self.sales(*columns, *(p for p in self._partitions if p not in columns))

    @cached_property
    def products(self) -> DataFrame:
        return self._read("dim_products")

    @cached_property
    def sections(self) -> DataFrame:
        return self._read("dim_sections")

    @cached_property
    def branches(self) -> DataFrame:
        return self._read("dim_branches")

    @cached_property
    def customers(self) -> DataFrame:
        return self._read("dim_customers")

    @cached_property
    def employees(self) -> DataFrame:
        return self._read("dim_employees")

    @cached_property
    def inventory(self) -> DataFrame:
        return self._read("central_inventory")


def parquet_star(spark: SparkSession, root: str) -> Star:
    """A star stored as one Parquet folder per table below ``root``.

    The fact's files are listed anew whenever its lines are asked for, so what
    others have added since is seen.
    """

    def read(table: str) -> DataFrame:
        return read_parquet_table(spark, f"{root}/{table}", table)

    path = f"{root}/fact_sales"
    kind = spark.read.parquet(path).schema

    def sales(*columns: str) -> DataFrame:
        return conform(spark.read.schema(kind).parquet(path), STAR["fact_sales"]).select(*columns)

    stored = [c for c in kind.fieldNames() if c == SALE_DATE]
    last_day = partial(_last_folder, spark, path) if stored else lambda: None
    return Star(sales, read, stored, last_day, path, partial(file_versions, spark, path))


def file_versions(spark: SparkSession, *paths: str) -> DataFrame:
    """sale_date and version of stored files, by their names, sizes and times; no file is opened."""
    files = spark.read.format("binaryFile").load(list(paths))
    date = F.col(SALE_DATE).cast("date") if SALE_DATE in files.columns else F.lit(None).cast("date")
    mark = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    return files.groupBy(date.alias(SALE_DATE)).agg(
        F.concat_ws("-", F.count("*"), F.sum("length"), F.bit_xor(mark)).alias("version")
    )


def _last_folder(spark: SparkSession, path: str) -> dt.date | None:
    """The latest day that has a folder, from their names alone."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    days = [name.removeprefix(f"{SALE_DATE}=") for name in names if name.startswith(f"{SALE_DATE}=")]
    return max((dt.date.fromisoformat(day) for day in days if day[:1].isdigit()), default=None)


def jdbc_star(spark: SparkSession, options: Callable[[str], Mapping[str, str]]) -> Star:
    """A star in a database; ``options`` gives the scan options of a table.

    The fact has to be split (see ``jdbc_options``), or all of it would come
    through one connection.
    """

    def read(table: str) -> DataFrame:
        asked = options(table)
        if table == "fact_sales" and "partitionColumn" not in asked:
            raise ValueError("the scan of fact_sales needs a partition column")
        return read_jdbc_table(spark, table, asked)

    return Star(lambda *columns: read("fact_sales").select(*columns), read)
