"""Sinks: appended sale lines and result tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import drop_path
from .readers import conform
from .schemas import FACT_SALES, LOAD_BATCH, NO_DATE, SALE_DATE

_NAME = re.compile(r"[A-Za-z0-9._-]+")

MAX_ROWS_PER_FILE = 20_000_000


def append_sales(lines: DataFrame, path: str, batch_id: str | None = None) -> None:
    """Append sale lines to the fact table, one folder per sale date.

    With ``batch_id``, the caller's name of this load, the lines lie in a folder
    of that name within each sale date, and take the place of what the same
    batch wrote before: a job that is repeated, or broke off and runs again, adds
    nothing twice, and dates that the batch no longer holds are taken back.
    Every load of a table has a batch id, or none has.

    The rebalance hint gathers the rows of a date into few files and still
    splits a date that holds a large part of all rows over many tasks.
    """
    rows = conform(lines, FACT_SALES).withColumn(SALE_DATE, F.to_date("timestamp"))
    if batch_id is None:
        dealt = rows.hint("rebalance", SALE_DATE).write.mode("append")
        dealt.option("maxRecordsPerFile", MAX_ROWS_PER_FILE).partitionBy(SALE_DATE).parquet(path)
        return
    if not _NAME.fullmatch(batch_id):
        raise ValueError("a batch id is made of letters, digits, dots, dashes and underscores")
    before = _folders_of(lines.sparkSession, path, batch_id)
    (
        rows.withColumn(LOAD_BATCH, F.lit(batch_id))
        .hint("rebalance", SALE_DATE)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy(SALE_DATE, LOAD_BATCH)
        .parquet(path)
    )
    if before:
        written = conform(lines, FACT_SALES).select(F.to_date("timestamp").alias(SALE_DATE)).distinct().collect()
        names = {f"{SALE_DATE}={row[0] or NO_DATE}" for row in written}
        for folder in before:
            if folder not in names:
                drop_path(lines.sparkSession, f"{path}/{folder}/{LOAD_BATCH}={batch_id}")


def _folders_of(spark: SparkSession, path: str, batch_id: str) -> list[str]:
    """The sale dates' folders in which a batch has written."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SALE_DATE}=*/{LOAD_BATCH}={batch_id}"))
    return [entry.getPath().getParent().getName() for entry in found or ()]


def write_result(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    result.write.mode(mode).parquet(path)
