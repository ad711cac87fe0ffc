"""Daily revenue of a stream, with the rows that came too late kept and counted.

A stateful aggregation drops what lies behind its watermark without a trace of
the rows.  Here each micro-batch adds its own sums: what is on time is folded to
days, what is late goes to a table of its own, and the batch's counts are stored
beside them.  Sums of batches add up, so no state is held; each batch writes
under its number, and one that is repeated overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import path_exists
from .daily_revenue import WATERMARK, as_utc

_BATCH = "batch"
_COUNTS = "rows long, late_rows long, latest timestamp, watermark timestamp"


def _counts(spark: SparkSession, path: str) -> DataFrame:
    if path_exists(spark, f"{path}/batches"):
        return spark.read.schema(f"{_COUNTS}, {_BATCH} long").parquet(f"{path}/batches")
    return spark.createDataFrame([], f"{_COUNTS}, {_BATCH} long")


def start_counted_revenue(
    sales: DataFrame, path: str, checkpoint_path: str, watermark: str = WATERMARK, available_now: bool = False
) -> StreamingQuery:
    """Adds up the gross sales of a stream by day below ``path``.

    A line is late if its day had ended by the watermark: the latest time of the
    batches before, less ``watermark``.  Lines without a time are late as well.
    """
    timed = sales.withColumn("event_time", as_utc())

    def write_batch(lines: DataFrame, batch_id: int) -> None:
        spark = lines.sparkSession
        before = _counts(spark, path).filter(F.col(_BATCH) < batch_id)
        limit = before.agg((F.max("latest") - F.expr(f"INTERVAL {watermark}")).alias("limit")).first()[0]
        day = F.date_from_unix_date(F.floor(F.unix_seconds("event_time") / 86400).cast("int"))
        day_end = F.timestamp_seconds((F.unix_date("day") + 1) * 86400)
        behind = F.lit(False) if limit is None else day_end <= F.lit(limit)
        held = lines.withColumn("day", day)
        held = held.withColumn("late", F.col("event_time").isNull() | behind)
        seen = Observation()
        observed = held.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"), F.max("event_time").alias("latest")
        )
        # The lines of one micro-batch; both tables are made of them.
        observed = observed.persist()
        try:
            late = observed.filter("late").drop("late", "day", "event_time")
            late.write.mode("overwrite").parquet(f"{path}/late/{_BATCH}={batch_id}")
            sums = observed.filter("NOT late").groupBy("day").agg(F.coalesce(F.sum("gross_amount"), F.lit(0)).alias("gross_amount"))
            sums.write.mode("overwrite").parquet(f"{path}/days/{_BATCH}={batch_id}")
        finally:
            observed.unpersist()
        counts = seen.get
        row = [(counts["rows"], counts["late_rows"], counts["latest"], limit)]
        spark.createDataFrame(row, _COUNTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/{_BATCH}={batch_id}")

    writer = timed.writeStream.option("checkpointLocation", checkpoint_path).foreachBatch(write_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_counted_revenue(spark: SparkSession, path: str, target: float) -> DataFrame:
    """Gross sales per day over all batches, without late lines."""
    sums = spark.read.parquet(f"{path}/days").groupBy("day").agg(F.sum("gross_amount").alias("gross_amount"))
    return sums.select("day", "gross_amount", F.lit(float(target)).alias("target"), (F.col("gross_amount") >= target).alias("reached"))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late lines as they came, with the number of their batch."""
    return spark.read.parquet(f"{path}/late")


def batch_counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, rows, late_rows, latest and the watermark that each batch was judged by."""
    return _counts(spark, path).select(_BATCH, "rows", "late_rows", "latest", "watermark")
