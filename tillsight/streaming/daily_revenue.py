"""Daily revenue against a target, kept up to date from a stream of sales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

WATERMARK = "1 day"
_VERSION = "batch"


def as_utc() -> Column:
    """A sale's time as the zoned time that watermarks need.

    Day windows start at midnight UTC, so the wall-clock time is read as UTC,
    whatever zone the session is in.
    """
    wall_clock = F.col("timestamp").cast("timestamp_ntz").cast("timestamp")
    return F.from_utc_timestamp(wall_clock, F.current_timezone())


def stream_daily_revenue(sales: DataFrame, target: float, watermark: str = WATERMARK) -> DataFrame:
    """Gross sales per day of a stream; rows behind the watermark are dropped.

    ``late_rows`` keeps and counts them instead.
    """
    return (
        sales.withColumn("event_time", as_utc())
        .withWatermark("event_time", watermark)
        .groupBy(F.window("event_time", "1 day").alias("w"))
        .agg(F.coalesce(F.sum("gross_amount"), F.lit(0)).alias("gross_amount"))
        .select(
            F.date_from_unix_date(F.floor(F.unix_seconds("w.start") / 86400).cast("int")).alias("day"),
            "gross_amount",
            F.lit(float(target)).alias("target"),
            (F.col("gross_amount") >= target).alias("reached"),
        )
    )


def start_daily_revenue(
    daily: DataFrame, table_path: str, checkpoint_path: str, available_now: bool = False
) -> StreamingQuery:
    """Write each micro-batch's changed days under its batch number.

    A batch that is repeated after a failure overwrites its own folder, so
    the table holds every change exactly once.
    """

    def write_batch(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table_path}/{_VERSION}={batch_id}")

    writer = (
        daily.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint_path)
        .foreachBatch(write_batch)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_daily_revenue(spark: SparkSession, table_path: str, upto: int | None = None) -> DataFrame:
    """The latest state of every day, of all batches or those up to a number."""
    changes = spark.read.parquet(table_path)
    if upto is not None:
        changes = changes.filter(F.col(_VERSION) <= upto)
    values = [c for c in changes.columns if c not in ("day", _VERSION)]
    return (
        changes.groupBy("day")
        .agg(F.max_by(F.struct(*values), _VERSION).alias("latest"))
        .select("day", "latest.*")
    )


def compact_daily_revenue(spark: SparkSession, table_path: str) -> None:
    """Fold all batches but the newest into one, so that the folders stay few.

    The newest batch may still be repeated after a failure and is left alone.
    The fold takes the number of the last batch in it; older folders hold
    nothing newer than it, so a reader or a crash between the steps sees the
    same days.  A fold that was cut short is finished by the next call.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    files = jvm_path(table_path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside = jvm_path(f"{table_path}/_folding")

    def batches(folder) -> list[int]:
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{_VERSION}="))

    def swap_in(number: int) -> None:
        target = jvm_path(f"{table_path}/{_VERSION}={number}")
        files.delete(target, True)
        files.rename(jvm_path(f"{table_path}/_folding/{_VERSION}={number}"), target)
        files.delete(aside, True)
        for older in batches(jvm_path(table_path)):
            if older < number:
                files.delete(jvm_path(f"{table_path}/{_VERSION}={older}"), True)

    for number in batches(aside):
        if files.exists(jvm_path(f"{table_path}/_folding/{_VERSION}={number}/_SUCCESS")):
            swap_in(number)
    closed = batches(jvm_path(table_path))[:-1]
    if len(closed) < 2:
        return
    kept = read_daily_revenue(spark, table_path, upto=closed[-1])
    kept.write.mode("overwrite").parquet(f"{table_path}/_folding/{_VERSION}={closed[-1]}")
    swap_in(closed[-1])
