"""The moment a day's sales reach a target, as alerts of a stream.

Amounts are first summed per time stamp in Spark's own windowless aggregation,
spread over all tasks.  It hands a stamp on once the watermark has passed it, so
what comes after it in later batches is later in time as well.  A state per day
then holds no more than the running total and the moment found so far; a timer
at the day's end reports the whole day and drops the state.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from .daily_revenue import WATERMARK, as_utc

# The processor travels with its tasks, so workers need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Amounts have four decimals; the state counts in whole units of the last one.
UNITS = 10_000
_OUTPUT = "day date, closed boolean, units long, reached boolean, first_reached timestamp"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY = dt.timedelta(days=1)
_EPOCH = dt.datetime(1970, 1, 1)


class DayTotals(StatefulProcessor):
    """Follows one day: an alert when its running total first reaches the target, a report when it is over."""

    def __init__(self, target_units: int) -> None:
        self.target_units = target_units

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("day", "units long, first_reached timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = key[0]
        # A row for each time stamp of the day that the last batch has closed.
        stamps = pd.concat(list(rows)).sort_values("event_time")
        if self.state.exists():
            units, moment = self.state.get()
        else:
            units, moment = 0, None
            self.handle.registerTimer(_millis(_EPOCH + dt.timedelta(days=(day - _EPOCH.date()).days) + _DAY))
        units, moment = int(units), None if pd.isna(moment) else moment
        totals = units + stamps["units"].cumsum()
        reached = totals >= self.target_units
        fresh = moment is None and bool(reached.any())
        if fresh:
            moment = stamps["event_time"][reached].iloc[0].to_pydatetime()
        units = int(totals.iloc[-1])
        self.state.update((units, moment))
        if fresh:
            yield _row(day, False, int(totals[reached].iloc[0]), True, moment)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        units, moment = self.state.get()
        self.state.clear()
        yield _row(key[0], True, int(units), int(units) >= self.target_units, None if pd.isna(moment) else moment)

    def close(self) -> None:
        pass


def _millis(moment: dt.datetime) -> int:
    return int((moment - _EPOCH).total_seconds() * 1000)


def _row(*values) -> pd.DataFrame:
    names = ("day", "closed", "units", "reached", "first_reached")
    frame = pd.DataFrame({name: [value] for name, value in zip(names, values, strict=True)})
    return frame.astype({"first_reached": "datetime64[us]"})


def first_reached(sales: DataFrame, target: float, watermark: str = WATERMARK) -> DataFrame:
    """Alerts and reports of a stream's days: day, closed, gross_amount, target, reached, first_reached.

    An alert (``closed`` false) holds the total at the first time stamp at which
    the running total reached the target.  The report of a day (``closed`` true)
    holds its whole total, and whether that reaches it.  Both come once the
    watermark has passed what they speak of; rows behind it are dropped.
    Lines without a time don't count, and a null amount counts as 0.
    """
    units = (F.coalesce(F.sum("gross_amount"), F.lit(0)) * UNITS).cast("bigint")
    stamps = (
        sales.withColumn("event_time", as_utc())
        .withWatermark("event_time", watermark)
        .groupBy("event_time")
        .agg(units.alias("units"))
        .withColumn("day", F.date_from_unix_date(F.floor(F.unix_seconds("event_time") / 86400).cast("int")))
    )
    target_units = round(target * UNITS)
    followed = stamps.groupBy("day").transformWithStateInPandas(
        DayTotals(target_units), outputStructType=_OUTPUT, outputMode="Append", timeMode="EventTime"
    )
    return followed.select(
        "day",
        "closed",
        (F.col("units").cast("decimal(28,4)") / UNITS).cast("decimal(28,4)").alias("gross_amount"),
        F.lit(float(target)).alias("target"),
        "reached",
        F.to_utc_timestamp("first_reached", F.current_timezone()).cast("timestamp_ntz").alias("first_reached"),
    )


@contextmanager
def _rocks_db(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for the queries started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS_DB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def start_first_reached(alerts: DataFrame, table_path: str, checkpoint_path: str, available_now: bool = False) -> StreamingQuery:
    """Writes each micro-batch's alerts and reports under its batch number; a repeated batch overwrites its own."""

    def write_batch(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{table_path}/batch={batch_id}")

    writer = alerts.writeStream.outputMode("append").option("checkpointLocation", checkpoint_path).foreachBatch(write_batch)
    if available_now:
        writer = writer.trigger(availableNow=True)
    with _rocks_db(alerts.sparkSession):
        return writer.start()


def read_closed_days(spark: SparkSession, table_path: str) -> DataFrame:
    """The reports of the days that are over."""
    return spark.read.parquet(table_path).filter("closed").drop("closed", "batch")
