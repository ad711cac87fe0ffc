"""Intermediate tables in the shared folder that the session names."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from ..session import drop_path, new_shared_path

# Rows of texts that a task works on at a time.
BATCH_ROWS = 512


class Scratch:
    """One folder of an operator's run, below ``spark.checkpoint.dir``.

    Tables written here survive lost executors and cut the lineage.  Those that
    the returned frame doesn't read are dropped by the operator itself; the
    folder as a whole can be dropped by ``clear`` once the result is stored.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = new_shared_path(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        drop_path(self.spark, f"{self.path}/{name}")

    def clear(self) -> None:
        drop_path(self.spark, self.path)


class Shared:
    """An object that is sent to every executor once.

    It travels with the code of its class, so workers need no installed copy of
    this package; a task unpacks it when it first asks for it.
    """

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self._packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self) -> dict:
        return {"_packed": self._packed}

    @property
    def value(self) -> Any:
        if "_value" not in self.__dict__:
            self._value = cloudpickle.loads(self._packed.value)
        return self._value

    def destroy(self) -> None:
        self._packed.destroy()


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that few texts are held as Python objects at a time."""
    for block in batches:
        for start in range(0, block.num_rows, rows):
            yield block.slice(start, rows)


def by_place(df: DataFrame) -> DataFrame:
    """``df`` with its columns named by their place, so that Arrow batches can be made of columns of any name."""
    return df.toDF(*[f"c{place}" for place in range(len(df.columns))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
