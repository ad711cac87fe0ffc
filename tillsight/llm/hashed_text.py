"""What classifiers over hashed text share: labelled samples, features, sparse rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 22
MAX_FEATURES = 4000
LEAST_ROWS = 3
LEAST_EVIDENCE = 4.0
DRAWS = 1 << 30


def bucket(key: str) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % BUCKETS


def labelled_sample(
    docs: DataFrame, labels: DataFrame, key_col: str, text_col: str, most: int
) -> DataFrame:
    """label, text and weight of about ``most`` labelled documents of each label.

    ``labels`` has key and label.  Rows are picked by a hash of their key; in
    smaller tables all are taken.  Null texts are passed over.  The sample is
    bounded by ``most``, so its keys can be sent to every executor.  The weight is
    1 / the share of the label's rows that are taken, so that weighted sums keep
    the labels' rates of the whole table.
    """
    numbers = {row["label"]: row["count"] for row in labels.groupBy("label").count().collect()}
    texts = docs.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    shares = [part for label, n in numbers.items() for part in (F.lit(label), F.lit(min(1.0, most / n)))]
    share = F.create_map(*shares)[F.col("label")] if shares else F.lit(1.0)
    taken = labels.where(F.pmod(F.xxhash64("key"), F.lit(DRAWS)) < share * float(DRAWS))
    return texts.join(F.broadcast(taken.withColumn("weight", 1 / share)), "key").select("label", "text", "weight")


def chosen_features(sample: DataFrame, features: Callable[[str], Iterable[int]]) -> dict[int, int]:
    """Column numbers of the buckets whose presence says most about the label.

    ``sample`` has a numeric label and a weight.  Evidence is the distance of the
    weighted mean label of the rows that have the feature from that of all, in
    standard errors.
    """

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            for label, text, weight in zip(block["label"], block["text"], block["weight"], strict=True):
                yield pd.DataFrame({"label": label, "bucket": list(features(text)), "weight": weight})

    w, y = F.col("weight"), F.col("label")
    weight, total, squares = sample.agg(F.sum("weight"), F.sum(w * y), F.sum(w * y * y)).first()
    if not weight:
        return {}
    mean = total / weight
    variance = squares / weight - mean * mean
    if variance <= 1e-12:
        return {}
    counts = (
        sample.mapInPandas(present, "label int, bucket int, weight double")
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.sum(w * w).alias("squares"), F.sum(w * y).alias("total"))
        .where(F.col("n") >= LEAST_ROWS)
    )
    evidence = F.abs(F.col("total") - mean * F.col("weight")) / F.sqrt(variance * F.col("squares"))
    best = counts.select("bucket", evidence.alias("z")).where(F.col("z") >= LEAST_EVIDENCE)
    chosen = sorted(row["bucket"] for row in best.orderBy(F.desc("z"), "bucket").limit(MAX_FEATURES).collect())
    return {b: number for number, b in enumerate(chosen)}


class SparseRows:
    """Rows of a few numbers each."""

    def __init__(self, rows: list[list[tuple[int, float]]], width: int) -> None:
        self.row = np.array([i for i, r in enumerate(rows) for _ in r], np.int64)
        self.column = np.array([c for r in rows for c, _ in r], np.int64)
        self.value = np.array([v for r in rows for _, v in r], np.float64)
        self.height, self.width = len(rows), width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.height)

    def transposed(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], minlength=self.width)

    def norm(self) -> float:
        """A bound of the largest squared singular value."""
        if not self.value.size:
            return 0.0
        size = np.abs(self.value)
        return float(np.bincount(self.row, size).max() * np.bincount(self.column, size).max())


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0)))
