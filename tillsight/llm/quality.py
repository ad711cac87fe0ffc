"""Quality classifier for graded ratings: an ordinal cumulative-link regression.

One set of weights over hashed text gives a document's standing; ordered
thresholds cut it into grades: P(grade >= j) = sigmoid(standing - threshold j).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .hashed_text import SparseRows, bucket, chosen_features, labelled_sample, sigmoid
from .storage import Shared, by_place

# Rated documents of each grade that are learned from, at most about so many.
TRAIN_ROWS = 4000
STEPS = 300
RATE = 0.05
RIDGE = 1e-3
SELECT_FROM = 0.5
CACHE = 400_000
RUNS = re.compile(r"(.)\1+", re.S)
DIGIT, LETTER = re.compile(r"\d"), re.compile(r"[^\W\d_]")


def shape(word: str) -> str:
    """A word with letters as a or A, digits as 9, and runs shortened: ``Word!!`` is ``Aa!``."""
    cased = LETTER.sub(lambda c: "A" if c[0].isupper() else "a", word)
    return RUNS.sub(r"\1", DIGIT.sub("9", cased))[:12]


def word_buckets(word: str) -> list[int]:
    return [bucket(f"={word.lower()}"), bucket(f"~{shape(word)}")]


def form_buckets(words: list[str], distinct: int, lines: int) -> list[int]:
    """Buckets of a text's length, of how often it repeats itself and of the length of its lines."""
    n = len(words)
    return [
        bucket(f"#words{int(math.log2(n + 1))}"),
        bucket(f"#distinct{int(10 * distinct / max(1, n))}"),
        bucket(f"#line{int(math.log2(n / max(1, lines) + 1))}"),
    ]


def features(text: str) -> set[int]:
    words = text.split()
    distinct = set(words)
    return {b for w in distinct for b in word_buckets(w)} | set(
        form_buckets(words, len(distinct), text.count("\n") + 1)
    )


@dataclass
class OrdinalModel:
    """Grades are 0 to the number of thresholds."""

    thresholds: np.ndarray
    weights: dict[int, float]  # by bucket

    def tails(self, standing):
        """P(grade >= j) for j from 1 on, one column each."""
        return sigmoid(np.asarray(standing)[:, None] - self.thresholds[None, :])

    def scorer(self):
        """A function from texts to standings that remembers the words it has met."""
        known: dict[str, tuple[int, ...]] = {}

        def standing(text: str | None) -> float:
            words = (text or "").split()
            distinct = set(words)
            found = set(form_buckets(words, len(distinct), (text or "").count("\n") + 1)) & self.weights.keys()
            for word in distinct:
                held = known.get(word)
                if held is None:
                    if len(known) >= CACHE:
                        known.clear()
                    held = known[word] = tuple(b for b in word_buckets(word) if b in self.weights)
                if held:
                    found.update(held)
            return float(sum(sorted(self.weights[b] for b in found)))

        return standing


def optimise(x: SparseRows, y: np.ndarray, grades: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds (ordered, as steps are exponentials) and weights by Adam on all rows, which count by their weight."""
    a = np.ones(len(y)) if weight is None else weight / weight.mean()
    cuts = grades - 1
    share = np.clip([(a * (y >= j)).mean() for j in range(1, grades)], 1e-3, 1 - 1e-3)
    first = -np.log(share / (1 - share))
    steps = np.log(np.maximum(np.diff(first), 1e-2))
    parameters = np.concatenate([first[:1], steps, np.zeros(x.width)])
    mean, square = np.zeros_like(parameters), np.zeros_like(parameters)
    n = len(y)
    for number in range(1, STEPS + 1):
        theta = np.cumsum(np.concatenate([parameters[:1], np.exp(parameters[1:cuts])]))
        w = parameters[cuts:]
        eta = x.times(w)
        edges = np.concatenate([[-np.inf], theta, [np.inf]])
        low, high = sigmoid(eta - edges[y]), sigmoid(eta - edges[y + 1])
        low, high = np.where(y == 0, 1.0, low), np.where(y == cuts, 0.0, high)
        p = np.maximum(low - high, 1e-12)
        at_low, at_high = a * low * (1 - low) / p, a * high * (1 - high) / p
        d_eta = -(at_low - at_high) / n
        d_theta = np.bincount(y, at_low / n, minlength=grades)[1:] - np.bincount(y + 1, at_high / n, minlength=grades + 1)[1:grades]
        d_first = d_theta.sum()
        d_steps = np.array([d_theta[j:].sum() * math.exp(parameters[j]) for j in range(1, cuts)])
        slope = np.concatenate([[d_first], d_steps, x.transposed(d_eta) + RIDGE * w])
        mean = 0.9 * mean + 0.1 * slope
        square = 0.999 * square + 0.001 * slope**2
        parameters -= RATE * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.999**number)) + 1e-8)
    theta = np.cumsum(np.concatenate([parameters[:1], np.exp(parameters[1:cuts])]))
    return theta, parameters[cuts:]


def fit(
    docs: DataFrame,
    ratings: DataFrame,
    grades: int,
    key_col: str = "doc_id",
    text_col: str = "text",
    grade_col: str = "grade",
    train_rows: int = TRAIN_ROWS,
) -> OrdinalModel:
    """A model from rated documents, grades 0 to ``grades`` - 1.

    About ``train_rows`` documents of each grade are learned from, picked by a
    hash of their key and weighted to keep the grades' rates; in smaller tables
    all are.  Other grades, nulls and null
    texts are passed over.  Without ratings every tail probability is 0.5 or
    falls by the grade.
    """
    usable = ratings.where(F.col(grade_col).between(0, grades - 1)).select(
        F.col(key_col).alias("key"), F.col(grade_col).cast("int").alias("label")
    )
    sample = labelled_sample(docs, usable, key_col, text_col, train_rows).cache()
    place = chosen_features(sample, features)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            has = [sorted(place[b] for b in features(text) if b in place) for text in block["text"]]
            yield pd.DataFrame({"label": block["label"], "weight": block["weight"], "has": has})

    table = sample.mapInPandas(rows, "label int, weight double, has array<int>").toPandas()
    sample.unpersist()
    if table.empty:
        return OrdinalModel(np.arange(grades - 1, dtype=np.float64), {})
    x = SparseRows([[(c, 1.0) for c in has] for has in table["has"]], len(place))
    theta, w = optimise(x, table["label"].to_numpy(np.int64), grades, table["weight"].to_numpy())
    return OrdinalModel(theta, {b: float(w[number]) for b, number in place.items()})


def grade(docs: DataFrame, model: OrdinalModel, text_col: str = "text", select_from: float = SELECT_FROM) -> DataFrame:
    """``docs`` with expected_grade, p_at_least_1, p_at_least_2, ... and selected.

    ``selected`` holds where P(grade >= 1) is at least ``select_from``.  Whole
    texts are read; null texts count as empty.  Columns of ``docs`` with the
    new names are replaced, all others are passed on.
    """
    tails = [f"p_at_least_{j + 1}" for j in range(len(model.thresholds))]
    new = [T.StructField(name, T.DoubleType(), False) for name in ("expected_grade", *tails)]
    new.append(T.StructField("selected", T.BooleanType(), False))
    kept = docs.drop(*[f.name for f in new])
    shared = Shared(docs.sparkSession, model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        standing = shared.value.scorer()
        for block in batches:
            p = shared.value.tails([standing(text) for text in block.column(at).to_pylist()])
            made = [pa.array(p.sum(axis=1)), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, 0] >= select_from)]
            yield pa.RecordBatch.from_arrays([*block.columns, *made], [*block.schema.names, *(f.name for f in new)])

    held = by_place(kept)
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *new])).toDF(*kept.columns, *[f.name for f in new])
