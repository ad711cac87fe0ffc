"""Toxicity classifier that doesn't change its mind when a group's name is swapped.

A logistic regression over hashed words and word beginnings.  Sentences of the
labelled texts that name a group are paired with the same sentence naming
another group; the training penalises differences between the scores of the
two, so that the mere mention of a group carries no weight.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .hashed_text import SparseRows, bucket, chosen_features, labelled_sample, sigmoid
from .storage import Shared, by_place

# Labelled rows of either class that are learned from, at most about so many.
TRAIN_ROWS = 6000
PREFIXES = (4, 5, 6)
LASSO = 2e-4
RIDGE = 1e-4
COUNTERFACTUAL = 1.0
STEPS = 400
CACHE = 400_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")
# Names of groups that stand for each other, by kind.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("men", "women"),
    ("man", "woman"),
    ("male", "female"),
    ("boys", "girls"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("young", "old"),
    ("immigrants", "natives", "refugees"),
)
OUTPUT = [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)]


def buckets_of(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    keys = [f"={word}"] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return [bucket(key) for key in keys]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(text: str) -> set[int]:
    return {b for word in words_of(text) for b in buckets_of(word)}


def swaps(terms: Sequence[Sequence[str]]) -> dict[str, str]:
    """Each term to the next one of its kind."""
    return {a: b for kind in terms for a, b in zip(kind, [*kind[1:], kind[0]], strict=True)}


def counterfactuals(text: str, swap: dict[str, str]) -> Iterator[tuple[set[int], set[int]]]:
    """Features that a swap removes from and adds to each sentence that names a group."""
    for sentence in SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        if any(word in swap for word in words):
            before = {b for w in words for b in buckets_of(w)}
            after = {b for w in words for b in buckets_of(swap.get(w, w))}
            yield before - after, after - before


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float]  # by bucket

    def scorer(self):
        """A function from texts to scores that remembers the words it has met."""
        known: dict[str, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            found: set[int] = set()
            for word in words_of(text or ""):
                held = known.get(word)
                if held is None:
                    if len(known) >= CACHE:
                        known.clear()
                    held = known[word] = tuple(b for b in buckets_of(word) if b in self.weights)
                if held:
                    found.update(held)
            total = self.bias + sum(sorted(self.weights[b] for b in found))
            return float(sigmoid(total))

        return score


def optimise(
    x: SparseRows, y: np.ndarray, pairs: SparseRows, counterfactual: float = COUNTERFACTUAL, weight: np.ndarray | None = None
) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient steps; the bias isn't shrunk.  Rows count by their weight, or all the same."""
    n, m = len(y), max(1, pairs.height)
    a = np.ones(n) if weight is None else weight / weight.mean()
    step = 1.0 / (0.25 * a.max() * (x.norm() + n) / n + 2 * counterfactual * pairs.norm() / m + RIDGE)
    # A few dominant directions make that bound pessimistic; longer steps are
    # taken as long as the loss falls.
    rate = np.clip((a * y).mean(), 1e-4, 1 - 1e-4)
    bias, w = float(np.log(rate / (1 - rate))), np.zeros(x.width)

    def smooth(b: float, v: np.ndarray) -> tuple[float, float, np.ndarray]:
        logits = b + x.times(v)
        p = sigmoid(logits)
        gap = pairs.times(v)
        loss = (a * np.logaddexp(0, logits)).mean() - (a * y * logits).mean()
        loss += counterfactual * (gap @ gap) / m + RIDGE / 2 * (v @ v)
        slope = x.transposed(a * (p - y) / n) + 2 * counterfactual * pairs.transposed(gap) / m + RIDGE * v
        return float(loss), float((a * (p - y)).mean()), slope

    vb, v, momentum, step = bias, w.copy(), 1.0, step * 64
    for _ in range(STEPS):
        loss, db, dv = smooth(vb, v)
        while True:
            nb = vb - step * db
            nw = v - step * dv
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * LASSO, 0.0)
            move = nw - v
            bound = loss + db * (nb - vb) + dv @ move + ((nb - vb) ** 2 + move @ move) / (2 * step)
            if smooth(nb, nw)[0] <= bound + 1e-12 or step < 1e-8:
                break
            step /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / following
        vb, v = nb + pull * (nb - bias), nw + pull * (nw - w)
        bias, w, momentum = nb, nw, following
    return bias, w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    train_rows: int = TRAIN_ROWS,
    counterfactual: float = COUNTERFACTUAL,
) -> ToxicityModel:
    """A model from labelled documents.

    About ``train_rows`` rows of either class are learned from, picked by a
    hash of their key and weighted to keep the classes' rates; in smaller tables
    all are.  Labels other than 0 and 1
    and null texts are passed over.  If only one class is left, or none, the
    score is that class's rate (0.5 if there is no row).
    """
    swap = swaps(terms)
    usable = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(key_col).alias("key"), F.col(label_col).cast("int").alias("label")
    )
    sample = labelled_sample(docs, usable, key_col, text_col, train_rows).cache()
    held = {row["label"]: row["count"] for row in sample.groupBy("label").count().collect()}
    if len(held) < 2:
        sample.unpersist()
        rate = (held.get(1, 0) + 0.5) / (sum(held.values()) + 1)
        return ToxicityModel(float(np.log(rate / (1 - rate))), {})
    place = chosen_features(sample, features)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in batches:
            out = []
            for label, text, weight in zip(block["label"], block["text"], block["weight"], strict=True):
                out.append((label, weight, sorted(place[b] for b in features(text) if b in place), None))
                for gone, come in counterfactuals(text, swap):
                    gone, come = ([place[b] for b in side if b in place] for side in (gone, come))
                    if gone or come:
                        out.append((label, weight, sorted(gone), sorted(come)))
            yield pd.DataFrame(out, columns=["label", "weight", "has", "instead"])

    table = sample.mapInPandas(rows, "label int, weight double, has array<int>, instead array<int>").toPandas()
    sample.unpersist()
    alone = table["instead"].isna()
    x = SparseRows([[(c, 1.0) for c in has] for has in table["has"][alone]], len(place))
    # The penalty takes squares, so a pair's row holds the root of its weight.
    root = np.sqrt(table["weight"][~alone] / table["weight"][~alone].mean())
    pairs = SparseRows(
        [
            [(c, r) for c in has] + [(c, -r) for c in instead]
            for has, instead, r in zip(table["has"][~alone], table["instead"][~alone], root, strict=True)
        ],
        len(place),
    )
    bias, w = optimise(x, table["label"][alone].to_numpy(np.float64), pairs, counterfactual, table["weight"][alone].to_numpy())
    return ToxicityModel(bias, {b: float(w[number]) for b, number in place.items() if w[number]})


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on).

    Whole texts are read; each feature counts once, however often it occurs.
    A null or empty text gets the score of no features.  Columns of ``docs``
    with the new names are replaced, all others are passed on.
    """
    kept = docs.drop(*[f.name for f in OUTPUT])
    shared = Shared(docs.sparkSession, model)
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for block in batches:
            found = [scorer(text) for text in block.column(at).to_pylist()]
            new = [pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([*block.columns, *new], [*block.schema.names, *(f.name for f in OUTPUT)])

    held = by_place(kept)
    return held.mapInArrow(run, T.StructType([*held.schema.fields, *OUTPUT])).toDF(*kept.columns, *[f.name for f in OUTPUT])
